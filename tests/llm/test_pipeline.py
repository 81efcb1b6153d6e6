"""The pipeline's stages, each held against a brute-force version over its own input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from codelode.llm import _kernel as K, jaccard, quality
from codelode.llm._store import written
from tests.llm.test_corpus import brute_leaks, check_pieces, shingles
from tests.llm.test_maps import base_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with junk, copies, near copies, boilerplate and leaks, as the driver lays it out."""
    rng = random.Random(17)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocabulary = [a + b for a in ("the", "riv", "sto", "lig", "wat", "gre", "slo", "hou") for b in ("er", "ne", "ht", "en", "w", "se", "in", "al")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, prose(30)) for k in range(6)]
    rows, labels = [], []
    for k in range(240):
        kind = k % 8
        if kind == 0:
            text = " | ".join(rng.choices(["BUY", "%%%", "WIN$$", "click***"], k=50))
        elif kind == 1 and k > 8:
            text = rows[k - 7][1]
        elif kind == 2 and k > 8:
            words = rows[k - 7][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{prose(60)}\n{items[k % 6][1].upper()}, {prose(20)}"
        elif kind == 4:
            text = f"posted by user {rng.choice(['ann', 'bob', 'kim'])} under the old site rules\n{prose(80)}"
        else:
            text = prose(rng.randint(40, 150))
        rows.append((k, text, "en", "src", len(text)))
        if k % 2 == 0 or kind == 5:
            labels.append((k, 0 if kind == 0 else 1, 0))
    rows += [(500, None, "en", "src", 0), (501, "", None, None, None), (9, rows[9][1], "en", "src", 1), (None, prose(50), "de", "x", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def brute_lines(rows):
    """The rows of documents after the line stage, by its rule, with plain loops."""
    docs = {(i, t or "", hashlib.md5((t or "").encode()).hexdigest()[:15]) for i, t in rows}
    places = {}
    for i, t, digest in docs:
        for k, line in enumerate(t.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(tokens) >= 3:
                places.setdefault(tokens, []).append((i is not None, i or 0, digest, k))
    held = {s: len({p[:3] for p in own}) for s, own in places.items()}
    support = Counter()
    for s, n in held.items():
        support.update({(len(s), s[:3], k, w): n for k, w in enumerate(s) if w != "<*>"})
    groups, least = {}, lambda s: 2 if len(s) > 50 else 3
    for s in held:
        own = [support[len(s), s[:3], k, w] for k, w in enumerate(s)]
        of_line = sorted(own, reverse=True)[(70 * len(s) + 99) // 100 - 1]
        if of_line >= 3:
            groups.setdefault((s[:3], of_line, tuple(w if 2 * n > of_line else "<*>" for w, n in zip(s, own, strict=True))), []).append(s)
    lost, general = set(), set()
    for (_, of_line, template), own in groups.items():
        every = [p for s in own for p in places[s]]
        if 100 * sum(held[s] for s in own) >= of_line and len({p[:3] for p in every}) >= 3:
            general |= set(own)
            lost |= set(every) - {min(every)}
    for s in set(held) - general:
        if held[s] >= least(s):
            lost |= set(places[s]) - {min(places[s])}
    gone = {}
    for known, i, digest, k in lost:
        gone.setdefault((known, i, digest), set()).add(k)
    out = []
    for i, t in rows:
        drop = gone.get((i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest()[:15]))
        if drop:
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
        if not drop or re.search(r"[^\x20\x09-\x0D]", t):
            out.append((i, t))
    return out


def brute_scores(rows, model):
    """The score and the harm of each text from the model's ratios, word by word."""
    bucket = lambda h, n: int(h) >> 64 - (n.bit_length() - 1)
    out = []
    for _, t in rows:
        raw = (t or "").encode()
        tokens = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", raw)]
        one = [int(K.word_hashes([w])[0]) for w in tokens]
        two = [int(K.grams(np.array(pair, np.uint64), 2)[0]) for pair in zip(one, one[1:], strict=False)]
        ratios = [int(model.ratios[bucket(h, quality.BUCKETS)]) for h in one + two]
        harm = sorted(int(model.harm_ratios[b]) for b in {bucket(K.word_hashes([w.lower()])[0], quality.HARM_BUCKETS) for w in tokens}) if model.harm_ratios is not None else []
        out.append((sum(ratios) / max(1, len(ratios)) / quality.SCALE, sum([x for x in harm if x < 0][: quality.WORST]) / quality.WORST / quality.SCALE))
    return out


def test_quality_verdicts_against_brute_force(spark, tables):
    folder, _ = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marked = labels.withColumn("toxic", (labels["doc_id"] % 8 == 6).cast("int"))  # prose that passes the base rules
    model = quality.fit(docs, marked)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for (i, t), (score, harm) in zip(rows, brute_scores(rows, model), strict=True):
        kept = not base_of(t)[-1] and (model.threshold is None or score >= model.threshold) and (model.harm_threshold is None or harm >= model.harm_threshold)
        want.append(repr((i, kept, round(score, 9))))
    got = quality.judge(docs, model).collect()
    assert model.threshold is not None and sorted(repr((r["doc_id"], r["kept"], round(r["score"], 9))) for r in got) == sorted(want)
    assert sorted(str(r["doc_id"]) for r in quality.keep(docs, model).collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_stages(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        columns = docs.columns
        docs = written(stage(spark, docs, folder), f"test-{name}")
        after = [tuple(r) for r in docs.collect()]
        kept[name] = len(after)
        if name != "packing":
            assert docs.columns == columns
        pairs = [(r[0], r[1]) for r in after]
        if name == "quality":
            assert not any(base_of(t)[-1] for _, t in pairs) and not any("%%%" in t or "BUY" in t for _, t in pairs)
            assert set(after) <= set(before) and sum("|" not in (r[1] or "|") and not base_of(r[1])[-1] for r in before) - len(after) <= 2
        if name == "lines":
            assert all(r[4] == len(r[1]) for r in after)
            assert sum("under the old site rules" in t for _, t in pairs) == 1  # the first line of the template
            assert sorted(map(repr, ((r[0], r[1]) for r in after))) == sorted(map(repr, brute_lines([(r[0], r[1]) for r in before])))
        if name == "near_duplicates":
            assert set(after) <= set(before)
            sets = [shingles(t) for _, t in pairs]
            assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a))
            gone = [r for r in before if r not in after]
            assert all(any(100 * len(shingles(r[1]) & shingles(o[1])) >= 80 * len(shingles(r[1]) | shingles(o[1])) for o in before if o is not r) for r in gone)
        if name == "decontamination":
            leaky = {i for i, _, _ in brute_leaks([(r[0], r[1]) for r in before], items)}
            assert leaky and sorted(str(r[0]) for r in after) == sorted(str(r[0]) for r in before if r[0] not in leaky)
        if name == "packing":
            check_pieces([(r[0], r[1]) for r in before], docs.collect())
    assert kept["quality"] >= kept["lines"] > kept["near_duplicates"] > kept["decontamination"] > 0


def test_run_is_the_stages_in_a_row(spark, tables):
    folder, _ = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_stage_needs_more_than_its_columns(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert quality.keep(docs, model).columns == ["doc_id", "text"] and re.match("doc_id", quality.judge(docs, model).columns[0])


def test_near_duplicates_ties_no_unlike_documents_of_six_gigabytes():
    """What lines leave of 6 GB has about a billion shingles; passages of 60 documents are not among the first of each of these."""
    rng = np.random.default_rng(6)
    counts = rng.poisson(1.05e9 / jaccard.SKETCH, jaccard.SKETCH)
    passages = rng.integers(0, 1 << 64, (20, 40), np.uint64)
    np.add.at(counts, (passages.ravel() >> np.uint64(65 - jaccard.SKETCH.bit_length())).astype(np.int64), 60)
    ranks = jaccard._order(counts)
    for passage in passages:
        keys = [jaccard._keys(np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 400, np.uint64)])), ranks) for _ in range(60)]
        first = Counter(np.concatenate(keys).tolist())
        assert max(first.values()) <= jaccard.LISTED
