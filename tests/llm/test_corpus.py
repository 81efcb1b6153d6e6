"""Operators over the corpus: line dedup, packing, the Jaccard join, substrings, decontamination."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codelode.llm import _graph, _join, decontam, jaccard, line_dedup, packing, substring
from codelode.llm._store import prepare

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ("lost", "gone", "line", "leaf", "text_hash", "sig", "spans")


@pytest.fixture
def frame(spark):
    prepare(spark)

    def make(rows):
        schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
        return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], schema)

    return make


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_texts(seed, n=60):
    """Texts with copies, near copies, shared passages, short ones, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)] + ["été", "The", "a", "über"]
    prose = lambda m: " ".join(rng.choices(vocabulary, k=m))
    passage, rows = prose(60), []
    for k in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            text = rng.choice([t for _, t in rows if t] or [prose(9)])
            if kind < 0.2:
                words = text.split(" ")
                for _ in range(rng.randint(1, 4)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                text = " ".join(words)
        elif kind < 0.45:
            text = prose(rng.randint(1, 40)) + "\n" + passage + " " + prose(rng.randint(0, 30))
        else:
            text = prose(rng.choice([0, 1, 3, 4, 5, 6, 30, 120, 300]))
        rows.append((k, text))
    return rows + [(1000, None), (1001, ""), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, "alone and without an id here")]


# Line dedup


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_sql(spark, frame, seed):
    rng = random.Random(seed)
    forms = ["page {} of the old book", "posted on {} by {} in news", "the same line in many texts", "x  y\tz {}", "short", "", "   ", "all rights are kept by {} here today", "Ünï line with {} words in it"]
    def line():
        return rng.choice(forms).format(rng.choice([1, 22, "a7", "ann", "bob", "cy"]), rng.choice(["ann", "bob", "kim", "zoe", "eve", 9]))
    rows = [(k, "\n".join(line() for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(None, "page 1 of the old book"), (200, None), (201, ""), (3, "page 2 of the old book"), (202, "word " * 20_000 + "\nthe same line in many texts")]
    rows += [rows[4], rows[5], (7, "posted on 1 by one hand in news"), (7, "\n".join(["posted on 1 by one hand in news", "x y z 9"])), (7, "posted on 1 by one hand in news")]
    got = sorted(map(repr, map(tuple, line_dedup.scan(frame(rows)).collect())))
    docs = frame(rows).select("doc_id", "text").toPandas()  # noqa: F841
    c = duckdb.connect()
    c.execute("create table docs_in(doc_id bigint, text varchar)")
    c.executemany("insert into docs_in values (?, ?)", rows)
    want = sorted(map(repr, c.execute(line_dedup.SQL.format(docs="docs_in")).fetchall()))
    assert got == want


def test_lines_generalise_fields_and_keep_the_first(frame):
    own = ["green hills far away", "a cat sat on some mat", "rain fell all night long then", "seven ships went out to sea", "no news is what they call good"]
    rows = [(k, f"{own[k]}\nreported by user {n} about the broken red door") for k, n in enumerate(["ann", "bob", "cyd", "dan", "eve"])]
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.clean(frame(rows)).collect()}
    assert len(out[0]) == 2 and all(len(out[k]) == 1 for k in range(1, 5))
    cleaned = line_dedup.clean(frame(rows), drop_emptied=True)
    assert cleaned.columns == ["doc_id", "text", *EXTRA] and cleaned.count() == 5
    same = [(k, "one line that is all there is") for k in range(4)] + [(9, ""), (10, None)]
    assert {r["doc_id"] for r in line_dedup.clean(frame(same), drop_emptied=True).collect()} == {0, 9, 10}
    assert line_dedup.scan(frame([])).count() == 0 and line_dedup.clean(frame([])).count() == 0


@pytest.mark.parametrize(("n", "values"), [(30, 12), (200, 12), (200, 400), (3000, 12), (3000, 40)])
def test_lines_merge_fields_at_any_size(frame, n, values):
    """A template goes but for its first line, whether its fields' values recur or not; text of one's own stays."""
    rng = random.Random(n + values)
    name = lambda: "n" + "".join("bcdfghklmnpqrstvwxyz"[int(c)] for c in str(rng.randrange(values)))
    own = lambda: " ".join("%x" % rng.randrange(10**9) for _ in range(5)).translate(str.maketrans("0123456789", "ghijklmnop"))
    rows = [(k, f"reported by user {name()} about the broken red door seen near {name()} today by staff\n{own()}") for k in range(n)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean(frame([*rows, (None, rows[0][1] + " and more")])).collect()}
    assert [k for k, t in out.items() if "reported by user" in t] == [None]  # a null id comes first
    assert all(out[k].endswith(t.split("\n")[1]) for k, t in rows)


def test_templates_of_one_leaf_are_told_apart(frame):
    """A rare template beside a frequent one recurs by itself; frequent words alone are no template."""
    rng = random.Random(8)
    rows = [(k, f"posted by user n{'abcdefgh'[k % 8]}x from the old site rules page") for k in range(400)]
    rows += [(1000 + k, f"posted by user q{'abcdefgh'[k % 8]}x with no other words here now") for k in range(12)]
    rows += [(2000 + k, "posted by user " + " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], k=7))) for k in range(300)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean(frame(rows)).collect()}
    assert sum("old site" in t for t in out.values()) == 1 and sum("no other" in t for t in out.values()) == 1
    assert sum(bool(out[k]) for k, _ in rows[412:]) >= 290


def test_lines_without_sending_and_with_hot_keys(frame, monkeypatch):
    rows = [(k, f"reported by user {'abcdef'[k % 6]} about the broken red door\nthe very same line\n" + "w%x " % k) for k in range(60)]
    want = sorted(map(tuple, line_dedup.scan(frame(rows)).collect()))
    monkeypatch.setattr(_join, "SENT_ROWS", 0)
    for hot in (10**6, 20):
        monkeypatch.setattr(_join, "HOT_ROWS", hot)
        assert sorted(map(tuple, line_dedup.scan(frame(rows)).collect())) == want and sum(r[2] for r in want) == 2 * 59


def test_long_lines_go_from_two_documents_on(frame):
    passage, short = (" ".join(f"{c}{a}{b}" for c in x for a in "bcdfgh" for b in "aeiouy") for x in ("kl", "m"))
    rows = [(1, f"one text of its own\n{passage}"), (2, f"quite another text here\n{passage}"), (3, f"third is this one\n{short}"), (4, f"and a fourth\n{short}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean(frame(rows)).collect()}
    assert out == {1: rows[0][1], 2: "quite another text here", 3: rows[2][1], 4: rows[3][1]}


# Packing


def check_pieces(rows, pieces):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER)
    ids = Counter()
    known = {}
    for i, t in rows:
        own = tuple([*encode.encode(t or "", add_special_tokens=False).ids, 2])
        ids[(i, len(own))] += 1
        known.setdefault((i, len(own)), []).append(own)
    covered = Counter()
    for p in pieces:
        key = (p["doc_id"], p["doc_tokens"])
        raw = [zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for own in known[key]]
        assert p["length"] > 0 and p["ids_crc32"] in raw
        covered.update((key, k) for k in range(p["start"], p["start"] + p["length"]))
    assert covered == Counter({(key, k): n for key, n in ids.items() for k in range(key[1])})
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    sizes = []
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        sizes.append(at)
    return sizes


def test_packing_round_trip(frame):
    rows = [(k, t) for k, t in some_texts(4)] + [(70, "it's <|endoftext|> or <|ENDOFTEXT|>, don't--“q”… 3.14"), (71, "word " * 9000), (72, "x" * 3000), (73, "é́ ĵ漢字, 🎉 it's\x85a\x1cb\x00"), (74, "a b " * 2047)]
    sizes = check_pieces(rows, packing.pack_documents(frame(rows), TOKENIZER).collect())
    assert sum(s > packing.WINDOW - 4 * packing.STEP for s in sizes) >= len(sizes) - 3
    assert packing.pack_documents(frame([]), TOKENIZER).count() == 0


def test_packing_pads_little():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.5, 0.9, 4000).astype(int) + 1, packing.WINDOW - 1)
    sequences = packing.pack(lengths)
    cover = {}
    for row in sequences:
        assert sum(n for _, _, n in row) <= packing.WINDOW
        for d, start, n in row:
            cover.setdefault(d, []).append((start, n))
    for d, own in cover.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[d]
    assert len(cover) == len(lengths)
    assert (len(sequences) * packing.WINDOW - lengths.sum()) / lengths.sum() < 0.01
    assert packing.pack(np.array([], int)) == [] and packing.pack(np.array([5])) == [[(0, 0, 5)]]


@pytest.mark.parametrize(("median", "n"), [(8, 60_000), (55, 12_000), (148, 12_000), (665, 4_000)])
def test_packing_plans_short_lengths_too(median, n):
    lengths = np.minimum(np.random.default_rng(median).lognormal(np.log(median), 0.9, n).astype(int) + 1, packing.WINDOW - 1)
    planned, left = packing.plan(lengths)
    assert sorted([d for own in planned for d in own] + left) == list(range(n))
    assert all(packing.WINDOW - 16 * packing.DEPTH < lengths[own].sum() <= packing.WINDOW for own in planned)
    sequences = packing.pack(lengths)
    assert len(planned) >= 0.8 * len(sequences) and (len(sequences) - 1) * packing.WINDOW < 1.01 * lengths.sum()


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"Ab": 5, "ab": 6, "?": 7}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    texts = ["Ab ab x", "", None, "ab"]
    tokens = packing.Tokens(str(tmp_path / "other.json"))
    got = [ids[a:b].tolist() for _, _, ids, offs in tokens.encode(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert not tokens.by_pieces and packing.Tokens(TOKENIZER).by_pieces and got == [[5, 6, 7, 2], [2], [2], [6, 2]]


def test_nnls_and_checksums():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((8, 14)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope[x > 1e-9]).max(initial=0) < 1e-6  # the conditions of an optimum
    data = rng.bytes(4 * 77)
    cuts = [data[k : k + 64] for k in range(0, len(data), 64)]
    assert packing.combined([zlib.crc32(c) for c in cuts], [len(c) for c in cuts]) == zlib.crc32(data)


def test_tokens_are_the_tokenizers(frame):
    import pyarrow as pa

    rng = random.Random(6)
    alphabet = ["a", "B", "é", "́", "'", "'s", " ", "\n", "7", "½", "-", "“", "_", " ", "\u0085", "漢", "ß", "İ", "’", "=", "̸", "<|endoftext|>", "<|EndOfText|>", "\x1f", "🎉"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    tokens = packing.Tokens(TOKENIZER)
    got = [ids[a:b].tolist() for _, _, ids, offs in tokens.encode(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == [[*e.ids, 2] for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


# The Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_join_against_brute_force(frame, seed):
    rows = some_texts(seed, 80)
    assert sorted(map(repr, map(tuple, jaccard.join(frame(rows)).collect()))) == sorted(map(repr, brute_components(rows)))


def test_join_of_a_large_family_is_cut_into_tiles(frame, monkeypatch):
    rng = random.Random(3)
    base = ["v%d" % rng.randrange(5000) for _ in range(150)]
    rows = []
    for k in range(130):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    want = sorted(map(repr, brute_components(rows)))
    assert sorted(map(repr, map(tuple, jaccard.join(frame(rows)).collect()))) == want
    monkeypatch.setattr(jaccard, "ROWS", 30)
    assert sorted(map(repr, map(tuple, jaccard.join(frame(rows)).collect()))) == want
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)  # the way without sending ids
    assert sorted(map(repr, map(tuple, jaccard.join(frame(rows)).collect()))) == want


def test_join_of_hot_copies_and_a_very_long_text(frame, monkeypatch):
    monkeypatch.setattr(_join, "SENT_ROWS", 0)
    monkeypatch.setattr(_join, "HOT_ROWS", 5)
    long = " ".join("v%d" % k for k in range(40_000))
    rows = [*some_texts(14, 40), *[(k, "one text that very many documents share here") for k in range(3000, 3030)], (4000, long), (4001, long + " end"), (None, long)]
    assert sorted(map(repr, map(tuple, jaccard.join(frame(rows)).collect()))) == sorted(map(repr, brute_components(rows)))


def test_one_document_of_each_component_stays(frame):
    rows = some_texts(21, 60)
    kept = jaccard.keep_one(frame(rows))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", *EXTRA]
    brute = brute_components(rows)
    sets = [shingles(t) for _, t in rows]
    groups = {}
    for k, (_, n, c) in enumerate(brute):
        if n:
            groups.setdefault(c if c is not None else ("none", k), []).append(k)
    assert sum(1 for _, t in got if not shingles(t)) == sum(not s for s in sets)
    full = [(i, t) for i, t in got if shingles(t)]
    assert len(full) == len(groups)
    assert sorted(str(i) for i, _ in full) == sorted(str(c if not isinstance(c, tuple) else None) for c in groups)


def test_join_of_nothing(frame):
    assert jaccard.join(frame([])).count() == 0 and jaccard.keep_one(frame([])).count() == 0
    assert [tuple(r) for r in jaccard.join(frame([(3, None)])).collect()] == [(3, 0, 3)]


def test_common_shingles_come_late_in_six_gigabytes():
    """A passage in 120 documents, among the 1.5 billion shingles of 6 GB, ties few of them together."""
    rng = np.random.default_rng(5)
    counts = rng.poisson(1.5e9 / jaccard.SKETCH, jaccard.SKETCH)
    passage = rng.integers(0, 1 << 64, 100, np.uint64)
    np.add.at(counts, (passage >> np.uint64(65 - jaccard.SKETCH.bit_length())).astype(np.int64), 120)
    ranks = jaccard._order(counts)
    first = Counter()
    for _ in range(120):
        keys = jaccard._keys(np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 400, np.uint64)])), ranks)
        first.update((keys & np.uint64((1 << 56) - 1)).tolist())
    assert max(first.values()) <= jaccard.LISTED


def test_counts_of_the_sketch_are_packed_whole():
    counts = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1] * 3, np.uint32)
    assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()


def test_components_of_chains_and_stars(spark):
    prepare(spark)
    edges = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(500, 600)] + [(9, 8), (8, 9), (3, 3)]
    rng = random.Random(1)
    rng.shuffle(edges)
    want = {k: 100 for k in range(100, 401)} | {k: 7 for k in [7, *range(500, 600)]} | {8: 8, 9: 8}
    for one_task in (None, 0):
        got = _graph.components(spark.createDataFrame(edges, "a long, b long").repartition(9), one_task)
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substrings


def brute_substrings(rows):
    raw = [(t or "").encode() for _, t in rows]
    n = substring.LENGTH
    count = Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                cover[k : k + n] = b"\1" * n
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if cover[k] and (not k or not cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [31, 32])
def test_substrings_against_brute_force(frame, seed):
    rng = random.Random(seed)
    rows = some_texts(seed, 50)
    source = " ".join(t for _, t in rows if t)
    for k in range(2000, 2030):  # passages about as long as the limit, at odd places
        at, size = rng.randrange(len(source) - 400), rng.choice([150, 195, 196, 199, 200, 201, 205, 260, 399])
        rows.append((k, "q%d" % k * rng.randint(0, 9) + source[at : at + size] + "éz%d" % k * rng.randint(0, 9)))
    rows += [(3000, "a" * 500), (3001, "ab" * 99), (3002, "ab" * 100), (3003, "from " * 90), (3004, "xy" * 120 + "z"), (3005, "é" * 100), (3006, "é" * 101)]
    assert sorted(map(repr, map(tuple, substring.digest(frame(rows)).collect()))) == sorted(map(repr, brute_substrings(rows)))


def test_substrings_in_small_batches_and_cleaned(spark, frame):
    rows = some_texts(33, 60)
    want = sorted(map(repr, brute_substrings(rows)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, map(tuple, substring.digest(frame(rows)).collect()))) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    cleaned = {r["doc_id"]: r["text"] for r in substring.clean(frame(rows)).collect()}
    digests = {i: d for i, _, _, _, d in brute_substrings(rows)}
    whole = [i for i, _ in rows if i is not None and i != 5]
    assert all("�" in cleaned[i] or hashlib.sha256(cleaned[i].encode()).hexdigest() == digests[i] for i in whole)
    assert substring.digest(frame([])).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "=", "\x00\xff"])
def test_corpus_order_is_the_order_of_suffixes(alphabet):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choices(alphabet, k=rng.choice([200, 201, 260, 700]))).encode("latin-1") for _ in range(25)]
    texts += [texts[3][50:] + texts[4][:150] + texts[3][:40], texts[5] * 2, bytes(texts[6])]
    texts = [t for t in texts if t]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    from codelode.llm import _kernel

    starts, order = substring.corpus_order(buf, offs, _kernel.prefix_hash(buf))
    ends = offs[np.searchsorted(offs, starts, "right")]
    assert starts.tolist() == [int(a) + k for a, t in zip(offs, texts, strict=False) for k in range(len(t) - substring.LENGTH + 1)]
    own = [bytes(buf[s:e])[: substring.LENGTH] for s, e in zip(starts[order], ends[order], strict=True)]
    assert own == sorted(own)


def test_substrings_of_filler_and_repeated_rows(spark, frame, monkeypatch):
    """Periodic texts of any length, many equal rows without ids, and a passage in every document."""
    monkeypatch.setattr(substring, "SEGMENT", 5_000)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, same = own(260), own(700)
    rows = [(k, own(300) + passage + own(100)) for k in range(40)] + [(None, same)] * 60
    rows += [(100, "=" * 30_000), (101, own(100) + "ab" * 9_000 + own(100)), (102, "=" * 200), (103, "-" * 201), (104, "-" * 200 + "x"), (105, "from " * 50), (106, "0123456789abc" * 900 + own(20)), (107, own(12_000))]
    got = sorted(map(repr, map(tuple, substring.digest(frame(rows)).collect())))
    assert got == sorted(map(repr, brute_substrings(rows)))


@pytest.mark.parametrize("seed", [1, 33])
def test_substrings_where_triggers_are_hot(frame, monkeypatch, seed):
    """Every repeated trigger is hot: its starts meet by their own strings, with the same result."""
    monkeypatch.setattr(substring, "HOT_BYTES", 0)
    rng = random.Random(seed)
    own = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = own(330)
    rows = some_texts(seed, 40) + [(k, own(150) + passage + own(150)) for k in range(4000, 4040)] + [(5000, "=" * 9_000), (5001, "ab" * 400), (5002, passage)]
    assert sorted(map(repr, map(tuple, substring.digest(frame(rows)).collect()))) == sorted(map(repr, brute_substrings(rows)))


def test_a_passage_in_many_documents_is_spread(spark, frame):
    """One passage between own words: its triggers are hot, and no part gets more than a few times its share of what is sent."""
    rng = random.Random(4)
    own = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = own(330)
    rows = [(k, own(150) + passage + own(150)) for k in range(800)]
    total = sum(len(t) for _, t in rows)
    docs = frame(rows).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    for least, most in ((1 << 40, None), (0, 0.02)):
        substring.HOT_BYTES, kept = least, substring.HOT_BYTES
        try:
            marks = spark.sparkContext.broadcast(substring.repeated_triggers(docs, total))
        finally:
            substring.HOT_BYTES = kept
        sent = docs.mapInArrow(lambda it, marks=marks: substring._gather(it, marks), substring._GATHERED).filter("content is not null")
        sizes = [r["b"] for r in sent.groupBy("key").agg(F.sum(F.length("piece") + 40).alias("b")).collect()]
        if most is None:
            assert max(sizes) > 0.3 * sum(sizes)
        else:
            assert max(sizes) < most * sum(sizes)


def test_a_long_filler_text_stays_small(frame):
    """Five megabytes of one character, and of a period, travel as a few rows."""
    import pyarrow as pa

    marks = type("Marks", (), {"value": (np.full(1 << 10, 255, np.uint8), np.empty(0, np.uint64))})
    for text in ("=" * 5_000_000, "ab" * 2_500_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc_id", "text_hash", "text"])
        out = list(substring._gather(iter([batch]), marks))
        assert sum(b.num_rows for b in out) < 100 and sum(b.nbytes for b in out) < 100_000


# Decontamination


def brute_leaks(rows, items, rate=decontam.RATE, min_words=1):
    out = set()
    for i, t in rows:
        text = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        for j, s in items:
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(s))
            if len(own) < min_words:
                continue
            before = [0] * (len(text) + 1)
            for a in range(1, len(own) + 1):
                now = [a]
                for b in range(1, len(text) + 1):
                    now.append(min(before[b] + 1, now[-1] + 1, before[b - 1] + (own[a - 1] != text[b - 1])))
                before = now
            if min(before) <= int(rate * len(own)):
                out.add((i, j, min(before)))
    return out


@pytest.mark.parametrize("seed", [41, 42])
def test_leaks_against_brute_force(spark, frame, seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 9, 12, 20, 31, 45])))) for k in range(25)] + [(90, None), (91, ""), (None, "some item without any id at all")]
    rows = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 50))
        if k % 2:
            own = (rng.choice([s for _, s in items if s])).split()
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(own))
                own[p : p + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
                own = own or ["w1"]
            at = rng.randint(0, len(words))
            words[at:at] = own
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(words).upper() if k % 3 else " ".join(words)))
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, "x some item, without ANY id at all")]
    benchmark = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    for block in (decontam.BLOCK_WORDS, 60):
        got = decontam.search(frame(rows), benchmark, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == brute_leaks(rows, items)
    for rate in (0.0, 0.3, 0.6):
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.search(frame(rows), benchmark, rate=rate).collect()} == brute_leaks(rows, items, rate)
    dirty = {i for i, _, _ in brute_leaks(rows, items, min_words=decontam.MIN_WORDS)}
    kept = decontam.clean(frame(rows), benchmark)
    assert kept.columns == ["doc_id", "text", *EXTRA] and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)
    assert decontam.search(frame([]), benchmark).count() == 0 and decontam.search(frame(rows), benchmark.limit(0)).count() == 0 and decontam.clean(frame(rows), benchmark.limit(0)).count() == len(rows)


def test_leaks_of_ties_repeated_items_and_long_texts(spark, frame):
    item = " ".join("w%d" % k for k in range(20))
    items = [(1, item), (1, item), (2, item), (3, "x y"), (None, item)]
    text = "a b " * 30_000
    rows = [(1, f"{text} {item} {item} {text}"), (2, item.replace("w3", "q")), (2, item.replace("w3", "q")), (3, "z x y z")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["distance"], r["first_word"], r["end_word"]) for r in decontam.search(frame(rows), benchmark).collect())
    assert got == sorted([(1, i, 0, 60_000, 60_020) for i in (0, 1, 2)] + [(2, i, 1, 0, 20) for i in (0, 1, 2)] * 2 + [(3, 3, 0, 1, 3)])
    assert [r["doc_id"] for r in decontam.clean(frame(rows), benchmark).collect()] == [3]
    with pytest.raises(ValueError):
        decontam.search(frame(rows), benchmark, rate=1.0)


def test_items_that_begin_alike_are_not_all_verified(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    items = ["what is the value of " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(9)) for _ in range(800)]
    calls = []
    known = decontam.myers
    monkeypatch.setattr(decontam, "myers", lambda *a, **k: calls.append(1) or known(*a, **k))
    block = decontam.compile_block(list(range(800)), items, decontam.RATE, 1)
    assert not list(decontam.find(pa.array(["what is the value of " + "gold and silver now " * 8] * 50), block)) and len(calls) < 50


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randint(1, 70))], [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        for anchored in (False, True):
            before = list(range(len(t) + 1)) if anchored else [0] * (len(t) + 1)
            for a in range(1, len(p) + 1):
                now = [a]
                for b in range(1, len(t) + 1):
                    now.append(min(before[b] + 1, now[-1] + 1, before[b - 1] + (p[a - 1] != t[b - 1])))
                before = now
            assert decontam.myers(p, t, anchored) == before[1:]
