"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set is its distinct 5-word shingles; two sets link when their Jaccard
similarity is at least ``PERCENT`` / 100.

1. One pass gives each document's set size, a signature (equal sets, equal
   signatures: a class), and a histogram of its shingles over a number of cells that follows its size; and,
   for all documents together, how frequent shingles are in ``SKETCH`` cells.
2. Shingles are put in one order, rare cells first.  Two sets that link share a
   shingle among the first ``n - ceil(n * PERCENT / 100) + 1`` of each, so only those
   entries of the incidence matrix are needed.  They are dealt by shingle into column
   blocks.  A block's task multiplies its part: for each shingle, pairs of the classes
   that have it, less those whose sizes or places in the order rule a link out.
3. The pairs' overlap has an upper bound, the sum over cells of the smaller count;
   pairs below the overlap that their sizes call for are discarded.
4. What is left joins classes into candidate groups.  Each group's sets are brought
   together and multiplied in full: overlaps of a row with all rows that it has not
   reached yet.  A group above ``TILE`` shingles or ``ROWS`` classes is cut into blocks, a task
   for each pair of blocks.
5. Components of the links, over classes, give every document its component.

A shingle that very many classes share is late in the order.  Where it still is among the
first (a large family of near copies), the block only ties those classes together, and
step 4 compares them; no task lists all pairs of a group, and no pair is lost.

Copies are classes of one row from the first pass on.  Edge cases: a text with fewer
than five words is one shingle; a null or empty text, or one without words, has the empty
set, links with nothing and is a component of its own; equal doc_ids are different rows
of the same id; a null doc_id is a component's id only if it has no other; very long texts
are one set each, held whole by a task; of equal ids the least text hash stands for a component;
an empty table gives no rows.  Only the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K
from codelode.llm._graph import components, forest
from codelode.llm._join import meet
from codelode.llm._store import settle

WORDS, PERCENT = 5, 80
#: Cells of the corpus-wide frequencies (a power of two; many enough that a shingle of LISTED documents stands out of what else falls
#: into its cell, else common shingles come first and tie unlike documents to groups that are multiplied in full); the most of a document's histogram, and its shingles for each cell.
SKETCH, CELLS, PER_CELL = 1 << 22, 4096, 8
#: Entries of the incidence matrix for each column block, about.
BLOCK_ENTRIES = 1_200_000
#: Classes of one shingle up to which its pairs are listed.
LISTED = 48
#: Shingles and classes of one tile of step 4, at most, and shingles of one task of small tiles.
TILE, ROWS, TASK = 4_000_000, 4_000, 1_000_000
#: Ids up to which a list of documents is sent to all tasks (about 50 bytes each); beyond it the tables are joined by a shuffle.
SENT_IDS = 250_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted sets of 64-bit hashes) of runs of rows."""
    for at, _, buf, offs in K.chunks(column):
        lower = K.LOWER[buf]
        starts, ends, woffs = K.words(lower, offs)
        h = K.span_hash(K.prefix_hash(lower), starts, ends) if len(starts) else np.empty(0, np.uint64)
        g = K.grams(h, WORDS)
        sets = []
        for a, b in zip(woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
            if b - a >= WORDS:
                x = np.sort(g[a : b - WORDS + 1])
                fresh = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=fresh[1:])
                sets.append(x[fresh])
            elif b > a:
                sets.append(K.grams(h[a:b], b - a) ^ np.uint64(b - a))
            else:
                sets.append(np.empty(0, np.uint64))
        yield at, sets


def signature(x: np.ndarray) -> int:
    """64 bits of a set, as a signed long; 0 for the empty one alone."""
    if not len(x):
        return 0
    s = K.mix(np.array([(K.mix(x) ^ np.uint64(len(x))).sum(dtype=np.uint64)], np.uint64))
    return int(s.view(np.int64)[0]) or 1


def histogram(x: np.ndarray) -> bytes:
    """Counts of a set by the lowest bits, a byte for each cell; 255 stands for that many or more."""
    cells = min(CELLS, 1 << max(5, (len(x) // PER_CELL).bit_length()))
    return np.minimum(np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the overlap of two sets, from their histograms; the finer one is folded."""
    x, y = (np.frombuffer(h, np.uint8).astype(np.int64) for h in (a, b))
    if (x == 255).any() or (y == 255).any():
        return 1 << 62
    cells = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


_FIRST = "kind int, doc_id long, text_hash long, n long, sig long, cells binary, slice int, counts binary"
_SLICES = 64


def _packed(counts: np.ndarray) -> bytes:
    """Counts of 32 bits, their bytes apart by weight: in a task's part of the sketch most are 0 or 1."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FIRST.split(", ")]
    counts = np.zeros(SKETCH, np.uint32)
    to_cell = np.uint64(64 - (SKETCH.bit_length() - 1))
    for batch in batches:
        sizes, sigs, cells = [], [], []
        for _, sets in shingle_sets(batch.column(2)):
            for x in sets:
                sizes.append(len(x))
                sigs.append(signature(x))
                cells.append(histogram(x))
            np.add.at(counts, (np.concatenate(sets) >> to_cell).astype(np.int64), np.uint32(1))
        n = batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(cells, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if counts.any():
        parts = [_packed(p) for p in counts.reshape(_SLICES, -1)]
        none = [pa.nulls(_SLICES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(_SLICES, np.int32)), *none, pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + _unpacked(c).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(np.minimum(s, (1 << 32) - 1)) for s in sums.values()], pa.binary())], names=["slice", "counts"])


def _order(counts: np.ndarray) -> np.ndarray:
    """The order of the cells by frequency, as bytes (finer than halves of an octave)."""
    logs = np.log2(np.maximum(counts, 1))
    base = np.median(logs)  # the ordinary cell; what stands out from it is told apart finely
    return np.clip(128 + np.rint(16 * (logs - base)), 0, 255).astype(np.uint8)


def _ranks(first: DataFrame) -> np.ndarray:
    """The order of the SKETCH cells, by the counts of all documents."""
    counts = np.zeros((_SLICES, SKETCH // _SLICES), np.uint32)
    for r in first.filter("kind = 1").select("slice", "counts").repartition(_SLICES, "slice").mapInArrow(K.frugal(_add_slices), "slice int, counts binary").collect():
        counts[r["slice"]] = _unpacked(r["counts"])
    return _order(counts.ravel())


def _keys(x: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the common order."""
    cell = (x >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64)
    keys = ranks[cell].astype(np.uint64) << np.uint64(56) | x & np.uint64((1 << 56) - 1)
    n = len(x)
    p = n + PERCENT * -n // 100 + 1  # n - ceil(n * PERCENT / 100) + 1
    return np.sort(keys if p >= n else np.partition(keys, p - 1)[:p])


def _entries(batches: Iterator[pa.RecordBatch], ranks, blocks: int) -> Iterator[pa.RecordBatch]:
    """Parts of column blocks: a row for each block and batch, a class once for each task."""
    ranks, seen = ranks.value, set()
    for batch in batches:
        keys, sigs, sizes = [], [], []
        for _, sets in shingle_sets(batch.column(2)):
            for x in sets:
                s = signature(x)
                if s and s not in seen:
                    seen.add(s)
                    keys.append(_keys(x, ranks))
                    sigs.append(s)
                    sizes.append(len(x))
        if not keys:
            continue
        lengths = np.array([len(k) for k in keys])
        first = np.array([k[0] for k in keys])
        doc, place = np.repeat(np.arange(len(keys)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat = np.concatenate(keys)
        block = (K.mix(flat) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange(blocks + 1))
        sigs, sizes = np.array(sigs, np.int64), np.array(sizes, np.int64)
        out_blocks, out = [], []
        for b in range(blocks):
            own = order[at[b] : at[b + 1]]
            if len(own):
                docs, local = np.unique(doc[own], return_inverse=True)
                head = np.array([len(docs), len(own)], "<i8").tobytes()
                out_blocks.append(b)
                out.append(head + b"".join(a.tobytes() for a in (sigs[docs], sizes[docs].astype("<u4"), first[docs], flat[own], local.astype("<u4"), place[own].astype("<u4"))))
        yield pa.RecordBatch.from_arrays([pa.array(out_blocks, pa.int32()), pa.array(out, pa.binary())], names=["block", "part"])


def _read_part(part: bytes) -> list[np.ndarray]:
    """Signatures, sizes and first keys of a part's classes, and keys, classes and places of its entries."""
    docs, n = np.frombuffer(part, "<i8", 2).tolist()
    out, at = [], 16
    for kind, size in (("<i8", docs), ("<u4", docs), ("<u8", docs), ("<u8", n), ("<u4", n), ("<u4", n)):
        out.append(np.frombuffer(part, kind, size, at))
        at += out[-1].nbytes
    return out


def _shared(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """sig, n, first, key and place of the entries whose shingle two classes or more of the block have, by shingle."""
    sig, n, first, key, doc, place = ([p[k] for p in parts] for k in range(6))
    base = np.cumsum([0] + [len(s) for s in sig[:-1]])
    doc = np.concatenate([d + np.uint32(at) for d, at in zip(doc, base, strict=True)])
    key, place = np.concatenate(key), np.concatenate(place)
    order = np.argsort(key)
    again = np.zeros(len(order) + 1, bool)
    np.equal(key[order][1:], key[order][:-1], out=again[1:-1])
    order = order[again[1:] | again[:-1]]  # most shingles are one document's alone
    sig, n, first = np.concatenate(sig)[doc[order]], np.concatenate(n)[doc[order]].astype(np.int64), np.concatenate(first)[doc[order]]
    key, place = key[order], place[order].astype(np.int64)
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    fresh = np.ones(len(key), bool)  # a class that several tasks sent counts once
    fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    return sig[fresh], n[order][fresh], first[order][fresh], key[fresh], place[order][fresh]


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of classes of one column block, each once; tied: they only stand for a group to be compared."""
    by_block: dict[int, list] = {}
    for batch in batches:
        for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_block.setdefault(b, []).append(_read_part(part))
    for b in list(by_block):
        sig, n, first, key, place = _shared(by_block.pop(b))
        if not len(key):
            continue
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        found = [np.empty((0, 2), np.int64)]
        for g in np.unique(size[(size > 1) & (size <= LISTED)]).tolist():
            starts = edge[:-1][size == g]
            i, j = np.triu_indices(g, 1)
            for some in np.array_split(starts, max(1, len(starts) * len(i) // 2_000_000)):
                p, q = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                lo, hi = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
                most = np.minimum(place[p], place[q]) + 1 + np.minimum(n[p] - place[p], n[q] - place[q]) - 1
                # A pair with the same first key is left to that key's block.
                ok = (100 * lo >= PERCENT * hi) & (most >= need(n[p], n[q])) & ((first[p] != first[q]) | (first[p] == key[p]))
                found.append(np.stack([sig[p[ok]], sig[q[ok]]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        large = np.flatnonzero(size > LISTED)
        tied = [np.empty((0, 2), np.int64)]
        for k in large.tolist():
            # Sorted by size, neighbours whose sizes could link are tied; a gap parts the group.
            own = np.arange(edge[k], edge[k + 1])
            own = own[np.argsort(n[own], kind="stable")]
            near = 100 * n[own[:-1]] >= PERCENT * n[own[1:]]
            tied.append(np.stack([sig[own[:-1][near]], sig[own[1:][near]]], 1))
        ties = np.stack(forest(*np.concatenate(tied).T), 1) if len(large) else tied[0]
        every = np.concatenate([pairs, ties])
        if len(every):
            flags = np.arange(len(every)) >= len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(flags)], names=["a", "b", "tied"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose histograms allow a link."""
    for batch in batches:
        if batch.num_rows:
            least = need(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)))
            ok = [most_shared(x, y) >= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), least.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def links(sigs: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between these sets: from each row reached, overlaps with all rows not reached yet.

    sides: rows of different sides only are compared (None: all).
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sigs, sets = sigs[order], [sets[k] for k in order]
    sides = None if sides is None else sides[order]
    n = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int32)
    sums = np.zeros(offs[-1] + 1, np.int64)
    free = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    todo: list[int] = []
    for k in range(len(sets)):
        if not free[k]:
            continue
        free[k] = False
        todo.append(k)
        while todo:
            x = todo.pop()
            lo = int(np.searchsorted(100 * n, PERCENT * n[x]))
            hi = int(np.searchsorted(PERCENT * n, 100 * n[x], "right"))
            left = lo + np.flatnonzero(free[lo:hi] if sides is None else free[lo:hi] & (sides[lo:hi] != sides[x]))
            if not len(left):
                continue
            mark[ids[offs[x] : offs[x + 1]]] = 1
            a, b = offs[lo], offs[hi]
            np.cumsum(mark[ids[a:b]], out=sums[a + 1 : b + 1])
            sums[a] = 0
            shared = sums[offs[left + 1]] - sums[offs[left]]
            mark[ids[offs[x] : offs[x + 1]]] = 0
            for y in left[100 * shared >= PERCENT * (n[x] + n[left] - shared)].tolist():
                free[y] = False
                todo.append(y)
                edges.append((x, y))
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = np.array(edges).T
    return sigs[x], sigs[y]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each tile (root, i, j) of the rows (root, i, j, first, sig, shingles); if i and j differ, from block to block only."""
    tiles: dict[tuple, dict[int, tuple[bool, bytes]]] = {}
    for batch in batches:
        for root, i, j, first, sig, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tiles.setdefault((root, i, j), {})[sig] = (first, x)
    for (_, i, j), own in tiles.items():
        a, b = links(np.array(list(own), np.int64), [np.frombuffer(x, "<u8") for _, x in own.values()], None if i == j else np.array([f for f, _ in own.values()]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, i, j, first, sig, shingles) of the rows (sig, root, parts, text): a class once for each task, in every tile that needs it."""
    seen = set()
    for batch in batches:
        sigs, roots, parts = (batch.column(k).to_pylist() for k in range(3))
        for at, sets in shingle_sets(batch.column(3)):
            rows = []
            for k, x in enumerate(sets, at):
                if sigs[k] not in seen:
                    seen.add(sigs[k])
                    own = sigs[k] % parts[k]
                    rows += [(roots[k], min(own, o), max(own, o), own <= o, sigs[k], x.astype("<u8").tobytes()) for o in range(parts[k])]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["root", "i", "j", "first", "sig", "shingles"])


def _by_size(ids: DataFrame) -> DataFrame:
    """The ids, to be sent to all tasks if they are few; else a join shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, sig, component, first) of each row; first: whether it stands for its component.

    docs: doc_id, text_hash and text.
    """
    first = settle(docs.mapInArrow(K.frugal(_first_pass), _FIRST))
    rows = first.filter("kind = 0").select("doc_id", "text_hash", "n", "sig")
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(first))
    total = rows.agg(F.sum(F.ceil(F.col("n") * (100 - PERCENT) / 100) + 1)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_ENTRIES))

    entries = docs.mapInArrow(K.frugal(lambda it: _entries(it, ranks, blocks)), "block int, part binary")
    product = settle(entries.repartition(blocks, "block").mapInArrow(K.frugal(_product), "a long, b long, tied boolean").groupBy("a", "b").agg(F.max("tied").alias("tied")))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("lead")
    classes = first.filter("kind = 0 and sig <> 0").groupBy("sig").agg(lead, F.max("n").alias("n"), F.max("cells").alias("cells"), F.count("*").alias("rows"))
    listed = product.filter("not tied").select("a", "b")
    touched = product.select(F.col("a").alias("sig")).unionByName(product.select(F.col("b").alias("sig"))).distinct()
    some = settle(classes.join(touched, "sig"))
    x, y = (some.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("cells").alias(f"cells_{k}")) for k in "ab")
    bounded = listed.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(K.frugal(_bounded), "a long, b long")
    groups = components(bounded.unionByName(product.filter("tied").select("a", "b")))

    members = groups.select(F.col("node").alias("sig"), "root").join(some.select("sig", F.col("lead.doc_id").alias("of"), F.col("lead.text_hash").alias("hash"), "n"), "sig")
    weights = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.count("*") / ROWS)).cast("int").alias("parts"))
    members = settle(members.join(weights, "root"))
    chosen = _by_size(members)
    texts = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["of"]) & (docs["text_hash"] == chosen["hash"])).select("sig", "root", "parts", "text")
    tiled = texts.mapInArrow(K.frugal(_sets_of), "root long, i int, j int, first boolean, sig long, shingles binary")
    total = members.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    linked = components(tiled.repartition(max(1, -(-total // TASK)), "root", "i", "j").mapInArrow(K.frugal(_tiles), "a long, b long"))

    named = linked.select(F.col("node").alias("sig"), "root").join(some.select("sig", "lead"), "sig")
    leads = named.groupBy("root").agg(F.min("lead").alias("of_all"))
    by_class = classes.select("sig", "lead", "rows").join(named.select("sig", "root").join(leads, "root").select("sig", "of_all"), "sig", "left").select("sig", F.coalesce("of_all", "lead").alias("lead"), "rows")
    out = meet(rows.filter("sig <> 0"), settle(by_class), ["sig"]).select("doc_id", "text_hash", "n", "sig", F.col("lead.doc_id").alias("component"), (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("first"))
    return out.unionByName(rows.filter("sig = 0").select("doc_id", "text_hash", "n", "sig", F.col("doc_id").alias("component"), F.lit(True).alias("first")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))


def join(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the least doc_id that links reach."""
    return _components(_keyed(docs)).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the least doc_id (null last), then text hash.

    Of rows with the same id and text any one stays.  Documents with the empty set all stay.
    """
    rows = settle(_components(_keyed(docs)).select("doc_id", "text_hash", "sig", "first"))
    name = "gone"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"

    def on(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys[f"{name}_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys[f"{name}_hash"])

    def named(some: DataFrame) -> DataFrame:
        return _by_size(some.select(F.col("doc_id").alias(f"{name}_id"), F.col("text_hash").alias(f"{name}_hash")).distinct())

    gone = named(rows.filter("not first"))
    again = rows.filter("first and sig <> 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if again.isEmpty():
        return docs.join(gone, on(gone), "left_anti")
    twice, lost = named(again), named(rows.filter("not first").select("doc_id", "text_hash").unionByName(again.select("doc_id", "text_hash")))
    return docs.join(lost, on(lost), "left_anti").unionByName(docs.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


#: The same in DuckDB's dialect, over a table of documents with distinct ids; {docs} is the table.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT a, a FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, coalesce(min(reached.other), d.doc_id) AS component_id
FROM {docs} d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reached ON reached.doc_id = d.doc_id GROUP BY d.doc_id
"""
