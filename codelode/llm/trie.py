"""The prefix trie of conversations, merged family first.

Conversations whose ids differ by less than ``FAMILY`` share a base and are a family.  A
conversation is rebuilt from the base's first turns and its own later ones; each distinct
sequence of first turns is a node of one trie over all conversations.

1. Turns are dealt by base, as ids, digests and sizes (texts stay where they are).  There
   a family is put in order and rebuilt, each node gets a key (two 64-bit running hashes of
   places and digests), and equal nodes of the family become one row with its members.
2. Only these combined rows are shuffled by key.  Nodes of more than one family are merged:
   members are summed, the least one owns the node.
3. The merged values go back to the families.  Along each conversation's path, from its
   end up, sums of bytes, of owned bytes and of owned leaves are what its subtrees hold of
   it.  A node that one family has is final then; the others are summed by key once more.

The work is linear in the turns at any depth: no node meets its ancestors.  Digests of the
conversations that end in a shared node are computed from sorted pieces of at most
``CHUNK`` ids, so no list of members is ever whole in memory.

Edge cases: turns are ordered by turn (null first), equal ones by role, the text's first 40
characters and its digest; repeated rows are turns like others; a null role or text is empty;
rows with a null conv_id belong to no conversation and take no part; a negative id's base is
the multiple of FAMILY next to it towards 0; a conversation without turns after rebuilding is a
member of the root; an empty table has no nodes.  Further columns are not read.  A family is
put in order in one task by Spark's sort and windows, which spill, unless one of its conversations has
``LONG`` turns or more (and one in ``SHARE`` of all): those are cut into slices, each in a task, whose
totals, a row for each, carry places, keys and sums from slice to slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelode.llm import _kernel as K
from codelode.llm._join import meet
from codelode.llm._store import settle

#: Ids of a family; what the length of the shared beginning is taken modulo, so it is below that.
FAMILY, SHARED = 5, 9
#: Ids in a piece of a shared node's ends, and rows of them that a task puts in order.
CHUNK, CHUNK_ROWS = 1 << 15, 1_000_000

#: Turns from which a conversation is sliced, and the share of all turns that it must have; so no more than SHARE conversations are; slices of one.
LONG, SHARE, MOST_SLICES = 100_000, 100_000, 10_000

_KEY = ["k1", "k2", "depth"]
_NONE = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), F.substring(text, 1, 40).alias("head"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)


def long_ones(conversations: DataFrame) -> tuple[DataFrame | None, int]:
    """(base, conv_id, bounds) of conversations to slice, None if there are none, and the turns from which one is long.

    bounds: turns that cut a conversation into slices of about that length; equal turns stay together.
    """
    sizes = settle(conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count("*").alias("n")))
    least = max(LONG, (sizes.agg(F.sum("n")).first()[0] or 0) // SHARE)
    long = sizes.filter(F.col("n") >= least).withColumn("slices", F.least(F.ceil(F.col("n") / least), F.lit(MOST_SLICES)).cast("int"))
    cuts = long.agg(F.max("slices")).first()[0]
    if cuts is None:
        return None, least
    found = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn").join(F.broadcast(long), "conv_id").groupBy("conv_id", "slices").agg(F.percentile_approx("turn", [k / cuts for k in range(1, cuts + 1)], 10 * cuts).alias("b"))
    own = F.when(F.col("slices") > 1, F.transform(F.sequence(F.lit(1), F.col("slices") - 1), lambda k: F.element_at("b", F.floor(k * cuts / F.col("slices")).cast("int")))).otherwise(F.slice("b", 1, 0))
    bounds = found.select("conv_id", F.array_distinct(own).alias("bounds"))  # as many in all as SHARE, twice at most
    return settle(bounds.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)), least


def _keys() -> list[tuple]:
    """The two running hashes' terms; the root's are 0."""
    first, second = F.xxhash64("depth", "digest"), F.xxhash64(F.lit("second"), "digest", "depth")
    return [(F.when(F.col("depth") > 0, h).otherwise(F.lit(0).cast("long")), k) for h, k in ((first, "k1"), (second, "k2"))]


def _rebuilt(placed: DataFrame) -> DataFrame:
    """(base, conv_id, slice, n_turns, depth, digest, n_bytes) of placed turns: pos, n (turns of the conversation) and prefix (the base's first)."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    placed = placed.withColumn("h", shared).withColumn("m", F.least(F.size("prefix").cast("long"), "h"))
    node = lambda depth, digest, n_bytes: F.struct(depth.alias("depth"), digest.alias("digest"), n_bytes.alias("n_bytes"))
    root = F.array(node(F.lit(0).cast("long"), F.lit(b""), F.lit(0).cast("long")))
    begin = F.concat(root, F.transform(F.slice("prefix", F.lit(1), F.col("m").cast("int")), lambda x: node(x["pos"], x["digest"], x["n_bytes"])))
    own = F.array(node(F.col("m") + F.col("pos") - F.col("h"), F.col("digest"), F.col("n_bytes")))
    nodes = F.concat(F.when(F.col("pos") == 1, begin).otherwise(F.slice(root, 1, 0)), F.when(F.col("pos") > F.col("h"), own).otherwise(F.slice(root, 1, 0)))
    return placed.select("base", "conv_id", "slice", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"), F.explode(nodes).alias("x")).select("base", "conv_id", "slice", "n_turns", "x.*")


def paths(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, depth, n_bytes, n_turns, k1, k2): every node of every rebuilt conversation, the root first, where its family is."""
    one, family = Window.partitionBy("base", "conv_id"), Window.partitionBy("base")
    turns = _turns(conversations).repartition("base").withColumn("slice", F.lit(0))
    placed = turns.withColumn("pos", F.row_number().over(one.orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest")).cast("long")).withColumn("n", F.count("*").over(one))
    first = F.when((F.col("conv_id") == F.col("base")) & (F.col("pos") < SHARED), F.struct("pos", "digest", "n_bytes"))
    rows = _rebuilt(placed.withColumn("prefix", F.sort_array(F.collect_list(first).over(family))))
    so_far = one.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("base", "conv_id", "depth", "n_bytes", "n_turns", *(F.bit_xor(h).over(so_far).alias(k) for h, k in _keys()))


_SLICE = ["base", "conv_id", "slice"]


def sliced_paths(conversations: DataFrame, long: DataFrame) -> DataFrame:
    """The same for families with a long conversation: a task has one slice, and totals of slices carry on."""
    part, whole = Window.partitionBy(*_SLICE), Window.partitionBy("base", "conv_id")
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_ = F.when(F.col("bounds").isNull() | F.col("turn").isNull(), 0).otherwise(1 + F.size(F.filter("bounds", lambda b: b < F.col("turn"))))
    turns = _turns(conversations).join(F.broadcast(long.select("conv_id", "bounds")), "conv_id", "left").withColumn("slice", slice_).drop("bounds")
    local = settle(turns.repartition(*_SLICE).withColumn("own", F.row_number().over(part.orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest")).cast("long")))
    sizes = settle(local.groupBy(*_SLICE).agg(F.count("*").alias("n"))).select(*_SLICE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n"))
    placed = local.join(sizes, _SLICE).withColumn("pos", F.col("own") + F.col("before"))
    first = placed.filter(F.col("conv_id") == F.col("base")).filter(F.col("pos") < SHARED).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("prefix"))
    none = F.array().cast("array<struct<pos:bigint,digest:binary,n_bytes:bigint>>")
    rows = settle(_rebuilt(placed.join(F.broadcast(settle(first)), "base", "left").withColumn("prefix", F.coalesce("prefix", none))))  # a few turns of at most SHARE families
    totals = settle(rows.groupBy(*_SLICE).agg(*(F.bit_xor(h).alias(k) for h, k in _keys()))).select(*_SLICE, *(F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(f"{k}_before") for k in ("k1", "k2")))
    so_far = part.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = rows.repartition(*_SLICE).select("*", *(F.bit_xor(h).over(so_far).alias(k) for h, k in _keys())).join(totals, _SLICE)
    return keyed.select("base", "conv_id", "depth", "n_bytes", "n_turns", *(F.col(k).bitwiseXOR(F.col(f"{k}_before")).alias(k) for k in ("k1", "k2")))


def families(rows: DataFrame) -> DataFrame:
    """One row for each node of each family's trie: bytes, members in order, and whether any goes on; rows: paths."""
    member = F.struct("conv_id", (F.col("n_turns") == F.col("depth")).alias("ends"))
    return rows.groupBy("base", *_KEY).agg(F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(member)).alias("members"), F.max(F.col("n_turns") > F.col("depth")).alias("inner"))


def _below(rows: DataFrame) -> DataFrame:
    """What the subtrees of each conversation's nodes hold of it, and whether it owns the next node and who owns the last."""
    up = Window.partitionBy("base", "conv_id").orderBy(F.col("depth").desc())
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({
        "held": F.sum("n_bytes").over(below), "kept": F.sum("own_bytes").over(below), "leaves": F.sum("own_leaf").over(below),
        "child": F.coalesce(F.lag("owned").over(up), F.lit(0)), "parent": F.lead("owner").over(up)})


def _sliced_below(rows: DataFrame, length: int) -> DataFrame:
    """The same in slices of ``length`` depths."""
    rows = rows.withColumn("slice", F.floor(F.col("depth") / length)).repartition(*_SLICE)
    up = Window.partitionBy(*_SLICE).orderBy(F.col("depth").desc())
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({
        "held": F.sum("n_bytes").over(below), "kept": F.sum("own_bytes").over(below), "leaves": F.sum("own_leaf").over(below),
        "child": F.lag("owned").over(up), "parent": F.lead("owner").over(up)})
    totals = rows.groupBy(*_SLICE).agg(F.sum("n_bytes").alias("b"), F.sum("own_bytes").alias("o"), F.sum("own_leaf").alias("l"), F.min_by("owned", "depth").alias("top"), F.max_by("owner", "depth").alias("end"))
    deeper = Window.partitionBy("base", "conv_id").orderBy(F.col("slice").desc())
    past = deeper.rowsBetween(Window.unboundedPreceding, -1)
    edges = settle(totals).select(*_SLICE, *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_below") for c in "bol"), F.lag("top").over(deeper).alias("next"), F.lead("end").over(deeper).alias("above"))
    return local.join(edges, _SLICE).withColumns({
        "held": F.col("held") + F.col("b_below"), "kept": F.col("kept") + F.col("o_below"), "leaves": F.col("leaves") + F.col("l_below"),
        "child": F.coalesce("child", "next", F.lit(0)), "parent": F.coalesce("parent", "above")}).select(*rows.drop("slice").columns, "held", "kept", "leaves", "child", "parent")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order become pieces: a node's key, the first id, and the ids' decimals joined."""

    def piece(key: tuple, ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True), first=ids[0], ids=",".join(map(str, ids)).encode())], pa.schema([*((k, pa.int64()) for k in _KEY), ("first", pa.int64()), ("ids", pa.binary())]))

    now, ids = None, []
    for batch in batches:
        for *key, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now or len(ids) == CHUNK:
                if ids:
                    yield piece(now, ids)
                now, ids = key, []
            ids.append(conv_id)
    if ids:
        yield piece(now, ids)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order."""

    def done(key: tuple, hashed) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True), ends_sha256=hashed.hexdigest())], pa.schema([*((k, pa.int64()) for k in _KEY), ("ends_sha256", pa.string())]))

    now, hashed = None, None
    for batch in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == now:
                hashed.update(b",")
            else:
                if now is not None:
                    yield done(now, hashed)
                now, hashed = key, hashlib.sha256()
            hashed.update(ids)
    if now is not None:
        yield done(now, hashed)


def _shared_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each node of (key, conv_id): ids are put in order in ranges, which split large nodes."""
    tasks = max(1, -(-ends.count() // CHUNK_ROWS))
    pieces = ends.repartitionByRange(tasks, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(K.frugal(_chunks), "k1 long, k2 long, depth long, first long, ids binary")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(K.frugal(_digests), "k1 long, k2 long, depth long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations."""
    long, length = long_ones(conversations)
    if long is None:
        family = settle(families(paths(conversations)))
    else:
        bases = F.broadcast(long.select("base").distinct())  # at most SHARE
        of = conversations.withColumn("base", F.col("conv_id").cast("long") - F.col("conv_id").cast("long") % FAMILY)
        some, rest = (of.join(bases, "base", how).drop("base") for how in ("left_semi", "left_anti"))
        family = settle(families(paths(rest)).unionByName(families(sliced_paths(some, long))))
    merged = family.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.sum(F.size("members")).alias("n"), F.min(F.col("members")[0]["conv_id"]).alias("owner"), F.max("inner").alias("goes_on")).filter("rows > 1")
    known = meet(family, settle(merged), _KEY, "left").withColumns({
        "shared": F.col("n").isNotNull(), "n_convs": F.coalesce("n", F.size("members").cast("long")), "owner": F.coalesce("owner", F.col("members")[0]["conv_id"]), "inner": F.coalesce("goes_on", "inner")})

    def members(known: DataFrame) -> DataFrame:
        rows = known.select("base", *_KEY, "n_bytes", "shared", "n_convs", "owner", "inner", F.explode("members").alias("member")).select("*", F.col("member.conv_id").alias("conv_id"), F.col("member.ends").alias("ends")).drop("member")
        owned = (F.col("owner") == F.col("conv_id")).cast("long")
        return rows.withColumn("owned", owned).withColumn("own_bytes", F.col("owned") * F.col("n_bytes")).withColumn("own_leaf", F.col("owned") * (~F.col("inner")).cast("long"))

    if long is None:
        rows = _below(members(known.repartition("base")))
    else:
        known = settle(known)
        some, rest = (known.join(bases, "base", how) for how in ("left_semi", "left_anti"))
        rows = _below(members(rest.repartition("base"))).unionByName(_sliced_below(members(some), length))
    sums = {"saved_tokens": F.sum(F.col("held") - F.col("kept")), "n_leaves": F.sum("leaves"), "n_children": F.sum("child")}
    told = [F.first(c).alias(c) for c in ("shared", "n_convs", "owner")]
    ends = F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("conv_id"))))  # of one family
    by_family = settle(rows.groupBy("base", *_KEY).agg(*told, F.max("parent").alias("parent"), *(v.alias(k) for k, v in sums.items()), ends.alias("ends")))
    out = [F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    private = by_family.filter("not shared").withColumn("ends_sha256", F.sha2(F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").cast("binary"), 256))
    shared = by_family.filter("shared")
    summed = shared.groupBy(*_KEY).agg(F.first("n_convs").alias("n_convs"), F.first("owner").alias("owner"), F.max("parent").alias("parent"), *(F.sum(k).alias(k) for k in sums))
    digests = _shared_digests(shared.select(*_KEY, F.explode("ends").alias("conv_id")))
    return private.select(*out).unionByName(summed.join(digests, _KEY, "left").fillna(_NONE, ["ends_sha256"]).select(*out))


def _crc32(of: str) -> str:
    """DuckDB has no crc32: the table-free form, bit by bit over the characters of a decimal."""
    step = "lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({of}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), {step})))"


#: The same in DuckDB's dialect; {turns} is the table.  A node's name is the joined digests of its turns.
SQL = rf"""
WITH turns AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, coalesce(text, '') AS text, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 40), md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM {{turns}} WHERE conv_id IS NOT NULL),
convs AS (SELECT c.conv_id, c.base, c.h, count(p.pos) AS m FROM (SELECT DISTINCT conv_id, base, {_crc32('conv_id')} % {SHARED} AS h FROM turns) c LEFT JOIN turns p ON p.conv_id = c.base AND p.pos <= c.h GROUP BY ALL),
rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, t.digest, strlen(t.text) AS n_bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, c.m + t.pos - c.h, t.digest, strlen(t.text) FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
named AS (SELECT *, string_agg(digest, '.' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS name, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM rebuilt),
nodes AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, max(n_turns) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256 FROM named GROUP BY name, depth),
below AS (
  SELECT a.name, count(*) FILTER (b.depth = a.depth + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes b ON starts_with(b.name, a.name) GROUP BY a.name)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (name) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.name = left(n.name, length(n.name) - 33)
"""
