"""Line dedup: a log-template tree, in DataFrame operations alone.

Each line's tokens (runs without white space; a token with a digit becomes the
wildcard ``<*>``) lead it down a tree of fixed depth: its token count, then its
first ``DEPTH`` tokens.  Equal token sequences are one sequence, weighted by the
documents that hold it.  In a leaf,

* a token's support at a place is the weight of the sequences that have it there;
* a line's support is that of its k-th best supported token, where k is ``PERCENT``
  percent of its tokens (rounded up; a wildcard has support 0);
* a line's template keeps the tokens with more than half the line's support and has
  a wildcard for all others.  Both supports grow with the corpus alike, so a field
  whose values all recur is a field at any size.

A template recurs if ``MIN_DOCS`` documents hold it, the line's support is as much,
and the template's sequences weigh ``SHARE`` percent of it or more (which tells templates
from ordinary words that only happen to be frequent at their places).  All lines of a
recurring template are dropped but for its first (the least doc_id, then the least
digest of the text, then the least line number).  Lines whose template does not recur,
but whose own sequence does in as many documents, are dropped likewise; own
sequences of more than ``LONG`` tokens recur from ``LONG_DOCS`` documents on.

Rows with equal doc_id and text are one document and are cleaned alike.  No group is
ever collected: recurrence is counted with partial sums, and only a line's own tokens
are gathered, by line.  Joins on keys that a hot line, leaf or token can dominate
send the other side's rows to all tasks: all of them if they are few (counted), and
else those of the keys that many rows have, of which there is a bounded number.

Edge cases: a null text has one empty line; lines with fewer than ``MIN_TOKENS``
tokens are kept; a document may lose all lines and is then empty; very long texts
and lines are handled whole, and a task holds one text with its lines' hashes at a
time; an empty table gives no rows; null ids are ordinary values, and come first;
ties are broken as stated.  The result of ``scan`` has fixed columns; ``clean`` keeps
all columns of the input, and its own have names that no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm._join import meet
from codelode.llm._store import settle

#: Leading tokens that the tree looks at; tokens of the shortest line that is judged.
DEPTH, MIN_TOKENS = 3, 3
#: Documents in which a template recurs; tokens that a long line has more than, and documents for those.
MIN_DOCS, LONG, LONG_DOCS = 3, 50, 2
#: The percentage of a line's tokens that its support is taken from, and the percentage of it that a template weighs.
PERCENT, SHARE = 70, 1

_TOKEN = r"[^\x20\x09-\x0D]+"
_VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _masked(lines: Column) -> Column:
    """Each line's tokens, masked, with one space between two.

    One step after another, so that each is evaluated once for a line; regular expressions only see lines that call for them.
    """

    def plain(line: Column) -> Column:
        odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
        for c in "\t\v\f\r":
            odd = odd | line.contains(c)
        return F.when(odd, F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))).otherwise(line)

    def mask(line: Column) -> Column:
        return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, "<*>")).otherwise(line)

    return F.transform(F.transform(lines, plain), mask)


def _n_tokens(masked: Column) -> Column:
    return F.when(masked == "", 0).otherwise(F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1)


def _digest(text: Column) -> Column:
    """60 bits of the text's MD5, which tell the texts of one id apart and order them."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _place(masked: Column) -> Column:
    """The leaf and the whole sequence of a line, as hashes; null for a line that is too short.  A long line's leaf is odd."""
    n = _n_tokens(masked)
    leaf = F.xxhash64(n, F.substring_index(masked, " ", DEPTH)).bitwiseAND(F.lit(-2)).bitwiseOR((n > LONG).cast("long"))
    return F.when(n >= MIN_TOKENS, F.struct(leaf.alias("leaf"), F.xxhash64(masked).alias("own")))


_LEAST = f"IF(leaf & 1 = 1, {LONG_DOCS}, {MIN_DOCS})"
_LATER = "not (doc <=> first.doc and digest = first.digest and line = first.line)"


def _words(seqs: DataFrame, texts: DataFrame) -> DataFrame:
    """(own, leaf, docs, n, place, token) of the first line of each sequence, read from its text, less wildcards; a token is a hash."""
    wanted = settle(seqs.groupBy(F.col("first.doc").alias("of"), F.col("first.digest").alias("hash")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "own", "leaf", "docs")).alias("wanted")))
    found = texts.join(wanted.hint("merge"), texts["doc"].eqNullSafe(wanted["of"]) & (texts["digest"] == wanted["hash"])).select(F.split("text", "\n", -1).alias("lines"), "wanted")
    found = found.select(F.explode(F.arrays_zip("wanted", _masked(F.transform("wanted", lambda w: F.get("lines", w["line"]))).alias("masked"))).alias("w"))
    found = found.select("w.wanted.own", "w.wanted.leaf", "w.wanted.docs", "w.masked").dropDuplicates(["own"])  # a text may stand in several rows
    words = found.select("own", "leaf", "docs", F.split("masked", " ").alias("words"))
    words = words.select("own", "leaf", "docs", F.size("words").alias("n"), F.posexplode("words").alias("place", "token"))
    return words.filter("token <> '<*>'").withColumn("token", F.xxhash64("token"))


def _templates(seqs: DataFrame, texts: DataFrame) -> DataFrame:
    """(own, leaf, template, rows) of the sequences whose template can recur."""
    several = settle(seqs.groupBy("leaf").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("rows")).filter("a <> b").select("leaf", "rows"))  # where one sequence is alone its template is itself
    words = settle(_words(meet(seqs, several, ["leaf"], "left_semi"), texts))
    support = settle(words.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support"), F.count("*").alias("rows")).filter("support >= 2"))  # less is never a constant
    lined = meet(words, support, ["leaf", "place", "token"]).groupBy("own", "leaf", "docs", "n").agg(F.array_sort(F.collect_list(F.struct("place", "token", "support"))).alias("words"))
    best, k = F.sort_array(F.transform("words", lambda w: w["support"]), asc=False), F.floor((PERCENT * F.col("n") + 99) / 100).cast("int")
    lined = lined.withColumn("of_line", F.when(F.size("words") >= k, F.element_at(best, k))).filter(f"of_line >= {MIN_DOCS}")
    template = F.xxhash64(F.transform(F.filter("words", lambda w: 2 * w["support"] > F.col("of_line")), lambda w: F.struct(w["place"], w["token"])))
    lined = settle(lined.select("own", "leaf", "docs", "of_line", template.alias("template")))
    good = lined.groupBy("leaf", "template").agg(F.sum("docs").alias("weight"), F.max("of_line").alias("of_line"), F.count("*").alias("rows")).filter(f"weight >= {MIN_DOCS} and 100 * weight >= {SHARE} * of_line").select("leaf", "template", "rows")
    return meet(lined.select("own", "leaf", "template", F.col("docs").alias("rows")), settle(good), ["leaf", "template"], "left_semi")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc, digest, line) of the lines that each document loses."""
    texts = docs.select(F.col("doc_id").alias("doc"), _digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    placed = settle(texts.select("doc", "digest", F.transform(_masked(F.split("text", "\n", -1)), _place).alias("places")))
    # A template in so many documents stands in a leaf that as many reach; few lines do.
    leaves = settle(placed.select(F.explode(F.array_distinct(F.transform("places", lambda p: p["leaf"]))).alias("leaf")).filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("rows")).filter(f"rows >= {_LEAST}"))
    lines = placed.select("doc", "digest", F.posexplode("places").alias("line", "place")).select("doc", "digest", "line", "place.own", "place.leaf").filter("leaf is not null")
    lines = settle(meet(lines, leaves, ["leaf"], "left_semi").distinct())
    firsts = lines.groupBy("own", "leaf", "doc", "digest").agg(F.min("line").alias("line")).groupBy("own", "leaf").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "digest", "line")).alias("first"))
    seqs = settle(firsts)

    templates = settle(_templates(seqs, texts))
    members = meet(lines.drop("leaf"), templates, ["own"]).groupBy("leaf", "template", "doc", "digest").agg(F.min("line").alias("line"))
    recurring = settle(members.groupBy("leaf", "template").agg(F.count("*").alias("rows"), F.min(F.struct("doc", "digest", "line")).alias("first")).filter(f"rows >= {MIN_DOCS}"))
    general = settle(meet(templates, recurring, ["leaf", "template"]).select("own", "first", "rows"))
    exact = meet(seqs.filter(f"docs >= {_LEAST}").withColumnRenamed("docs", "rows"), general.drop("first"), ["own"], "left_anti").select("own", "first", "rows")
    lost = settle(general.unionByName(exact))
    return meet(lines, lost, ["own"]).filter(_LATER).select("doc", "digest", "line")


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column, of the name returned, of the lines to drop (null: none)."""
    lost = settle(recurring_lines(docs).groupBy("doc", "digest").agg(F.collect_set("line").alias("lines")))
    name = "lost"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    lost = lost.select(F.col("doc").alias(f"{name}_doc"), F.col("digest").alias(f"{name}_digest"), F.col("lines").alias(name))
    on = docs["doc_id"].eqNullSafe(lost[f"{name}_doc"]) & (_digest(docs["text"]) == lost[f"{name}_digest"])
    return docs.join(lost.hint("merge"), on, "left").drop(f"{name}_doc", f"{name}_digest"), name


def _kept(lines: Column, lost: Column) -> Column:
    return F.when(lost.isNull(), lines).otherwise(F.filter(lines, lambda _, k: ~F.array_contains(lost, k)))


def clean(docs: DataFrame, *, drop_emptied: bool = False) -> DataFrame:
    """The documents without recurring lines, with all their columns.

    drop_emptied: documents that lose their last line with a token go as well; those that had none stay.
    """
    marked, name = _cleaned(docs)
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(_kept(F.split("text", "\n", -1), F.col(name)), "\n"))
    out = marked.select(*(text.alias(c) if c == "text" else marked[c] for c in docs.columns), name)
    if drop_emptied:
        out = out.filter(F.col(name).isNull() | F.col("text").rlike(_TOKEN))
    return out.drop(name)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its lines, those dropped, and the length and digest of the text that is kept."""
    marked, name = _cleaned(docs.select("doc_id", "text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(_kept(lines, F.col(name)), "\n")
    return marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")).select("doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB's dialect, over a table of documents; {docs} is the table.
SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS digest FROM {{docs}}),
parsed AS (
  SELECT doc_id, digest, line, regexp_extract_all(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS tokens
  FROM (SELECT doc_id, digest, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM (SELECT DISTINCT doc_id, text, digest FROM docs))),
placed AS (SELECT doc_id, digest, line, tokens, len(tokens) AS n, tokens[1:{DEPTH}] AS lead, CASE WHEN len(tokens) > {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END AS least FROM parsed WHERE len(tokens) >= {MIN_TOKENS}),
seqs AS (SELECT tokens, n, lead, least, count(DISTINCT (doc_id, digest)) AS docs FROM placed GROUP BY ALL),
words AS (SELECT tokens, n, lead, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM seqs),
supports AS (SELECT n, lead, place, token, sum(docs) AS support FROM words WHERE token <> '<*>' GROUP BY ALL),
lined AS (
  SELECT w.tokens, w.n, w.lead, w.docs, list(w.token ORDER BY w.place) AS own, list(coalesce(s.support, 0) ORDER BY w.place) AS support
  FROM words w LEFT JOIN supports s ON w.n = s.n AND w.lead = s.lead AND w.place = s.place AND w.token = s.token GROUP BY w.tokens, w.n, w.lead, w.docs),
of_lines AS (SELECT *, list_reverse_sort(support)[({PERCENT} * n + 99) // 100] AS of_line FROM lined),
shaped AS (
  SELECT tokens, n, lead, docs, of_line, list_transform(range(1, n + 1), lambda k: CASE WHEN 2 * support[k] > of_line THEN own[k] ELSE '<*>' END) AS template
  FROM of_lines WHERE of_line >= {MIN_DOCS}),
heavy AS (SELECT n, lead, template FROM shaped GROUP BY ALL HAVING 100 * sum(docs) >= {SHARE} * max(of_line)),
tagged AS (SELECT p.*, s.template FROM placed p JOIN shaped s ON p.tokens = s.tokens SEMI JOIN heavy h ON s.n = h.n AND s.lead = h.lead AND s.template = h.template),
recurring AS (SELECT n, lead, template FROM tagged GROUP BY n, lead, template HAVING count(DISTINCT (doc_id, digest)) >= {MIN_DOCS}),
general AS (SELECT t.doc_id, t.digest, t.line, t.lead, t.template, t.tokens FROM tagged t SEMI JOIN recurring r ON t.n = r.n AND t.lead = r.lead AND t.template = r.template),
exact AS (
  SELECT p.doc_id, p.digest, p.line, p.tokens FROM placed p JOIN seqs s ON p.tokens = s.tokens
  ANTI JOIN general g ON p.tokens = g.tokens WHERE s.docs >= s.least),
lost AS (
  SELECT doc_id, digest, line FROM (SELECT doc_id, digest, line, row_number() OVER (PARTITION BY lead, template ORDER BY doc_id NULLS FIRST, digest, line) AS k FROM general) WHERE k > 1
  UNION ALL SELECT doc_id, digest, line FROM (SELECT doc_id, digest, line, row_number() OVER (PARTITION BY tokens ORDER BY doc_id NULLS FIRST, digest, line) AS k FROM exact) WHERE k > 1),
lost_lines AS (SELECT doc_id, digest, list(line) AS lines FROM lost GROUP BY doc_id, digest),
kept AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS lines, l.lines AS lost FROM docs d LEFT JOIN lost_lines l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.digest = l.digest),
texts AS (
  SELECT doc_id, len(lines) AS n_lines, coalesce(len(lost), 0) AS n_dropped,
    CASE WHEN lost IS NULL THEN array_to_string(lines, chr(10)) ELSE array_to_string(list_filter(lines, lambda x, k: NOT list_contains(lost, k - 1)), chr(10)) END AS kept FROM kept)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM texts
"""
