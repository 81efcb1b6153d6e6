"""Source and definition files that Spark derives from documents, and what their parsers must find, as DuckDB SQL.

A document's names are the first tokens of its lines, each with its number, so that all are different.
A file is a head, a few lines for each name, and a foot; some have code written by hand behind that, with every form of definition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions import text as X
from codelode.plans.samples import SAMPLES


@dataclass(frozen=True)
class Form:
    """Lines of a file; {n} is a name, {i} its number and {d} the document's id.  found: what the parser must find for a
    name (name, kind, first and last line of the lines for it); above: the same for the file, where m counts its names.
    tail: texts behind the foot, and what the parser must find in each, by its own lines."""

    extension: str
    head: tuple[str, ...]
    each: tuple[str, ...]
    foot: tuple[str, ...]
    found: tuple[str, str, int, int]
    above: tuple[tuple[str, str, str, str], ...] = ()
    tail: tuple[tuple[str, tuple[tuple[str, str, int, int], ...]], ...] = ()


FORMS = {
    "py_symbols": Form(".py", ("class Doc:",), ("    def {n}(self):", "        return '}}' # {i}"), (), ("Doc.{n}", "function", 1, 2), (("Doc", "class", "1", "1 + 2 * m"),)),
    "rust_symbols": Form(".rs", ("struct Doc;", "impl Doc {"), ("    fn {n}<'a>(&self, x: &'a str) -> u32 {", "        let s = r#\"}\"#; // }", "        {i}", "    }"), ("}",), ("Doc.{n}", "function", 1, 4), (("Doc", "class", "1", "1"),)),
    "bash_symbols": Form(".sh", ("#!/bin/bash",), ("{n}() {", '  echo "}" $((1 << {i}))', "}"), (), ("{n}", "function", 1, 3)),
    "ts_symbols": Form(".ts", ("export class Doc {",), ("  {n}(x: string): number {", "    if (x) /}/.test(x);", "    return `}${ {i} }`.length;", "  }"), ("}",), ("Doc.{n}", "function", 1, 4), (("Doc", "class", "1", "2 + 4 * m"),)),
    "js_symbols": Form(".js", ("class Doc {",), ("  {n}(x) {", "    while (x) /}/.test(x);", "    return `}${ {i} }`;", "  }"), ("}",), ("Doc.{n}", "function", 1, 4), (("Doc", "class", "1", "2 + 4 * m"),)),
    "go_symbols": Form(".go", ("package doc", "", "type Doc struct {", "\tsize int", "}"), ("func (d *Doc) {n}() string {", "\treturn `}` // } {i}", "}"), (), ("{n}", "function", 1, 3), (("Doc", "class", "3", "5"),)),
    "cs_symbols": Form(".cs", ("public class Doc", "{"), ("    public string {n}(bool a)", "    {", '        return $"{(a ? "}" : "{")}{i}"; // }', "    }"), ("}",), ("Doc.{n}", "function", 1, 4), (("Doc", "class", "1", "3 + 4 * m"),)),
    "ps_symbols": Form(".ps1", (), ("function {n} {", '  "a $(if ($x) { "}" }) {i}"', "}"), (), ("{n}", "function", 1, 3)),
    "yaml_sections": Form(".yaml", ("# of a document", "name: 'Doc {d}'"), ("{n}:", "  - {i}"), (), ("Doc {d}.{n}", "section", 1, 2), (("Doc {d}.name", "section", "2", "2"),)),
    "msbuild_sections": Form(".csproj", ("<Project>",), ("  <PropertyGroup>", "    <{n}>{i}</{n}>", "  </PropertyGroup>"), ("</Project>",), ("doc_{d}.PropertyGroup.{n}", "section", 1, 3)),
}


FORMS |= {name: replace(FORMS[name], tail=tail) for name, tail in SAMPLES.items()}


def names(docs: DataFrame) -> DataFrame:
    """(doc_id, names) of documents that have a name."""
    found = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_extract(x, X.EMBED_TOKEN, 0)), lambda x: x != "")
    return docs.select("doc_id", F.transform(found, lambda x, i: F.concat(x, F.lit("_"), (i + 1).cast("string"))).alias("names")).filter("size(names) > 0")


def _filled(line: str, n: Column | None, i: Column | None) -> Column:
    """A line of a form as a column."""
    known = {"{n}": n, "{i}": None if i is None else (i + 1).cast("string"), "{d}": F.col("doc_id").cast("string")}
    parts, rest = [], line
    while rest:
        at, key = min(((rest.find(k), k) for k in known if known[k] is not None and k in rest), default=(len(rest), ""))
        parts += [F.lit(rest[:at])] * bool(at) + ([known[key]] if key else [])
        rest = rest[at + len(key) :]
    return F.concat(*parts) if parts else F.lit("")


def files(docs: DataFrame, extension: str, head: tuple[str, ...], each, foot: tuple[str, ...], tail: str = "") -> DataFrame:
    """(file_path, text) of files in a form; each: lines, or a function of name and number to an array of lines; tail: a text behind the foot."""
    lines = each if callable(each) else lambda n, i: F.array(*(_filled(x, n, i) for x in each))
    whole = F.flatten(F.transform("names", lines))
    before, after = (F.array(*(_filled(x, None, None) for x in part)) if part else F.array().cast("array<string>") for part in (head, foot))
    path = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(extension))
    return names(docs).select(path.alias("file_path"), F.concat(F.array_join(F.concat(before, whole, after), "\n"), F.lit("\n" * bool(tail) + tail)).alias("text"))


def formed(docs: DataFrame, form: Form) -> DataFrame:
    return files(docs, form.extension, form.head, form.each, form.foot, "".join(text for text, _ in form.tail))


#: The names in DuckDB's dialect: a row for each, with its number and how many its document has.
NAMED = r"""named AS (
  SELECT doc_id, i, raw || '_' || i AS name, raw, count(*) OVER (PARTITION BY doc_id) AS m FROM (
    SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
      SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '[A-Za-z_][A-Za-z0-9_]+'))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE raw <> ''))"""


def _text(template: str) -> str:
    return "'" + template.replace("{n}", "' || name || '").replace("{d}", "' || doc_id || '") + "'"


def sql(form: Form, kind: bool) -> str:
    """What the parser must find in all files of a form."""
    name, own, first, last = form.found
    path, place = f"'src/doc_' || doc_id || '{form.extension}'", f"{len(form.head)} + (i - 1) * {len(form.each)}"
    columns = lambda n, k, a, b: f"{path} AS file_path, {_text(n)} AS symbol_name, " + f"'{k}' AS kind, " * kind + f"{a} AS start_line, {b} AS end_line"
    parts = [f"SELECT {columns(name, own, f'{place} + {first}', f'{place} + {last}')} FROM named"]
    parts += [f"SELECT {columns(*above)} FROM named WHERE i = 1" for above in form.above]
    begin = len(form.head) + len(form.foot)
    for text, rows in form.tail:
        values = ", ".join(f"('{n}', '{k}', {begin + a}, {begin + b})" for n, k, a, b in rows)
        parts.append(f"SELECT {path} AS file_path, s.symbol_name, {'s.kind, ' * kind}{len(form.each)} * m + s.first AS start_line, {len(form.each)} * m + s.last AS end_line FROM named, (VALUES {values}) AS s(symbol_name, kind, first, last) WHERE i = 1")
        begin += text.count("\n")
    return f"WITH {NAMED} {' UNION ALL '.join(parts)}"
