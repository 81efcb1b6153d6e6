"""The parsers of sections and code over texts written by hand, and the rows that they call for."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.operators import code, sections
from codelode.operators.lexers import masked
from codelode.ship import ship
from codelode.sources import scan
from tests import fixtures


def files(spark, *names):
    return ship(spark).createDataFrame([(n, fixtures.FILES[n]) for n in names], "file_path string, text string")


def placed(rows):
    return sorted(tuple(r) for r in rows.select("file_path", "symbol_name", "start_line", "end_line").collect())


def test_sections(spark):
    assert placed(sections.markdown_sections(files(spark, "guide.md", "fences.md", "deep.md"))) == sorted(fixtures.MARKDOWN)
    assert placed(sections.yaml_sections(files(spark, "tool.yaml", "plain.yml"))) == sorted(fixtures.YAML)
    assert placed(sections.msbuild_sections(files(spark, "src/Shop.csproj", "Directory.Build.props", "Stamp.targets", "src/Odd.csproj"))) == sorted(fixtures.MSBUILD)
    assert placed(sections.msbuild_sections(files(spark, "Torn.csproj"))) == sorted(fixtures.MSBUILD_BROKEN)
    heads = sections.markdown_headings(files(spark, "fences.md")).select("file_path", F.explode("heads").alias("h")).select("file_path", "h.line", "h.level", "h.title")
    assert sorted(map(tuple, heads.collect())) == sorted(fixtures.FENCED)


@pytest.mark.parametrize("name", sorted(fixtures.CODE))
def test_code(spark, name):
    got = code.code_symbols(files(spark, name)).select("symbol_name", "kind", "start_line", "end_line").collect()
    assert sorted(map(tuple, got)) == sorted(fixtures.CODE[name])


#: Code after which a definition must still be found, by language.
TRAPS = {
    "bash": ["f() {\n  a=$((1<<n))\n}\n", "f() {\n  (( x <<= 2 )) && echo $(( (1<<y) + (2<<z) ))\n}\n", 'f() {\n  echo "$(echo "}" "$(echo "}")")"\n}\n', "f() {\n  cat <<E\n }\nE\n}\n"],
    "javascript": ["function f(x) {\n  if (x) /}/.test(x);\n}\n", "function f(x) {\n  while (g(x)) /[}/]}/g.exec(x);\n  y = (a + b) / 2 / c;\n}\n", "function f(x) {\n  return (x) / 2; // }/\n}\n", "function f(x) {\n  return `${ `${ '}' }` }}`;\n}\n"],
    "csharp": ['class A {\n  string f() {\n    return $"{(a ? "}" : "{")}";\n  }\n}\n', 'class A {\n  string f() {\n    return $"{{ }}}}" + $@"a""{x["}"]} \\" + @$"{b}";\n  }\n}\n', 'class A {\n  string f() {\n    return $"\\"}}{c:N2}" + "}";\n  }\n}\n'],
    "powershell": ['function f {\n  "a $(if ($x) { "}" }) b"\n}\n', 'function f {\n  "a ""} `" }" + "$($y["}"])"\n}\n', "function f {\n  '}' + \"}\" # }\n}\n"],
}
AFTER = {"bash": "g() {\n  :\n}\n", "javascript": "function g() {\n}\n", "csharp": "class g {\n}\n", "powershell": "function g {\n}\n"}


@pytest.mark.parametrize(("language", "trap"), [(k, t) for k, v in TRAPS.items() for t in v])
def test_brackets_in_strings_patterns_and_arithmetic(language, trap):
    """The trap ends where it ends, and what stands behind it is found."""
    found = {name.rpartition(".")[2]: (first, last) for name, _, first, last, _ in code.definitions(trap + AFTER[language], language)}
    lines = trap.count("\n")
    assert found["f"] == (2, lines - 1) if language == "csharp" else found["f"] == (1, lines)
    assert found["g"][0] == lines + 1
    assert len(masked(trap, language)) == len(trap) and masked(trap, language).count("\n") == lines


def test_names_and_ignore_rules(spark):
    names = ["  ## Getting   started ## ", "..\\lib\\My.Core.csproj", "Serilog.Sinks.File", "a/b c!.txt", "{urn:x}Tag", "ns:Item", "plain"]
    got = spark.createDataFrame([(n,) for n in names], "raw string").select(X.slug("raw"), X.compact_name("raw"), X.local_xml_name("raw")).collect()
    assert [tuple(r) for r in got][:4] == [("Getting started", "Getting started", "  ## Getting   started ## "), ("..\\lib\\My.Core.csproj", "My Core", "..\\lib\\My.Core.csproj"), ("Serilog.Sinks.File", "Serilog Sinks", "Serilog.Sinks.File"), ("a/b c!.txt", "b c", "a/b c!.txt")]
    assert [r[2] for r in got][4:] == ["Tag", "Item", "plain"]
    rules = scan.IgnoreRules(fixtures.IGNORE_LINES)
    ruled = spark.createDataFrame(fixtures.IGNORED, "rel string, want boolean").select("rel", "want", rules.column("rel").alias("got")).collect()
    assert all(r["want"] == r["got"] == rules.drops(r["rel"]) for r in ruled)
