"""How definitions leave a task, and what the queries of code must find."""

import pyarrow as pa

import pytest

from codelode.operators import code
from codelode.plans import catalog, derived
from tests import fixtures

#: The files written by hand that a query was first made for.
FILES = {"ts_symbols": ("cart.ts", "odd.ts"), "js_symbols": ("cart.js", "odd.js"), "go_symbols": ("shop.go", "odd.go"), "cs_symbols": ("Shop.cs", "Odd.cs"), "ps_symbols": ("Shop.ps1", "Odd.ps1")}


def test_definitions_leave_in_small_batches():
    """One batch of many files, as large tables make them."""
    text = fixtures.FILES["Odd.cs"] + f"class Big {{ /* {'x' * 2_000} */ }}\n"
    n = 3_000
    batch = pa.RecordBatch.from_pydict({"file_path": [f"{k}.cs" for k in range(n)], "ext": [".cs"] * n, "content": [text.encode() if k % 10 else None for k in range(n)]})
    out = list(code.carved(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 5 and max(b.nbytes for b in out) < 2 << 20
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == (n - n // 10) * (len(fixtures.CODE["Odd.cs"]) + 1)
    one = [r for r in rows if r["file_path"] == "1.cs"]
    assert [(r["symbol_name"], r["kind"], r["start_line"], r["end_line"], r["code_content"]) for r in one] == code.definitions(text, "csharp")
    assert [r["seq"] for r in one] == list(range(len(one)))


@pytest.mark.parametrize("name", sorted(FILES))
def test_each_file_holds_every_form_of_definition(spark, tmp_path, name):
    """What the query found in those files it finds behind the lines of each document that has a name."""
    texts = ["one two\nthree", "x", None, "four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    form = derived.FORMS[name]
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    want = []
    for doc, names in ((0, ["one_1", "three_2"]), (3, ["four_1"])):
        path, m, at = f"src/doc_{doc}{form.extension}", len(names), len(form.head)
        for i, n in enumerate(names):
            want.append((path, form.found[0].replace("{n}", n), "function", at + i * len(form.each) + 1, at + (i + 1) * len(form.each)))
        want += [(path, n, k, eval(a), eval(b, {"m": m})) for n, k, a, b in form.above]
        at += m * len(form.each) + len(form.foot)
        for file in FILES[name]:
            want += [(path, n, k, at + a, at + b) for n, k, a, b in fixtures.CODE[file]]
            at += fixtures.FILES[file].count("\n")
    assert got == sorted(want)
