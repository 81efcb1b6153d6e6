"""Every catalogue query against its DuckDB oracle, on the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from codelode.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    said = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == order
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in said.fetchall())
    assert got == want


def test_symbols_of_documents_that_share_a_path(spark, tmp_path):
    """Both plans agree, and rows with one path are merged across documents."""
    from codelode.operators.reconcile import last_wins
    from codelode.plans import corpus_view

    rows = [(1, "a b\n\nb x\na y\na z\nlast a", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "one", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    narrow, wide = corpus_view._last_of_each(docs), last_wins(corpus_view.extracted(docs)).drop("seq")
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
    assert narrow.columns == wide.columns and sorted(narrow.collect()) == sorted(wide.collect())
    docs.unionByName(spark.createDataFrame([(1, "a b\nother", "en", "s")], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_view.symbols(spark, str(tmp_path)).collect()
    assert len({r["id"] for r in found}) == len(found)
