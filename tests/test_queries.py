"""Every query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from inkfold.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return f"{round(v, 4) + 0.0:.4f}"
        return f"{v:.4f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple("null" if r[i] is None else plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
        assert sorted(names) == sorted(df.columns)
        assert cells([tuple(r) for r in got], df.columns) == cells(rows, names)


def test_checks_return_every_request(spark):
    marks = catalogue.QUERIES["selected_values"](spark, DATA).count()
    assert catalogue.QUERIES["verify_text_checks"](spark, DATA).count() == marks == catalogue.QUERIES["assembled_selections"](spark, DATA).count()
