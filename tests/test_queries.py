"""Every query with SQL against DuckDB; the others for their rows."""

import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int | float | decimal.Decimal):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(float(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in got.fetchall())


def test_rollup_of_scores_on_edges(spark, tmp_path):
    """Scores on the edges of coarse bins, where fine bins round to the other side."""
    edges = [-0.66, -0.54, -0.32, 0.16, 0.36, 0.84, 0.86, 0.0, 1.0, -1.0]
    rows = [(0, [1.0] + [0.0] * 63, 0)] + [(i + 1, [x] + [0.0] * (i + 8) + [1.0] + [0.0] * (54 - i), 0) for i, x in enumerate(edges)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(SQL["agg_hist_rollup"]).fetchall())
    assert sorted(map(tuple, QUERIES["agg_hist_rollup"](spark, str(tmp_path)).collect())) == want
