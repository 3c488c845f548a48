"""Every registered query against its SQL in DuckDB, or against a property where SQL has none."""

import os

import duckdb
import pytest

from grainmill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_capped_greedy_keeps_its_caps(spark, small):
    got = registry.QUERIES["capped_greedy_select"](spark, small).toPandas()
    assert len(got) and got.groupby("lang").size().max() <= 40 and got.groupby("source").size().max() <= 9
    alone = registry.QUERIES["capped_greedy_select"](spark, small).toPandas()
    assert sorted(got.doc_id) == sorted(alone.doc_id)


def test_dbscan_by_brute_force(spark):
    from grainmill.operators.geometry import dbscan

    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (5, 5), (5, 6), (6, 5), (20, 20), (1, 2)])]
    got = dict(dbscan(spark.createDataFrame(points, "k long, x double, y double"), "k", ["x", "y"], 1.0, 3).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: None, 7: None}


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists("/root/testdata/sf0.001")


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from grainmill.functions import scalar as fn

    one = spark.range(1)
    turn = lambda d: one.select(fn.signed_turn(F.lit(d))).first()[0]
    assert [turn(d) for d in (190, 180, -180, 0, 540)] == [-170, 180, 180, 0, 180]
    assert one.select(fn.sector(F.lit(0.0), F.lit(1.0))).first()[0] == "N"
    assert one.select(fn.answer_of(F.lit("x <answer> 4 </answer>"))).first()[0] == "4"
    assert one.select(fn.answer_of(F.lit("<answer>1</answer><answer>2</answer>"))).first()[0] is None
    a = F.array(*(F.lit(i) for i in range(63)))
    assert one.select(fn.evenly(a, 32)).first()[0] == [k * 62 // 31 for k in range(32)]
    assert one.select(fn.increasing(a), fn.increasing(F.array(F.lit(1), F.lit(1)))).first()[:] == (True, False)
    assert one.select(fn.within(F.lit(105), F.lit(100), 5), fn.within(F.lit(1), F.lit(0), 5)).first()[:] == (True, False)
    assert one.select(fn.half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_point_triangle_distance_by_sampling(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from grainmill.operators.geometry import point_triangle_squared

    rng = np.random.default_rng(3)
    cases = rng.normal(size=(60, 12))
    cases[0, 3:12] = np.tile(cases[0, 3:6], 3)  # no area, no length
    cases[1, 9:12] = (cases[1, 3:6] + cases[1, 6:9]) / 2  # three points of a line
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cases)], "i long, " + ", ".join(f"c{j} double" for j in range(12)))
    cols = [[F.col(f"c{j}") for j in range(k, k + 3)] for k in (0, 3, 6, 9)]
    got = dict(df.select("i", point_triangle_squared(*cols)).collect())
    u, v = np.meshgrid(np.linspace(0, 1, 401), np.linspace(0, 1, 401))
    u, v = u[u + v <= 1.0000001], v[u + v <= 1.0000001]
    for i, r in enumerate(cases):
        p, a, b, c = r.reshape(4, 3)
        near = ((a + u[:, None] * (b - a) + v[:, None] * (c - a) - p) ** 2).sum(1).min()
        assert got[i] <= near + 1e-9 and abs(got[i] ** 0.5 - near**0.5) < 0.02


def test_document_check_reads_any_segment_and_count(spark, tmp_path):
    segments = {"BUILDING": 11, "AUTOMOBILE": 1, "a|b": 10, " pad ": 2, "": 3, "two\nlines": 1, "(none)": 4, "0x0": 12, None: 2}
    spark.createDataFrame([(s, 1.5) for s, n in segments.items() for _ in range(n)], "c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.s: (r.n_ok, r.found) for r in registry.QUERIES["document_check"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == {s: (ok, found) for s, ok, found in con.execute(registry.ORACLE_SQL["document_check"]).fetchall()}
