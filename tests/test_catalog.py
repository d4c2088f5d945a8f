"""Every registered query with SQL equals DuckDB's result on the smallest scale."""

import glob
import os

import duckdb
import pytest

from plyforge.plans import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(show(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_partitions_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 500)
    monkeypatch.setattr(views, "VOLUMES", 10)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert catalog.gcode_position(spark, SF).rdd.getNumPartitions() == -(-n // 500) > 4
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert catalog.mesh_info(spark, SF).rdd.getNumPartitions() == -(-n // 10) > 4
