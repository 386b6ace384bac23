"""Every registered query of the engine against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from driftwell.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(tuple, frame[cols].astype(str).values.tolist()))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(got)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 45
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def crossed(spark, tmp_path_factory):
    """Orders whose client copies (id + 1000000) meet ids that the client has already, and DuckDB over them."""
    folder = tmp_path_factory.mktemp("crossed")
    rows = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 1000")
    rows.unionByName(rows.withColumn("o_orderkey", rows.o_orderkey + 1_000_000)).write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["ibf_subtract", "ibf_diff", "strata_estimate"])
def test_ids_that_a_side_holds_twice(spark, crossed, name):
    folder, con = crossed
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.sql(SQL[name]).df())
