"""Every registered ledger query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(names, table):
    out = []
    for r in table:
        d = dict(zip(names, r, strict=True))
        out.append(tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for _, v in sorted(d.items())))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "events documents conversations pages embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, want.fetchall())


def test_poll_keeps_groups_of_equal_times_whole(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet").orderBy("event_id").limit(90).withColumn("n", F.row_number().over(Window.orderBy("event_id")))
    at = F.lit(catalogue.T1) + F.make_dt_interval(mins=F.when(F.col("n") <= 15, F.col("n")).when(F.col("n") <= 55, 20).otherwise(F.col("n")))
    e.withColumn("ts", at.cast(e.schema["ts"].dataType)).drop("n").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["new_turns_poll"](spark, str(tmp_path)).collect()
    assert len(got) == 55 and sorted(r.place for r in got) == [*range(1, 16), *[16] * 40]
