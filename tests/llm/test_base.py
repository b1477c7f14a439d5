"""Helpers of the operators: measured broadcasts, written tables, rows that stand for many."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripleweave.llm import base


def test_sides_are_measured_in_bytes(spark):
    """Few rows of long texts are no small side."""
    short = base.cut(spark.range(100).select("id", F.lit("x").alias("t")))
    long = base.cut(spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("t")))
    assert base.memory_bytes(short) < 10_000 and 1_000_000 < base.memory_bytes(long) < 1_100_000
    hint = lambda df: "ResolvedHint" in base.hinted(df, 100_000)._jdf.queryExecution().analyzed().toString()
    assert hint(short) and not hint(long)
    lists = base.cut(spark.range(3).select(F.sequence(F.lit(1), F.lit(1000)).alias("l")))
    assert base.memory_bytes(lists) > 30_000 and base.memory_bytes(base.cut(spark.range(0))) == 0


def test_written_tables_go(spark):
    df = base.cut(spark.range(5))
    path = Path(df._cut_path.removeprefix("file://"))
    assert path.is_dir() and df.count() == 5
    base.uncut(df, spark.range(3))
    assert not path.exists()


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_rows_are_unrolled_in_chunks(spark, chunk):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 3), ("d", 7)], "k string, n long")
    got = sorted((r["k"], r["at"]) for r in base.unrolled(df, "n", "at", chunk).collect())
    assert got == sorted((k, i) for k, n in (("a", 1), ("b", 10), ("c", 3), ("d", 7)) for i in range(n))


def test_names_never_clash(spark):
    df = spark.range(1).select(F.col("id").alias("__X"), F.col("id").alias("__x_"))
    assert base.fresh(df, "__x", "__x", "y") == ["__x__", "__x___", "y"]
    odd = spark.range(1).select(F.col("id").alias("a.b"), F.col("id").alias("c`d"))
    assert odd.select(*base.own_columns(odd)).columns == ["a.b", "c`d"]


def test_session_settings_are_lowered_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for now, want in (("100", "100"), ("10000", "2000"), ("0", "2000")):
            spark.conf.set(key, now)
            base.arrow_bounds(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key)
