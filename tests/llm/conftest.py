import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names an operator might use itself.
CLASHING = ["__digest", "__order", "__source", "__turn", "__last0", "id", "size", "h", "rows", "shard", "kept", "fp", "start", "kind", "media", "order", "root", "row"]


@pytest.fixture
def table(spark):
    """documents from (doc_id, text[, source[, lang]]) tuples, with columns of clashing names."""

    def make(rows):
        whole = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(whole, DOCUMENT)
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])

    return make


@pytest.fixture
def edge_rows():
    """Nulls, empty and long texts, ties, rows repeated whole."""
    long = "word " * 30_000
    return [(1, None, None, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (5, "one  two"), (None, "one two"), (None, None), (6, long), (7, long), (8, "ünïcode ß 漢字 🙂 text"), (9, "!!! 123")]


@pytest.fixture(autouse=True)
def few_jobs(spark):
    """Small tables need no new plan after each exchange; the registered queries run with it."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
