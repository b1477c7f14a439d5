"""Exact dedup: groups of one 128-bit content hash, in which bytes are compared before rows count as equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .base import cut, fresh, hinted, own_columns, unrolled


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces are left alone, as most are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, digest), one row for each row of df.

    Rows are equal when their normalised texts are; null text is empty text, and empty texts are equal. Of equal rows
    the one with the smallest id stays; a null id stays only in a group without others. Of rows repeated with their id
    one stays. An empty table gives an empty table; other columns are neither read nor returned.

    The hash decides which rows may be equal: id, hash and SHA-256 are all that is shuffled of rows alone in their
    group. Where a hash repeats, texts are grouped by their bytes, map-side first, so a group of any size crosses the
    network as one row a task. Hashes that meet different texts (`digest` can be a weak one) are split by those bytes.
    """
    texts = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    hashed = texts.select("id", digest(F.col("text")).alias("h"), "text")
    rows = cut(hashed.select("id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).groupBy("id", "h", "sha").agg(F.count("*").alias("n")))
    groups = rows.groupBy("h").agg(F.min("id").alias("keep"), F.sum("n").alias("size"))
    repeated = hinted(cut(groups.where("size > 1")))
    by_bytes = hashed.join(repeated.select("h"), "h", "left_semi").groupBy("h", "text").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    checked = cut(by_bytes.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1"))
    if checked.isEmpty():
        placed = rows.join(repeated, "h", "left")
    else:
        apart = hinted(cut(by_bytes.join(checked.select("h"), "h", "left_semi").select("h", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "keep", "size")))
        met = rows.join(checked.select("h"), "h", "left_semi").join(apart, ["h", "sha"])
        alone = rows.join(checked.select("h"), "h", "left_anti").join(repeated, "h", "left")
        placed = alone.select("id", "h", "sha", "n", "keep", "size").unionByName(met.select("id", "h", "sha", "n", "keep", "size"))
    size = F.coalesce("size", "n")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    once = unrolled(cut(placed.select("id", "h", "sha", keep.alias("keep"), size.alias("size"), "n")), "n", "copy")
    return once.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 0)).alias("kept"), F.col("sha").alias("text_sha256"), F.col("h").alias("digest"))


def kept_rows(df: DataFrame, found: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """df without the rows of which found (id, digest, stays, rows: already cut, one row for each different pair) says
    that they go, and with one row of each pair that stays and has several. All columns as they are, whatever their
    names. What goes is broadcast only when it is small, measured in bytes; else a shuffled join takes it."""
    (key,) = fresh(df, "__digest")
    keyed = df.withColumn(key, digest)
    match = lambda side: keyed[id_col].eqNullSafe(side["id"]) & (keyed[key] == side["digest"])
    gone = hinted(cut(found.where(~F.col("stays")).select("id", "digest")))
    out = keyed.join(gone, match(gone), "left_anti")
    again = cut(found.where(F.col("stays") & (F.col("rows") > 1)).select("id", "digest"))
    if not again.isEmpty():
        again = hinted(again)
        out = out.join(again, out[id_col].eqNullSafe(again["id"]) & (out[key] == again["digest"]), "left_anti").unionByName(keyed.join(again, match(again), "left_semi").dropDuplicates([id_col, key]))
    return out.select(*own_columns(df))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all its columns as they are.

    Null text is empty text, so of all rows without text one stays; of equal rows the one with the smallest id stays, of
    rows repeated with their id one, and a row without id only where its group has no other. Long texts are compared
    whole; columns of any names pass through; an empty table gives an empty table.
    """
    found = cut(copies(df, id_col, text_col).groupBy(F.col(id_col).alias("id"), "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")))
    return kept_rows(df, found, id_col, content_hash(normalised(F.col(text_col))))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
