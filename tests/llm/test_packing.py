import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleweave.llm import packing


def check(df, capacity=2048):
    """The pieces are the plain tokenizer's; sequences are whole, gapless and not too full. Returns (bins, bound)."""
    plain = Tokenizer.from_file(packing.vocabulary())
    want = []
    for r in df.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((-1 if r["doc_id"] is None else r["doc_id"], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = packing.pack_documents(df, capacity=capacity).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), packing.lower_bound(np.bincount([w[3] for w in want], minlength=capacity + 1), capacity)


def test_documents(spark):
    bins, bound = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert bins <= bound + 1


def test_edges(table, edge_rows):
    check(table([*edge_rows, (20, "it's <|endoftext|> we'll see é \x1c\x85 İ ΣΣ x" + "y" * 500)]), 64)


def test_empty(table):
    out = packing.pack_documents(table([]))
    assert out.count() == 0 and "sequence_id" in out.columns


def plain_bins(lengths, capacity):
    """The least bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= capacity and fills[k] not in fills[:k]:
                fills[k] += lengths[i]
                place(i + 1, fills)
                fills[k] -= lengths[i]
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 30))
    lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 10))))[::-1]
    bins, offsets, fills = packing.best_fit(lengths, capacity)
    least, best = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity), plain_bins(lengths.tolist(), capacity)
    assert least <= best <= len(fills) and fills.max() <= capacity and fills.sum() == lengths.sum()


def test_exchange_saves_bins(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, int(x), i) for i, x in enumerate(rng.integers(1, 900, 4000))]
    items = spark.createDataFrame(rows, "id long, piece int, length long, ids_crc32 long")
    bound = packing.lower_bound(np.bincount([r[2] for r in rows], minlength=2049), 2048)
    once = packing.pack(items, part_items=100, turns=0).select("sequence_id").distinct().count()
    more = packing.pack(items, part_items=100).select("sequence_id").distinct().count()
    assert bound <= more < once


def test_rows_that_repeat_spread_over_parts(spark):
    """A third of all items are equal in every column; parts stay of one size, and the bound is reported."""
    rows = [(None, 0, 1, 9)] * 2000 + [(i, 0, i % 1500 + 1, i) for i in range(4000)]
    items = spark.createDataFrame(rows, "id long, piece int, length long, ids_crc32 long").withColumnRenamed("id", "doc").selectExpr("*", "doc AS row")
    out = packing.pack(items, part_items=500)
    got = out.collect()
    assert out.columns == [*items.columns, "sequence_id", "offset", "least_sequences"] and len(got) == len(rows)
    bound = packing.lower_bound(np.bincount([r[2] for r in rows], minlength=2049), 2048)
    assert {r["least_sequences"] for r in got} == {bound} and len({r["sequence_id"] for r in got}) <= bound + 2
    dealt = packing._packed(items.select("length").withColumn("row", F.monotonically_increasing_id()), 12, 2048, 0).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 2 * len(rows) / 12


def test_query_itself(spark):
    out = packing.op9_packing(spark, "/root/testdata/sf0.001")
    assert out.where("piece = 0").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
