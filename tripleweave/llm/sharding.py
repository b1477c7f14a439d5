"""Sharding by histogram sort: exact byte counts below candidate boundaries refine the splitters; rows move once."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import cut, hinted, own_columns

#: Three parts of a row's key have 63 bits each: hashes of the text and of the id, then a number of the row, which parts
#: rows that repeat whole. As one number: the parts one after the other.
BITS = 63
LOW = (1 << BITS) - 1
KEY = ("k1", "k2", "k3")
#: Sums that one round of the search may bring to the driver.
SUMS = 1 << 18


@dataclass
class Search:
    """Where one splitter still may be: keys from lo up to hi, `below` bytes lying under lo."""

    goal: float
    lo: int = 0
    hi: int = 1 << 3 * BITS
    below: int = 0
    at: int | None = None


def key_columns(id_col: str, text_col: str) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 1).alias("k1"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("k2"), F.monotonically_increasing_id().alias("k3")]


def parted(key: int) -> list[int]:
    """A key's parts; the end of all keys is the last of them, which no row's number reaches."""
    key = min(key, (1 << 3 * BITS) - 1)
    return [key >> 2 * BITS, key >> BITS & LOW, key & LOW]


def listed(rows: list[dict], kind: str) -> Column:
    """An array of structs as one constant."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


_KEY_KIND = "k1:bigint,k2:bigint,k3:bigint"


def place(bounds: list[int]) -> Column:
    """How many of the boundaries, in order, are at or under a row's key: a binary search, whose steps grow with the
    logarithm of their number, in one constant array."""
    if not bounds:
        return F.lit(0)
    known, key = listed([dict(zip(KEY, parted(b))) for b in bounds], _KEY_KIND), F.struct(*KEY)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= key, at + step).otherwise(at))


def splitters(keyed: DataFrame, parts: int, tolerance: float, weight: str = "size", each: int = 1) -> list[int]:
    """parts x each - 1 boundaries in key order whose sums of weights are within tolerance of a shard's mean of their
    goals, or as near as whole rows allow.

    Each round divides every splitter's range in pieces, sums the weights of each exactly, in partial sums on the
    executors, and keeps the piece with the goal. The driver sees at most about SUMS sums a round, whatever the table's
    size; the key's 189 bits bound the rounds.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    many = parts * each
    searches = [Search(total * i / many) for i in range(1, many)]
    slack = tolerance * total / parts
    fan = max(16, min(256, SUMS // max(1, many)))
    while total and (active := [s for s in searches if s.at is None]):
        ranges = sorted({(s.lo, s.hi) for s in active})
        table = []
        for lo, hi in ranges:
            # divide by the first part of the key in which more than one value is left
            level = next(k for k in (1, 2, 3) if hi - lo > 1 << BITS * (3 - k) or k == 3)
            unit = 1 << BITS * (3 - level)
            start = lo // unit & (LOW if level > 1 else -1)
            step = -(-((hi - lo) // unit) // fan)
            end = parted(hi)
            table.append({"lo": dict(zip(KEY, parted(lo))), "hi": dict(zip(KEY, end)), "level": level, "start": start, "step": step, "unit": unit})
        known = listed([{k: v for k, v in r.items() if k != "unit"} for r in table], f"lo:struct<{_KEY_KIND}>,hi:struct<{_KEY_KIND}>,level:int,start:bigint,step:bigint")
        which = place([lo for lo, _ in ranges]) - 1
        found = keyed.select(*KEY, F.col(weight).alias("weight"), which.alias("which")).where("which >= 0").withColumn("r", F.get(known, F.col("which"))).where(F.struct(*KEY) < F.col("r.hi"))
        piece = F.expr("(CASE r.level WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END - r.start) div r.step")
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in found.groupBy("which", piece.alias("piece")).agg(F.sum("weight").alias("bytes"), F.count("*").alias("rows")).collect():
            counts.setdefault(r["which"], {})[r["piece"]] = (r["bytes"], r["rows"])
        index = {r: n for n, r in enumerate(ranges)}
        for s in active:
            n = index[s.lo, s.hi]
            below, step = s.below, table[n]["step"] * table[n]["unit"]
            for piece_no, (size, rows) in sorted(counts.get(n, {}).items()):
                if below + size < s.goal:
                    below += size
                    continue
                lo, hi = s.lo + piece_no * step, min(s.hi, s.lo + (piece_no + 1) * step)
                before, after = s.goal - below, below + size - s.goal
                if min(before, after) <= slack or rows == 1 or hi - lo == 1:
                    s.at = lo if before <= after else hi
                else:
                    s.lo, s.hi, s.below = lo, hi, below
                break
            else:
                s.at = s.hi
    out: list[int] = []
    for s in searches:
        out.append(max(s.at or 0, out[-1] if out else 0))
    return out


def shards(df: DataFrame, parts: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, task_rows: int = 2_000_000) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row for each row of df: shards hold nearly equal bytes, and slots
    follow the key's order.

    A row's size is its text's UTF-8 bytes and 16. Keys order rows by hashes of text and id, so equal texts lie
    together; a group larger than a shard is cut by id, and rows that repeat whole by a number of their own, so no tie
    of any size keeps shards from being equal. Null text is empty; a null id hashes like any value. An empty table gives
    an empty table; other columns are neither read nor returned. Where shards have over task_rows rows, the table is cut
    by row counts in ranges of the key, and each shard is numbered range by range.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = cut(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), *key_columns(id_col, text_col)))
    placed = keyed.withColumn("shard", place(splitters(keyed, parts, tolerance)).cast("int"))
    most = placed.groupBy("shard").agg(F.count("*").alias("rows")).agg(F.max("rows"), F.sum("rows")).first()
    row = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*KEY)).cast("long") - 1
    if (most[0] or 0) <= task_rows:
        numbered = placed.withColumn("slot", row("shard"))
    else:
        ranges = splitters(keyed.select(*KEY, F.lit(1).alias("one")), -(-most[1] // task_rows), 0.25, "one")
        placed = placed.withColumn("sub", place(ranges))
        counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("rows"))
        start = F.sum("rows").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
        starts = hinted(cut(counts.select("shard", "sub", F.coalesce(start, F.lit(0)).alias("start"))))
        numbered = placed.withColumn("row", row("shard", "sub")).join(starts, ["shard", "sub"]).withColumn("slot", F.col("row") + F.col("start"))
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(df: DataFrame, path: str, parts: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, shard_col: str = "shard", task_bytes: int = 1 << 30) -> list[int]:
    """Write df, all its columns, as one folder a shard, rows in key order within a file, with one exchange of the rows
    straight to the task that the exact splitters name. A shard of over task_bytes is cut by further splitters and written
    by as many tasks. shard_col must not be a column of df. Returns the boundaries of shards.

    The row numbers that part rows repeated whole are those of this reading of df; which of such rows goes where does
    not matter.
    """
    if shard_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {shard_col}")
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 16).cast("long")
    keyed = cut(df.select(size.alias("size"), *key_columns(id_col, text_col)))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (parts * task_bytes)))
    fine = splitters(keyed, parts, tolerance, each=each)
    moved = df.select(F.struct(*own_columns(df)).alias("row"), *key_columns(id_col, text_col)).withColumn("task", place(fine))
    dealt = moved.repartitionById(parts * each, F.col("task").cast("int")).sortWithinPartitions("task", *KEY)
    dealt.select("row.*", F.floor(F.col("task") / F.lit(each)).cast("int").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
    return fine[each - 1 :: each]


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
