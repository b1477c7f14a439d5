"""Mixing sources to target weights by a curriculum whose weights vary over training time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import cut, fresh, hinted, own_columns, unrolled

#: A schedule: (training time from 0 to 1, relative weight) knots, linear between them. Sources take them in turn.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """How many runs of other than white space a text has; null has none."""
    single = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    return F.when(single == "", F.lit(0)).otherwise(F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit(""))) + 1).cast("long")


def inverted(schedule: Schedule, part: Column) -> Column:
    """The training time by which a source has had `part` (0 to 1) of its tokens: the integral of its weight,
    quadratic between knots, inverted piece by piece."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    whole = sum(areas)
    out, done = F.lit(float(schedule[-1][0])), whole
    for (t0, w0), (t1, w1), area in reversed(list(zip(schedule, schedule[1:], areas))):
        done -= area
        more = part * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        time = F.lit(t0) + (more / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * more, F.lit(0.0))) - F.lit(w0)) / F.lit(slope))
        out = F.when(more < F.lit(area), time).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size): share x all tokens by weight, none above
    cap x its size. Sources are as few as the table has; what is over a cap is reshared among the others, which is to
    find the one level at which weight x level, held to the caps, sums to the whole."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("turn", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("turn", F.lit(len(weights))).cast("int") + 1)
    capped = ranked.withColumn("weight", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(everything))
    before = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level)
    met = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "turn", "level"))).over(everything)["level"]
    return levels.withColumn("met", met).select("source", "source_size", "turn", F.when(F.col("met").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("met") * F.col("weight"))).alias("target"))


def order_key(id_col: str, text_col: str) -> Column:
    """Where a row stands in its source's stream: the MD5 of its id and its text's MD5, so that neither an id nor a text
    of many rows makes a hot range; only rows of one id and one text share it."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))


#: A range of order keys holds about so many different rows; ranges are summed in groups of 16 ** GROUP at most.
RANGE_ROWS, GROUP = 256, 3


def _placed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """(source, turn, id, size, order, n, source_size, target, before): each different row of df and how many times (n) it is there, with
    the words of its source that come before it; and the sources' targets. Both are written tables."""
    each = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), order_key(id_col, text_col).alias("order"))
    rows = cut(each.groupBy("source", "id", "size", "order").agg(F.count("*").alias("n")))
    known = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    digits = max(1, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16)))
    few = hinted(known)
    placed = rows.join(few, rows["source"].eqNullSafe(few["source"])).select(rows["source"], "turn", "id", "size", "order", "n", "source_size", "target", F.substring("order", 1, digits).alias("range"))
    earlier = lambda column, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # sums of ranges, then of their groups, and of groups of groups: no window has more than 16 ** GROUP rows of a source
    starts = cut(placed.groupBy("turn", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    start, level, length = starts.select("turn", "range", F.lit(0).cast("long").alias("start")), starts, digits
    while length > 0:
        group = max(0, length - GROUP)
        at = level.select("turn", "range", "words", F.substring("range", 1, group).alias("group"))
        inside = hinted(cut(at.select("turn", F.col("range").alias("upto"), earlier("words", "turn", "group", ["range"]).alias("more"))))
        start = start.join(inside, (start["turn"] == inside["turn"]) & (F.substring(start["range"], 1, length) == inside["upto"])).select(start["turn"], "range", (F.col("start") + F.col("more")).alias("start"))
        level, length = cut(at.groupBy("turn", F.col("group").alias("range")).agg(F.sum("words").alias("words"))), group
    start = hinted(cut(start))
    within = earlier(F.col("size") * F.col("n"), "turn", "range", ["order", "id", "size"])
    out = placed.withColumn("within", within).join(start, ["turn", "range"])
    return cut(out.select("source", "turn", "id", "size", "order", "n", "source_size", "target", (F.col("start") + F.col("within")).alias("before"))), known


def _middle(copy: Column) -> Column:
    """Where the middle word of a row lies in its source's stream; copy tells rows of one key apart, from 0."""
    return (F.col("before") + F.col("size") * copy).cast("double") + F.col("size") / F.lit(2.0)


def _times(schedules: Sequence[Schedule], cap: float) -> Column:
    """The training times of the copies of a row whose middle word lies at `middle` in its source's stream: of each epoch
    that reaches it under the target, where the source's integrated schedule has had so much."""
    times = []
    for e in range(math.ceil(cap)):
        at = F.col("middle") + F.col("source_size") * F.lit(float(e))
        one = F.when((F.col("size") > 0) & (at <= F.col("target")), at)
        part, time = one / F.col("target"), F.lit(None).cast("double")
        for n, schedule in enumerate(schedules):
            time = F.when(F.pmod("turn", F.lit(len(schedules))) == n, inverted(schedule, part)).otherwise(time)
        times.append(F.when(one.isNotNull(), time))
    return F.filter(F.array(*times), lambda x: x.isNotNull())


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """(id, size, source_size, target, copies, taken, positions, after), one row for each row of df.

    Sizes are words. Each source is a stream in the order of order_key(), repeated without end; it gives documents whole
    while half of the next still lies under its target, so it ends within half a document of it. With targets up to
    cap x a source's size, no document is taken more than ceil(cap) times. positions holds a training time between 0
    and 1 for each copy: where the source's integrated schedule reaches the copy's middle word.

    Null text has no words; a null source is a source of its own, last in turn; rows of one id are rows of their own,
    told apart by their texts; rows that share id, text and source are counted once with their number before anything is
    sorted, and each of them has its own place. An empty table gives an empty table; other columns are neither read nor
    returned. Nothing depends on how rows are dealt, so reruns agree. Places are found by sums of ranges of the order,
    level by level, then within a range, so that a source with most of the rows is spread over many tasks.
    """
    placed, _ = _placed(df, id_col, text_col, source_col, weights, share, cap)
    rows = unrolled(placed, "n", "copy").withColumn("middle", _middle(F.col("copy")))
    found = rows.withColumn("positions", _times(schedules, cap))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", F.size("positions").alias("copies"), (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions", (F.lit(1.0) + F.col("middle") / (F.col("source_size") + 1)).alias("after"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by their first position; those the mix leaves out follow."""
    return mixed.orderBy(F.coalesce(F.get("positions", F.lit(0)), F.col("after")))


def taken_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """df as the mix takes it, in training order: each row as many times as it has copies, all columns as they are, and
    each copy at its own training time, which is that of mix(): where the source's integrated schedule reaches the copy's
    middle word. Rows are range-sorted by it, so files written of them follow each other in training time.

    What an epoch takes of a source is the beginning of its stream, so rows whose order key comes after all that the first
    epoch takes go before anything moves. The others are joined with their times by source and key, then sorted. Rows that
    share id, text and source also share their key; they are numbered, and each has the place of its number.

    Rows without words are never taken; a null source is a source; rows of one id are judged each by its text; columns of any
    names pass through; an empty table gives an empty table. Ties in time go by source, then by key.
    """
    placed, known = _placed(df, id_col, text_col, source_col, weights, share, cap)
    started = placed.withColumn("middle", _middle(F.lit(0))).where((F.col("size") > 0) & (F.col("middle") <= F.col("target")))
    ends = started.groupBy("turn").agg(F.max("order").alias("last"))
    key, source, turn, last = fresh(df, "__order", "__source", "__turn", "__last")
    cuts = hinted(cut(known.join(ends, "turn").select(F.col("source").alias(source), F.col("turn").alias(turn), F.col("last").alias(last))))
    keyed = df.withColumn(key, order_key(id_col, text_col))
    reached = keyed.join(cuts, keyed[source_col].eqNullSafe(cuts[source])).where(F.col(key) <= F.col(last))
    rows = reached.select(F.struct(*own_columns(df)).alias("row"), F.col(turn).alias("turn"), F.col(key).alias("order"))
    at = ["order", "turn"]
    single, repeated = started.where("n = 1").select(*at, _times(schedules, cap).alias("times")), started.where("n > 1")
    if repeated.isEmpty():
        timed = rows.join(single, at)
    else:
        keys = hinted(cut(repeated.select(*at)))
        each = unrolled(repeated, "n", "place").withColumn("middle", _middle(F.col("place"))).select(*at, "place", _times(schedules, cap).alias("times"))
        some = _numbered(cut(rows.join(keys, at)), at)
        timed = rows.join(keys, at, "left_anti").join(single, at).unionByName(some.join(each, [*at, "place"]).select(*at, "row", "times"))
    return timed.withColumn("time", F.explode("times")).orderBy("time", "turn", "order").select("row.*")


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """df, already cut, with the place of each row among those of its group, counted by file part: no group is sorted in
    one task."""
    marked = df.withColumn("mark", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mark", 33))
    counts = marked.groupBy(*by, "part").agg(F.count("*").alias("rows"))
    start = F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = hinted(cut(counts.select(*by, "part", start.alias("start"))))
    at = F.row_number().over(Window.partitionBy(*by, "part").orderBy("mark")) - 1
    return marked.withColumn("at", at).join(starts, [*by, "part"]).withColumn("place", F.col("start") + F.col("at"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = in_training_order(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"), F.get("positions", F.lit(1)).alias("second_position"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || md5(coalesce(text, ''))) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS whole FROM r),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, (cap / weight, turn)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, l.source_size, l.turn, CASE WHEN m.level IS NULL THEN l.cap ELSE least(l.cap, m.level * l.weight) END AS target FROM l LEFT JOIN m ON TRUE),
p AS (SELECT d.doc_id, d.size, t.source_size, t.turn, t.target,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY t.turn ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN size > 0 AND middle <= target THEN middle / target END AS f1,
             CASE WHEN size > 0 AND middle + source_size * 1.0::DOUBLE <= target THEN (middle + source_size * 1.0::DOUBLE) / target END AS f2 FROM p),
u AS (SELECT doc_id, size, source_size, target, turn % 3 AS k, f1, f2 FROM e),
v AS (SELECT doc_id, size, source_size, target, CAST(size * ((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT) AS BIGINT) AS taken, {one} AS first_position, {two} AS second_position FROM u)
SELECT * FROM v
"""


def _position_sql(part: str) -> str:
    """inverted() for the default schedules, as SQL."""
    def of(schedule: Schedule) -> str:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
        whole = sum(areas)
        done, cases = whole, []
        for (t0, w0), (t1, w1), area in reversed(list(zip(schedule, schedule[1:], areas))):
            done -= area
            more = f"({part} * {whole!r}::DOUBLE - {done!r}::DOUBLE)"
            slope = (w1 - w0) / (t1 - t0)
            time = f"{t0!r}::DOUBLE + " + (f"{more} / {w0!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {more}, 0.0::DOUBLE)) - {w0!r}::DOUBLE) / {slope!r}::DOUBLE")
            cases.insert(0, f"WHEN {more} < {area!r}::DOUBLE THEN {time}")
        return f"CASE {' '.join(cases)} ELSE {float(schedule[-1][0])!r}::DOUBLE END"

    return f"CASE WHEN {part} IS NULL THEN NULL " + " ".join(f"WHEN k = {n} THEN {of(s)}" for n, s in enumerate(SCHEDULES)) + " END"


OP2_SQL = OP2_SQL.format(one=_position_sql("f1"), two=_position_sql("f2"))
