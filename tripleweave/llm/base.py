"""Helpers shared by the training-data operators.

Conventions that hold for all of them:

* an operator names its id and text columns and reads no other column, so extra columns,
  whatever their names, never clash with its own;
* it returns its own columns beside the id, one row for each input row unless it says otherwise;
* null text is empty text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows and bytes of one Arrow batch at most, so that a Python worker's memory does not grow with the table.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: A side is broadcast by hint only when its rows, measured, take at most so many bytes in memory.
BROADCAST_BYTES = 16 << 20
#: What a row costs in a hash table beside its values.
ROW_BYTES = 48
#: White space as the contracts have it.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of its own only in local mode without a setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="tripleweave-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor
    costs no more than the reading of a file. The table goes with uncut(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tripleweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            files, at = _path(df.sparkSession, path)
            files.delete(at, True)


def _width(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 16 + 16
    return F.lit(16 if isinstance(kind, T.DecimalType) else 8)


def memory_bytes(df: DataFrame) -> int:
    """What the rows of df, already cut, take in a hash table: lengths of texts and lists are summed, not guessed."""
    widths = [_width(f.name, f.dataType) for f in df.schema.fields]
    found = df.agg(F.count("*").alias("n"), *[F.sum(w.cast("long")).alias(f"w{k}") for k, w in enumerate(widths)]).first()
    return found["n"] * ROW_BYTES + sum(x or 0 for x in found[1:])


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, already cut, with a broadcast hint if it is small in memory; else a shuffled join takes it."""
    return F.broadcast(df) if memory_bytes(df) <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, changed where df has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def file_order(df: DataFrame) -> Column:
    """A number that rises, with gaps, in the order in which df was written: by the part number of a row's file, then by its
    place in the file. Reading deals files by size, so the order of partitions is not it; df that was read from no files
    has no other."""
    try:
        file = df.metadataColumn("_metadata")
        df.select(file["row_index"])
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.regexp_extract(file["file_name"], pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"^part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)[.]"), 34) + file["row_index"]


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unrolled(df: DataFrame, count: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """df with a row for each number from 0 up to column count, in the column name. A row that stands for more than
    chunk is dealt over tasks in chunks before it is unrolled."""
    last = F.col(count) - 1
    few = df.where(F.col(count) <= chunk).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = df.where(F.col(count) > chunk).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(chunk).cast("long"))))
    if df.where(F.col(count) > chunk).isEmpty():
        return few
    many = parts.repartition(F.col(name), *own_columns(df)[:1]).withColumn(name, F.explode(F.sequence(F.col(name), F.least(last, F.col(name) + (chunk - 1)))))
    return few.unionByName(many)


def arrow_bounds(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes in this session. The settings are read when a plan
    runs, so they stay; they are lowered, never raised."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.sub(r"[bB]$", "", str(spark.conf.get(key)))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns under fixed names, null text as empty text."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def per_text(df: DataFrame, work, fields: list[T.StructField], id_col: str, text_col: str) -> DataFrame:
    """mapInArrow over (id, text): work takes the UTF-8 texts of a batch and gives a list for each of fields."""
    arrow_bounds(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: What the span operators return for each finding; start and end count code points, end exclusive.
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])


def joined_spans(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined in the order given."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digests(found: DataFrame, id_col: str, base_kinds: list[str], more_kinds: list[str]) -> DataFrame:
    """Counts by kind, the SHA-256 of the base spans, and all spans and their scores as text, in one order."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["rank"] < len(base_kinds))
    return found.select(id_col, *map(count, base_kinds), F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"), *map(count, more_kinds), F.array_join(F.transform("findings", lambda x: F.round(x["score"], 3).cast("string")), ",").alias("scores"))
