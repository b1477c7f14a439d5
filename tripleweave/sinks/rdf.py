"""The graph as N-Triples, N-Quads, Turtle and RDF/JSON, and its parts for targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import unescape_literal
from ..plans.model import Target
from ..plans.turtle import RDF
from ..scratch import delete, file_system, scratch_path

_PN_LOCAL = r"[A-Za-z0-9_][A-Za-z0-9_-]*"


def ntriples(graph: DataFrame) -> DataFrame:
    return graph.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def nquads(graph: DataFrame) -> DataFrame:
    return graph.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def shortened(token: Column, prefixes: dict[str, str]) -> Column:
    """IRI tokens by the longest prefix that leaves a plain local name."""
    out = token
    for name, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substring(token, F.lit(len(space) + 2), F.length(token) - len(space) - 2)
        out = F.when(token.startswith("<" + space) & local.rlike(f"^{_PN_LOCAL}$"), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
    return out


def _between(rows: DataFrame) -> tuple[DataFrame, Column, Column, Column, Column]:
    """rows (s, p, o and more) in order within each subject, and whether a row begins its subject, begins its predicate,
    ends its predicate, ends its subject. Rows are sorted, never gathered, so a subject of any size is written as it comes."""
    ordered = Window.partitionBy("s").orderBy("p", "o")
    around = rows.select("*", F.lag("p").over(ordered).alias("before"), F.lead("p").over(ordered).alias("after"))
    p, before, after = F.col("p"), F.col("before"), F.col("after")
    return around, before.isNull(), before.isNull() | (before != p), after.isNull() | (after != p), after.isNull()


def turtle(graph: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One row of text for each statement, in order: a subject's predicates by ; and a predicate's objects by ,. The rows
    of a subject follow each other in one partition."""
    s, p, o = (shortened(F.col(c), prefixes or {}) for c in "spo")
    verb = F.when(F.col("p") == f"<{RDF}type>", "a").otherwise(p)
    rows, new_s, new_p, last_p, last_s = _between(graph.select(s.alias("s"), verb.alias("p"), o.alias("o")).distinct())
    start = F.when(new_s, F.concat(F.col("s"), F.lit("\n    "), F.col("p"), F.lit(" "))).when(new_p, F.concat(F.lit("    "), F.col("p"), F.lit(" "))).otherwise("        ")
    return rows.select(F.concat(start, F.col("o"), F.when(last_s, " .").when(last_p, " ;").otherwise(" ,")).alias("value"))


def turtle_header(prefixes: dict[str, str], base: str | None = None) -> str:
    return "".join([f"@base <{base}> .\n"] if base else []) + "".join(f"@prefix {k}: <{v}> .\n" for k, v in prefixes.items())


def _json_value(token: Column) -> Column:
    literal = unescape_literal(F.regexp_extract(token, r'^"((?:[^"\\]|\\.)*)"', 1))
    lang = F.nullif(F.regexp_extract(token, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    kind = F.nullif(F.regexp_extract(token, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.startswith('"'), F.struct(literal.alias("value"), F.lit("literal").alias("type"), lang.alias("lang"), kind.alias("datatype"))).otherwise(F.struct(F.when(token.startswith("<") & ~token.startswith("<<"), inner).otherwise(token).alias("value"), F.when(token.startswith("<"), "uri").otherwise("bnode").alias("type"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype")))


def _bare(token: Column) -> Column:
    return F.when(token.startswith("<") & ~token.startswith("<<"), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def rdf_json(graph: DataFrame, one: bool = False) -> DataFrame:
    """{subject: {predicate: [values]}} for each subject, a row of text for each statement; the rows of a subject follow
    each other in one partition. one: subjects are members of one object, whose braces are not written here: each but
    the first begins with a comma, and partitions are in the order of subjects."""
    triples = graph.select("s", "p", "o").distinct()
    first = triples.agg(F.min("s")).first()[0] if one else None
    triples = triples.repartitionByRange("s") if one else triples
    rows, new_s, new_p, last_p, last_s = _between(triples)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")
    opened = F.when(F.col("s") == first, "").otherwise(",") if one else F.lit("{")
    start = F.when(new_s, F.concat(opened, quoted(_bare(F.col("s"))), F.lit(":{"))).when(new_p, ",").otherwise("")
    key = F.when(new_p, F.concat(quoted(_bare(F.col("p"))), F.lit(":["))).otherwise(",")
    end = F.concat(F.when(last_p, "]").otherwise(""), F.when(last_s, "}" if one else "}}").otherwise(""))
    return rows.select(F.concat(start, key, F.to_json(_json_value(F.col("o"))), end).alias("value"))


FORMATS = {"n-triples": ntriples, "ntriples": ntriples, "n-quads": nquads, "nquads": nquads, "turtle": turtle, "rdf-json": rdf_json, "rdfjson": rdf_json}


def write(graph: DataFrame, path: str, form: str = "n-triples", prefixes: dict[str, str] | None = None, single_file: bool = False, mode: str = "overwrite") -> None:
    """Text files in a folder, as many as the graph has partitions, or (single_file) one file at the path itself. Turtle
    uses whole IRIs where there are several files, so that each can be read on its own; a single file begins with its
    prefixes. RDF/JSON is an object a subject in files of a folder, and one object in a single file.

    A single file is formatted by all tasks and its parts are then copied one after the other, so no task holds it.
    """
    form = form.lower().replace("_", "-")
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}; known: {', '.join(sorted(FORMATS))}")
    if not single_file:
        FORMATS[form](graph).write.mode(mode).text(path)
        return
    head, tail = (turtle_header(prefixes or {}), "") if form == "turtle" else ("{\n", "}\n") if "json" in form else ("", "")
    lines = turtle(graph, prefixes) if form == "turtle" else rdf_json(graph, True) if "json" in form else FORMATS[form](graph)
    parts = f"{path}._parts"
    lines.write.mode("overwrite").text(parts)
    merge(graph.sparkSession, parts, path, head, tail, mode == "overwrite")


def merge(spark: SparkSession, folder: str, path: str, head: str = "", tail: str = "", overwrite: bool = True) -> None:
    """The part files of a folder, in order, as one file; the folder goes."""
    files, at = file_system(spark, path)
    if overwrite:
        files.delete(at, True)
    conf, source = spark._jsc.hadoopConfiguration(), file_system(spark, folder)[1]
    out = files.create(at, False)
    try:
        out.write(bytearray(head.encode()))
        parts = sorted(x.getPath().getName() for x in files.listStatus(source) if x.getPath().getName().startswith("part-"))
        for name in parts:
            part = files.open(spark._jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    files.delete(source, True)


def distinct_targets(targets: list[Target]) -> list[Target]:
    """Of targets of one place and serialization, the first."""
    seen: dict[tuple[str, str], Target] = {}
    for t in targets:
        seen.setdefault((t.location, t.serialization), t)
    return list(seen.values())


def write_targets(engine, folder: str, single_file: bool = False) -> dict[str, str]:
    """Each target's part of the graph under folder; the rest under `default`. Returns paths by target id.

    The mapping runs once: its distinct statements, with the place each is bound for, are written partitioned by place,
    and each place is formatted from its own partition.
    """
    targets, out = distinct_targets(list(engine.mapping.targets.values())), {}
    number = {(t.location, t.serialization): n for n, t in enumerate(targets, 1)}
    spark = engine.spark
    statements = engine.statements()
    places = F.coalesce(*[F.nullif(F.array_distinct(F.transform(F.col("t"), lambda t: F.element_at(F.create_map(*[F.lit(x) for k, v in engine.mapping.targets.items() for x in (k, number[v.location, v.serialization])]), t))), F.array().cast("array<int>"))], F.array(F.lit(0)))
    staged = scratch_path(spark)
    statements.select("s", "p", "o", "g", F.explode(places).alias("place")).dropDuplicates().write.partitionBy("place").parquet(staged)
    whole = spark.read.schema("s string, p string, o string, g string, place int").parquet(staged)
    part = lambda n: whole.where(F.col("place") == n).drop("place")
    for t in targets:
        n = number[t.location, t.serialization]
        where = t.location if t.location.startswith("/") or "://" in t.location and not t.location.startswith("http") else f"{folder}/{t.location.rstrip('/').rsplit('/', 1)[-1]}"
        write(part(n), where, t.serialization, engine.mapping.prefixes, single_file)
        out |= {x.id: where for x in engine.mapping.targets.values() if number[x.location, x.serialization] == n}
    write(part(0), f"{folder}/default", "n-quads", None, single_file)
    delete(spark, staged)
    return out
