"""Graphs from streams: an extension; a mapping's row-local maps over a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.terms import Options
from ..plans.engine import Engine
from ..plans.model import Mapping
from ..sources.readers import flat


def stream_graph(mapping: Mapping, streams: dict[str, DataFrame], options: Options | None = None, time_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(s, p, o, g) of a mapping whose sources (by location) are streams with flat columns. Parents must be on the same
    row or on static tables. With time_col, repeats within the watermark's delay go, and state stays bounded by it."""
    spark = next(iter(streams.values())).sparkSession
    marked = {k: (df.withWatermark(time_col, delay) if time_col and time_col in df.columns else df) for k, df in streams.items()}
    engine = Engine(spark, mapping, options, {k: flat(df, "csv") for k, df in marked.items()})
    if not time_col:
        return engine.statements().select("s", "p", "o", "g")
    parts = []
    for m in mapping.maps.values():
        rows = engine.rows(m.source)
        found, _ = engine.row_statements(rows, m)
        quads = engine.quads(found)
        parts.append(engine.frame(rows).select(time_col, F.explode(quads).alias("q")).select(time_col, "q.s", "q.p", "q.o", "q.g"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where("s is not null and p is not null and o is not null").dropDuplicatesWithinWatermark(["s", "p", "o", "g"])
