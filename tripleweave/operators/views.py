"""Logical views: fields, nested rows and joins over a source, as a flat DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from ..plans.model import Field, JoinCondition, TermMap, View
from ..sources.paths import segments, xpath_segments
from ..sources.readers import Rows, _column, flat, iterate, read
from .terms import Terms, references

#: A CSV line's cells: commas outside of quotes.
_CELLS = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def row_index(df: DataFrame, name: str = "#") -> DataFrame:
    """df with the 0-based place of each row as text, in the order of reading: places within partitions, and the sums
    of the partitions before, of which there is one row a partition."""
    mark = df.withColumn("__mark", F.monotonically_increasing_id())
    part = F.shiftright("__mark", 33)
    counts = mark.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    starts = counts.select("__part", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    joined = mark.join(F.broadcast(starts), part == F.col("__part"))
    place = F.col("__start") + F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, place.cast("string")).drop("__mark", "__part", "__rows", "__start")


def flatten_struct(df: DataFrame) -> DataFrame:
    """Struct columns as one column a field, named column.field; one level."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [_column(f.name).getField(x.name).alias(f"{f.name}.{x.name}") for x in f.dataType.fields]
        else:
            out.append(_column(f.name))
    return df.select(*out)


def has_nested(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, T.StructType) for f in df.schema.fields)


def flatten_lists(df: DataFrame) -> DataFrame:
    """Each list column unrolled on its own, with its items' places as column.#: a row with two lists gives as many
    rows as both have items, the other list's columns null, and a row whose lists are all empty goes. Rows of a table
    without lists stay as they are."""
    lists = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return df
    plain = [_column(f.name) for f in df.schema.fields if f not in lists]
    parts = []
    for f in lists:
        one = df.select(*plain, F.posexplode(_column(f.name)).alias("__place", "__item"))
        item = [F.col("__item").alias(f.name)]
        if isinstance(f.dataType.elementType, T.StructType):
            item = [F.col("__item").getField(x.name).alias(f"{f.name}.{x.name}") for x in f.dataType.elementType.fields]
        parts.append(one.select(*plain, *item, F.col("__place").cast("string").alias(f"{f.name}.#")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_items(c: Column) -> Column:
    """A list without repeats, in order."""
    return F.array_distinct(c)


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, _CELLS), lambda x: F.regexp_replace(F.regexp_replace(x, '^\\s*"|"\\s*$', ""), '""', '"'))


def _embedded_csv(text: Column, fields: tuple[Field, ...], name: str) -> Column:
    """Rows of CSV text in a cell: one struct a line under the header, a field for each sub-field. All lines are kept;
    a JSON iterator's repeats go."""
    lines = F.filter(F.split(F.regexp_replace(text, r"\r", ""), "\n"), lambda x: F.trim(x) != "")
    header = _cells(F.get(lines, F.lit(0)))
    at = lambda x, ref: F.get(_cells(x), F.nullif(F.array_position(header, ref), F.lit(0)).cast("int") - 1)
    build = lambda x: F.struct(*[at(x, f.term.value if f.term else f.name).alias(f.name) for f in fields])
    return F.when(F.size(lines) > 1, F.transform(F.slice(lines, F.lit(2), F.size(lines)), build))


def _json_path(reference: str) -> str:
    reference = reference.strip()
    return reference if reference.startswith("$") else f"$.{reference}"


def _embedded_json(text: Column, iterator: str | None, fields: tuple[Field, ...]) -> Column:
    """Values of JSON text in a cell: one struct a value at the iterator, a field for each sub-field. Text that is no
    JSON has none."""
    path = _json_path(iterator or "$")
    many = path.endswith("[*]") or path.endswith(".*")
    root = F.try_parse_json(text)
    stem = path[:-3] if path.endswith("[*]") else path[:-2] if many else path
    whole = F.try_variant_get(root, stem, "variant") if stem != "$" else root
    items = F.coalesce(F.try_variant_get(root, stem or "$", "array<variant>"), F.when(whole.isNotNull(), F.array(whole)))
    get = lambda x, f: F.try_variant_get(x, _json_path(f.term.value if f.term else f.name), "string")
    return F.transform(items, lambda x: F.struct(*[get(x, f).alias(f.name) for f in fields]))


def _nested_rows(rows: Rows, terms: Terms, f: Field) -> Column:
    """An iterable field as a list of structs, a field for each sub-field (dotted names for deeper ones)."""
    if f.formulation and "CSV" in f.formulation:
        return _embedded_csv(terms.reference(f.term.value if f.term else f.name).column, f.fields, f.name)
    if f.formulation and "JSON" in f.formulation:
        return _embedded_json(terms.reference(f.term.value if f.term else f.name).column, f.iterator, f.fields)
    from ..sources.paths import compile_path

    item = "item" if "item" in rows.df.columns else max((c for c in rows.df.columns if c.startswith("up")), key=lambda c: int(c[2:]))
    kind = rows.df.schema[item].dataType
    parse = segments if rows.kind == "json" else xpath_segments
    steps = parse(f.iterator)
    while steps and steps[-1] == ("all",):
        steps.pop()
    found = _list_at(kind, steps)
    if found is None:
        return F.lit(None).cast("array<struct<" + ",".join(f"`{x.name}`:string" for x in f.fields) + ">>")
    column, element = found[0](F.col(item)), found[1]

    def build(x: Column) -> Column:
        out = []
        for sub in f.fields:
            reference = sub.term.value if sub.term else sub.name
            inner = compile_path(element, parse(reference)) if reference.strip() not in ("$", "@", ".") else ((lambda c: c), element, False)
            if inner is None or isinstance(inner[1], T.StructType | T.MapType):
                out.append(F.lit(None).cast("string").alias(sub.name))
            elif inner[2]:  # the last of several
                out.append(tx.text_of(F.try_element_at(inner[0](x), F.lit(-1)), inner[1]).alias(sub.name))
            else:
                out.append(tx.text_of(inner[0](x), inner[1]).alias(sub.name))
        return F.struct(*out)

    made = F.transform(column, build)
    return distinct_items(made) if rows.kind == "json" else made


def _list_at(kind: T.DataType, steps: list[tuple]):
    """(access, element type) of a list at a path of names, or None."""
    get = lambda c: c
    for step in steps:
        if not isinstance(kind, T.StructType) or step[0] != "name":
            return None
        field = next((x for x in kind.fields if x.name == step[1]), None)
        if field is None:
            return None
        get, kind = (lambda c, get=get, name=step[1]: get(c).getField(name)), field.dataType
    if isinstance(kind, T.ArrayType):
        return get, kind.elementType
    return (lambda c: F.when(get(c).isNotNull(), F.array(get(c)))), kind


def _record(rows: Rows, f: Field) -> Column | None:
    """A field that names a record of nested rows, as texts of what it holds directly; it becomes a column for each."""
    if rows.kind != "json" or "item" not in rows.df.columns or (f.term is not None and f.term.form != "reference"):
        return None
    kind, column = rows.df.schema["item"].dataType, F.col("item")
    for step in segments(f.term.value if f.term else f.name):
        found = next((x for x in kind.fields if x.name == step[1]), None) if isinstance(kind, T.StructType) and step[0] == "name" else None
        if found is None:
            return None
        kind, column = found.dataType, column.getField(step[1])
    if not isinstance(kind, T.StructType):
        return None
    plain = [x for x in kind.fields if not isinstance(x.dataType, T.StructType | T.ArrayType | T.MapType)]
    return F.when(column.isNotNull(), F.struct(*[tx.text_of(column.getField(x.name), x.dataType).alias(x.name) for x in plain]))


def view_rows(engine, view: View) -> Rows:
    """A view's rows: one column a field, with # the place of the source's row and field.# that of an item in its
    list. Places are given before joins, so rows that an inner join drops leave gaps."""
    if view.source.formulation == "View":
        rows = engine.rows(view.source)
    elif view.source.location in engine.tables:
        rows = engine.tables[view.source.location]
    else:
        wanted = [r for f in view.fields for r in references(f.term)] + [r for j in view.joins for c in j.conditions for r in references(c.child)]
        rows = read(engine.spark, view.source, wanted, engine.options)
    used = _uses_index(engine, view)
    rows = Rows(row_index(rows.df), rows.resolve, rows.kind, rows.tokens) if used else engine.spread(rows)
    terms = Terms(rows, engine.options, engine.mapping.base)
    columns: list[Column] = [F.col("`#`")] if used else []
    for f in view.fields:
        if f.iterator or f.formulation:
            columns.append(_nested_rows(rows, terms, f).alias(f.name))
        elif (record := _record(rows, f)) is not None:
            columns.append(record.alias(f.name))
        elif f.term is None:
            columns.append(terms.reference(f.name).column.alias(f.name))
        else:
            columns.append(terms.text(f.term).column.alias(f.name))
    keyed, joins, lists = [], [], []
    for n, j in enumerate(view.joins):
        for i, c in enumerate(j.conditions):
            key = terms.text(c.child)
            keyed.append(key.column.alias(f"__key{n}_{i}"))
            lists += [f"__key{n}_{i}"] if key.many else []
        joins.append((n, j))
    df = terms.frame().select(*columns, *keyed)
    for name in lists:  # a list of keys joins by each of its items
        df = df.withColumn(name, F.explode_outer(name))
    if has_nested(df):
        df = flatten_struct(df)
    for n, j in joins:
        df = _joined(engine, df, n, j)
    return flat(flatten_lists(df), "view")


def _joined(engine, df: DataFrame, n: int, j) -> DataFrame:
    parent = engine.rows(_view_source(j.parent))
    terms = Terms(parent, engine.options, engine.mapping.base)
    names = [f"__parent{n}_{i}" for i in range(len(j.conditions))]
    fields = [(terms.text(f.term).column if f.term else terms.reference(f.name).column).alias(f.name) for f in j.fields]
    made = [terms.text(c.parent) for c in j.conditions]
    side = terms.frame().select(*[key.column.alias(k) for k, key in zip(names, made)], *fields)
    for k, key in zip(names, made):
        side = side.withColumn(k, F.explode(k)) if key.many else side
    for k in names:
        side = side.where(F.col(k) != "")
    side = side.distinct()
    placed = [f.name for f in j.fields if f"{f.name}.#" in _wanted(engine)]
    if placed:  # places among a key's matches, in the order of their values
        place = (F.row_number().over(Window.partitionBy(*names).orderBy(*[_column(f.name) for f in j.fields])) - 1).cast("string")
        side = side.select("*", *[place.alias(f"{name}.#") for name in placed])
    on = reduce(lambda x, y: x & y, [F.col(f"__key{n}_{i}") == F.col(k) for i, k in enumerate(names)])
    return df.join(side, on, "left" if j.kind == "left" else "inner").drop(*names, *[f"__key{n}_{i}" for i in range(len(names))])


def _view_source(parent: str):
    from ..plans.model import Source

    return Source(parent, "View")


def _wanted(engine) -> set[str]:
    """All that maps and views refer to."""
    wanted = {r for m in engine.mapping.maps.values() for r in engine.map_references(m)}
    wanted |= {r for v in engine.mapping.views.values() for f in v.fields for r in references(f.term)}
    return wanted | {r for v in engine.mapping.views.values() for j in v.joins for f in j.fields for r in references(f.term)}


def _uses_index(engine, view: View) -> bool:
    """Whether anything refers to a row's place: it costs a count of the rows."""
    return "#" in _wanted(engine)


def shared_items(left: list[Column], right: list[Column]) -> Column:
    """How many pairs of columns are equal, nulls included."""
    return reduce(lambda a, b: a + b, [x.eqNullSafe(y).cast("int") for x, y in zip(left, right)])


__all__ = ["Field", "JoinCondition", "TermMap", "distinct_items", "flatten_lists", "flatten_struct", "has_nested", "iterate", "row_index", "view_rows"]
