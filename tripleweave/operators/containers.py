"""Gather maps: members in order as containers and lists, by array expressions over the row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.model import Gather
from ..plans.turtle import RDF
from ..sources.paths import Value

STATEMENT = "struct<s:string,p:string,o:string>"
NIL = f"<{RDF}nil>"


def statement(s: Column, p: str | Column, o: Column) -> Column:
    return F.struct(s.alias("s"), (F.lit(f"<{RDF}{p}>") if isinstance(p, str) else p).alias("p"), o.alias("o"))


@dataclass(frozen=True)
class Gathered:
    """nodes are what points to the container (many for a product of lists); statements describe it."""

    nodes: Value
    statements: Column


def as_array(value: Value) -> Column:
    """A value's tokens without nulls; a null array is empty."""
    found = value.column if value.many else F.array(value.column)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def cell(node: Column, *at: Column) -> Column:
    """The blank node of a place in a list, the same on every run."""
    return F.concat(F.lit("_:l"), F.substring(F.sha2(F.concat_ws("|", node, *[x.cast("string") for x in at]).cast("binary"), 256), 1, 32))


def container(node: Column, kind: str, members: list[Column]) -> Column:
    """rdf:Bag numbers all members in a row; rdf:Seq and rdf:Alt number those of each member map from one."""
    typed = F.array(statement(node, "type", F.lit(f"<{RDF}{kind}>")))
    number = lambda arr: F.transform(arr, lambda x, i: statement(node, F.concat(F.lit(f"<{RDF}_"), (i + 1).cast("string"), F.lit(">")), x))
    numbered = [number(F.concat(*members))] if kind == "Bag" else [number(m) for m in members]
    return F.concat(typed, *numbered)


def chain(node: Column, values: Column) -> Column:
    """rdf:first and rdf:rest of a list whose first cell is node; nothing for no values."""
    n = F.size(values)
    at = lambda i: F.when(i == 0, node).otherwise(cell(node, i))
    links = F.transform(values, lambda x, i: F.array(statement(at(i), "first", x), statement(at(i), "rest", F.when(i + 1 == n, NIL).otherwise(cell(node, i + 1)))))
    return F.flatten(links)


def product(members: list[Column]) -> Column:
    """Every combination of one value from each array, as arrays."""
    def longer(heads: Column, more: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(more, lambda x: F.concat(head, F.array(x)))))

    return reduce(longer, members[1:], F.transform(members[0], lambda x: F.array(x)))


def gather(g: Gather, members: list[Value], node: Column, nested: list[Column] = ()) -> Gathered:
    """A gather map's nodes and statements from its members' tokens. Without members there is no container, unless
    empty ones are asked for: then an empty list is rdf:nil, and a container has its type alone. nested are the statements of
    gathers among the members."""
    arrays = [as_array(m) for m in members]
    none = F.array().cast(f"array<{STATEMENT}>")
    more = F.concat(none, *nested) if nested else none
    if g.strategy == "cartesian" and g.kind == "List":
        lists = product(arrays)
        heads = F.transform(lists, lambda x: cell(node, F.concat_ws("|", x)))
        chains = F.flatten(F.transform(lists, lambda x: chain(cell(node, F.concat_ws("|", x)), x)))
        return Gathered(Value(heads, None, True), F.concat(chains.cast(f"array<{STATEMENT}>"), more))
    values = F.concat(*arrays)
    some = F.size(values) > 0
    if g.kind == "List":
        head = F.when(some, node)
        head = F.coalesce(head, F.lit(NIL)) if g.empty else head
        return Gathered(Value(head, None), F.concat(F.when(some, chain(node, values)).otherwise(none).cast(f"array<{STATEMENT}>"), more))
    made = container(node, g.kind, arrays)
    return Gathered(Value(node if g.empty else F.when(some, node), None), F.concat((made if g.empty else F.when(some, made).otherwise(none)).cast(f"array<{STATEMENT}>"), more))


def group_by_term(df: DataFrame, term: Column, *values: Column) -> DataFrame:
    """(term, members): the rows that share a generated term, as sorted structs of values; null terms group nothing."""
    return df.select(term.alias("term"), F.struct(*values).alias("member")).where("term is not null").groupBy("term").agg(F.sort_array(F.collect_set("member")).alias("members"))
