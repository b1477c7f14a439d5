"""Mapping documents as frozen values. They stay on the driver; executors see Column expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from .turtle import Term


@dataclass(frozen=True)
class Source:
    """Where rows come from: location is a path, a connection, or the id of a view; formulation is CSV, JSONPath,
    XPath, SQL, SPARQL, NTriples or View."""

    location: str
    formulation: str
    iterator: str | None = None
    table: str | None = None
    query: str | None = None
    connection: tuple[tuple[str, str], ...] = ()
    null_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class TermMap:
    """form is constant, template, reference, function, gather or quoted; value is a Term, a text, a Call, a Gather or
    the id of a triples map."""

    form: str
    value: object
    term_type: str | None = None
    datatype: TermMap | None = None
    language: TermMap | None = None
    conditions: tuple[JoinCondition, ...] = ()
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinCondition:
    child: TermMap
    parent: TermMap


@dataclass(frozen=True)
class Call:
    """A function by name, with its parameters by name; a list value is an array of term maps. output picks a field."""

    name: str
    parameters: tuple[tuple[str, TermMap | tuple[TermMap, ...]], ...]
    output: str | None = None


@dataclass(frozen=True)
class Gather:
    """kind is Bag, Seq, Alt or List."""

    members: tuple[TermMap | ParentMap, ...]
    kind: str
    empty: bool = False
    strategy: str = "append"
    node: TermMap | None = None


@dataclass(frozen=True)
class ParentMap:
    """A reference to another map's subjects, by equal keys or on the same row."""

    parent: str
    conditions: tuple[JoinCondition, ...] = ()
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class PredicateObject:
    predicates: tuple[TermMap, ...]
    objects: tuple[TermMap | ParentMap, ...]
    graphs: tuple[TermMap, ...] = ()


@dataclass(frozen=True)
class SubjectMap:
    term: TermMap
    classes: tuple[str, ...] = ()
    graphs: tuple[TermMap, ...] = ()


@dataclass(frozen=True)
class TriplesMap:
    id: str
    source: Source
    subject: SubjectMap
    poms: tuple[PredicateObject, ...] = ()
    asserted: bool = True


@dataclass(frozen=True)
class Field:
    """A view's field: an expression, or (iterator given) rows with fields of their own. formulation is set where a
    field's text is read as CSV or JSON."""

    name: str
    term: TermMap | None = None
    iterator: str | None = None
    formulation: str | None = None
    fields: tuple[Field, ...] = ()


@dataclass(frozen=True)
class ViewJoin:
    parent: str
    conditions: tuple[JoinCondition, ...]
    fields: tuple[Field, ...]
    kind: str = "inner"


@dataclass(frozen=True)
class View:
    id: str
    source: Source
    fields: tuple[Field, ...]
    joins: tuple[ViewJoin, ...] = ()


@dataclass(frozen=True)
class Target:
    id: str
    location: str
    serialization: str = "N-Triples"


@dataclass(frozen=True)
class Mapping:
    maps: dict[str, TriplesMap]
    views: dict[str, View] = field(default_factory=dict)
    targets: dict[str, Target] = field(default_factory=dict)
    base: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)


__all__ = ["Call", "Field", "Gather", "JoinCondition", "Mapping", "ParentMap", "PredicateObject", "Source", "SubjectMap", "Target", "Term", "TermMap", "TriplesMap", "View", "ViewJoin"]
