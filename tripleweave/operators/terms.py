"""Term maps as Column expressions over a source's rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.registry import Arguments, Registry, default_registry
from ..plans.model import Call, TermMap
from ..plans.turtle import XSD, Blank, Iri, Literal, Term
from ..sources.paths import Value
from ..sources.readers import Rows

STRING = T.StringType()


class ReferenceError_(ValueError):
    """A reference that the source does not have."""


@dataclass(frozen=True)
class Options:
    """ignore: a missing reference is null, not an error. csv_multiline: whether quoted cells may hold line ends, which
    makes a file one task; None finds out. csv_check: rows not as wide as the header are an error. jdbc: more options of
    relational reads, as partitionColumn, numPartitions and fetchsize; with a column, its bounds are asked for if not given. compat_lang, compat_quotes
    and compat_iri reproduce older language matching, quote replacement, and encoding of IRIs: whole ones encoded, those
    of templates as they come."""

    ignore: bool = False
    remove_duplicates: bool = True
    csv_multiline: bool | None = None
    csv_check: bool = False
    jdbc: tuple[tuple[str, str], ...] = ()
    sparql_page: int = 0
    compat_lang: bool = False
    compat_quotes: bool = False
    compat_iri: bool = False
    null_tokens: bool = True
    registry: Registry = field(default_factory=default_registry)


def tokens_of(template: str) -> list[tuple[bool, str]]:
    """A template as (is a reference, text) parts; a backslash before a brace makes it text."""
    parts: list[tuple[bool, str]] = []
    now, inside, at = "", False, 0
    while at < len(template):
        c = template[at]
        if c == "\\" and template[at + 1 : at + 2] in ("{", "}", "\\"):
            now += template[at + 1]
            at += 2
            continue
        if (c == "{" and not inside) or (c == "}" and inside):
            if now or inside:
                parts.append((inside, now))
            now, inside = "", not inside
        else:
            now += c
        at += 1
    if inside:
        raise ValueError(f"template {template!r} has an open brace")
    if now:
        parts.append((False, now))
    return parts


def references(term: TermMap | None) -> list[str]:
    """All references that a term map reads of its own row."""
    if term is None or not isinstance(term, TermMap):
        return []
    out: list[str] = []
    if term.form == "reference":
        out.append(term.value)
    elif term.form == "template":
        out += [t for is_ref, t in tokens_of(term.value) if is_ref]
    elif term.form == "function":
        for _, p in term.value.parameters:
            for x in p if isinstance(p, tuple) else (p,):
                out += references(x)
    elif term.form == "gather":
        for m in term.value.members:
            out += references(m) if isinstance(m, TermMap) else [r for c in m.conditions for r in references(c.child)]
        out += references(term.value.node)
    return out + references(term.language) + references(term.datatype) + [r for c in term.conditions for r in references(c.child)]


def condition_of(template: str) -> tuple[str, str | None]:
    """(reference, condition) of `reference[field=value]`, a template's text apart from its condition."""
    m = re.fullmatch(r"(.*?)\[([^\[\]=?@]+=[^\[\]=]*)\]", template)
    return (m[1], m[2]) if m else (template, None)


def spread(values: list[Value], build: Callable[[list[Column]], Column]) -> Value:
    """build over every combination of the many-valued among values; scalar if none is."""
    many = [i for i, v in enumerate(values) if v.many]

    def nest(k: int, bound: dict[int, Column]) -> Column:
        if k == len(many):
            return build([bound.get(i, v.column) for i, v in enumerate(values)])
        inner = F.transform(values[many[k]].column, lambda x: nest(k + 1, bound | {many[k]: x}))
        return inner if k == len(many) - 1 else F.flatten(inner)

    return Value(nest(0, {}), STRING, bool(many))


def each(value: Value, change: Callable[[Column], Column]) -> Value:
    return Value(F.transform(value.column, change) if value.many else change(value.column), STRING, value.many)


def constant_token(term: Term) -> str:
    if isinstance(term, Iri):
        return f"<{term.value}>"
    if isinstance(term, Blank):
        return f"_:{term.value}"
    text = term.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    if term.language:
        return f'"{text}"@{term.language}'
    return f'"{text}"' + (f"^^<{term.datatype}>" if term.datatype and term.datatype != XSD + "string" else "")


class Terms:
    """Compiles the term maps of one source's rows.

    Cells and tokens become columns of their own in two projections under what uses them, each computed once a row
    however often it is used, and expressions stay small enough to be compiled.
    """

    def __init__(self, rows: Rows, options: Options, base: str | None = None, before: Terms | None = None):
        """before: the terms of the rows that these extend by columns; what it made is there already."""
        self.rows, self.options, self.base = rows, options, base
        self.cells: dict[tuple, Value] = dict(before.cells) if before else {}
        self.tokens: dict[TermMap, Value] = dict(before.tokens) if before else {}
        self.made: list[list[Column]] = [[], []]

    def frame(self) -> DataFrame:
        """The rows with the columns that terms made so far."""
        df = self.rows.df
        for columns in self.made:
            df = df.select("*", *columns) if columns else df
        return df

    def _kept(self, known: dict, key, layer: int, make: Callable[[], Value]) -> Value:
        if key not in known:
            found = make()
            name = f"__{'ct'[layer]}{len(known)}"
            self.made[layer].append(found.column.alias(name))
            known[key] = Value(F.col(name), STRING, found.many)
        return known[key]

    def value(self, reference: str) -> Value:
        found = self.rows.resolve(reference)
        if found is None:
            if not self.options.ignore and self.rows.kind in ("csv", "mysql", "postgres", "view"):
                raise ReferenceError_(f"the source has no {reference!r}")
            return Value(F.lit(None).cast("string"), STRING)
        return found

    def subject_key(self, references_: list[str]) -> Column:
        """The values of some references joined by _: what tells subjects apart."""
        return F.concat_ws("_", *[self.reference(r).column for r in references_])

    # --- texts without marks

    def reference(self, reference: str) -> Value:
        tokens = self.rows.tokens if self.options.null_tokens else ()

        def make() -> Value:
            found = self.value(reference)
            return each(found, lambda c: self._cell(c, found.type, tokens))

        return self._kept(self.cells, ("text", reference), 0, make)

    @staticmethod
    def _cell(c: Column, kind: T.DataType, tokens: tuple[str, ...]) -> Column:
        """A cell's text; only text can be blank or stand for null."""
        made = tx.text_of(c, kind)
        return tx.trimmed(tx.present(made, tokens)) if isinstance(kind, T.StringType | T.BinaryType) else made

    def _part(self, reference: str) -> Value:
        """A value as it stands in a template."""
        return self._kept(self.cells, ("part", reference), 0, lambda: self._made_part(self.value(reference)))

    def _made_part(self, found: Value) -> Value:
        kind, tokens = found.type, self.rows.tokens if self.options.null_tokens else ()

        def change(c: Column) -> Column:
            if self.rows.kind in ("json", "mysql", "postgres") and isinstance(kind, T.DoubleType | T.FloatType):
                return F.ceil(c).cast("string")
            t = self._cell(c, kind, tokens)
            if isinstance(kind, T.StringType):
                t = tx.ceiling(t) if self.rows.kind in ("json", "mysql", "postgres") else tx.decimal_repr(t)
            return F.when(t == "-", "UnKnown").otherwise(t) if self.rows.kind == "mysql" else t

        return each(found, change)

    def template(self, template: str, encode: bool) -> Value:
        """A template's text; a condition at its end is no part of it, and selects nothing."""
        parts = tokens_of(condition_of(template)[0])
        values = [self._part(t) for is_ref, t in parts if is_ref]

        def build(columns: list[Column]) -> Column:
            out, n, text_has, seen = [], 0, False, []
            for is_ref, t in parts:
                if not is_ref:
                    out.append(F.lit(tx.iri_safe_text(t) if encode and not self.options.compat_iri else t))
                    text_has = text_has or "http" in t
                    continue
                c, n = columns[n], n + 1
                if encode:
                    wanted = ~c.contains("http")
                    if self.rows.kind != "json" and not text_has:
                        before = [x.contains("http") for x in seen]
                        wanted = wanted & before[0] if len(before) == 1 else (wanted & F.greatest(*before) if before else F.lit(False))
                    out.append(F.when(wanted, tx.percent_encode(c)).otherwise(c if self.options.compat_iri else tx.iri_safe(c)))
                else:
                    out.append(c)
                seen.append(c)
            return F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")

        return spread(values, build)

    def call(self, call: Call) -> Value:
        """A function's result as text; a parameter that is many-valued is an array, a list of parameters too."""
        columns, constants = {}, {}
        for name, given in call.parameters:
            if isinstance(given, tuple):
                columns[name] = F.array(*[self.text(x).column for x in given])
                continue
            columns[name] = self.text(given).column
            if given.form == "constant":
                constants[name] = given.value.value
        made = self.options.registry.build(call.name, Arguments(columns, constants))
        if call.output and call.output in ("protocolOutput", "stringOutput", "domainOutput"):
            made = made.getField(call.output)
        return Value(made.cast("string"), STRING)

    def text(self, term: TermMap, encode: bool = False) -> Value:
        if term.form == "constant":
            return Value(F.lit(term.value.value), STRING)
        if term.form == "reference":
            return self.reference(term.value)
        if term.form == "template":
            return self.template(term.value, encode)
        if term.form == "function":
            return self.call(term.value)
        raise ValueError(f"a {term.form} has no text")

    # --- tokens

    def iri(self, text: Value, whole: bool = False, absolute_: bool = False) -> Value:
        """An IRI token: relative ones start from the base; a whole one is null where it has a space, as no IRI has.
        absolute_: known to have a scheme."""

        def change(c: Column) -> Column:
            absolute = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
            full = F.when(absolute, c).otherwise(F.concat(F.lit(self.base), c)) if self.base and not absolute_ else c
            if whole:
                full = tx.percent_encode(full) if self.options.compat_iri else tx.iri_safe(full)
                full = F.when(~c.contains(" "), full)
            return F.concat(F.lit("<"), full, F.lit(">"))

        return each(text, change)

    def blank(self, text: Value) -> Value:
        return each(text, lambda c: F.concat(F.lit("_:"), tx.blank_label(c)))

    def language(self, term: TermMap) -> Column:
        """@tag, or nothing where there is none."""
        tag = self.text(term).column
        if self.options.compat_lang:
            known = F.when(tag.contains("spanish") | tag.contains("es"), "es").when(tag.contains("english") | tag.contains("en"), "en").when(F.length(tag) == 2, tag)
        else:
            known = F.when(tag.rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"), tag)
        return F.coalesce(F.concat(F.lit("@"), known), F.lit(""))

    def datatype(self, term: TermMap) -> Column:
        return F.coalesce(F.concat(F.lit("^^<"), self.text(term).column, F.lit(">")), F.lit(""))

    def literal(self, text: Value, term: TermMap) -> Value:
        suffix = self.language(term.language) if term.language else self.datatype(term.datatype) if term.datatype else None
        marks = [F.lit('"')] if suffix is None else [F.lit('"'), suffix]
        return each(text, lambda c: F.concat(F.lit('"'), tx.escape_literal(c, self.options.compat_quotes), *marks))

    def token(self, term: TermMap) -> Value:
        if term.form == "constant" and term.term_type == ({Iri: "IRI", Blank: "BlankNode", Literal: "Literal"}[type(term.value)]) and not (term.language or term.datatype):
            return Value(F.lit(constant_token(term.value)), STRING)
        return self._kept(self.tokens, term, 1, lambda: self._token(term))

    def _token(self, term: TermMap) -> Value:
        kind = term.term_type or "Literal"
        if kind == "IRI":
            known = term.form == "template" and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:[^{]", term.value) is not None
            return self.iri(self.text(term, True), whole=term.form in ("reference", "function"), absolute_=known)
        if kind == "BlankNode":
            return self.blank(self.text(term))
        return self.literal(self.text(term), term)
