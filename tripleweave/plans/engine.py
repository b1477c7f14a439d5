"""From a mapping to the graph: term maps become expressions, parents joins, and one scan serves a source's maps.

Three rules beyond what the optimizer sees: sides of a join are deduplicated before it (what is left of repeated rows
never crosses the network), all row-local statements of a source leave one scan, and parents on the same row take no
join at all.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.containers import Gathered, as_array, gather
from ..operators.terms import Options, Terms, references
from ..sources.paths import Value
from ..sources.readers import Rows, read
from .model import Gather, JoinCondition, Mapping, ParentMap, PredicateObject, Source, TermMap, TriplesMap
from .turtle import RDF, Iri

QUAD = "struct<s:string,p:string,o:string,g:string,t:array<string>>"
DEFAULT_GRAPHS = ("http://www.w3.org/ns/r2rml#defaultGraph", "http://w3id.org/rml/defaultGraph")


@dataclass(frozen=True)
class Statement:
    """One statement of a row, parts as tokens; any may be many-valued. given: it exists only where this is true."""

    s: Value
    p: Value
    o: Value
    g: Value | None
    targets: tuple[str, ...] = ()


def single(column: Column) -> Value:
    return Value(column, None)


class Engine:
    def __init__(self, spark: SparkSession, mapping: Mapping, options: Options | None = None, tables: dict[str, Rows] | None = None):
        """tables gives rows for source locations in place of reading them."""
        self.spark, self.mapping, self.options = spark, mapping, options or Options()
        self.tables, self.read, self.made, self.joins = dict(tables or {}), {}, {}, 0
        self.names = {m.id: i for i, m in enumerate(mapping.maps.values())}

    # --- sources

    def all_references(self, source: Source) -> list[str]:
        out: list[str] = []
        for m in self.mapping.maps.values():
            out += self.map_references(m) if m.source == source else []
            for pom in m.poms:
                for o in pom.objects:
                    parent = self.mapping.maps.get(o.parent if isinstance(o, ParentMap) else o.value if o.form == "quoted" else None)
                    if parent is not None and parent.source == source:
                        out += [r for c in o.conditions for r in references(c.parent)]
                    if isinstance(o, TermMap) and o.form == "gather":
                        for x in o.value.members:
                            if isinstance(x, ParentMap) and self.mapping.maps[x.parent].source == source:
                                out += [r for c in x.conditions for r in references(c.parent)]
        return list(dict.fromkeys(out))

    def map_references(self, m: TriplesMap) -> list[str]:
        terms = [m.subject.term, *m.subject.graphs]
        out: list[str] = []
        for pom in m.poms:
            terms += [*pom.predicates, *pom.graphs]
            for o in pom.objects:
                if isinstance(o, ParentMap):
                    out += [r for c in o.conditions for r in references(c.child)]
                else:
                    terms.append(o)
        return out + [r for t in terms for r in references(t)]

    def rows(self, source: Source) -> Rows:
        if source not in self.read:
            if source.location in self.tables:
                self.read[source] = self.tables[source.location]
            elif source.formulation == "View":
                from ..operators.views import view_rows

                self.read[source] = view_rows(self, self.mapping.views[source.location])
            else:
                self.read[source] = self.spread(read(self.spark, source, self.all_references(source), self.options))
        return self.read[source]

    def spread(self, rows: Rows) -> Rows:
        """Rows of files that cannot be split, fewer than there are cores, are dealt over all of them before terms are
        made."""
        cores = self.spark.sparkContext.defaultParallelism
        if rows.kind in ("mysql", "postgres") or not rows.whole_files or len(rows.df.inputFiles()) >= cores:
            return rows
        return replace(rows, df=rows.df.repartition(cores))

    def terms(self, rows: Rows) -> Terms:
        """The one compiler of some rows' terms."""
        if id(rows) not in self.made:
            self.made[id(rows)] = Terms(rows, self.options, self.mapping.base)
        return self.made[id(rows)]

    def frame(self, rows: Rows) -> DataFrame:
        """The rows with the columns of all terms compiled for them so far."""
        return self.terms(rows).frame()

    # --- terms that need more than expressions

    def local(self, child: Source, conditions: tuple[JoinCondition, ...], parent: TriplesMap) -> bool:
        """Whether a parent's terms are those of the same row: same source, and no or equal keys."""
        return child == parent.source and all(c.child == c.parent for c in conditions)

    def keys(self, rows: Rows, terms: list[TermMap]) -> list[Column]:
        made = [self.terms(rows).text(t) for t in terms]
        return [F.explode(k.column) if k.many else k.column for k in made]

    def parent_side(self, parent: TriplesMap, conditions: tuple[JoinCondition, ...], token: Value, rows: Rows) -> DataFrame:
        """Distinct keys and tokens of a parent's rows; null and empty keys join nothing."""
        keys = [k.alias(f"k{i}") for i, k in enumerate(self.keys(rows, [c.parent for c in conditions]))]
        df = self.frame(rows).select("*", (F.explode(token.column) if token.many else token.column).alias("token")).select(*keys, "token")
        for i in range(len(conditions)):
            df = df.where(F.col(f"k{i}") != "")
        return df.where("token is not null").distinct()

    def quoted(self, rows: Rows, m: TriplesMap) -> Value:
        """<< s p o >> of each statement of a map on a row."""
        found, _ = self.row_statements(rows, m)
        tokens = [_spread([x.s, x.p, x.o], lambda c: F.concat(F.lit("<< "), c[0], F.lit(" "), c[1], F.lit(" "), c[2], F.lit(" >>"))) for x in found]
        if len(tokens) == 1:
            return tokens[0]
        return Value(F.concat(*[as_array(t) for t in tokens]), None, True)

    def joined_column(self, rows: Rows, conditions: tuple[JoinCondition, ...], parent: TriplesMap, token: Value, parent_rows: Rows) -> tuple[Rows, Value]:
        """rows with a column of the sorted tokens of all parents of a row."""
        self.joins += 1
        name = f"__joined{self.joins}"
        side = self.parent_side(parent, conditions, token, parent_rows)
        by = [f"k{i}" for i in range(len(conditions))]
        made = [self.terms(rows).text(c.child) for c in conditions]
        own = [f"{name}k{i}" for i in range(len(by))]
        if any(k.many for k in made):
            # each different list of keys meets the parents of any of its items once
            lists = self.frame(rows).select(*[k.column.alias(n) for k, n in zip(made, own)]).distinct()
            keyed = lists
            for k, n, key in zip(made, own, by):
                keyed = keyed.withColumn(key, F.explode(n) if k.many else F.col(n))
            lists = keyed.join(side, by).groupBy(*own).agg(F.sort_array(F.collect_set("token")).alias(name))
        else:
            lists = side.groupBy(*by).agg(F.sort_array(F.collect_set("token")).alias(name)).select(*[F.col(k).alias(n) for k, n in zip(by, own)], name)
        on = reduce(lambda x, y: x & y, [k.column == F.col(n) for k, n in zip(made, own)])
        after = replace(rows, df=self.frame(rows).join(lists, on, "left").drop(*own))
        self.made[id(after)] = Terms(after, self.options, self.mapping.base, self.terms(rows))
        return after, Value(F.col(name), None, True)

    def gathered(self, rows: Rows, g: Gather, m: TriplesMap, node: Column | None, mark: str) -> tuple[Rows, Gathered]:
        values, nested = [], []
        for n, member in enumerate(g.members):
            if isinstance(member, ParentMap):
                parent = self.mapping.maps[member.parent]
                if self.local(m.source, member.conditions, parent):
                    values.append(self.terms(rows).token(parent.subject.term))
                else:
                    parent_rows = self.rows(parent.source)
                    rows, value = self.joined_column(rows, member.conditions, parent, self.terms(parent_rows).token(parent.subject.term), parent_rows)
                    values.append(value)
            elif member.form == "gather":
                rows, inner = self.gathered(rows, member.value, m, None, f"{mark}.{n}")
                values.append(inner.nodes)
                nested.append(inner.statements)
            else:
                values.append(self.terms(rows).token(member))
        if node is None and g.node is not None:
            node = self.terms(rows).token(g.node).column
        if node is None:
            parts = [F.array_join(as_array(v), "|", "") for v in values]
            subject = m.subject.term
            own = [] if subject.form == "gather" else [self.terms(rows).token(subject).column]
            node = F.concat(F.lit("_:g"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(f"{self.names.get(m.id, 0)}/{mark}"), *own, *parts).cast("binary"), 256), 1, 32))
        return rows, gather(g, values, node, nested)

    # --- statements

    def graphs(self, rows: Rows, *maps: tuple[TermMap, ...]) -> list[Value | None]:
        terms = list(dict.fromkeys(t for group in maps for t in group))
        if not terms:
            return [None]
        return [None if t.form == "constant" and t.value.value in DEFAULT_GRAPHS else self.terms(rows).token(t) for t in terms]

    def row_statements(self, rows: Rows, m: TriplesMap) -> tuple[list[Statement], list[tuple[Rows, list]]]:
        """(statements, (rows, container statements)): all that a map says by its own rows. Joined objects are left to
        joined_statements()."""
        out: list[Statement] = []
        containers: list[tuple[Column, Value | None]] = []
        make = lambda: self.terms(rows)
        term = m.subject.term
        if term.form == "gather":
            rows, made = self.gathered(rows, term.value, m, None, "s")
            subject = made.nodes
            containers.append((made.statements, self.graphs(rows, m.subject.graphs)[0]))
        elif term.form == "quoted":
            subject = self.quoted(rows, self.mapping.maps[term.value])
        elif term.form == "fresh":
            subject = single(F.concat(F.lit("_:r"), F.substring(F.sha2(F.to_json(F.struct("*")).cast("binary"), 256), 1, 32)))
        else:
            subject = make().token(term)
        for c in m.subject.classes:
            for g in self.graphs(rows, m.subject.graphs):
                out.append(Statement(subject, single(F.lit(f"<{RDF}type>")), single(F.lit(f"<{c}>")), g, term.targets))
        for n, pom in enumerate(m.poms):
            for k, o in enumerate(pom.objects):
                if self.needs_join(m, o):
                    continue
                if isinstance(o, ParentMap):
                    parent = self.mapping.maps[o.parent]
                    found = self.quoted(rows, self.mapping.maps[parent.subject.term.value]) if parent.subject.term.form == "quoted" else make().token(parent.subject.term)
                elif o.form == "quoted":
                    found = self.quoted(rows, self.mapping.maps[o.value])
                elif o.form == "gather":
                    rows, made = self.gathered(rows, o.value, m, None, f"{n}.{k}")
                    found = made.nodes
                    containers.append((made.statements, self.graphs(rows, m.subject.graphs, pom.graphs)[0]))
                else:
                    found = make().token(o)
                out += self.pom_statements(rows, m, pom, subject, found, o)
        return out, [(rows, containers)]

    def pom_statements(self, rows: Rows, m: TriplesMap, pom: PredicateObject, subject: Value, found: Value, o: TermMap | ParentMap) -> list[Statement]:
        more = [t for x in (o.language, o.datatype) if x is not None for t in x.targets] if isinstance(o, TermMap) else []
        return [Statement(subject, self.terms(rows).token(p), found, g, tuple(dict.fromkeys([*m.subject.term.targets, *p.targets, *o.targets, *more]))) for p in pom.predicates for g in self.graphs(rows, m.subject.graphs, pom.graphs)]

    def needs_join(self, m: TriplesMap, o: TermMap | ParentMap) -> bool:
        if isinstance(o, ParentMap):
            parent = self.mapping.maps[o.parent]
        elif o.form == "quoted":
            parent = self.mapping.maps[o.value]
        else:
            return False
        if not self.local(m.source, o.conditions, parent):
            if not o.conditions:
                raise ValueError(f"{m.id}: a parent on another source needs a join condition")
            return True
        return False

    def joined_statements(self, rows: Rows, m: TriplesMap) -> list[DataFrame]:
        """A join of distinct sides for each object that comes from other rows."""
        out = []
        for pom in m.poms:
            for o in pom.objects:
                if not self.needs_join(m, o):
                    continue
                parent = self.mapping.maps[o.parent if isinstance(o, ParentMap) else o.value]
                parent_rows = self.rows(parent.source)
                if isinstance(o, ParentMap) and parent.subject.term.form not in ("quoted", "gather"):
                    token = self.terms(parent_rows).token(parent.subject.term)
                elif isinstance(o, ParentMap) and parent.subject.term.form == "gather":
                    parent_rows, made = self.gathered(parent_rows, parent.subject.term.value, parent, None, "s")
                    token = made.nodes
                else:
                    token = self.quoted(parent_rows, self.mapping.maps[parent.subject.term.value] if isinstance(o, ParentMap) else parent)
                right = self.parent_side(parent, o.conditions, token, parent_rows)
                subject = self.terms(rows).token(m.subject.term) if m.subject.term.form != "quoted" else self.quoted(rows, self.mapping.maps[m.subject.term.value])
                statements = self.pom_statements(rows, m, pom, subject, single(F.lit(None).cast("string")), o)
                names = [f"c{i}" for i in range(len(o.conditions))]
                keys = [k.alias(n) for k, n in zip(self.keys(rows, [c.child for c in o.conditions]), names)]
                left = self.frame(rows).select(*keys, self.quads(statements).alias("quads"))
                for n in names:
                    left = left.where(F.col(n) != "")
                left = left.select(*names, F.explode("quads").alias("q"))
                left = left.select(*names, "q.s", "q.p", "q.g", "q.t").where("s is not null and p is not null")
                left = left.distinct() if self.options.remove_duplicates else left
                on = reduce(lambda x, y: x & y, [F.col(n) == F.col(f"k{i}") for i, n in enumerate(names)])
                out.append(left.join(right, on).select("s", "p", F.col("token").alias("o"), "g", "t"))
        return out

    def statements(self) -> DataFrame:
        """(s, p, o, g, t) of all asserted maps, repeats included; t are the targets that a statement is bound for."""
        scans: dict[int, tuple[Rows, list[Column]]] = {}
        parts: list[DataFrame] = []
        for m in self.mapping.maps.values():
            if not m.asserted:
                continue
            rows = self.rows(m.source)
            found, [(after, containers)] = self.row_statements(rows, m)
            arrays = [self.quads(found)] if found else []
            for made, g in containers:
                graph = g.column if g is not None else F.lit(None).cast("string")
                arrays.append(self.in_graph(made, graph))
            scans.setdefault(id(after), (after, []))[1].extend(arrays)
            parts += self.joined_statements(rows, m)
        for rows, arrays in scans.values():
            if arrays:
                whole = F.concat(*[a.cast(f"array<{QUAD}>") for a in arrays]) if len(arrays) > 1 else arrays[0].cast(f"array<{QUAD}>")
                parts.append(self.frame(rows).select(F.explode(whole).alias("q")).select("q.*"))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string, g string, t array<string>")
        return reduce(DataFrame.unionByName, parts).where("s is not null and p is not null and o is not null")

    def graph(self) -> DataFrame:
        """(s, p, o, g): the mapping's graph, as a set unless repeats are to be kept."""
        out = self.statements().select("s", "p", "o", "g")
        return out.dropDuplicates() if self.options.remove_duplicates else out

    def by_target(self) -> dict[str | None, DataFrame]:
        """The graph's part for each target; None has what is bound for none."""
        all_ = self.statements()
        out: dict[str | None, DataFrame] = {None: all_.where(F.coalesce(F.size("t") <= 0, F.lit(True)))}
        for t in self.mapping.targets:
            out[t] = all_.where(F.array_contains("t", t))
        return {t: df.select("s", "p", "o", "g").dropDuplicates() for t, df in out.items()}

    def in_graph(self, statements: Column, graph: Column) -> Column:
        return F.transform(statements, lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["o"].alias("o"), graph.alias("g"), self.bound(()).alias("t")))

    def bound(self, targets: tuple[str, ...]) -> Column:
        """The targets of a statement; null throughout where the mapping has none."""
        if not self.mapping.targets:
            return F.lit(None).cast("array<string>")
        return F.array(*[F.lit(t) for t in targets]) if targets else F.array().cast("array<string>")

    def quads(self, statements: list[Statement]) -> Column:
        """All statements of a row in one array."""
        plain, many = [], []
        for x in statements:
            g = x.g or single(F.lit(None).cast("string"))
            targets = self.bound(x.targets)
            made = _spread([x.s, x.p, x.o, g], lambda c, targets=targets: F.struct(c[0].alias("s"), c[1].alias("p"), c[2].alias("o"), c[3].alias("g"), targets.alias("t")))
            (many if made.many else plain).append(made.column)
        arrays = ([F.array(*plain)] if plain else []) + [F.coalesce(a, F.array().cast(f"array<{QUAD}>")) for a in many]
        return F.concat(*arrays) if len(arrays) > 1 else arrays[0]

    def predicates(self) -> Counter:
        """How often each constant predicate is used by the maps; a class assertion counts under its class, and
        predicates that relate terms of a vocabulary count with their objects."""
        out: Counter = Counter()
        for m in self.mapping.maps.values():
            out.update(m.subject.classes)
            for pom in m.poms:
                for p in pom.predicates:
                    if p.form != "constant" or not isinstance(p.value, Iri):
                        continue
                    if p.value.value.endswith(("subClassOf", "sameAs", "seeAlso", "subPropertyOf")):
                        out.update(f"{p.value.value} {getattr(o.value, 'value', o.value)}" if isinstance(o, TermMap) else p.value.value for o in pom.objects)
                    else:
                        out[p.value.value] += 1
        return out


def _spread(values: list[Value], build) -> Value:
    from ..operators.terms import spread

    return spread(values, build)
