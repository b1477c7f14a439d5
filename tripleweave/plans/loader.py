"""From a mapping document (RML old and new, R2RML, FNML, logical views, collections, RDF-star) to a Mapping."""

from __future__ import annotations

from pathlib import Path

from .model import Call, Field, Gather, JoinCondition, Mapping, ParentMap, PredicateObject, Source, SubjectMap, Target, TermMap, TriplesMap, View, ViewJoin
from .turtle import RDF, XSD, Blank, Graph, Iri, Literal, Term, parse

# The vocabularies' namespaces.
SPACES = ("http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://w3id.org/rml/", "http://semweb.mmlab.be/ns/fnml#", "http://w3id.org/rml/fnml/")
D2RQ = "http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#"
FNO = ("http://w3id.org/function/ontology#", "https://w3id.org/function/ontology#")
SD = "http://www.w3.org/ns/sparql-service-description#"
VOID = "http://rdfs.org/ns/void#"


def local(iri: str) -> str:
    """What follows the last # or /."""
    return iri.rstrip("/#").replace("#", "/").rsplit("/", 1)[-1]


class MappingError(ValueError):
    pass


class _Loader:
    def __init__(self, graph: Graph, folder: str | None):
        self.graph, self.folder = graph, folder

    def all(self, node: Term, *names: str) -> list[Term]:
        return self.graph.values(node, *(s + n for n in names for s in SPACES))

    def one(self, node: Term, *names: str) -> Term | None:
        found = self.all(node, *names)
        return found[0] if found else None

    def text(self, node: Term, *names: str) -> str | None:
        found = self.one(node, *names)
        return found.value if found is not None else None

    def having(self, *names: str) -> list[Term]:
        return [n for n in self.graph.nodes if self.all(n, *names)]

    def typed(self, node: Term, name: str) -> bool:
        return any(local(t.value) == name for t in self.graph.values(node, RDF + "type"))

    # --- sources

    def path(self, text: str) -> str:
        text = text.removeprefix("file://") if text.startswith("file:///") else text
        if self.folder and "://" not in text and not text.startswith("/"):
            return f"{self.folder}/{text.removeprefix('./')}"
        return text

    def source(self, node: Term) -> Source:
        if self.all(node, "viewOn"):
            return Source(self.id(node), "View")
        formulation = self.text(node, "referenceFormulation")
        kind = local(formulation) if formulation else "SQL"
        kind = {"SQL2008Table": "SQL", "SQL2008Query": "SQL", "MySQL": "SQL", "N-Triples": "NTriples", "JSONPath": "JSONPath"}.get(kind, kind)
        where = self.one(node, "source")
        iterator, query = self.text(node, "iterator"), self.text(node, "query", "sqlQuery")
        table = self.text(node, "tableName")
        nulls = tuple(x.value for x in self.all(node, "null"))
        if iterator and kind == "SQL" and "select" in iterator.lower() and not query:
            iterator, query = None, iterator
        location, connection = "", ()
        if isinstance(where, Literal):
            location = self.path(where.value)
        elif where is not None:
            endpoint = self.graph.values(where, SD + "endpoint")
            if endpoint:
                return Source(f"endpoint:{endpoint[0].value}", "SPARQL", iterator, None, query)
            if self.all(where, "viewOn"):
                return Source(self.id(where), "View")
            props = self.graph.nodes.get(where, {})
            jdbc = {local(p): v[0].value for p, v in props.items() if p.startswith(D2RQ)}
            nulls = nulls or tuple(x.value for x in self.all(where, "null"))
            if jdbc:
                connection, location = tuple(sorted(jdbc.items())), jdbc.get("jdbcDSN", "")
            else:
                found = self.text(where, "path") or next((v[0].value for p, v in props.items() if local(p) in ("url", "dataDump", "downloadURL", "accessURL", "path")), None)
                location = self.path(found or where.value)
        elif kind == "SQL":
            location = ""
        if kind == "SQL" and location.rsplit(".", 1)[-1].lower() in ("csv", "json", "xml", "nt"):
            kind = {"csv": "CSV", "json": "JSONPath", "xml": "XPath", "nt": "NTriples"}[location.rsplit(".", 1)[-1].lower()]
        if kind == "SPARQL" or location.endswith(".nt"):
            kind = "NTriples" if location.endswith(".nt") else "SPARQL"
        return Source(location, kind, iterator, table, query, connection, nulls)

    # --- terms

    def id(self, node: Term) -> str:
        return node.value if isinstance(node, Iri) else f"_:{node.value}"

    def constant(self, term: Term) -> TermMap:
        return TermMap("constant", term, {Iri: "IRI", Blank: "BlankNode", Literal: "Literal"}[type(term)])

    def targets(self, node: Term) -> tuple[str, ...]:
        return tuple(self.id(t) for t in self.all(node, "logicalTarget"))

    def term(self, node: Term, default: str | None = None) -> TermMap:
        """A term map node: its expression and term type, language and datatype."""
        kind = self.text(node, "termType")
        kind = local(kind) if kind else None
        kind = {"URI": "IRI"}.get(kind, kind)
        language = self.one(node, "language")
        language_map = self.one(node, "languageMap")
        datatype = self.one(node, "datatype")
        datatype_map = self.one(node, "datatypeMap")
        more = {
            "language": self.constant(Literal(language.value)) if language is not None else self.term(language_map) if language_map is not None else None,
            "datatype": self.constant(datatype) if datatype is not None else self.term(datatype_map) if datatype_map is not None else None,
            "targets": self.targets(node),
        }
        call = self.one(node, "functionExecution", "functionValue")
        if call is not None:
            output = self.one(node, "return")
            return TermMap("function", self.call(call, local(output.value) if output is not None else None), kind or default, **more)
        if self.all(node, "gather", "gatherAs"):
            return TermMap("gather", self.gather(node), kind, **more)
        quoted = self.one(node, "quotedTriplesMap", "subjectMap") if self.all(node, "quotedTriplesMap") else None
        if quoted is not None:
            return TermMap("quoted", self.id(quoted), None, None, None, self.conditions(node), more["targets"])
        for form, names in (("template", ("template",)), ("reference", ("reference", "column"))):
            value = self.text(node, *names)
            if value is not None:
                if form == "reference" and names[1:] and self.all(node, "column"):
                    value = value.strip('"`')
                literal = more["language"] or more["datatype"] or form == "reference"
                return TermMap(form, value, kind or default or ("Literal" if literal else "IRI"), **more)
        constant = self.one(node, "constant")
        if constant is not None:
            found = self.constant(constant)
            if isinstance(constant, Literal) and (more["language"] or more["datatype"]):
                return TermMap("constant", constant, kind or "Literal", **more)
            return TermMap("constant", constant, kind or found.term_type, targets=more["targets"])
        if kind == "BlankNode":
            return TermMap("fresh", "", "BlankNode", targets=more["targets"])
        raise MappingError(f"no expression in term map {self.id(node)}")

    def maps(self, node: Term, full: str, short: str, default: str | None = None) -> tuple[TermMap, ...]:
        found = [self.constant(t) for t in self.all(node, short)] + [self.term(t, default) for t in self.all(node, full)]
        return tuple(found)

    def key(self, node: Term, name: str) -> TermMap:
        short = self.one(node, name)
        if short is not None:
            return TermMap("template", short.value, "Literal") if "{" in short.value else TermMap("reference", short.value.strip('"`'), "Literal")
        full = self.one(node, f"{name}Map")
        if full is None:
            raise MappingError(f"a join condition has no {name}")
        return self.term(full, "Literal")

    def conditions(self, node: Term) -> tuple[JoinCondition, ...]:
        return tuple(JoinCondition(self.key(c, "child"), self.key(c, "parent")) for c in self.all(node, "joinCondition"))

    def object(self, node: Term) -> TermMap | ParentMap:
        parent = self.one(node, "parentTriplesMap")
        if parent is not None:
            return ParentMap(self.id(parent), self.conditions(node), self.targets(node))
        if self.all(node, "quotedTriplesMap"):
            return TermMap("quoted", self.id(self.one(node, "quotedTriplesMap")), None, None, None, self.conditions(node), self.targets(node))
        return self.term(node)

    def gather(self, node: Term) -> Gather:
        members = []
        for head in self.all(node, "gather"):
            for member in self.graph.items(head):
                members.append(self.object(member))
        kind = local(self.text(node, "gatherAs") or RDF + "List")
        strategy = local(self.text(node, "strategy") or "append")
        empty = (self.text(node, "allowEmptyListAndContainer") or "false").lower() in ("true", "1")
        own = None
        if self.all(node, "template", "reference", "constant"):
            form = "template" if self.all(node, "template") else "reference" if self.all(node, "reference") else "constant"
            kind_of = self.text(node, "termType")
            value: object = self.one(node, form) if form == "constant" else self.text(node, form)
            own = TermMap(form, value, local(kind_of) if kind_of else "IRI")
        return Gather(tuple(members), kind, empty, "cartesian" if strategy.lower().startswith("cartesian") else "append", own)

    # --- functions

    def call(self, node: Term, output: str | None = None) -> Call:
        """New executions name function and inputs; old function maps do so by predicate-object maps."""
        name = self.one(node, "function", "functionMap")
        if name is not None:
            inner = self.one(name, "constant") if isinstance(name, Blank) else name
            parameters = []
            for given in self.all(node, "input"):
                p = self.one(given, "parameter")
                if p is None:
                    p = self.one(self.one(given, "parameterMap"), "constant")
                values = [self.constant(t) for t in self.all(given, "inputValue", "value")] + [self.term(t, "Literal") for t in self.all(given, "inputValueMap", "valueMap")]
                parameters.append((local(p.value), values[0] if len(values) == 1 else tuple(values)))
            return Call(local(inner.value), tuple(self.merged(parameters)), output)
        executes, parameters = None, []
        for pom in self.all(node, "predicateObjectMap"):
            predicate = self.maps(pom, "predicateMap", "predicate")[0].value.value
            objects = [self.constant(t) for t in self.all(pom, "object")] + [self.term(t, "Literal") for t in self.all(pom, "objectMap")]
            if predicate in [f + "executes" for f in FNO]:
                executes = local(objects[0].value.value)
            else:
                parameters.append((local(predicate), objects[0] if len(objects) == 1 else tuple(objects)))
        if executes is None:
            raise MappingError("a function map executes nothing")
        return Call(executes, tuple(self.merged(parameters)), output)

    @staticmethod
    def merged(parameters: list) -> list:
        """Values given under one name are one array."""
        out: dict = {}
        for k, v in parameters:
            if k in out:
                v = (*(out[k] if isinstance(out[k], tuple) else (out[k],)), *(v if isinstance(v, tuple) else (v,)))
            out[k] = v
        return list(out.items())

    # --- maps and views

    def triples_map(self, node: Term) -> TriplesMap:
        logical = self.one(node, "logicalSource", "logicalTable")
        if logical is None:
            raise MappingError(f"{self.id(node)} has no source")
        graphs = lambda n: self.maps(n, "graphMap", "graph", "IRI")
        subjects = [SubjectMap(self.constant(t)) for t in self.all(node, "subject")]
        for s in self.all(node, "subjectMap"):
            classes = tuple(c.value for c in self.all(s, "class"))
            subjects.append(SubjectMap(self.term(s, "IRI"), classes, graphs(s)))
        if len(subjects) != 1:
            raise MappingError(f"{self.id(node)} has {len(subjects)} subject maps")
        poms = []
        for pom in self.all(node, "predicateObjectMap"):
            objects = tuple(self.constant(t) for t in self.all(pom, "object")) + tuple(self.object(t) for t in self.all(pom, "objectMap"))
            poms.append(PredicateObject(self.maps(pom, "predicateMap", "predicate", "IRI"), objects, graphs(pom)))
        return TriplesMap(self.id(node), self.source(logical), subjects[0], tuple(dict.fromkeys(poms)), not self.typed(node, "NonAssertedTriplesMap"))

    def fields(self, node: Term) -> tuple[Field, ...]:
        out = []
        for f in self.all(node, "field"):
            name = self.text(f, "fieldName")
            formulation = self.text(f, "referenceFormulation")
            formulation = local(formulation) if formulation else None
            iterator = self.text(f, "iterator")
            expression = any(self.all(f, x) for x in ("reference", "template", "constant", "functionExecution"))
            out.append(Field(name, self.term(f, "Literal") if expression else None, iterator, formulation, self.fields(f)))
        return tuple(out)

    def view(self, node: Term) -> View:
        joins = []
        for kind, name in (("inner", "innerJoin"), ("left", "leftJoin")):
            for j in self.all(node, name):
                parent = self.one(j, "parentLogicalView")
                joins.append(ViewJoin(self.id(parent), self.conditions(j), self.fields(j), kind))
        return View(self.id(node), self.source(self.one(node, "viewOn")), self.fields(node), tuple(joins))

    def mapping(self) -> Mapping:
        called = {n for x in self.graph.nodes for n in self.all(x, "functionValue", "functionExecution")}
        maps = [n for n in self.having("subjectMap", "subject") if n not in called]
        targets = {}
        for node in {t for x in self.graph.nodes for t in self.all(x, "logicalTarget")}:
            where = self.one(node, "target")
            path = None
            if where is not None:
                path = where.value if isinstance(where, Literal) else self.text(where, "path") or next((v[0].value for p, v in self.graph.nodes.get(where, {}).items() if local(p) in ("path", "dataDump", "url")), where.value)
            form = self.text(node, "serialization")
            targets[self.id(node)] = Target(self.id(node), path or self.id(node), local(form) if form else "N-Triples")
        return Mapping({self.id(n): self.triples_map(n) for n in maps}, {self.id(n): self.view(n) for n in self.having("viewOn")}, targets, self.graph.base, dict(self.graph.prefixes))


def load_text(text: str, folder: str | None = None) -> Mapping:
    """A mapping from Turtle; folder is where relative source paths start."""
    return _Loader(parse(text), folder).mapping()


def load(path: str, folder: str | None = None) -> Mapping:
    return load_text(Path(path).read_text(encoding="utf-8"), folder or str(Path(path).parent))


__all__ = ["MappingError", "XSD", "load", "load_text", "local"]
