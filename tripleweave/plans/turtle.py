"""A reader of Turtle for mapping documents: terms, triples, prefixes and base."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    language: str | None = None


Term = Iri | Blank | Literal

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<type>\^\^)
  | (?P<blank>_:[\w][\w.-]*)
  | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<name>(?:[\w][\w.-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
  | (?P<word>a\b|true\b|false\b)
  | (?P<mark>[\[\](),;.])
    """,
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


class TurtleError(ValueError):
    pass


@dataclass
class Graph:
    """Triples by subject and predicate, in document order."""

    base: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    nodes: dict[Term, dict[str, list[Term]]] = field(default_factory=dict)

    def add(self, s: Term, p: str, o: Term) -> None:
        values = self.nodes.setdefault(s, {}).setdefault(p, [])
        if o not in values:
            values.append(o)

    def values(self, s: Term, *predicates: str) -> list[Term]:
        found = self.nodes.get(s, {})
        return [o for p in predicates for o in found.get(p, ())]

    def items(self, head: Term) -> list[Term]:
        """The members of a collection, or the node itself if it is none."""
        if head == Iri(RDF + "nil"):
            return []
        if not self.values(head, RDF + "first"):
            return [head]
        out = []
        while head != Iri(RDF + "nil"):
            out += self.values(head, RDF + "first")
            head = (self.values(head, RDF + "rest") or [Iri(RDF + "nil")])[0]
        return out


class _Reader:
    def __init__(self, text: str):
        self.graph, self.tokens, self.at, self.blanks = Graph(), [], 0, 0
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise TurtleError(f"line {text.count(chr(10), 0, pos) + 1}: unexpected {text[pos : pos + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), text.count("\n", 0, pos) + 1 if m.group() in "." else 0))
            pos = m.end()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TurtleError("the document ends within a statement")
        kind, text, _ = self.tokens[self.at]
        self.at += 1
        return kind, text

    def expect(self, mark: str) -> None:
        _, text = self.next()
        if text != mark:
            raise TurtleError(f"expected {mark!r}, found {text!r}")

    def fresh(self) -> Blank:
        self.blanks += 1
        return Blank(f"genid{self.blanks}")

    def resolve(self, iri: str) -> str:
        iri = unescape(iri)
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) or not self.graph.base:
            return iri
        return urljoin(self.graph.base, iri) if iri else self.graph.base

    def term(self) -> Term:
        kind, text = self.next()
        if kind == "iri":
            return Iri(self.resolve(text[1:-1]))
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.graph.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return Iri(self.graph.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return Blank(text[2:])
        if kind in ("string", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return Literal(value, None, self.next()[1][1:])
            if self.peek() == "^^":
                self.next()
                return Literal(value, self.term().value)
            return Literal(value)
        if kind == "number":
            return Literal(text, XSD + ("double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"))
        if text == "a":
            return Iri(RDF + "type")
        if kind == "word":
            return Literal(text, XSD + "boolean")
        if text == "[":
            node = self.fresh()
            if self.peek() != "]":
                self.properties(node)
            self.expect("]")
            return node
        if text == "(":
            members = []
            while self.peek() != ")":
                members.append(self.term())
            self.expect(")")
            head: Term = Iri(RDF + "nil")
            for member in reversed(members):
                cell = self.fresh()
                self.graph.add(cell, RDF + "first", member)
                self.graph.add(cell, RDF + "rest", head)
                head = cell
            return head
        raise TurtleError(f"unexpected {text!r}")

    def properties(self, subject: Term) -> None:
        while True:
            while self.peek() == ";":
                self.next()
            if self.peek() in (".", "]", ""):
                return
            predicate = self.term()
            if not isinstance(predicate, Iri):
                raise TurtleError("a predicate is no IRI")
            while True:
                self.graph.add(subject, predicate.value, self.term())
                if self.peek() != ",":
                    break
                self.next()
            if self.peek() != ";":
                return

    def document(self) -> Graph:
        while self.at < len(self.tokens):
            kind, text, _ = self.tokens[self.at]
            if kind == "directive":
                self.next()
                if "prefix" in text.lower():
                    _, name = self.next()
                    self.graph.prefixes[name.rstrip(":").partition(":")[0]] = self.resolve(self.next()[1][1:-1])
                else:
                    self.graph.base = self.resolve(self.next()[1][1:-1])
                if text.startswith("@"):
                    self.expect(".")
                continue
            subject = self.term()
            if self.peek() != ".":
                self.properties(subject)
            self.expect(".")
        return self.graph


def parse(text: str) -> Graph:
    return _Reader(text).document()
