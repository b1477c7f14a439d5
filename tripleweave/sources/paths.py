"""References into nested rows, resolved against the schema on the driver into field accesses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class Value:
    """What a reference yields: a scalar of its type, or (many) an array of scalars."""

    column: Column
    type: T.DataType
    many: bool = False


_SEGMENT = re.compile(
    r"""\['(?P<q>(?:[^'\\]|\\.)*)'\] | \["(?P<d>(?:[^"\\]|\\.)*)"\] | \[(?P<i>-?\d+)\] | \[(?P<all>\*)\] | \[\?\(@\.(?P<k>[^=!\s\]]+)\s*(?P<op>==|!=)\s*['"]?(?P<v>[^'"\]]*?)['"]?\)\] | \.?(?P<star>\*) | \.?(?P<name>[^.\[\]]+) | (?P<dot>\.+)""",
    re.X,
)


def segments(path: str) -> list[tuple]:
    """A JSONPath as steps: ("name", n), ("all",), ("at", i) or ("where", key, equal, value)."""
    text = path.strip()
    text = text[1:] if text.startswith("$") else text
    out, at = [], 0
    while at < len(text):
        m = _SEGMENT.match(text, at)
        if not m:
            raise ValueError(f"path {path!r} is not understood at {text[at:]!r}")
        if m["q"] is not None or m["d"] is not None:
            out.append(("name", re.sub(r"\\(.)", r"\1", m["q"] if m["q"] is not None else m["d"])))
        elif m["i"] is not None:
            out.append(("at", int(m["i"])))
        elif m["all"] or m["star"]:
            out.append(("all",))
        elif m["k"]:
            out.append(("where", m["k"], m["op"] == "==", m["v"]))
        elif m["name"]:
            out.append(("name", m["name"]))
        at = m.end()
    return out


Step = Callable[[Column], Column]


def _field(kind: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in kind.fields if f.name == name), None)


def compile_path(kind: T.DataType, steps: list[tuple]) -> tuple[Step, T.DataType, bool] | None:
    """How to get from a value of a type to what steps name; None where no such field exists."""
    if not steps:
        if isinstance(kind, T.ArrayType):
            inner = compile_path(kind.elementType, [])
            return None if inner is None else (lambda c: F.transform(c, inner[0]), inner[1], True) if not inner[2] else (lambda c: F.flatten(F.transform(c, inner[0])), inner[1], True)
        return (lambda c: c), kind, False
    head, rest = steps[0], steps[1:]
    if isinstance(kind, T.ArrayType):
        if head[0] == "at":
            inner = compile_path(kind.elementType, rest)
            return inner and ((lambda c: inner[0](F.get(c, F.lit(head[1])))), inner[1], inner[2])
        if head[0] == "where":
            key = compile_path(kind.elementType, segments(head[1]))
            inner = compile_path(kind.elementType, rest)
            if key is None or inner is None:
                return None
            test = lambda x: key[0](x).cast("string") == head[3] if head[2] else key[0](x).cast("string") != head[3]
            return (lambda c: inner[0](F.try_element_at(F.filter(c, test), F.lit(-1)))), inner[1], inner[2]
        inner = compile_path(kind.elementType, rest if head[0] == "all" else steps)
        if inner is None:
            return None
        return (lambda c: F.flatten(F.transform(c, inner[0])) if inner[2] else F.transform(c, inner[0])), inner[1], True
    if isinstance(kind, T.StructType):
        if head[0] == "where":
            key = compile_path(kind, segments(head[1]))
            inner = compile_path(kind, rest)
            if key is None or inner is None:
                return None
            return (lambda c: F.when(key[0](c).cast("string") == head[3] if head[2] else key[0](c).cast("string") != head[3], inner[0](c))), inner[1], inner[2]
        if head[0] == "all":
            if len(kind.fields) != 1:
                return None
            head = ("name", kind.fields[0].name)
        if head[0] != "name":
            return None
        found = _field(kind, head[1])
        inner = found and compile_path(found.dataType, rest)
        return inner and ((lambda c: inner[0](c.getField(head[1]))), inner[1], inner[2])
    if isinstance(kind, T.MapType) and head[0] == "name":
        inner = compile_path(kind.valueType, rest)
        return inner and ((lambda c: inner[0](F.try_element_at(c, F.lit(head[1])))), inner[1], inner[2])
    return compile_path(kind, rest) if head[0] == "all" else None


def value_at(column: Column, kind: T.DataType, path: str) -> Value | None:
    """The scalars at a path, or None if the schema has none there; a record at the end is no scalar."""
    found = compile_path(kind, segments(path))
    if found is None or isinstance(found[1], T.StructType | T.MapType):
        return None
    return Value(found[0](column), found[1], found[2])


def find_path(kind: T.DataType, key: str, prefix: str = "") -> str | None:
    """The first dotted path, depth first, to a field of a name."""
    if isinstance(kind, T.ArrayType):
        return find_path(kind.elementType, key, f"{prefix}[*]")
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            if f.name == key:
                return path
            if (below := find_path(f.dataType, key, path)) is not None:
                return below
    return None


def xpath_segments(path: str) -> list[tuple]:
    """A reference of child elements, attributes, text() and .. as steps."""
    out = []
    for part in path.strip().split("/"):
        if part in ("", ".", "text()"):
            continue
        if part == "..":
            out.append(("up",))
        elif m := re.fullmatch(r"(.+?)\[@?([\w:.-]+)='([^']*)'\]", part):
            out += [("name", m[1]), ("where", ("_" if "@" in part else "") + m[2], True, m[3])]
        elif m := re.fullmatch(r"(.+?)\[(\d+)\]", part):
            out += [("name", m[1]), ("at", int(m[2]) - 1)]
        else:
            out.append(("name", "_" + part[1:] if part.startswith("@") else part))
    return out
