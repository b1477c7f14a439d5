"""Sources as DataFrames, each with a way to resolve references into its rows."""

from __future__ import annotations

import csv as _csv
import io
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import NULL_TOKENS
from ..plans.model import Source
from .paths import Value, compile_path, find_path, segments, value_at, xpath_segments

Resolver = Callable[[str], Value | None]


@dataclass(frozen=True)
class Rows:
    """A source's rows. kind is csv, json, xml, mysql, postgres or view; tokens are cells that mean null; whole_files: its
    files cannot be split over tasks."""

    df: DataFrame
    resolve: Resolver
    kind: str
    tokens: tuple[str, ...] = ()
    whole_files: bool = False


class SourceError(ValueError):
    pass


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _flat(df: DataFrame, kind: str, tokens: tuple[str, ...] = (), fold: bool = False) -> Rows:
    """Rows with one column a reference; a path that is no column's name goes into nested columns."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def resolve(reference: str) -> Value | None:
        for name in (reference, reference.lower()) if fold else (reference,):
            if name in types and not isinstance(types[name], T.StructType | T.MapType | T.ArrayType):
                return Value(_column(name), types[name])
        path = segments(reference) if not reference.startswith("#") else [("name", reference)]
        if path and path[0][0] == "name" and path[0][1] in types:
            found = compile_path(types[path[0][1]], path[1:])
            if found and not isinstance(found[1], T.StructType | T.MapType):
                return Value(found[0](_column(path[0][1])), found[1], found[2])
        return None

    return Rows(df, resolve, kind, tokens)


# --- delimited text


def open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, so that a cell goes on in the next: one pass over the text, split
    over tasks and ended by the first such line."""
    return not spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool | None = None, **options) -> DataFrame:
    """All columns as text; doubled quotes and empty cells as they are meant. multiline: whether quoted cells may hold
    line ends, in which case a file is one task; None finds out, so that all other files are split over tasks."""
    delimiter = delimiter or ("\t" if path.endswith(".tsv") else ",")
    multiline = open_quotes(spark, path) if multiline is None else multiline
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("emptyValue", "").option("nullValue", "\u0000").option("sep", delimiter)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def csv_faults(spark: SparkSession, path: str, delimiter: str = ",") -> int:
    """How many rows are not as wide as the header."""
    header = spark.read.text(path).first()
    if header is None:
        return 0
    names = next(_csv.reader(io.StringIO(header[0]), delimiter=delimiter))
    schema = T.StructType([T.StructField(f"c{n}", T.StringType()) for n in range(len(names))] + [T.StructField("__fault", T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__fault").option("sep", delimiter).csv(path)
    return df.agg(F.count("__fault"), *[F.max(f"c{n}") for n in range(len(names))]).first()[0]


# --- JSON


def one_a_line(spark: SparkSession, path: str) -> bool:
    """Whether a file has a JSON record a line, by its first two lines that are not empty: two whole records tell so,
    since a document that goes on over lines has none on its second."""
    first = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    try:
        return len(first) == 2 and all(isinstance(json.loads(x), dict) for x in first)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, iterator: str | None = None, lines: bool | None = None) -> DataFrame:
    """One row, in the column `item`, for each value at the iterator. The path is split over the cluster when its files
    have a record a line; lines says so, None looks."""
    lines = one_a_line(spark, path) if lines is None else lines
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", False).json(path)
    whole = df.select(F.struct(*[_column(c) for c in df.columns]).alias("item"))
    return iterate(whole, iterator)


def iterate(df: DataFrame, iterator: str | None, item: str = "item") -> DataFrame:
    """df with its item column replaced by the values at a path in it, a row each. The reader already makes a row of
    each element of a top-level list; a root with one list as its only field is unwrapped."""
    kind = df.schema[item].dataType
    steps = segments(iterator or "$")
    if isinstance(kind, T.StructType) and not [s for s in steps if s[0] == "name"]:
        if len(kind.fields) == 1 and isinstance(kind.fields[0].dataType, T.ArrayType) and isinstance(kind.fields[0].dataType.elementType, T.StructType):
            steps = [("name", kind.fields[0].name), ("all",)]
        else:
            return df
    rest = [c for c in df.columns if c != item]
    column, now, left = F.col(item), kind, list(steps)
    while left:
        found = compile_path(now, left[:1]) if not isinstance(now, T.ArrayType) or left[0][0] != "all" else None
        if isinstance(now, T.ArrayType) and left[0][0] in ("all", "name"):
            df = df.select(*[_column(c) for c in rest], F.explode(column).alias(item))
            column, now = F.col(item), now.elementType
            left = left[1:] if left[0][0] == "all" else left
            continue
        if left[0][0] == "all" and isinstance(now, T.StructType):
            found = compile_path(now, left[:1])
        if isinstance(now, T.StructType) and left[0][0] == "name":
            field = next((f for f in now.fields if f.name == left[0][1]), None)
            if field is None:
                raise SourceError(f"iterator {iterator!r}: no field {left[0][1]!r}")
            column, now, left = column.getField(left[0][1]), field.dataType, left[1:]
            continue
        if found is None:
            raise SourceError(f"iterator {iterator!r} does not fit the data")
        column, now, left = found[0](column), T.ArrayType(found[1]) if found[2] else found[1], left[1:]
    if isinstance(now, T.ArrayType):
        return df.select(*[_column(c) for c in rest], F.explode(column).alias(item))
    return df.select(*[_column(c) for c in rest], column.alias(item)).where(F.col(item).isNotNull())


def nested(df: DataFrame, kind: str = "json", item: str = "item") -> Rows:
    schema = df.schema[item].dataType

    def resolve(reference: str) -> Value | None:
        if reference.strip() in ("$", "@", "."):
            return None if isinstance(schema, T.StructType) else Value(F.col(item), schema)
        found = value_at(F.col(item), schema, reference)
        if found is None and re.fullmatch(r"\w+", reference) and (path := find_path(schema, reference)):
            found = value_at(F.col(item), schema, path)
        return found

    return Rows(df, resolve, kind)


# --- XML

#: A longer way to the end of a record than so many bytes leaves a file whole: pieces must fit memory.
_RECORD_BYTES = 1 << 26


def records_of(spark: SparkSession, path: str, tag: str, root: str) -> DataFrame | None:
    """The text of each element of a tag, a row each, from files split over tasks: a piece ends where the text has the
    element's end. None where that cannot be told from the text, which one pass finds out, split as well: elements in
    each other, without content or apart from the root; ends in comments or with blanks; entities; other encodings. None
    too where all files together are no more than Spark would split."""
    if tag == root or not re.fullmatch(r"[\w:.-]+", tag):
        return None
    reader = spark.read.option("lineSep", f"</{tag}>")
    # pieces of more bytes are passed over, which the sum of bytes tells
    pieces = reader.option("mapreduce.input.linerecordreader.line.maxlength", _RECORD_BYTES).text(path)
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    if pieces.columns != ["value"] or pieces._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= least:
        return None
    name, value = re.escape(tag), F.col("value")
    begun = rf"<{name}(?=[\s/>])"
    open_tag = rf"<{name}(?:\s+[^\s=<>/\"']+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*>"
    outside = F.when(value.contains("<!") | value.contains("<?"), F.regexp_replace(value, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", ""))
    odd = outside.contains("<!") | outside.contains("<?") | value.rlike(r"<\?xml[^>]*?encoding\s*=\s*[\"'](?!(?i:utf-?8)[\"'])")
    starts = F.regexp_count(value, F.lit(begun))
    faulty = (starts > 1) | ((starts == 1) & ~value.rlike(open_tag)) | F.coalesce(odd, F.lit(False))
    ends = (starts == 0) & value.rlike(rf"</{re.escape(root)}\s*>\s*$")
    told = pieces.select(faulty.alias("faulty"), (starts == 0).alias("rest"), ends.alias("ends"), F.octet_length("value").alias("bytes"), "_metadata.file_path", "_metadata.file_size")
    files = told.groupBy("file_path", "file_size").agg(F.count_if("faulty").alias("faulty"), F.count_if("rest").alias("rest"), F.count_if("ends").alias("ends"), (F.sum("bytes") + (F.count("*") - 1) * len(f"</{tag}>".encode())).alias("bytes"), F.count("*").alias("pieces"))
    # each file's last piece alone has no record, and closes the root
    sound = (F.col("faulty") == 0) & (F.col("rest") == 1) & (F.col("ends") == 1) & (F.col("bytes") == F.col("file_size"))
    if files.agg(F.coalesce(F.bool_and(sound) & (F.max("pieces") > 1), F.lit(False))).first()[0]:
        return reader.text(path).where(value.rlike(begun)).select(F.concat(F.substr(value, F.regexp_instr(value, F.lit(begun))), F.lit(f"</{tag}>")).alias("value"))
    return None


def load_xml(spark: SparkSession, path: str, tag: str, root: str) -> tuple[DataFrame, bool]:
    """(a row for each element of a tag, whether each file is one task)."""
    reader = spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").option("attributePrefix", "_").option("mode", "PERMISSIVE")
    if (records := records_of(spark, path, tag, root)) is not None:
        texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        df = DataFrame(reader._jreader.xml(texts), spark)
        if "_corrupt_record" not in df.columns:
            return df, False
    return reader.load(path), True


def read_xml(spark: SparkSession, path: str, iterator: str, references: list[str] = ()) -> Rows:
    """One row for each element at the iterator. Where references climb with .., rows start from the ancestor, whose
    element is the row tag, and are exploded downward, so each keeps what is above it."""
    names = [p for p in (iterator or "").split("/") if p]
    if not names:
        raise SourceError("an XPath source needs an iterator")
    climbs = max([0, *(sum(s[0] == "up" for s in xpath_segments(r)) for r in references)])
    climbs = min(climbs, len(names) - 1)
    tag, below = names[-1 - climbs], names[len(names) - climbs :]
    df, whole_files = load_xml(spark, path, tag, names[0])
    df = df.select(F.struct(*[_column(c) for c in df.columns]).alias("up0"))
    levels = ["up0"]
    for n, name in enumerate(below, 1):
        kind = df.schema[levels[-1]].dataType
        field = next((f for f in kind.fields if f.name == name), None)
        if field is None:
            raise SourceError(f"iterator {iterator!r}: no element {name!r}")
        child = F.col(levels[-1]).getField(name)
        child = F.explode(child) if isinstance(field.dataType, T.ArrayType) else child
        df = df.select(*levels, child.alias(f"up{n}")).where(F.col(f"up{n}").isNotNull())
        levels.append(f"up{n}")

    def resolve(reference: str) -> Value | None:
        steps = xpath_segments(reference)
        level = len(levels) - 1
        while steps and steps[0] == ("up",):
            level, steps = level - 1, steps[1:]
        if level < 0:
            return None
        kind = df.schema[levels[level]].dataType
        if not steps:
            steps = [("name", "_VALUE")] if isinstance(kind, T.StructType) else []
        found = compile_path(kind, steps)
        if found and isinstance(found[1], T.StructType):
            found = compile_path(kind, [*steps, ("name", "_VALUE")])
        return Value(found[0](F.col(levels[level])), found[1], found[2]) if found else None

    return Rows(df, resolve, "xml", whole_files=whole_files)


# --- relational


def table_query(table: str, columns: list[str], dialect: str) -> str:
    """The query that reads only what a map refers to: quoted by the dialect's marks, and distinct but for postgres."""
    quote = {"postgres": '"{}"', "sqlserver": "{}"}.get(dialect, "`{}`").format
    wanted = ", ".join(quote(c) for c in dict.fromkeys(columns)) or "*"
    return f"SELECT {'' if dialect == 'postgres' else 'DISTINCT '}{wanted} FROM {table}"


def dialect_of(connection: dict[str, str]) -> str:
    text = f"{connection.get('jdbcDriver', '')} {connection.get('jdbcDSN', '')}".lower()
    return "postgres" if "postgres" in text else "sqlserver" if "sqlserver" in text else "mysql"


def read_jdbc(spark: SparkSession, connection: dict[str, str], query: str, options: dict[str, str]) -> DataFrame:
    """A query over JDBC. With a partitionColumn (numPartitions, 16 if not given) the read is split in ranges of it; the
    bounds are asked of the database where none are given. Rows come in batches of fetchsize (10,000 if not given)."""
    options = {"fetchsize": "10000"} | options
    reader = spark.read.format("jdbc").option("url", connection["jdbcDSN"])
    for option, name in (("driver", "jdbcDriver"), ("user", "username"), ("password", "password")):
        if connection.get(name):
            reader = reader.option(option, connection[name])
    column = options.get("partitionColumn")
    if not column:
        return reader.options(**options).option("query", query).load()
    options.setdefault("numPartitions", "16")
    if "lowerBound" not in options:
        ends = reader.option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM ({query}) bounds_of").load().first()
        reader = spark.read.format("jdbc").options(**{k: v for k, v in (("url", connection["jdbcDSN"]), ("driver", connection.get("jdbcDriver")), ("user", connection.get("username")), ("password", connection.get("password"))) if v})
        if ends[0] is None:  # no rows, or none with a value to part them by
            options = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}
            return reader.options(**options).option("query", query).load()
        options |= {"lowerBound": str(ends[0]), "upperBound": str(ends[1])}
    return reader.options(**options).option("dbtable", f"({query}) read_of").load()


def read_relational(spark: SparkSession, source: Source, columns: list[str], jdbc: dict[str, str] | None = None) -> Rows:
    """Over JDBC where a connection is given, else from the session's tables and views."""
    connection = dict(source.connection)
    dialect = dialect_of(connection)
    query = source.query or (table_query(source.table, columns, dialect) if source.table else None)
    if query is None:
        raise SourceError("a relational source needs a table or a query")
    if connection.get("jdbcDSN"):
        df = read_jdbc(spark, connection, query.rstrip().rstrip(";"), dict(jdbc or {}))
    elif source.query:
        df = spark.sql(source.query.rstrip().rstrip(";"))
    else:
        df = spark.table(source.table)
        known = [c for c in dict.fromkeys(columns) if c in df.columns]
        df = df.select(*[_column(c) for c in known]).distinct() if known and set(columns) <= set(df.columns) else df
    return _flat(df, "postgres" if dialect == "postgres" else "mysql", fold=dialect == "postgres")


# --- N-Triples and SPARQL

_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, g) tokens from lines; comments and empty lines give no row."""
    part = lambda n: F.regexp_extract(column, _NT, n)
    return lines.where(F.col(column).rlike(_NT)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.nullif(part(4), F.lit("")).alias("g"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def plain(token: Column) -> Column:
    """A token's text: an IRI without its brackets, a literal's text, a blank node's label."""
    from ..functions.text import unescape_literal

    literal = unescape_literal(F.regexp_extract(token, r'^"((?:[^"\\]|\\.)*)"', 1))
    return F.when(token.startswith("<"), F.substring(token, F.lit(2), F.length(token) - 2)).when(token.startswith('"'), literal).otherwise(token)


_VAR = r"[?$](\w+)"


def select_query(triples: DataFrame, query: str) -> DataFrame:
    """SELECT over a basic graph pattern, as self-joins of the triples; PREFIX, a, ; and , are understood."""
    prefixes = dict(re.findall(r"(?i)\bPREFIX\s+([\w-]*):\s*<([^>]*)>", query))
    head = re.search(r"(?is)\bSELECT\s+(DISTINCT\s+)?(.*?)\s*(?:WHERE\s*)?\{(.*)\}", query)
    if not head:
        raise SourceError("only SELECT over a basic graph pattern is understood")
    tokens = re.findall(r'<[^>]*>|[?$]\w+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?|[\w-]*:[\w.-]*\w|\ba\b|[;,.]', head[3])

    def term(t: str) -> str:
        if t == "a":
            return "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
        if t[0] in '<?$"' or t.startswith("_:"):
            return t
        prefix, _, name = t.partition(":")
        return f"<{prefixes[prefix]}{name}>"

    patterns, now = [], []
    for t in [*tokens, "."]:
        if t in ".;,":
            if len(now) == 3:
                patterns.append(tuple(now))
            now = [] if t == "." else now[:1] if t == ";" else now[:2]
        else:
            now.append(term(t))
    out: DataFrame | None = None
    for pattern in patterns:
        step, columns, seen = triples.select("s", "p", "o"), [], {}
        for name, t in zip("spo", pattern):
            if t[0] in "?$":
                if t[1:] in seen:
                    step = step.where(F.col(seen[t[1:]]) == F.col(name))
                else:
                    seen[t[1:]] = name
                    columns.append(F.col(name).alias(t[1:]))
            else:
                step = step.where(F.col(name) == t)
        step = step.select(*columns)
        shared = [] if out is None else [c for c in step.columns if c in out.columns]
        if out is None:
            out = step
        elif shared:
            out = out.join(step, shared)
        else:
            raise SourceError("patterns must share a variable with those before")
    if out is None:
        raise SourceError("the pattern is empty")
    wanted = out.columns if head[2].strip() == "*" else re.findall(_VAR, head[2])
    out = out.select(*[plain(_column(c)).alias(c) for c in wanted])
    return out.distinct() if head[1] else out


class _EndpointReader(DataSourceReader):
    """Without `page` the query is one request. With it, the endpoint is asked for the number of results, and each page
    of so many is a task of its own; the query should be ordered, as endpoints owe no order otherwise."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        page = int(self.options.get("page", 0))
        if not page:
            return [InputPartition(None)]
        return [InputPartition((page, at)) for at in range(0, max(1, self.ask(counting(self.options["query"]))[0]), page)]

    def ask(self, query):
        """The first row of a query's answer."""
        row = next(iter(fetch(self.options["url"], query, float(self.options.get("timeout", 60)))[1]))
        return [int(x) for x in row]

    def read(self, partition):
        query = self.options["query"]
        if partition.value:
            query += " LIMIT {} OFFSET {}".format(*partition.value)
        yield from fetch(self.options["url"], query, float(self.options.get("timeout", 60)))[1]


def counting(query: str) -> str:
    """The query that counts another's results."""
    start = re.search(r"(?i)\bSELECT\b", query).start()
    return f"{query[:start]} SELECT (COUNT(*) AS ?results) WHERE {{ {{ {query[start:]} }} }}"


def fetch(url: str, query: str, timeout: float = 60) -> tuple[list[str], list[tuple]]:
    """Names and rows of a SELECT's JSON results."""
    request = urllib.request.Request(url, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        body = json.load(answer)
    names = body["head"]["vars"]
    return names, [tuple(b[n]["value"] if n in b else None for n in names) for b in body["results"]["bindings"]]


class SparqlEndpoint(DataSource):
    """spark.read.format("sparql_endpoint").option("url", ...).option("query", ...): all columns are text."""

    @classmethod
    def name(cls):
        return "sparql_endpoint"

    def schema(self):
        names = re.findall(_VAR, re.search(r"(?is)\bSELECT\s+(.*?)(?:\bWHERE\b|\{)", self.options["query"])[1])
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema):
        return _EndpointReader(dict(self.options))


def read(spark: SparkSession, source: Source, references: list[str], options) -> Rows:
    """The rows of a source; references are all that a map reads of it."""
    if source.formulation == "CSV":
        if options.csv_check and (faults := csv_faults(spark, source.location)):
            raise SourceError(f"{source.location}: {faults} rows are not as wide as the header")
        multiline = open_quotes(spark, source.location) if options.csv_multiline is None else options.csv_multiline
        df = read_csv(spark, source.location, multiline=multiline)
        tokens = (*(NULL_TOKENS if options.null_tokens else ()), *source.null_values)
        return replace(_flat(df, "csv", tokens), whole_files=multiline)
    if source.formulation == "JSONPath":
        lines = source.location.endswith((".jsonl", ".ndjson")) or one_a_line(spark, source.location)
        return replace(nested(read_json(spark, source.location, source.iterator, lines)), whole_files=not lines)
    if source.formulation == "XPath":
        return read_xml(spark, source.location, source.iterator, references)
    if source.formulation == "SQL":
        return read_relational(spark, source, references, dict(options.jdbc))
    if source.formulation == "NTriples":
        triples = read_ntriples(spark, source.location)
        query = source.query or source.iterator
        df = select_query(triples, query) if query else triples.select(*[plain(F.col(c)).alias(n) for c, n in zip("spo", ("subject", "predicate", "object"))])
        return _flat(df, "csv")
    if source.formulation == "SPARQL":
        spark.dataSource.register(SparqlEndpoint)
        df = spark.read.format("sparql_endpoint").option("url", source.location.removeprefix("endpoint:")).option("query", source.query or source.iterator).option("page", options.sparql_page).load()
        return _flat(df, "csv")
    raise SourceError(f"unknown reference formulation {source.formulation}")


flat = _flat
