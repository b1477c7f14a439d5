"""Text rules of RDF terms as Column expressions: all run in the JVM, within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Cells of delimited text that stand for no value.
NULL_TOKENS = ("nan", "N/A", "None", "NULL")
#: All Unicode white space, and the separators of ASCII.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def percent_encode(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and _ - . ~ : @ = + % as they are."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%40", "@"), ("%3D", "="), ("%2B", "+"), ("%25", "%")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike("[^A-Za-z0-9_.~:@=+%-]"), out).otherwise(c)


#: Characters that no IRI may hold.
NOT_IN_IRI = "".join(map(chr, range(0x21))) + '<>"{}|\\^`'


def iri_safe(c: Column) -> Column:
    """An IRI with the characters that none may hold percent-encoded, all others as they are."""
    out = c
    for bad in NOT_IN_IRI:
        out = F.replace(out, F.lit(bad), F.lit(f"%{ord(bad):02X}"))
    return F.when(c.rlike("[" + "".join(f"\\x{ord(x):02x}" for x in NOT_IN_IRI) + "]"), out).otherwise(c)


def iri_safe_text(text: str) -> str:
    return "".join(f"%{ord(x):02X}" if x in NOT_IN_IRI else x for x in text)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Whether a text has nothing but white space and bars."""
    return F.btrim(c, F.lit(WHITE + "|")) == ""


def present(c: Column, tokens: tuple[str, ...] = ()) -> Column:
    """c, or null where it is blank or one of tokens."""
    gone = is_blank(c) | c.isin(*tokens) if tokens else is_blank(c)
    return F.when(~gone, c)


def escape_literal(c: Column, compat_quotes: bool = False) -> Column:
    """Escapes of an N-Triples string; compat_quotes turns double quotes into single ones instead."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit("'" if compat_quotes else '\\"'))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_literal(c: Column) -> Column:
    """The text of an N-Triples string's escapes."""
    mark = F.lit("\x00")
    out = F.replace(c, F.lit("\\\\"), mark)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, mark, F.lit("\\"))


def blank_label(c: Column) -> Column:
    """A blank node's label: / as 2F, percent-encoded without the signs, . as 2E."""
    return F.replace(F.replace(percent_encode(F.replace(c, F.lit("/"), F.lit("2F"))), F.lit("%"), F.lit("")), F.lit("."), F.lit("2E"))


def decimal_repr(c: Column) -> Column:
    """Text that looks like a number with a fraction as the shortest such number: 1.50 as 1.5, 000.10 as 0.1, 2.00 as
    2.0; other text as it is."""
    whole = F.regexp_replace(F.regexp_extract(c, r"^-?(\d+)\.\d+$", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(c, r"^-?\d+\.(\d+)$", 1), r"(?<=\d)0+$", "")
    return F.when(c.contains(".") & c.rlike(r"^-?\d+\.\d+$"), F.concat(F.when(c.startswith("-"), "-").otherwise(""), whole, F.lit("."), part)).otherwise(c)


def ceiling(c: Column) -> Column:
    """Text that looks like a number with a fraction as the next whole number; other text as it is."""
    return F.when(c.contains(".") & c.rlike(r"^-?\d+\.\d+$"), F.ceil(c.try_cast("double")).cast("string")).otherwise(c)


def float_text(c: Column) -> Column:
    """A double as Python writes it where that has no exponent."""
    plain = F.call_function("format_number", c, F.lit("0.0##################"))
    return F.when(c == F.floor(c), F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).when(F.abs(c) >= 1e-3, F.when(F.abs(c) < 1e7, c.cast("string")).otherwise(plain)).otherwise(plain)


def text_of(c: Column, kind: T.DataType) -> Column:
    """Any scalar as the text of a literal."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float_text(c.cast("double"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def natural_datatype(kind: T.DataType) -> str | None:
    """The XSD type that a column's own type implies, if any."""
    names = {"boolean": "boolean", "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "double", "double": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "hexBinary"}
    name = "decimal" if isinstance(kind, T.DecimalType) else names.get(kind.typeName())
    return f"http://www.w3.org/2001/XMLSchema#{name}" if name else None


def url_suffix(c: Column) -> Column:
    """What may end a URL: letters, digits, _ - ( ), with slashes as -; text with http as it is."""
    return F.when(c.contains("http"), c).otherwise(F.regexp_replace(F.regexp_replace(c, r"[/\\]", "-"), r"(?U)[^\p{L}\p{N}_()-]", ""))


def valid_url(c: Column) -> Column:
    """Whether a text has a scheme and a host."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def is_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("true", "false", "0", "1"), F.lit(False))


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))


def is_double(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def is_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def is_datetime(c: Column) -> Column:
    return F.try_to_timestamp(F.replace(F.replace(c, F.lit(" T"), F.lit("T")), F.lit("Z"), F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
