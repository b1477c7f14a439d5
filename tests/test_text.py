import math
import random
import string
from urllib.parse import quote

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tripleweave.functions import text as tx


def column(spark, values, change, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(change(F.col("v"))).collect()]


def test_percent_encode_equals_quote(spark):
    rng = random.Random(7)
    pool = string.printable + "éßñ漢字🙂\u00a0\u2003İ"
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(800)]
    assert column(spark, values, tx.percent_encode) == [quote(v, safe="_-.~:@=+%") for v in values]


def test_blank_and_trim(spark):
    values = ["", " ", "\t", "|", " | ", "\u00a0", "\u2003\n", "a", " a ", "\u00a0b\u3000", "a|", None]
    assert column(spark, values, lambda c: tx.present(c)) == [None] * 7 + ["a", " a ", "\u00a0b\u3000", "a|", None]
    assert column(spark, values, tx.trimmed) == [None if v is None else v.strip() for v in values]


def test_numbers(spark):
    values = ["1.50", "000.10", "10000000.0", "-2.25", "7", "1.", ".5", "x1.5", "0.0001", "-0.50", "12.5"]
    assert column(spark, values, tx.decimal_repr) == ["1.5", "0.1", "10000000.0", "-2.25", "7", "1.", ".5", "x1.5", "0.0001", "-0.5", "12.5"]
    assert column(spark, values, tx.ceiling) == [str(math.ceil(float(v))) if v in ("1.50", "000.10", "10000000.0", "-2.25", "0.0001", "-0.50", "12.5") else v for v in values]
    floats = [1.5, 2.0, 1e7, 12345678.25, 0.001, 0.25, -3.0, 0.0, None]
    assert column(spark, floats, tx.float_text, "double") == [None if v is None else repr(v) for v in floats]


def test_literals_round(spark):
    values = ['a"b', "back\\slash", "line\nend", "cr\r", "\\n", "tab\t", "", 'x\\"']
    assert column(spark, values, lambda c: tx.unescape_literal(tx.escape_literal(c))) == values
    assert column(spark, ['a"b'], lambda c: tx.escape_literal(c, True)) == ["a'b"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_escapes_round_on_any_text(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values if "\x00" not in v] or [""]
    assert column(spark, values, lambda c: tx.unescape_literal(tx.escape_literal(c))) == values


def test_blank_labels_and_suffixes(spark):
    assert column(spark, ["http://a.b/c d"], tx.blank_label) == ["http:2F2Fa2Eb2Fc20d"]
    assert column(spark, ["a b/c\\d(é)!", "http://x y"], tx.url_suffix) == ["ab-c-d(é)", "http://x y"]
    assert column(spark, ["http://a/b", "a/b", "x:y", None], tx.valid_url) == [True, False, False, False]


def test_xsd_checks(spark):
    assert column(spark, ["true", "0", "yes", None], tx.is_boolean) == [True, True, False, False]
    assert column(spark, ["12", "-3", "1.5", "x"], tx.is_integer) == [True, True, False, False]
    assert column(spark, ["1e5", "x"], tx.is_double) == [True, False]
    assert column(spark, ["2020-02-29", "2021-02-29"], tx.is_date) == [True, False]
    assert column(spark, ["2020-02-29T10:11:12", "2020-02-29 T10:11:12", "x"], tx.is_datetime) == [True, True, False]


def test_iri_safe(spark):
    assert column(spark, ["http://a/b c<d>", "http://é/x"], tx.iri_safe) == ["http://a/b%20c%3Cd%3E", "http://é/x"]


@pytest.mark.parametrize("kind,value,want", [("boolean", True, "true"), ("int", 5, "5"), ("binary", b"ab", "ab"), ("decimal(5,2)", None, None)])
def test_text_of(spark, kind, value, want):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert df.select(tx.text_of(F.col("v"), df.schema["v"].dataType)).first()[0] == want
