import html
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tripleweave.functions.registry import Arguments, FunctionError, default_registry, java_pattern


def run(spark, name, constants=None, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(default_registry().build(name, Arguments({k: F.col(k) for k in values}, constants))).first()[0]


CASES = [
    ("toLowerCase", {"valueParam": "ÀB"}, "àb"),
    ("toUpperCase", {"valueParam": "aß"}, "ASS"),
    ("toUpperCaseURL", {"str": "a b"}, "http://A%20B"),
    ("toUpperCaseURL", {"str": "https://x"}, "HTTPS://X"),
    ("concat2", {"value1": "a", "value2": "b"}, "ab"),
    ("concat2", {"value1": "a", "value2": ""}, ""),
    ("concat2", {"value1": "a", "value2": None}, ""),
    ("helloworld", {}, "Hello World!"),
    ("alwaysReturnsABC", {}, "ABC"),
    ("escape", {"valueParam": "<a href=\"x\">'&", "modeParam": "html"}, html.escape("<a href=\"x\">'&")),
    ("escape", {"valueParam": "a b/ü~*", "modeParam": "url"}, quote("a b/ü~*")),
    ("schema", {"stringParameter": "a b"}, "https://schema.org/a%20b"),
    ("string_replace", {"valueParam": "aXa", "param_find": "a", "param_replace": "b"}, "bXb"),
    ("string_replace", {"valueParameter": "a.a", "p_string_find": ".", "p_string_replace": ""}, "aa"),
    ("length", {"valueParam": "añ🙂"}, "3"),
    ("string_length", {"valueParam": ""}, "0"),
    ("string_substring", {"valueParam": "abc", "p_int_i_from": "1"}, "bc"),
    ("string_substring", {"valueParam": "abc", "p_int_i_from": "3"}, ""),
    ("string_substring", {"valueParam": "abc", "p_int_i_from": "4"}, None),
    ("string_substring", {"valueParameter": "abcdef", "param_int_i_from": "1", "param_int_i_opt_to": "3"}, "bc"),
    ("string_substring", {"valueParameter": "abc", "param_int_i_from": "1", "param_int_i_opt_to": "3"}, None),
    ("array_join", {"p_array_a": ["a", "b", "a"], "p_string_sep": "-"}, "a-b-a"),
    ("controls_if", {"bool_b": "true", "any_true": "y", "any_false": "n"}, "y"),
    ("controls_if", {"bool_b": "", "any_true": "y", "any_false": "n"}, "n"),
    ("controls_if", {"bool_b": "false", "any_true": "y"}, None),
    ("string_md5", {"valueParameter": "a"}, "0cc175b9c0f1b6a831c399e269772661"),
    ("string_contains", {"valueParameter": "abc", "string_sub": "bc"}, True),
    ("slugify", {"str": " Crème brûlée, Straße! "}, "creme-brulee-strasse"),
    ("trueCondition", {"strBoolean": "true", "str": "v"}, "v"),
    ("trueCondition", {"strBoolean": "", "str": "v"}, None),
    ("isNull", {"str": "null"}, True),
    ("isNull", {"str": None}, False),
    ("equal", {"valueParam": "a", "valueParam2": "a"}, True),
    ("equal", {"valueParameter": "a", "valueParameter2": "b"}, False),
    ("notEqual", {"valueParam": "a", "valueParam2": "b"}, True),
    ("listContainsElement", {"list": ["a", "b"], "str": "b"}, True),
    ("base36encode", {"number": "1295"}, "ZZ"),
    ("replaceValue", {"valueParam": "aa", "param_find": "a", "param_replace": "b"}, "bb"),
]


@pytest.mark.parametrize("name,values,want", CASES)
def test_pool(spark, name, values, want):
    assert run(spark, name, **values) == want


def test_parse_url(spark):
    assert tuple(run(spark, "parseURL", stringParameter="http://a.b/c/d")) == ("http", "d", "a.b/c")
    assert tuple(run(spark, "parseURL", stringParameter="https://a.b/c#d")) == ("https", "d", "a.b/c")


def test_dates(spark):
    assert run(spark, "normalizeDate", {"pattern": "%d/%m/%Y"}, strDate="31/12/2020", pattern="%d/%m/%Y") == "2020-12-31 00:00:00"
    assert run(spark, "normalizeDateTime", {"pattern": "%Y-%m-%dT%H:%M:%S"}, strDate="nonsense", pattern="x") is None
    assert java_pattern("%d-%m-%y T%H") == "dd-MM-yy 'T'HH"
    with pytest.raises(FunctionError):
        run(spark, "normalizeDate", strDate="x", pattern="%d")


def test_random_names(spark):
    assert len(run(spark, "uuid")) == len(run(spark, "random")) == 36


def test_unknown_and_registered(spark):
    registry = default_registry()
    with pytest.raises(FunctionError):
        registry.build("nothing", {})
    registry.register("twice", lambda a: F.concat(a["x"], a["x"]))
    assert spark.sql("select 'b' x").select(registry.build("twice", {"x": F.col("x")})).first()[0] == "bb"
