"""Queries over the shared tables: mappings of each operator, and the SQL whose rows they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import containers
from .operators.terms import Options, Terms, references
from .plans.engine import Engine
from .plans.loader import load_text
from .sinks import rdf
from .sources.readers import Rows, flat, nested, parse_ntriples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HEAD = """
@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix r: <http://w3id.org/rml/> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix f: <http://ex.org/functions#> .
@prefix ex: <http://ex.org/> .
@base <http://ex.org/> .
"""
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
#: SQL of percent-encoding, and of escapes in literals.
ENCODE = "replace(replace(replace(replace(replace(url_encode({0}),'%3A',':'),'%40','@'),'%3D','='),'%2B','+'),'%25','%')"
ESCAPE = "replace(replace(replace(replace({0},'\\','\\\\'),'\"','\\\"'),chr(10),'\\n'),chr(13),'\\r')"

Maker = Callable[[SparkSession, str], dict[str, Rows]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(*names: str, kind: str = "csv", **made: Callable[[SparkSession, str], DataFrame]) -> Maker:
    def make(spark: SparkSession, sf_dir: str) -> dict[str, Rows]:
        out = {n: flat(table(spark, sf_dir, n), kind) for n in names}
        return out | {n: flat(f(spark, sf_dir), kind) for n, f in made.items()}

    return make


def engine(spark: SparkSession, sf_dir: str, mapping: str, tables: Maker, options: Options | None = None) -> Engine:
    return Engine(spark, load_text(HEAD + mapping), options, tables(spark, sf_dir))


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def add_mapping(name: str, mapping: str, tables: Maker, sql: str | None, columns: str = "spo", options: Options | None = None) -> None:
    """A query whose rows are a mapping's graph."""
    add(name, lambda spark, sf_dir: engine(spark, sf_dir, mapping, tables, options).graph().select(*columns), sql)


def source(name: str, formulation: str = "ql:CSV") -> str:
    return f'rml:logicalSource [ rml:source "{name}" ; rml:referenceFormulation {formulation} ]'


def one_map(name: str, subject: str, *poms: str, more: str = "", id_: str = "#m") -> str:
    """A triples map with a template subject; poms are `predicate objectMap-body` pairs joined by |."""
    body = " ; ".join(f"rr:predicateObjectMap [ rr:predicate {p.split('|', 1)[0]} ; rr:objectMap [ {p.split('|', 1)[1]} ] ]" for p in poms)
    return f'<{id_}> {source(name)} ; rr:subjectMap [ rr:template "{subject}" {more} ]' + (f" ; {body}" if body else "") + " .\n"


def triples_sql(*parts: str, distinct: bool = True) -> str:
    """The union of SELECTs of s, p and o."""
    return (" UNION " if distinct else " UNION ALL ").join(f"({p})" for p in parts)


def select(s: str, p: str, o: str, rest: str, more: str = "") -> str:
    return f"SELECT DISTINCT {s} AS s, {p} AS p, {o} AS o{more} FROM {rest}"


def iri(stem: str, c: str) -> str:
    return f"'<http://ex.org/{stem}' || {c} || '>'"


P = "'<http://ex.org/{}>'".format

# --- joins, classes and terms

NATION = one_map("nation", "http://ex.org/nation/{n_name}", id_="#n")

add_mapping(
    "q01_ref_object_join",
    one_map("customer", "http://ex.org/customer/{c_custkey}", 'ex:inNation|rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "c_nationkey" ; rr:parent "n_nationkey" ]') + NATION,
    tables_of("customer", "nation"),
    select(iri("customer/", "c_custkey"), P("inNation"), iri("nation/", ENCODE.format("n_name")), "customer JOIN nation ON c_nationkey = n_nationkey"),
)
add_mapping("q02_class_assertion", one_map("region", "http://ex.org/region/{r_regionkey}", more="; rr:class ex:Region, ex:Place"), tables_of("region"), triples_sql(select(iri("region/", "r_regionkey"), f"'{TYPE}'", P("Region"), "region"), select(iri("region/", "r_regionkey"), f"'{TYPE}'", P("Place"), "region")))
add_mapping("q03_template_multi_ref", one_map("lineitem", "http://ex.org/line/{l_orderkey}-{l_linenumber}", 'ex:status|rml:reference "l_linestatus"'), tables_of("lineitem"), select(iri("line/", "l_orderkey || '-' || l_linenumber"), P("status"), "'\"' || l_linestatus || '\"'", "lineitem"))
add_mapping("q04_template_percent_encode", one_map("part", "http://ex.org/part/{p_name}/{p_type}", 'ex:brand|rr:template "http://ex.org/brand/{p_brand}"'), tables_of("part"), select(iri("part/", f"{ENCODE.format('p_name')} || '/' || {ENCODE.format('p_type')}"), P("brand"), iri("brand/", ENCODE.format("p_brand")), "part"))
add_mapping("q05_reference_literal", one_map("part", "http://ex.org/part/{p_partkey}", 'ex:name|rml:reference "p_name"'), tables_of("part"), select(iri("part/", "p_partkey"), P("name"), "'\"' || p_name || '\"'", "part"))
add_mapping("q06_typed_literal", one_map("orders", "http://ex.org/order/{o_orderkey}", 'ex:price|rml:reference "o_totalprice" ; rr:datatype xsd:double', 'ex:kind|rml:reference "o_orderstatus" ; rml:datatypeMap [ rr:template "http://ex.org/type/{o_orderpriority}" ]'), tables_of("orders"), triples_sql(select(iri("order/", "o_orderkey"), P("price"), "'\"' || CAST(o_totalprice AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#double>'", "orders"), select(iri("order/", "o_orderkey"), P("kind"), "'\"' || o_orderstatus || '\"^^<http://ex.org/type/' || o_orderpriority || '>'", "orders")))
add_mapping("q07_datetime_literal", one_map("events", "http://ex.org/event/{event_id}", 'ex:at|rml:reference "ts" ; rr:datatype xsd:dateTime'), tables_of("events"), select(iri("event/", "event_id"), P("at"), "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\"^^<http://www.w3.org/2001/XMLSchema#dateTime>'", "events"))
add_mapping("q08_language_map", one_map("documents", "http://ex.org/doc/{doc_id}", 'ex:source|rml:reference "source" ; rml:languageMap [ rml:reference "lang" ]', 'ex:note|rr:constant "seen" ; rr:language "en-GB"'), tables_of("documents"), triples_sql(select(iri("doc/", "doc_id"), P("source"), "'\"' || source || '\"' || coalesce('@' || lang, '')", "documents WHERE source IS NOT NULL"), select(iri("doc/", "doc_id"), P("note"), "'\"seen\"@en-GB'", "documents")))
add_mapping("q09_iri_term_type", one_map("pages", "http://ex.org/page/{page_id}", 'ex:url|rml:reference "url" ; rr:termType rr:IRI'), tables_of("pages"), select(iri("page/", "page_id"), P("url"), "'<' || url || '>'", "pages WHERE NOT contains(url, ' ')"))
add_mapping("q10_bnode_subject", '<#m> ' + source("pages") + ' ; rr:subjectMap [ rr:template "{url}" ; rr:termType rr:BlankNode ] ; rr:predicateObjectMap [ rr:predicate ex:id ; rr:objectMap [ rml:reference "page_id" ] ] .', tables_of("pages"), select(f"concat('_:', replace(replace({ENCODE.format(chr(39).join(['replace(url,', '/', ',', '2F', ')']))}, '%', ''), '.', '2E'))", P("id"), "'\"' || page_id || '\"'", "pages"))
add_mapping("q11_named_graph_template", one_map("orders", "http://ex.org/order/{o_orderkey}", 'ex:status|rml:reference "o_orderstatus"', more='; rr:graphMap [ rr:template "http://ex.org/graph/{o_orderpriority}" ]'), tables_of("orders"), select(iri("order/", "o_orderkey"), P("status"), "'\"' || o_orderstatus || '\"'", "orders", ", " + iri("graph/", ENCODE.format("o_orderpriority")) + " AS g"), "spog")
add_mapping("q12_constant_terms", one_map("region", "http://ex.org/region/{r_regionkey}", 'ex:part|rr:constant ex:World', 'ex:note|rr:constant "a \\"b\\""'), tables_of("region"), triples_sql(select(iri("region/", "r_regionkey"), P("part"), P("World"), "region"), select(iri("region/", "r_regionkey"), P("note"), "'\"a \\\"b\\\"\"'", "region")))
add_mapping("q13_predicate_template", '<#m> ' + source("events") + ' ; rr:subjectMap [ rr:template "http://ex.org/user/{user_id}" ] ; rr:predicateObjectMap [ rr:predicateMap [ rr:template "http://ex.org/did/{event_type}" ] ; rr:objectMap [ rr:template "http://ex.org/event/{event_id}" ] ] .', tables_of("events"), select(iri("user/", "user_id"), iri("did/", ENCODE.format("event_type")), iri("event/", "event_id"), "events"))

_HOLES = "CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'N/A' WHEN 3 THEN ' | ' WHEN 4 THEN NULL WHEN 5 THEN 'nan' ELSE p_name END"
add_mapping("q14_blank_and_sentinel_filter", one_map("holes", "http://ex.org/part/{p_partkey}", 'ex:name|rml:reference "v"', 'ex:link|rr:template "http://ex.org/name/{v}"'), lambda spark, sf_dir: {"holes": flat(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_HOLES} AS v"), "csv", ("nan", "N/A", "None", "NULL"))}, triples_sql(select(iri("part/", "p_partkey"), P("name"), "'\"' || p_name || '\"'", "part WHERE p_size % 7 = 6"), select(iri("part/", "p_partkey"), P("link"), iri("name/", ENCODE.format("p_name")), "part WHERE p_size % 7 = 6")))
add_mapping("q15_composite_key_join", one_map("lineitem", "http://ex.org/line/{l_orderkey}-{l_linenumber}", 'ex:part|rr:parentTriplesMap <#p> ; rr:joinCondition [ rr:child "l_orderkey" ; rr:parent "l_orderkey" ] , [ rr:child "l_linenumber" ; rr:parent "l_linenumber" ]') + one_map("lines", "http://ex.org/part/{l_partkey}", id_="#p"), tables_of("lineitem", lines=lambda s, d: table(s, d, "lineitem")), select(iri("line/", "a.l_orderkey || '-' || a.l_linenumber"), P("part"), iri("part/", "b.l_partkey"), "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"))
add_mapping("q16_self_source_rowlocal", one_map("nation", "http://ex.org/nation/{n_nationkey}", "ex:region|rr:parentTriplesMap <#r>", 'ex:same|rr:parentTriplesMap <#r> ; rr:joinCondition [ rr:child "n_name" ; rr:parent "n_name" ]') + one_map("nation", "http://ex.org/region/{n_regionkey}", id_="#r"), tables_of("nation"), triples_sql(*[select(iri("nation/", "n_nationkey"), P(p), iri("region/", "n_regionkey"), "nation") for p in ("region", "same")]))
add_mapping("q17_self_join_diff_cols", one_map("nation", "http://ex.org/nation/{n_nationkey}", 'ex:like|rr:parentTriplesMap <#o> ; rr:joinCondition [ rr:child "n_regionkey" ; rr:parent "n_nationkey" ]') + one_map("nation", "http://ex.org/name/{n_name}", id_="#o"), tables_of("nation"), select(iri("nation/", "a.n_nationkey"), P("like"), iri("name/", ENCODE.format("b.n_name")), "nation a JOIN nation b ON a.n_regionkey = b.n_nationkey"))
add_mapping("q18_dedup_before_join", one_map("orders", "http://ex.org/priority/{o_orderpriority}", 'ex:segment|rr:parentTriplesMap <#c> ; rr:joinCondition [ rr:child "o_custkey" ; rr:parent "c_custkey" ]') + one_map("customer", "http://ex.org/segment/{c_mktsegment}", id_="#c"), tables_of("orders", "customer"), select(iri("priority/", ENCODE.format("o_orderpriority")), P("segment"), iri("segment/", ENCODE.format("c_mktsegment")), "(SELECT DISTINCT o_orderpriority, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey"))

# --- logical views


def view(name: str, source_: str, fields: str, more: str = "", formulation: str = "ql:CSV") -> str:
    return f'<#{name}> a r:LogicalView ; r:viewOn [ r:source "{source_}" ; r:referenceFormulation {formulation} ] ; {fields} {more} .\n'


def field(name: str, body: str = "") -> str:
    return f'r:field [ r:fieldName "{name}" ; {body or f"r:reference {chr(34)}{name}{chr(34)}"} ]'


def over(view_: str, subject: str, *poms: str) -> str:
    return one_map("x", subject, *poms).replace(source("x"), f"rml:logicalSource <#{view_}>")


CUSTOMERS = view("customers", "customer", f"{field('c_custkey')} ; {field('c_name')}")
add_mapping("q19_lv_inner_join", CUSTOMERS + view("v", "orders", field("o_orderkey"), f'; r:innerJoin [ r:parentLogicalView <#customers> ; r:joinCondition [ r:child "o_custkey" ; r:parent "c_custkey" ] ; {field("name", "r:reference " + chr(34) + "c_name" + chr(34))} ]') + over("v", "http://ex.org/order/{o_orderkey}", 'ex:by|rml:reference "name"'), tables_of("orders", "customer"), select(iri("order/", "o_orderkey"), P("by"), "'\"' || c_name || '\"'", "orders JOIN customer ON o_custkey = c_custkey"))
add_mapping("q20_lv_left_join", view("o", "orders", f"{field('o_orderkey')} ; {field('o_custkey')}") + view("v", "customer", f"{field('c_custkey')} ; {field('c_name')}", f'; r:leftJoin [ r:parentLogicalView <#o> ; r:joinCondition [ r:child "c_custkey" ; r:parent "o_custkey" ] ; {field("order", "r:reference " + chr(34) + "o_orderkey" + chr(34))} ]') + over("v", "http://ex.org/customer/{c_custkey}", 'ex:name|rml:reference "c_name"', 'ex:order|rr:template "http://ex.org/order/{order}"'), tables_of("orders", "customer"), triples_sql(select(iri("customer/", "c_custkey"), P("name"), "'\"' || c_name || '\"'", "customer"), select(iri("customer/", "c_custkey"), P("order"), iri("order/", "o_orderkey"), "customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")))
add_mapping("q21_lv_templated_join_key", view("n", "nation", f"{field('n_nationkey')} ; {field('n_name')}") + view("v", "supplier", field("s_suppkey"), f'; r:innerJoin [ r:parentLogicalView <#n> ; r:joinCondition [ r:childMap [ r:template "N{{s_nationkey}}" ] ; r:parentMap [ r:template "N{{n_nationkey}}" ] ] ; {field("nation", "r:reference " + chr(34) + "n_name" + chr(34))} ]') + over("v", "http://ex.org/supplier/{s_suppkey}", 'ex:nation|rml:reference "nation"'), tables_of("supplier", "nation"), select(iri("supplier/", "s_suppkey"), P("nation"), "'\"' || n_name || '\"'", "supplier JOIN nation ON 'N' || s_nationkey = 'N' || n_nationkey"))
add_mapping("q22_lv_json_in_column", view("v", "events", f"{field('event_id')} ; " + field("props", f'r:reference "props" ; r:referenceFormulation ql:JSONPath ; r:iterator "$" ; {field("k")}')) + over("v", "http://ex.org/event/{event_id}", 'ex:k|rml:reference "props.k"', 'ex:at|rml:reference "props.#"'), tables_of("events"), triples_sql(select(iri("event/", "event_id"), P("k"), "'\"' || json_extract_string(props, '$.k') || '\"'", "events WHERE json_extract_string(props, '$.k') IS NOT NULL"), select(iri("event/", "event_id"), P("at"), "'\"0\"'", "events")))


def _word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("names"), F.split("p_type", " ").alias("types"))


add_mapping("q23_lv_flatten_lists", view("v", "words", f"{field('p_partkey')} ; {field('names')} ; {field('types')}") + over("v", "http://ex.org/part/{p_partkey}", 'ex:name|rr:template "{names.#}:{names}" ; rr:termType rr:Literal', 'ex:type|rr:template "{types.#}:{types}" ; rr:termType rr:Literal', 'ex:both|rr:template "{names}{types}" ; rr:termType rr:Literal'), tables_of(words=_word_lists), triples_sql(*[select(iri("part/", "p_partkey"), P(p), "'\"' || (i - 1) || ':' || w || '\"'", f"(SELECT p_partkey, unnest(string_split({c}, ' ')) AS w, generate_subscripts(string_split({c}, ' '), 1) AS i FROM part) WHERE trim(w) <> ''") for p, c in (("name", "p_name"), ("type", "p_type"))]))
add_mapping("q24_lv_item_index", view("v", "roles", f"{field('conv_id')} ; {field('roles')}") + over("v", "http://ex.org/conv/{conv_id}", 'ex:turn|rr:template "http://ex.org/turn/{roles.#}/{roles}"'), tables_of(roles=lambda s, d: _roles(s, d)), select(iri("conv/", "conv_id"), P("turn"), iri("turn/", "n || '/' || role"), "(SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)"))
add_mapping("q25_lv_row_index", view("v", "nation", field("n_name")) + over("v", "http://ex.org/nation/{n_name}", 'ex:place|rml:reference "#"'), tables_of(nation=lambda s, d: table(s, d, "nation").orderBy("n_nationkey").coalesce(1)), select(iri("nation/", ENCODE.format("n_name")), P("place"), "'\"' || n || '\"'", "(SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation)"))
add_mapping("q25b_lv_row_index_over_parts", view("v", "orders", field("o_orderkey")) + over("v", "http://ex.org/order/{o_orderkey}", 'ex:place|rml:reference "#"'), tables_of(orders=lambda s, d: table(s, d, "orders").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey")), select(iri("order/", "o_orderkey"), P("place"), "'\"' || n || '\"'", "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)"))
add_mapping("q26_view_over_view", view("inner", "region", f"{field('key', 'r:reference ' + chr(34) + 'r_regionkey' + chr(34))} ; {field('name', 'r:reference ' + chr(34) + 'r_name' + chr(34))}") + '<#v> a r:LogicalView ; r:viewOn <#inner> ; r:field [ r:fieldName "title" ; r:reference "name" ] ; r:field [ r:fieldName "id" ; r:reference "key" ] .\n' + over("v", "http://ex.org/region/{id}", 'ex:title|rml:reference "title"'), tables_of("region"), select(iri("region/", "r_regionkey"), P("title"), "'\"' || r_name || '\"'", "region"))


def _iterable(spark: SparkSession, sf_dir: str) -> dict[str, Rows]:
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("items"))
    return {"json": nested(items.select(F.struct("conv_id", "items").alias("item")))}


add_mapping("q26b_lv_iterable", view("v", "json", f"{field('conv_id')} ; " + field("item", f'r:iterator "$.items[*]" ; {field("turn")} ; {field("role")}'), formulation="ql:JSONPath") + over("v", "http://ex.org/conv/{conv_id}", 'ex:said|rr:template "{item.#} {item.turn} {item.role}" ; rr:termType rr:Literal'), _iterable, select(iri("conv/", "conv_id"), P("said"), "'\"' || n || ' ' || turn || ' ' || role || '\"'", "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS n FROM conversations)"))

# --- gathers


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["role"]).alias("roles"), F.transform(ordered, lambda x: x["turn"].cast("string")).alias("turns"))


def gather_map(kind: str, members: str, more: str = "") -> str:
    return f'<#m> {source("roles")} ; rr:subjectMap [ rr:template "http://ex.org/conv/{{conv_id}}" ] ; rr:predicateObjectMap [ rr:predicate ex:has ; rr:objectMap [ rr:template "http://ex.org/all/{{conv_id}}" ; r:gather ( {members} ) ; r:gatherAs rdf:{kind} {more} ] ] .'


_TURNS = "(SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)"
_ALL = iri("all/", "conv_id")
_HAS = select(iri("conv/", "conv_id"), P("has"), _ALL, "conversations")
RDF_ = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_ROLES, _TWO = '[ rml:reference "roles" ]', '[ rml:reference "roles" ] [ rml:reference "turns" ]'
add_mapping("q27_gather_bag", gather_map("Bag", _TWO), tables_of(roles=_roles), triples_sql(_HAS, select(_ALL, f"'{TYPE}'", f"'<{RDF_}Bag>'", "conversations"), select(_ALL, f"'<{RDF_}_' || n || '>'", "'\"' || role || '\"'", _TURNS), select(_ALL, f"'<{RDF_}_' || (n + m) || '>'", "'\"' || turn || '\"'", _TURNS)))
for _n, _kind in ((28, "Seq"), (29, "Alt")):
    add_mapping(f"q{_n}_gather_{_kind.lower()}", gather_map(_kind, _TWO), tables_of(roles=_roles), triples_sql(_HAS, select(_ALL, f"'{TYPE}'", f"'<{RDF_}{_kind}>'", "conversations"), select(_ALL, f"'<{RDF_}_' || n || '>'", "'\"' || role || '\"'", _TURNS), select(_ALL, f"'<{RDF_}_' || n || '>'", "'\"' || turn || '\"'", _TURNS)))
_CELL = "CASE WHEN {n} = 0 THEN " + _ALL + " ELSE '_:l' || substr(sha256(" + _ALL + " || '|' || {n}), 1, 32) END"
add_mapping("q30_gather_list", gather_map("List", _ROLES), tables_of(roles=_roles), triples_sql(_HAS, select(_CELL.format(n="(n - 1)"), f"'<{RDF_}first>'", "'\"' || role || '\"'", _TURNS), select(_CELL.format(n="(n - 1)"), f"'<{RDF_}rest>'", f"CASE WHEN n = m THEN '<{RDF_}nil>' ELSE {_CELL.format(n='n')} END", _TURNS)))


def _region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_name")).alias("names"), F.sort_array(F.collect_set(F.col("n_nationkey").cast("string"))).alias("keys"))


_PAIR = "(SELECT a.n_regionkey AS k, '\"' || a.n_name || '\"' AS x, '\"' || b.n_nationkey || '\"' AS y FROM nation a JOIN nation b USING (n_regionkey))"
_HEAD = "'_:l' || substr(sha256('<http://ex.org/all/' || k || '>|' || x || '|' || y), 1, 32)"
_NEXT = f"'_:l' || substr(sha256({_HEAD} || '|1'), 1, 32)"
add_mapping("q31_gather_cartesian", f'<#m> {source("names")} ; rr:subjectMap [ rr:template "http://ex.org/region/{{n_regionkey}}" ] ; rr:predicateObjectMap [ rr:predicate ex:pair ; rr:objectMap [ rr:template "http://ex.org/all/{{n_regionkey}}" ; r:gather ( [ rml:reference "names" ] [ rml:reference "keys" ] ) ; r:gatherAs rdf:List ; r:strategy r:cartesianProduct ] ] .', tables_of(names=_region_names), triples_sql(select(iri("region/", "k"), P("pair"), _HEAD, _PAIR), select(_HEAD, f"'<{RDF_}first>'", "x", _PAIR), select(_HEAD, f"'<{RDF_}rest>'", _NEXT, _PAIR), select(_NEXT, f"'<{RDF_}first>'", "y", _PAIR), select(_NEXT, f"'<{RDF_}rest>'", f"'<{RDF_}nil>'", _PAIR)))
add_mapping("q31b_gather_subject", f'<#m> {source("roles")} ; rr:subjectMap [ rr:template "http://ex.org/all/{{conv_id}}" ; r:gather ( {_ROLES} ) ; r:gatherAs rdf:Seq ] ; rr:predicateObjectMap [ rr:predicate ex:of ; rr:objectMap [ rml:reference "conv_id" ] ] .', tables_of(roles=_roles), triples_sql(select(_ALL, P("of"), "'\"' || conv_id || '\"'", "conversations"), select(_ALL, f"'{TYPE}'", f"'<{RDF_}Seq>'", "conversations"), select(_ALL, f"'<{RDF_}_' || n || '>'", "'\"' || role || '\"'", _TURNS)))
add_mapping("q31c_gather_joined_members", f'<#m> {source("region")} ; rr:subjectMap [ rr:template "http://ex.org/region/{{r_regionkey}}" ] ; rr:predicateObjectMap [ rr:predicate ex:nations ; rr:objectMap [ rr:template "http://ex.org/all/{{r_regionkey}}" ; r:gather ( [ rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "r_regionkey" ; rr:parent "n_regionkey" ] ] ) ; r:gatherAs rdf:Bag ] ] .\n' + NATION, tables_of("region", "nation"), triples_sql(select(iri("region/", "n_regionkey"), P("nations"), iri("all/", "n_regionkey"), "nation"), select(iri("all/", "n_regionkey"), f"'{TYPE}'", f"'<{RDF_}Bag>'", "nation"), select(iri("all/", "n_regionkey"), f"'<{RDF_}_' || row_number() OVER (PARTITION BY n_regionkey ORDER BY {iri('nation/', ENCODE.format('n_name'))}) || '>'", iri("nation/", ENCODE.format("n_name")), "nation")))
add("q32_group_by_term", lambda spark, sf_dir: containers.group_by_term(table(spark, sf_dir, "nation"), F.concat(F.lit("<http://ex.org/region/"), F.col("n_regionkey").cast("string"), F.lit(">")), F.col("n_name")).select("term", F.array_join(F.transform("members", lambda x: x["n_name"]), ",").alias("names")), "SELECT '<http://ex.org/region/' || n_regionkey || '>' AS term, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM nation GROUP BY n_regionkey")

# --- functions


def call(function: str, *parameters: tuple[str, str], output: str = "") -> str:
    inputs = " , ".join(f"[ r:parameter f:{name} ; r:inputValueMap [ {value} ] ]" for name, value in parameters)
    return f"r:functionExecution [ r:function f:{function} {'; r:input ' + inputs if inputs else ''} ]" + (f" ; r:return f:{output}" if output else "")


def ref(name: str) -> str:
    return f'rml:reference "{name}"'


def const(value: str) -> str:
    return f'rr:constant "{value}"'


def add_function(name: str, table_: str, key: str, body: str, sql: str | None, where: str = "") -> None:
    """A function's result as a literal for each row; sql is its text."""
    made = one_map(table_, f"http://ex.org/{table_}/{{{key}}}", f"ex:value|{body}")
    add_mapping(name, made, tables_of(table_), sql and f"SELECT * FROM ({select(iri(table_ + '/', key), P('value'), chr(39) + chr(34) + chr(39) + ' || ' + ESCAPE.format('(' + sql + ')') + ' || ' + chr(39) + chr(34) + chr(39), table_)}) WHERE o IS NOT NULL")


V = ("valueParam", ref("p_name"))
add_function("q33_to_lower_case", "part", "p_partkey", call("toLowerCase", ("valueParam", ref("p_type"))), "lower(p_type)")
add_function("q34_to_upper_case", "part", "p_partkey", call("toUpperCase", V), "upper(p_name)")
add_function("q35_to_upper_case_url", "part", "p_partkey", call("toUpperCaseURL", ("str", ref("p_name"))), f"'http://' || {ENCODE.format('upper(p_name)')}")
add_function("q36_concat2", "part", "p_partkey", call("concat2", ("value1", ref("p_brand")), ("value2", ref("p_type"))), "p_brand || p_type")
add_function("q37_escape_html", "pages", "page_id", call("escape", ("valueParam", ref("url")), ("modeParam", const("html"))), "replace(replace(replace(replace(replace(url,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')")
add_function("q38_escape_url", "pages", "page_id", call("escape", ("valueParam", ref("url")), ("modeParam", const("url"))), "replace(url_encode(url),'%2F','/')")
add_function("q39_schema", "part", "p_partkey", call("schema", ("stringParameter", ref("p_type"))), f"'https://schema.org/' || {ENCODE.format('p_type')}")
add_function("q40_string_replace", "part", "p_partkey", call("string_replace", V, ("param_find", const("a")), ("param_replace", const("_A_"))), "replace(p_name,'a','_A_')")
add_function("q40b_replace_value", "part", "p_partkey", call("replaceValue", V, ("param_find", const("e")), ("param_replace", const(""))), "replace(p_name,'e','')")
for _part, _sql in (("protocolOutput", "string_split(url,'://')[1]"), ("stringOutput", "CASE WHEN contains(url,'#') THEN string_split(url,'#')[-1] ELSE string_split(url,'/')[-1] END"), ("domainOutput", "CASE WHEN contains(url,'#') THEN string_split(string_split(url,'://')[2],'#')[1] ELSE array_to_string(string_split(string_split(url,'://')[2],'/')[:-2],'/') END")):
    add_function(f"q41_parse_url_{_part[:6].lower()}", "pages", "page_id", call("parseURL", ("stringParameter", ref("url")), output=_part), _sql)
add_function("q42_length", "part", "p_partkey", call("length", V), "CAST(length(p_name) AS VARCHAR)")
add_function("q42b_string_length", "part", "p_partkey", call("string_length", V), "CAST(length(p_name) AS VARCHAR)")
add_function("q43_substring_open", "part", "p_partkey", call("string_substring", V, ("p_int_i_from", const("7"))), "CASE WHEN length(p_name) >= 7 THEN substr(p_name, 8) END")
add_function("q43b_substring_range", "part", "p_partkey", call("string_substring", ("valueParameter", ref("p_name")), ("param_int_i_from", const("2")), ("param_int_i_opt_to", const("9"))), "CASE WHEN length(p_name) > 9 THEN substr(p_name, 3, 7) END")
add_function("q44_array_join", "part", "p_partkey", call("array_join", ("p_array_a", ref("p_brand")), ("p_array_a", ref("p_type")), ("p_array_a", const("z")), ("p_string_sep", const("+"))), "p_brand || '+' || p_type || '+z'")
add_function("q45_string_md5", "part", "p_partkey", call("string_md5", ("valueParameter", ref("p_name"))), "md5(p_name)")
add_function("q46_string_contains", "part", "p_partkey", call("string_contains", ("valueParameter", ref("p_name")), ("string_sub", const("re"))), "CAST(contains(p_name,'re') AS VARCHAR)")
add_function("q47_slugify", "part", "p_partkey", call("slugify", ("str", ref("p_name"))), "trim(regexp_replace(lower(p_name),'[^a-z0-9]+','-','g'),'-')")
add_function("q48_true_condition", "part", "p_partkey", call("trueCondition", ("strBoolean", call("equal", ("valueParam", ref("p_brand")), ("valueParam2", const("Brand#12")))), ("str", ref("p_name"))), "CASE WHEN p_brand = 'Brand#12' THEN p_name END")
add_function("q48b_not_equal", "part", "p_partkey", call("notEqual", ("valueParameter", ref("p_brand")), ("valueParameter2", const("Brand#12"))), "CAST(p_brand <> 'Brand#12' AS VARCHAR)")
add_function("q48c_is_null", "part", "p_partkey", call("isNull", ("str", ref("p_name"))), "CAST(p_name IN ('null','') AS VARCHAR)")
add_function("q49_normalize_date", "part", "p_partkey", call("normalizeDate", ("strDate", const("17/03/2021")), ("pattern", const("%d/%m/%Y"))), "strftime(strptime('17/03/2021','%d/%m/%Y'),'%Y-%m-%d %H:%M:%S')")
add_function("q49b_normalize_date_time", "part", "p_partkey", call("normalizeDateTime", ("strDate", const("2021-03-17 T08:09:10")), ("pattern", const("%Y-%m-%d T%H:%M:%S"))), "'2021-03-17 08:09:10'")
add_function("q50_list_contains", "part", "p_partkey", call("listContainsElement", ("list", ref("p_brand")), ("list", const("x")), ("str", const("Brand#12"))), "CAST(list_contains([p_brand,'x'],'Brand#12') AS VARCHAR)")
add_function("q50b_constants", "region", "r_regionkey", call("concat2", ("value1", call("helloworld")), ("value2", call("alwaysReturnsABC"))), "'Hello World!ABC'")
add_function("q50c_base36", "part", "p_partkey", call("base36encode", ("number", ref("p_partkey"))), "to_base(p_partkey, 36)")
add_function("q50d_uuid", "region", "r_regionkey", call("string_length", ("valueParam", call("uuid"))), "'36'")
add_function("q50e_random", "region", "r_regionkey", call("string_length", ("valueParam", call("random"))), "'36'")
add_function("q51_controls_if_nested", "orders", "o_orderkey", call("controls_if", ("bool_b", call("equal", ("valueParam", ref("o_orderstatus")), ("valueParam2", const("F")))), ("any_true", call("toLowerCase", ("valueParam", ref("o_orderpriority")))), ("any_false", const("open"))), "CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE 'open' END")

# --- statements about statements, union, sinks

add_mapping(
    "q52_quoted_triple",
    '<#q> a r:NonAssertedTriplesMap ; ' + source("orders") + ' ; rr:subjectMap [ rr:template "http://ex.org/order/{o_orderkey}" ] ; rr:predicateObjectMap [ rr:predicate ex:by ; rr:objectMap [ rr:template "http://ex.org/customer/{o_custkey}" ] ] .\n'
    '<#m> ' + source("orders") + ' ; rr:subjectMap [ r:quotedTriplesMap <#q> ] ; rr:predicateObjectMap [ rr:predicate ex:status ; rr:objectMap [ rml:reference "o_orderstatus" ] ] .\n'
    '<#j> ' + source("customer") + ' ; rr:subjectMap [ rr:template "http://ex.org/customer/{c_custkey}" ] ; rr:predicateObjectMap [ rr:predicate ex:claims ; rr:objectMap [ r:quotedTriplesMap <#q> ; rr:joinCondition [ rr:child "c_custkey" ; rr:parent "o_custkey" ] ] ] .',
    tables_of("orders", "customer"),
    triples_sql(select("'<< <http://ex.org/order/' || o_orderkey || '> <http://ex.org/by> <http://ex.org/customer/' || o_custkey || '> >>'", P("status"), "'\"' || o_orderstatus || '\"'", "orders"), select(iri("customer/", "c_custkey"), P("claims"), "'<< <http://ex.org/order/' || o_orderkey || '> <http://ex.org/by> <http://ex.org/customer/' || o_custkey || '> >>'", "customer JOIN orders ON c_custkey = o_custkey")),
)
UNION = one_map("region", "http://ex.org/place/{r_name}", 'ex:name|rml:reference "r_name"', more="; rr:class ex:Place") + one_map("nation", "http://ex.org/place/{n_name}", 'ex:name|rml:reference "n_name"', more="; rr:class ex:Place", id_="#b") + one_map("customer", "http://ex.org/customer/{c_custkey}", 'ex:name|rml:reference "c_name"', id_="#c")
_UNION = [x for t, c in (("region", "r_name"), ("nation", "n_name")) for x in (select(iri("place/", ENCODE.format(c)), P("name"), f"'\"' || {c} || '\"'", t), select(iri("place/", ENCODE.format(c)), f"'{TYPE}'", P("Place"), t))] + [select(iri("customer/", "c_custkey"), P("name"), "'\"' || c_name || '\"'", "customer")]
_UNION_TABLES = tables_of("region", "nation", "customer")
add_mapping("q53_graph_union_dedup", UNION, _UNION_TABLES, triples_sql(*_UNION))
_BY_REGION = one_map("nation", "http://ex.org/region/{n_regionkey}", 'ex:nation|rml:reference "n_name"', more="; rr:class ex:Region")
add("q54_turtle_grouping", lambda spark, sf_dir: rdf.turtle(engine(spark, sf_dir, _BY_REGION, tables_of("nation")).graph(), {"ex": "http://ex.org/"}), "SELECT '<http://ex.org/region/' || n_regionkey || '>' || chr(10) || '    a ex:Region ;' AS value FROM nation GROUP BY n_regionkey UNION ALL SELECT CASE WHEN n = 1 THEN '    ex:nation ' ELSE '        ' END || '\"' || n_name || '\"' || CASE WHEN n = m THEN ' .' ELSE ' ,' END FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS n, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation)")
add("q55_rdf_json", lambda spark, sf_dir: rdf.rdf_json(engine(spark, sf_dir, one_map("region", "http://ex.org/region/{r_regionkey}", 'ex:name|rml:reference "r_name"', "ex:part|rr:constant ex:World"), tables_of("region")).graph()), """SELECT '{"http://ex.org/region/' || r_regionkey || '":{"http://ex.org/name":[{"value":"' || r_name || '","type":"literal"}]' AS value FROM region UNION ALL SELECT ',"http://ex.org/part":[{"value":"http://ex.org/World","type":"uri"}]}}' FROM region""")
add("q55b_nquads_lines", lambda spark, sf_dir: rdf.nquads(engine(spark, sf_dir, one_map("region", "http://ex.org/region/{r_regionkey}", 'ex:name|rml:reference "r_name"', more="; rr:graph ex:g"), tables_of("region")).graph()), "SELECT DISTINCT '<http://ex.org/region/' || r_regionkey || '> <http://ex.org/name> \"' || r_name || '\" <http://ex.org/g> .' AS value FROM region")
_TARGETS = one_map("orders", "http://ex.org/order/{o_orderkey}", 'ex:status|rml:reference "o_orderstatus" ; r:logicalTarget <#t>', 'ex:priority|rml:reference "o_orderpriority"') + '<#t> a r:LogicalTarget ; r:target [ r:path "status.nt" ] ; r:serialization <http://www.w3.org/ns/formats/N-Triples> .'
add("q56_target_routing", lambda spark, sf_dir: engine(spark, sf_dir, _TARGETS, tables_of("orders")).by_target()["http://ex.org/#t"].select("s", "p", "o"), select(iri("order/", "o_orderkey"), P("status"), "'\"' || o_orderstatus || '\"'", "orders"))
add("q57_nt_parse", lambda spark, sf_dir: parse_ntriples(rdf.ntriples(engine(spark, sf_dir, one_map("nation", "http://ex.org/nation/{n_nationkey}", 'ex:name|rml:reference "n_name"'), tables_of("nation")).graph())).select("s", "p", "o"), select(iri("nation/", "n_nationkey"), P("name"), "'\"' || n_name || '\"'", "nation"))


def _customers(spark: SparkSession, sf_dir: str) -> dict[str, Rows]:
    grouped = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.col("c_mktsegment").alias("k")))).alias("all"))
    return {"json": nested(grouped.select(F.struct("c_nationkey", "all").alias("item")))}


add_mapping("q58_json_selector_filter", one_map("json", "http://ex.org/nation/{c_nationkey}", "ex:last|rr:template \"http://ex.org/customer/{all[?(@.k=='BUILDING')].c_custkey}\"", "ex:other|rr:template \"http://ex.org/customer/{all[?(@.k!='BUILDING')].c_custkey}\""), _customers, "SELECT * FROM (" + triples_sql(*[select(iri("nation/", "c_nationkey"), P(p), iri("customer/", f"max(c_custkey) FILTER (WHERE c_mktsegment {op} 'BUILDING')"), "customer GROUP BY c_nationkey") for p, op in (("last", "="), ("other", "<>"))]) + ") WHERE o IS NOT NULL")
add_mapping("q58b_json_multi_value", one_map("json", "http://ex.org/nation/{c_nationkey}", 'ex:has|rr:template "http://ex.org/customer/{all[*].c_custkey}"', 'ex:segment|rml:reference "all[*].k"'), _customers, triples_sql(select(iri("nation/", "c_nationkey"), P("has"), iri("customer/", "c_custkey"), "customer"), select(iri("nation/", "c_nationkey"), P("segment"), "'\"' || c_mktsegment || '\"'", "customer")))
add_mapping("q59_numeric_ceil_template", one_map("orders", "http://ex.org/price/{o_totalprice}", more="; rr:class ex:Price"), tables_of("orders", kind="mysql"), select(iri("price/", "CAST(CAST(ceil(o_totalprice) AS BIGINT) AS VARCHAR)"), f"'{TYPE}'", P("Price"), "orders"))
add_mapping("q59b_numeric_repr_template", one_map("orders", "http://ex.org/price/{o_totalprice}", more="; rr:class ex:Price"), tables_of("orders"), select(iri("price/", "CAST(o_totalprice AS VARCHAR)"), f"'{TYPE}'", P("Price"), "orders"))
add("q60_predicate_frequency", lambda spark, sf_dir: engine(spark, sf_dir, UNION, _UNION_TABLES).graph().groupBy("p").agg(F.count("*").alias("n")), f"SELECT p, count(*) AS n FROM ({triples_sql(*_UNION)}) GROUP BY p")
add_mapping("q61_url_validity_and_suffix", one_map("suffixes", "http://ex.org/page/{page_id}", 'ex:valid|rml:reference "valid"', 'ex:suffix|rml:reference "suffix"'), lambda spark, sf_dir: {"suffixes": flat(_suffixes(spark, sf_dir), "csv")}, triples_sql(select(iri("page/", "page_id"), P("valid"), "'\"true\"'", "pages"), select(iri("page/", "page_id"), P("suffix"), "'\"' || regexp_replace(replace(string_split(url,'://')[2],'/','-'),'[^\\p{L}\\p{N}_()-]','','g') || '\"'", "pages")))


def _suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import url_suffix, valid_url

    return table(spark, sf_dir, "pages").select("page_id", valid_url(F.col("url")).cast("string").alias("valid"), url_suffix(F.element_at(F.split("url", "://"), 2)).alias("suffix"))


def _bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.readers import select_query

    graph = engine(spark, sf_dir, one_map("customer", "http://ex.org/customer/{c_custkey}", 'ex:name|rml:reference "c_name"', 'ex:nation|rr:template "http://ex.org/nation/{c_nationkey}"') + one_map("nation", "http://ex.org/nation/{n_nationkey}", 'ex:name|rml:reference "n_name"', id_="#n"), tables_of("customer", "nation")).graph()
    return select_query(graph, "PREFIX ex: <http://ex.org/> SELECT ?name ?nation WHERE { ?c ex:nation ?n ; ex:name ?name . ?n ex:name ?nation . }")


add("q62_basic_graph_pattern", _bgp, "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")


def _headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: customers, their nations, orders and lines, over one scan a table and joins of distinct sides."""
    mapping = (
        one_map("customer", "http://ex.org/customer/{c_custkey}", 'ex:name|rml:reference "c_name"', 'ex:inNation|rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "c_nationkey" ; rr:parent "n_nationkey" ]', more="; rr:class ex:Customer")
        + one_map("nation", "http://ex.org/nation/{n_name}", 'ex:name|rml:reference "n_name"', more="; rr:class ex:Nation", id_="#n")
        + one_map("orders", "http://ex.org/order/{o_orderkey}", 'ex:status|rml:reference "o_orderstatus"', 'ex:by|rr:parentTriplesMap <#m> ; rr:joinCondition [ rr:child "o_custkey" ; rr:parent "c_custkey" ]', more="; rr:class ex:Order", id_="#o")
    )
    return engine(spark, sf_dir, mapping, tables_of("customer", "nation", "orders")).graph().select("s", "p", "o")


add("q63_headline_graph", _headline, triples_sql(select(iri("customer/", "c_custkey"), P("name"), "'\"' || c_name || '\"'", "customer"), select(iri("customer/", "c_custkey"), P("inNation"), iri("nation/", ENCODE.format("n_name")), "customer JOIN nation ON c_nationkey = n_nationkey"), select(iri("customer/", "c_custkey"), f"'{TYPE}'", P("Customer"), "customer"), select(iri("nation/", ENCODE.format("n_name")), P("name"), "'\"' || n_name || '\"'", "nation"), select(iri("nation/", ENCODE.format("n_name")), f"'{TYPE}'", P("Nation"), "nation"), select(iri("order/", "o_orderkey"), P("status"), "'\"' || o_orderstatus || '\"'", "orders"), select(iri("order/", "o_orderkey"), f"'{TYPE}'", P("Order"), "orders"), select(iri("order/", "o_orderkey"), P("by"), iri("customer/", "c_custkey"), "orders JOIN customer ON o_custkey = c_custkey")))

from . import catalogue_files  # noqa: E402, F401  (adds its queries)

__all__ = ["ORACLE_SQL", "QUERIES", "Terms", "references"]
