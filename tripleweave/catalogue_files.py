"""Queries that read files: the shared tables written as CSV, JSON, XML and session tables, then mapped; and the rarer
parts of mappings. Each equals its SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalogue import ENCODE, HEAD, RDF_, TYPE, P, add, add_mapping, call, const, engine, field, iri, one_map, over, ref, select, source, table, tables_of, triples_sql, view
from .functions.registry import BUILT_IN, Registry
from .operators.terms import Options, Terms
from .operators.views import shared_items
from .plans.engine import Engine
from .plans.loader import load_text
from .scratch import scratch_path
from .sinks import rdf
from .sources.readers import csv_faults, flat, parse_ntriples

Maker = Callable[[SparkSession, str], DataFrame]


def written(spark: SparkSession, df: DataFrame, form: str, **options) -> str:
    """The path of df as files of a form."""
    path = scratch_path(spark)
    (df.write.format(form).options(**options).save if form != "text" else df.write.text)(path)
    return path


def as_csv(spark: SparkSession, df: DataFrame) -> str:
    return written(spark, df, "csv", header=True, quote='"', escape='"', quoteAll=True)


def as_json(spark: SparkSession, df: DataFrame) -> str:
    return written(spark, df, "json")


def as_document(spark: SparkSession, df: DataFrame, key: str) -> str:
    """All rows as one JSON document under a key; for small tables."""
    rows = df.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("*"))).alias(key))).alias("value"))
    return written(spark, rows.select(F.regexp_replace("value", r"\},", "},\n")).coalesce(1), "text")


def as_xml(row: str) -> Callable[[SparkSession, DataFrame], str]:
    return lambda spark, df: written(spark, df, "xml", rowTag=row, rootTag="all")


def add_files(name: str, mapping: str, make: Maker, save: Callable[[SparkSession, DataFrame], str], sql: str, options: Options | None = None, columns: str = "spo") -> None:
    """A mapping whose source FILE is what make() gives, written by save()."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = save(spark, make(spark, sf_dir))
        return Engine(spark, load_text(HEAD + mapping.replace("FILE", path)), options).graph().select(*columns)

    add(name, query, sql)


def of(name: str, *columns: str) -> Maker:
    return lambda spark, sf_dir: table(spark, sf_dir, name).selectExpr(*columns) if columns else table(spark, sf_dir, name)


def json_map(subject: str, *poms: str, iterator: str = "", formulation: str = "ql:JSONPath") -> str:
    more = f'; rml:iterator "{iterator}"' if iterator else ""
    return one_map("FILE", subject, *poms).replace(source("FILE"), f'rml:logicalSource [ rml:source "FILE" ; rml:referenceFormulation {formulation} {more} ]')


def text(c: str) -> str:
    return f"'\"' || {c} || '\"'"


# --- CSV

add_files("q70_csv_files", one_map("FILE", "part/{p_partkey}", 'ex:name|rml:reference "p_name"', 'ex:brand|rr:template "brand/{p_brand}"'), of("part", "p_partkey", "p_name", "p_brand"), as_csv, triples_sql(select(iri("part/", "p_partkey"), P("name"), text("p_name"), "part"), select(iri("part/", "p_partkey"), P("brand"), iri("brand/", "p_brand"), "part")))
add_files("q70b_csv_cells_of_lines", one_map("FILE", "http://ex.org/part/{p_partkey}", 'ex:both|rml:reference "both"'), of("part", "p_partkey", "concat(p_name, '\\n\"', p_type, '\"') AS both"), as_csv, select(iri("part/", "p_partkey"), P("both"), """'"' || p_name || '\\n\\"' || p_type || '\\""'""", "part"))
add_files("q70c_csv_sentinels", one_map("FILE", "http://ex.org/part/{p_partkey}", 'ex:v|rml:reference "v"'), of("part", "p_partkey", "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN ' | ' ELSE p_name END AS v"), as_csv, select(iri("part/", "p_partkey"), P("v"), text("p_name"), "part WHERE p_size % 5 > 2"))
add_files("q70d_csv_repeated_rows", one_map("FILE", "http://ex.org/brand/{p_brand}", 'ex:kind|rml:reference "p_type"'), of("part", "p_brand", "p_type"), as_csv, select(iri("brand/", ENCODE.format("p_brand")), P("kind"), text("p_type"), "part"))


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    cut_short = F.when(F.col("n_nationkey") >= 20, F.concat(F.col("line"), F.lit(",more"))).when(F.col("n_nationkey") < 3, F.regexp_extract("line", "^[^,]*", 0)).otherwise(F.col("line"))
    out = []
    for name, column in (("whole", F.col("line")), ("broken", cut_short)):
        head = spark.createDataFrame([("key,name", -1)], "line string, n long")
        body = lines.select(column.alias("line"), F.col("n_nationkey").cast("long").alias("n"))
        path = written(spark, head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("line"), "text")
        out.append((name, csv_faults(spark, path)))
    return spark.createDataFrame(out, "file string, faults int")


add("q70e_csv_validation", _faults, "SELECT 'whole' AS file, 0 AS faults UNION ALL SELECT 'broken', CAST(count(*) FILTER (n_nationkey >= 20 OR n_nationkey < 3) AS INT) FROM nation")

# --- JSON

_NESTED = ("o_orderkey AS id", "o_totalprice AS price", "struct(o_orderstatus AS status, struct(o_custkey AS customer) AS who) AS more", "split(o_orderpriority, '-') AS words")
_WORDS = "(SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders)"
add_files("q71_json_lines", json_map("http://ex.org/order/{id}", 'ex:status|rml:reference "more.status"', 'ex:by|rr:template "http://ex.org/customer/{more.who.customer}"', 'ex:word|rml:reference "words[*]"', 'ex:price|rr:template "http://ex.org/price/{price}"'), of("orders", *_NESTED), as_json, triples_sql(select(iri("order/", "o_orderkey"), P("status"), text("o_orderstatus"), "orders"), select(iri("order/", "o_orderkey"), P("by"), iri("customer/", "o_custkey"), "orders"), select(iri("order/", "o_orderkey"), P("word"), text("w"), f"{_WORDS} WHERE trim(w) <> ''").replace("|| w ||", "|| trim(w) ||"), select(iri("order/", "o_orderkey"), P("price"), iri("price/", "CAST(CAST(ceil(o_totalprice) AS BIGINT) AS VARCHAR)"), "orders")))
_DOC = triples_sql(select(iri("nation/", "n_nationkey"), P("name"), text("n_name"), "nation"))
add_files("q71b_json_document_iterator", json_map("http://ex.org/nation/{n_nationkey}", 'ex:name|rml:reference "n_name"', iterator="$.nations[*]"), of("nation"), lambda s, df: as_document(s, df, "nations"), _DOC)
add_files("q71c_json_single_root", json_map("http://ex.org/nation/{n_nationkey}", 'ex:name|rml:reference "n_name"'), of("nation"), lambda s, df: as_document(s, df, "nations"), _DOC)
add_files("q71d_json_path_discovery", json_map("http://ex.org/order/{id}", 'ex:by|rml:reference "customer"'), of("orders", *_NESTED), as_json, select(iri("order/", "o_orderkey"), P("by"), text("o_custkey"), "orders"))

# --- XML

_PERSON = ("c_custkey AS _id", "c_name AS name", "struct(c_nationkey AS _no, c_mktsegment AS segment) AS home", "array(c_mktsegment, concat(c_name, '!')) AS label")
_XML = [select(iri("customer/", "c_custkey"), P(p), text(c), "customer") for p, c in (("name", "c_name"), ("nation", "c_nationkey"), ("segment", "c_mktsegment"), ("label", "c_mktsegment"), ("label", "c_name || '!'"))]
add_files("q72_xml_files", json_map("http://ex.org/customer/{@id}", 'ex:name|rml:reference "name"', 'ex:nation|rml:reference "home/@no"', 'ex:segment|rml:reference "home/segment/text()"', 'ex:label|rml:reference "label"', 'ex:link|rr:template "http://ex.org/seg/{home/segment}"', iterator="/all/person", formulation="ql:XPath"), of("customer", *_PERSON), as_xml("person"), triples_sql(*_XML, select(iri("customer/", "c_custkey"), P("link"), iri("seg/", ENCODE.format("c_mktsegment")), "customer")))
add_files("q72b_xml_parents", json_map("http://ex.org/customer/{../@id}/{@no}", 'ex:of|rml:reference "../name"', iterator="/all/person/home", formulation="ql:XPath"), of("customer", *_PERSON), as_xml("person"), select(iri("customer/", "c_custkey || '/' || c_nationkey"), P("of"), text("c_name"), "customer"))
add_files("q72c_xpath_view", view("v", "FILE", f'{field("id", "r:reference " + chr(34) + "@id" + chr(34))} ; {field("name")} ; r:field [ r:fieldName "place" ; r:iterator "home" ; {field("segment")} ]', formulation='ql:XPath ; r:iterator "/all/person"') + over("v", "http://ex.org/customer/{id}", 'ex:name|rml:reference "name"', 'ex:segment|rml:reference "place.segment"'), of("customer", *_PERSON), as_xml("person"), triples_sql(select(iri("customer/", "c_custkey"), P("name"), text("c_name"), "customer"), select(iri("customer/", "c_custkey"), P("segment"), text("c_mktsegment"), "customer")))

# --- relational


def as_session_table(spark: SparkSession, df: DataFrame) -> str:
    """A view of the session, by a name of its own."""
    name = "t" + scratch_path(spark).rsplit("/", 1)[-1]
    df.createOrReplaceTempView(name)
    return name


def r2rml(where: str, subject: str, *columns: str) -> str:
    poms = " ; ".join(f'rr:predicateObjectMap [ rr:predicate ex:{c} ; rr:objectMap [ rr:column "{c}" ] ]' for c in columns)
    return f'<#m> {where} ; rr:subjectMap [ rr:template "{subject}" ; rr:class ex:Row ] ; {poms} .\n'


_ROW = ("o_orderkey AS k", "CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_orderstatus END AS s", "o_totalprice AS price", "CAST(o_orderdate AS DATE) AS day", "CAST(o_orderpriority AS BINARY) AS bytes", "o_custkey % 2 = 0 AS even")
_S = "CASE WHEN o_orderstatus = 'F' THEN 'UnKnown' ELSE o_orderstatus END"
_KEY = iri("row/", f"o_orderkey || '/' || {_S} || '/' || CAST(CAST(ceil(o_totalprice) AS BIGINT) AS VARCHAR)")
_COLUMNS = [select(_KEY, P(p), text(c), "orders") for p, c in (("day", "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"), ("bytes", "o_orderpriority"), ("even", "CAST(o_custkey % 2 = 0 AS VARCHAR)"), ("s", "CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_orderstatus END"))]
add_files("q73_r2rml_table", r2rml('rr:logicalTable [ rr:tableName "FILE" ]', "http://ex.org/row/{k}/{s}/{price}", "day", "bytes", "even", "s"), of("orders", *_ROW), as_session_table, triples_sql(*_COLUMNS, select(_KEY, f"'{TYPE}'", P("Row"), "orders")))
add_files("q73b_r2rml_query", r2rml('rr:logicalTable [ rr:sqlQuery "SELECT s, count(*) AS n FROM FILE GROUP BY s;" ]', "http://ex.org/status/{s}", "n"), of("orders", *_ROW), as_session_table, f"SELECT {iri('status/', _S)} AS s, {P('n')} AS p, {text('count(*)')} AS o FROM orders GROUP BY o_orderstatus UNION SELECT {iri('status/', _S)}, '{TYPE}', {P('Row')} FROM orders")
_PG = "@prefix d2rq: <http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#> . <#pg> d2rq:jdbcDriver \"org.postgresql.Driver\" .\n"
_PG_KEY = iri("row/", "o_orderkey || '/' || CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_orderstatus END")
add_files("q73c_postgres_rows", _PG + '<#m> rml:logicalSource [ rml:source <#pg> ; rr:tableName "FILE" ] ; rr:subjectMap [ rr:template "http://ex.org/row/{K}/{s}" ] ; rr:predicateObjectMap [ rr:predicate ex:price ; rr:objectMap [ rr:template "http://ex.org/price/{price}" ] ] , [ rr:predicate ex:even ; rr:objectMap [ rml:reference "EVEN" ] ] .\n', of("orders", *_ROW), as_session_table, triples_sql(select(_PG_KEY, P("price"), iri("price/", "CAST(CAST(ceil(o_totalprice) AS BIGINT) AS VARCHAR)"), "orders"), select(_PG_KEY, P("even"), text("CAST(o_custkey % 2 = 0 AS VARCHAR)"), "orders")))

# --- views

_TWO_LINES = "concat('name,kind\\n\"', p_name, '\",', 'first\\n', 'x,second') AS rows"
add_files("q74_csv_in_json", view("v", "FILE", f"{field('p_partkey')} ; " + field("rows", f'r:reference "rows" ; r:referenceFormulation ql:CSV ; {field("name")} ; {field("kind")}'), formulation="ql:JSONPath") + over("v", "http://ex.org/part/{p_partkey}", 'ex:row|rr:template "{rows.#} {rows.name} {rows.kind}" ; rr:termType rr:Literal'), of("part", "p_partkey", _TWO_LINES), as_json, triples_sql(select(iri("part/", "p_partkey"), P("row"), text("'0 ' || p_name || ' first'"), "part"), select(iri("part/", "p_partkey"), P("row"), text("'1 x second'"), "part")))
_FIELDS = f"{field('key', 'r:reference ' + chr(34) + 'n_nationkey' + chr(34))} ; {field('kind', 'r:constant ' + chr(34) + 'nation' + chr(34))} ; {field('label', 'r:template ' + chr(34) + '{n_name} of {n_regionkey}' + chr(34))}"
add_mapping("q75_lv_constant_and_template", view("v", "nation", _FIELDS) + over("v", "http://ex.org/{kind}/{key}", 'ex:label|rml:reference "label"'), tables_of("nation"), select(iri("nation/", "n_nationkey"), P("label"), text("n_name || ' of ' || n_regionkey"), "nation"))
add_files("q75b_lv_flatten_record", view("v", "FILE", f"{field('id')} ; {field('more')}", formulation="ql:JSONPath") + over("v", "http://ex.org/order/{id}", 'ex:status|rml:reference "more.status"'), of("orders", *_NESTED), as_json, select(iri("order/", "o_orderkey"), P("status"), text("o_orderstatus"), "orders"))
add_files("q75c_lv_repeated_items", view("v", "FILE", f"{field('conv_id')} ; " + field("item", f'r:iterator "$.items[*]" ; {field("role")}'), formulation="ql:JSONPath") + over("v", "http://ex.org/conv/{conv_id}", 'ex:role|rr:template "{item.#} {item.role}" ; rr:termType rr:Literal'), lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x["role"].alias("role"))).alias("items")), as_json, select(iri("conv/", "conv_id"), P("role"), text("n || ' ' || role"), "(SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS n FROM conversations GROUP BY conv_id, role)"))
_ORDERS = view("o", "orders", f"{field('o_orderkey')} ; {field('o_custkey')}")
add_mapping("q75d_lv_place_of_match", _ORDERS + view("v", "customer", field("c_custkey"), f'; r:leftJoin [ r:parentLogicalView <#o> ; r:joinCondition [ r:child "c_custkey" ; r:parent "o_custkey" ] ; {field("order", "r:reference " + chr(34) + "o_orderkey" + chr(34))} ]') + over("v", "http://ex.org/customer/{c_custkey}", 'ex:order|rr:template "{order.#}:{order}" ; rr:termType rr:Literal'), tables_of("orders", "customer"), select(iri("customer/", "c_custkey"), P("order"), text("n || ':' || o_orderkey"), "(SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"))


def _keyed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_set(F.col("n_nationkey").cast("string"))).alias("keys"))


add_mapping("q75e_lv_join_on_list_key", view("n", "nation", f"{field('n_nationkey')} ; {field('n_name')}") + view("v", "regions", field("n_regionkey"), f'; r:innerJoin [ r:parentLogicalView <#n> ; r:joinCondition [ r:child "keys" ; r:parent "n_nationkey" ] ; {field("nation", "r:reference " + chr(34) + "n_name" + chr(34))} ]') + over("v", "http://ex.org/region/{n_regionkey}", 'ex:nation|rml:reference "nation"'), tables_of("nation", regions=_keyed_regions), select(iri("region/", "n_regionkey"), P("nation"), text("n_name"), "nation"))

# --- gathers

_N_NAME = iri("nation/", ENCODE.format("n_name"))
add_mapping("q76_gather_on_list_key", f'<#m> {source("regions")} ; rr:subjectMap [ rr:template "http://ex.org/region/{{n_regionkey}}" ] ; rr:predicateObjectMap [ rr:predicate ex:nations ; rr:objectMap [ rr:template "http://ex.org/all/{{n_regionkey}}" ; r:gather ( [ rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "keys" ; rr:parent "n_nationkey" ] ] ) ; r:gatherAs rdf:Bag ] ] .\n' + one_map("nation", "http://ex.org/nation/{n_name}", id_="#n"), tables_of("nation", regions=_keyed_regions), triples_sql(select(iri("region/", "n_regionkey"), P("nations"), iri("all/", "n_regionkey"), "nation"), select(iri("all/", "n_regionkey"), f"'{TYPE}'", f"'<{RDF_}Bag>'", "nation"), select(iri("all/", "n_regionkey"), f"'<{RDF_}_' || row_number() OVER (PARTITION BY n_regionkey ORDER BY {_N_NAME}) || '>'", _N_NAME, "nation")))


def _pair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.array("r_name").alias("names"), F.array(F.col("r_regionkey").cast("string")).alias("keys"))


def gather_of(node: str, members: str, kind: str) -> str:
    return f'<#m> {source("pairs")} ; rr:subjectMap [ rr:template "http://ex.org/region/{{r_regionkey}}" ] ; rr:predicateObjectMap [ rr:predicate ex:has ; rr:objectMap [ {node} r:gather ( {members} ) ; r:gatherAs rdf:{kind} ] ] .'


for _n, _node, _sql in (("template", 'rr:template "bag{r_regionkey}" ; rr:termType rr:BlankNode ;', "'_:bag' || r_regionkey"), ("reference", 'rml:reference "r_name" ; rr:termType rr:BlankNode ;', f"'_:' || replace({ENCODE.format('r_name')}, '%', '')")):
    add_mapping(f"q76b_gather_blank_{_n}", gather_of(_node, '[ rml:reference "names" ]', "Bag"), tables_of(pairs=_pair_lists), triples_sql(select(iri("region/", "r_regionkey"), P("has"), _sql, "region"), select(_sql, f"'{TYPE}'", f"'<{RDF_}Bag>'", "region"), select(_sql, f"'<{RDF_}_1>'", text("r_name"), "region")))
_FRESH = "'_:g' || substr(sha256('0/0.0' || chr(1) || '<http://ex.org/region/' || r_regionkey || '>' || chr(1) || '\"' || r_name || '\"'), 1, 32)"
add_mapping("q76c_gather_fresh_node", gather_of("", '[ rml:reference "names" ]', "Seq"), tables_of(pairs=_pair_lists), triples_sql(select(iri("region/", "r_regionkey"), P("has"), _FRESH, "region"), select(_FRESH, f"'{TYPE}'", f"'<{RDF_}Seq>'", "region"), select(_FRESH, f"'<{RDF_}_1>'", text("r_name"), "region")))
_INNER = "'_:g' || substr(sha256('0/0.0.1' || chr(1) || '<http://ex.org/region/' || r_regionkey || '>' || chr(1) || '\"' || r_regionkey || '\"'), 1, 32)"
_OUTER = iri("all/", "r_regionkey")
add_mapping("q76d_nested_gather", gather_of('rr:template "http://ex.org/all/{r_regionkey}" ;', '[ rml:reference "names" ] [ r:gather ( [ rml:reference "keys" ] ) ; r:gatherAs rdf:Seq ]', "Bag"), tables_of(pairs=_pair_lists), triples_sql(select(iri("region/", "r_regionkey"), P("has"), _OUTER, "region"), select(_OUTER, f"'{TYPE}'", f"'<{RDF_}Bag>'", "region"), select(_OUTER, f"'<{RDF_}_1>'", text("r_name"), "region"), select(_OUTER, f"'<{RDF_}_2>'", _INNER, "region"), select(_INNER, f"'{TYPE}'", f"'<{RDF_}Seq>'", "region"), select(_INNER, f"'<{RDF_}_1>'", text("r_regionkey"), "region")))

# --- functions

_FNML = "@prefix fnml: <http://semweb.mmlab.be/ns/fnml#> . @prefix fno: <https://w3id.org/function/ontology#> .\n"


def legacy(function: str, *parameters: tuple[str, str]) -> str:
    given = "".join(f" , [ rr:predicate f:{name} ; rr:objectMap [ {body} ] ]" for name, body in parameters)
    return f"fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:objectMap [ rr:constant f:{function} ] ]{given} ]"


add_mapping("q77_legacy_functions", _FNML + one_map("part", "http://ex.org/part/{p_partkey}", "ex:value|" + legacy("concat2", ("value1", ref("p_brand")), ("value2", ref("p_type")))), tables_of("part"), select(iri("part/", "p_partkey"), P("value"), text("p_brand || p_type"), "part"))
add_mapping("q77b_legacy_nested_functions", _FNML + one_map("part", "http://ex.org/part/{p_partkey}", "ex:value|" + legacy("toUpperCase", ("valueParam", legacy("string_replace", ("valueParam", ref("p_name")), ("param_find", const("a")), ("param_replace", const("_")))))), tables_of("part"), select(iri("part/", "p_partkey"), P("value"), text("upper(replace(p_name, 'a', '_'))"), "part"))
add_mapping("q77c_common_function", one_map("part", "http://ex.org/part/{p_partkey}", "ex:a|" + call("toLowerCase", ("valueParam", ref("p_name"))), "ex:b|" + call("concat2", ("value1", call("toLowerCase", ("valueParam", ref("p_name")))), ("value2", const("!")))), tables_of("part"), triples_sql(select(iri("part/", "p_partkey"), P("a"), text("lower(p_name)"), "part"), select(iri("part/", "p_partkey"), P("b"), text("lower(p_name) || '!'"), "part")))
add_mapping("q77d_user_function", one_map("part", "http://ex.org/part/{p_partkey}", "ex:value|" + call("backwards", ("valueParam", ref("p_name")))), tables_of("part"), select(iri("part/", "p_partkey"), P("value"), text("reverse(p_name)"), "part"), options=Options(registry=Registry(BUILT_IN | {"backwards": lambda a: F.reverse(a["valueParam"])})))
add_mapping("q77e_date_columns", one_map("days", "http://ex.org/order/{k}", "ex:day|" + call("normalizeDate", ("strDate", ref("day")), ("pattern", const("%d/%m/%Y"))), "ex:at|" + call("normalizeDateTime", ("strDate", ref("at")), ("pattern", const("%Y-%m-%d %H:%M:%S")))), tables_of(days=lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))), triples_sql(select(iri("order/", "o_orderkey"), P("day"), text("strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 00:00:00'"), "orders"), select(iri("order/", "o_orderkey"), P("at"), text("strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"), "orders")))
add_mapping("q77f_upper_case_url_whole", one_map("pages", "http://ex.org/page/{page_id}", "ex:value|" + call("toUpperCaseURL", ("str", ref("url")))), tables_of("pages"), select(iri("page/", "page_id"), P("value"), text("upper(url)"), "pages"))

# --- mapping rules

add(
    "q78_predicate_uses",
    lambda spark, sf_dir: spark.createDataFrame(sorted(engine(spark, sf_dir, one_map("region", "http://ex.org/r/{r_regionkey}", 'ex:name|rml:reference "r_name"', "rdf:seeAlso|rr:constant ex:World", more="; rr:class ex:Place") + one_map("nation", "http://ex.org/n/{n_nationkey}", 'ex:name|rml:reference "n_name"', more="; rr:class ex:Place", id_="#b"), tables_of("region", "nation")).predicates().items()), "predicate string, n int"),
    f"SELECT * FROM (VALUES ('http://ex.org/Place', 2), ('http://ex.org/name', 2), ('{RDF_}seeAlso http://ex.org/World', 1)) AS v(predicate, n)",
)
add_mapping("q79_repeated_poms", one_map("region", "http://ex.org/region/{r_regionkey}", *['ex:name|rml:reference "r_name"'] * 3), tables_of("region"), select(iri("region/", "r_regionkey"), P("name"), text("r_name"), "region"), options=Options(remove_duplicates=False))
add_mapping("q80_escaped_braces", one_map("region", "http://ex.org/region/{r_regionkey}", r'ex:note|rr:template "\\{{r_name}\\}" ; rr:termType rr:Literal'), tables_of("region"), select(iri("region/", "r_regionkey"), P("note"), text("'{' || r_name || '}'"), "region"))
add_mapping("q81_template_condition", one_map("part", "http://ex.org/part/{p_partkey}", 'ex:brand|rr:template "http://ex.org/brand/{p_brand}[p_size=7]"'), tables_of("part"), select(iri("part/", "p_partkey"), P("brand"), iri("brand/", ENCODE.format("p_brand")), "part"))


def _subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = Terms(flat(table(spark, sf_dir, "lineitem"), "csv"), Options())
    key = terms.subject_key(["l_orderkey", "l_linenumber"])
    return terms.frame().select(key.alias("subject_key"))


add("q82_subject_key", _subject_keys, "SELECT l_orderkey || '_' || l_linenumber AS subject_key FROM lineitem")
add("q82b_equal_values", lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", shared_items([F.col("n_nationkey"), F.lit(None)], [F.col("n_regionkey"), F.lit(None)]).alias("equal_values")), "SELECT n_nationkey, CAST(n_nationkey = n_regionkey AS INT) + 1 AS equal_values FROM nation")
_MISSING = one_map("region", "http://ex.org/region/{r_regionkey}", 'ex:name|rml:reference "r_name"', 'ex:of|rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "gone" ; rr:parent "n_nationkey" ]') + one_map("nation", "http://ex.org/nation/{n_nationkey}", id_="#n")
add_mapping("q83_missing_join_reference", _MISSING, tables_of("region", "nation"), select(iri("region/", "r_regionkey"), P("name"), text("r_name"), "region"), options=Options(ignore=True))
add_mapping("q84_iri_of_any_text", one_map("odd", "urn:part:{v}", 'ex:link|rr:template "http://ex.org/{v}/{w}"'), tables_of(odd=lambda s, d: table(s, d, "part").selectExpr("concat(p_name, ' <x>') AS v", "concat('http://a b|', p_partkey) AS w")), select("'<urn:part:' || replace(p_name, ' ', '%20') || '%20%3Cx%3E>'", P("link"), iri("", f"{ENCODE.format(chr(40) + 'p_name || ' + chr(39) + ' <x>' + chr(39) + chr(41))} || '/http://a%20b%7C' || p_partkey"), "part"))
_SHARED = one_map("orders", "http://ex.org/order/{o_orderkey}", *[f'ex:{p}|rr:parentTriplesMap <#c> ; rr:joinCondition [ rr:child "o_custkey" ; rr:parent "c_custkey" ]' for p in ("by", "paidBy")]) + one_map("customer", "http://ex.org/customer/{c_custkey}", id_="#c")
add_mapping("q85_shared_join_side", _SHARED, tables_of("orders", "customer"), triples_sql(*[select(iri("order/", "o_orderkey"), P(p), iri("customer/", "o_custkey"), "orders JOIN customer ON o_custkey = c_custkey") for p in ("by", "paidBy")]))

# --- sinks

_TARGETS = one_map("orders", "http://ex.org/order/{o_orderkey}", 'ex:status|rml:reference "o_orderstatus" ; r:logicalTarget <#t> , <#u>', 'ex:priority|rml:reference "o_orderpriority"') + "".join(f'<#{x}> a r:LogicalTarget ; r:target [ r:path "status.nt" ] ; r:serialization <http://www.w3.org/ns/formats/N-Triples> .\n' for x in "tu")


def _written_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir, _TARGETS, tables_of("orders"))
    folder = scratch_path(spark)
    places = sorted(set(rdf.write_targets(made, folder).values())) + [f"{folder}/default"]
    parts = [parse_ntriples(spark.read.text(p)).select(F.lit(n).alias("place"), "s", "p", "o") for n, p in enumerate(places)]
    return parts[0].unionByName(parts[1])


add("q86_targets_written_once", _written_targets, f"SELECT 0 AS place, * FROM ({select(iri('order/', 'o_orderkey'), P('status'), text('o_orderstatus'), 'orders')}) UNION ALL SELECT 1 AS place, * FROM ({select(iri('order/', 'o_orderkey'), P('priority'), text('o_orderpriority'), 'orders')})")


def _one_file(form: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = engine(spark, sf_dir, one_map("nation", "http://ex.org/region/{n_regionkey}", 'ex:nation|rml:reference "n_name"'), tables_of("nation")).graph()
        path = f"{scratch_path(spark)}/one"
        rdf.write(graph, path, form, {"ex": "http://ex.org/"}, single_file=True)
        return spark.read.text(path, wholetext=True)

    return query


_NATION_TRIPLES = "SELECT DISTINCT n_regionkey, n_name FROM nation"
add("q87_single_turtle_file", lambda spark, sf_dir: _one_file("turtle")(spark, sf_dir).select(F.explode(F.split("value", "\n")).alias("line")).where("line <> '' and line not like '<http%'"), f"SELECT '@prefix ex: <http://ex.org/> .' AS line UNION ALL SELECT CASE WHEN n = 1 THEN '    ex:nation ' ELSE '        ' END || '\"' || n_name || '\"' || CASE WHEN n = m THEN ' .' ELSE ' ,' END FROM (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS n, count(*) OVER (PARTITION BY n_regionkey) AS m FROM ({_NATION_TRIPLES}))")
add("q87b_single_json_file", lambda spark, sf_dir: _one_file("rdf-json")(spark, sf_dir).select(F.explode(F.from_json("value", "map<string,map<string,array<struct<value:string,type:string>>>>")).alias("s", "v")).select("s", F.explode("v").alias("p", "o")).select("s", "p", F.explode("o").alias("o")).select("s", "p", F.col("o.value").alias("o"), F.col("o.type").alias("type")), "SELECT DISTINCT 'http://ex.org/region/' || n_regionkey AS s, 'http://ex.org/nation' AS p, n_name AS o, 'literal' AS type FROM nation")

__all__ = ["add_files", "as_csv", "as_json", "as_xml"]
