import json

import pytest
from pyspark.sql import functions as F

from tripleweave.cli import run
from tripleweave.config import load_config
from tripleweave.operators.views import flatten_lists, flatten_struct, has_nested, row_index
from tripleweave.plans.loader import load_text
from tripleweave.sinks import rdf
from tripleweave.sources.paths import find_path
from tripleweave.streaming.graph import stream_graph

from .test_engine import HEAD, E, make, people, pom, small_splits, source, triples

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def view(name, src, body, kind="ql:CSV", more=""):
    return f'<#{name}> a r:LogicalView ; r:viewOn [ r:source "{src}" ; r:referenceFormulation {kind} {more} ] ; {body} .\n'


def ref(name, reference=None):
    return f'r:field [ r:fieldName "{name}" ; r:reference "{reference or name}" ]'


def over(name, template, *poms):
    return f'<#m{name}> rml:logicalSource <#{name}> ; rr:subjectMap [ rr:template "{template}" ] ; {" ; ".join(poms)} .\n'


def literal(p, template):
    return pom(p, f'rr:template "{template}" ; rr:termType rr:Literal')


def test_flatten_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], []), (3, ["c"], [])], "id int, l array<string>, m array<string>")
    got = sorted((r["id"], r["l"], r["l.#"], r["m"], r["m.#"]) for r in flatten_lists(df).select("id", "l", "`l.#`", "m", "`m.#`").collect() if r["l"]) + [(r["id"], r["m"]) for r in flatten_lists(df).collect() if r["m"]]
    assert got == [(1, "a", "0", None, None), (1, "b", "1", None, None), (3, "c", "0", None, None), (1, "x")]
    nested = spark.createDataFrame([((1, "b"),)], "s struct<x:int,y:string>")
    assert has_nested(nested) and flatten_struct(nested).columns == ["s.x", "s.y"] and not has_nested(df)


def test_row_index(spark):
    df = row_index(spark.range(1000, numPartitions=7))
    assert [r["#"] for r in df.orderBy("id").collect()] == [str(i) for i in range(1000)]


def test_inner_join_leaves_gaps_in_the_index(spark, tmp_path):
    join = 'r:innerJoin [ r:parentLogicalView <#p> ; r:joinCondition [ r:child "k" ; r:parent "k" ] ; ' + ref("w") + " ]"
    m = view("p", "p.csv", f"{ref('k')} ; {ref('w')}") + view("v", "c.csv", f"{ref('id')} ; {join}") + over("v", "http://ex.org/{id}", literal("x", "{#} {w}"))
    got = triples(spark, tmp_path, m, c__csv="id,k\n1,a\n2,zz\n3,b\n4,\n", p__csv="k,w\na,1\na,1\na,2\nb,3\n,9\n")
    assert [(s, o) for s, _, o in got] == [(E("1"), '"0 1"'), (E("1"), '"0 2"'), (E("3"), '"2 3"')]


def test_embedded_csv_and_json(spark, tmp_path):
    rows = [{"id": 1, "t": 'a,b\n1,"x, y"\n2,z'}, {"id": 2, "t": "a,b"}]
    sub = "r:field [ r:fieldName \"t\" ; r:reference \"t\" ; r:referenceFormulation ql:CSV ; " + ref("b") + " ]"
    m = view("v", "e.json", f"{ref('id')} ; {sub}", "ql:JSONPath", '; r:iterator "$[*]"') + over("v", "http://ex.org/{id}", literal("x", "{t.#} {t.b}"))
    assert [(s, o) for s, _, o in triples(spark, tmp_path, m, e__json=json.dumps(rows))] == [(E("1"), '"0 x, y"'), (E("1"), '"1 z"')]
    sub = 'r:field [ r:fieldName "j" ; r:reference "j" ; r:referenceFormulation ql:JSONPath ; r:iterator "$.l[*]" ; ' + ref("n", "a.n") + " ]"
    m = view("v", "e.csv", f"{ref('id')} ; {sub}") + over("v", "http://ex.org/{id}", literal("x", "{j.#} {j.n}"))
    assert [(s, o) for s, _, o in triples(spark, tmp_path, m, e__csv='id,j\n1,"{""l"":[{""a"":{""n"":5}},{""a"":{""n"":""q""}}]}"\n2,nonsense\n')] == [(E("1"), '"0 5"'), (E("1"), '"1 q"')]


def test_view_over_view(spark, tmp_path):
    m = view("a", "a.csv", ref("x", "id")) + f'<#b> a r:LogicalView ; r:viewOn <#a> ; {ref("y", "x")} .\n' + over("b", "http://ex.org/{y}", pom("v", 'rml:reference "y"'))
    assert triples(spark, tmp_path, m, a__csv="id\n7\n") == [(E("7"), E("v"), '"7"')]


def gathered(spark, tmp_path, values, kind, more="", members='[ rml:reference "values[*]" ]'):
    m = f'<#m> {source("g.json", "ql:JSONPath")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("has", f"rr:template " + chr(34) + "http://ex.org/n/{id}" + chr(34) + f" ; r:gather ( {members} ) ; r:gatherAs rdf:{kind} {more}")} .'
    return triples(spark, tmp_path, m, g__json=json.dumps([{"id": 1, "values": values, "more": ["z"]}, {"id": 2, "values": ["only"], "more": []}]))


def test_lists(spark, tmp_path):
    got = gathered(spark, tmp_path, ["a", "b"], "List")
    by = {(s, p): o for s, p, o in got}
    node = by[E("1"), E("has")]
    assert by[node, f"<{RDF}first>"] == '"a"'
    rest = by[node, f"<{RDF}rest>"]
    assert by[rest, f"<{RDF}first>"] == '"b"' and by[rest, f"<{RDF}rest>"] == f"<{RDF}nil>"
    assert by[E("n/2"), f"<{RDF}rest>"] == f"<{RDF}nil>"
    assert got == gathered(spark, tmp_path, ["a", "b"], "List")  # the same nodes on every run


def test_empty_gathers(spark, tmp_path):
    assert not [x for x in gathered(spark, tmp_path, [], "List") if x[0] == E("1")]
    assert (E("1"), E("has"), f"<{RDF}nil>") in gathered(spark, tmp_path, [], "List", "; r:allowEmptyListAndContainer true")
    assert (E("n/1"), f"<{RDF}type>", f"<{RDF}Bag>") in gathered(spark, tmp_path, [], "Bag", "; r:allowEmptyListAndContainer true")


def test_nested_gather(spark, tmp_path):
    got = gathered(spark, tmp_path, ["a", "b"], "Bag", members='[ rml:reference "more[*]" ] [ r:gather ( [ rml:reference "values[*]" ] ) ; r:gatherAs rdf:Seq ]')
    inner = next(o for s, p, o in got if s == E("n/1") and p == f"<{RDF}_2>")
    assert {(p, o) for s, p, o in got if s == inner} == {(f"<{RDF}type>", f"<{RDF}Seq>"), (f"<{RDF}_1>", '"a"'), (f"<{RDF}_2>", '"b"')}


def graph_of(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, g string")


def test_sinks(spark, tmp_path):
    g = graph_of(spark, [(E("a"), f"<{RDF}type>", E("T"), None), (E("a"), E("p"), '"x \\"y\\""@en', E("g")), (E("a"), E("p"), "_:b", None), ("_:b", E("p"), '"1"^^<http://t>', None)])
    rdf.write(g, str(tmp_path / "nt"), "n-triples", single_file=True)
    rdf.write(g, str(tmp_path / "nq"), "n-quads")
    rdf.write(g, str(tmp_path / "ttl"), "turtle", {"ex": "http://ex.org/"}, single_file=True)
    assert (tmp_path / "nt").is_file() and len((tmp_path / "nt").read_text().splitlines()) == 4
    assert f'{E("a")} {E("p")} "x \\"y\\""@en {E("g")} .' in {r[0] for r in spark.read.text(str(tmp_path / "nq")).collect()}
    text = (tmp_path / "ttl").read_text()
    assert text.startswith("@prefix ex: <http://ex.org/> .")
    from tripleweave.plans.turtle import Blank, Iri, Literal, parse

    parsed = parse(text)
    assert parsed.values(Iri("http://ex.org/a"), "http://ex.org/p") == [Literal('x "y"', None, "en"), Blank("b")] and parsed.values(Blank("b"), "http://ex.org/p") == [Literal("1", "http://t")]
    rdf.write(g, str(tmp_path / "rj"), "rdf-json", single_file=True)
    whole = json.loads((tmp_path / "rj").read_text())
    assert whole["_:b"] == {"http://ex.org/p": [{"value": "1", "type": "literal", "datatype": "http://t"}]}
    assert len(whole["http://ex.org/a"]["http://ex.org/p"]) == 2 and len(whole) == 2
    rows = "".join(r[0] for r in rdf.rdf_json(g.repartition(1)).collect())
    decoder, at, found = json.JSONDecoder(), 0, {}
    while at < len(rows):
        one, at = decoder.raw_decode(rows, at)
        found |= one
    assert found == whole
    with pytest.raises(ValueError):
        rdf.write(g, str(tmp_path / "no"), "jsonld")


def test_turtle_of_a_large_subject(spark):
    """A subject of many statements is written row by row, and reads back as it was."""
    from tripleweave.plans.turtle import Iri, parse

    g = graph_of(spark, [(E("hub"), E(f"p{i % 3}"), E(f"o{i}"), None) for i in range(2000)] + [(E("x"), E("p0"), E("hub"), None)])
    text = "\n".join(r[0] for r in rdf.turtle(g, {"ex": "http://ex.org/"}).collect())
    parsed = parse("@prefix ex: <http://ex.org/> .\n" + text)
    assert sum(len(parsed.values(Iri("http://ex.org/hub"), f"http://ex.org/p{k}")) for k in range(3)) == 2000
    assert "collect_list" not in rdf.turtle(g)._jdf.queryExecution().optimizedPlan().toString()


def test_targets(spark, tmp_path):
    m = f'<#m> {source("a.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "id" + chr(34) + " ; r:logicalTarget <#t> , <#u>")} ; {pom("w", "rml:reference " + chr(34) + "id" + chr(34))} . <#t> r:target [ r:path "t.nt" ] ; r:serialization <http://www.w3.org/ns/formats/N-Triples> . <#u> r:target [ r:path "t.nt" ] ; r:serialization <http://www.w3.org/ns/formats/N-Triples> .'
    engine = make(spark, tmp_path, m, a__csv="id\n1\n2\n")
    paths = rdf.write_targets(engine, str(tmp_path / "out"))
    assert len(set(paths.values())) == 1 and len(rdf.distinct_targets(list(engine.mapping.targets.values()))) == 1
    assert {E("v") in r[0] for r in spark.read.text(str(tmp_path / "out/t.nt")).collect()} == {True}
    assert spark.read.text(str(tmp_path / "out/default")).count() == 2


def test_config_and_run(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,v\n1,a\n1,a\n")
    (tmp_path / "m.ttl").write_text(HEAD + f'<#m> {source("d.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "v" + chr(34))} .')
    (tmp_path / "c.ini").write_text("[default]\nmain: .\n[datasets]\nnumber_of_datasets: 1\noutput_folder: ${default:main}/out\nremove_duplicate: yes\nall_in_one_file: yes\nname: whole\nenrichment: yes\nordered: yes\noutput_format: n-triples\n[dataset1]\nname: one\nmapping: ${default:main}/m.ttl\n")
    config = load_config(str(tmp_path / "c.ini"))
    assert config.remove_duplicates and config.all_in_one_file and config.datasets[0].name == "one"
    (path,) = run(spark, config)
    assert path.endswith("whole.nt") and (tmp_path / "out/whole.nt").is_file()
    assert [r[0] for r in spark.read.text(path).collect()] == [f'{E("1")} {E("v")} "a" .']


def test_path_discovery(spark):
    df = spark.createDataFrame([(1, [(2, ("x",))])], "a int, b array<struct<c:int,d:struct<e:string>>>")
    assert find_path(df.schema, "e") == "b[*].d.e" and find_path(df.schema, "zz") is None


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2020-01-01 00:00:00"), (1, "a", "2020-01-01 00:00:01"), (2, None, "2020-01-01 00:00:02")], "id int, v string, at string").select("id", "v", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v string, at timestamp").parquet(str(tmp_path / "in"))
    mapping = load_text(HEAD + f'<#m> {source("live")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "v" + chr(34))} .')
    query = stream_graph(mapping, {"live": stream}, time_col="at").select("s", "p", "o").writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [(E("1"), E("v"), '"a"')]


def test_places_of_joined_values_and_xml_views(spark, tmp_path):
    join = 'r:leftJoin [ r:parentLogicalView <#p> ; r:joinCondition [ r:child "k" ; r:parent "k" ] ; ' + ref("w") + " ]"
    m = view("p", "p.csv", f"{ref('k')} ; {ref('w')}") + view("v", "c.csv", f"{ref('id')} ; {join}") + over("v", "http://ex.org/{id}", literal("x", "{w.#} {w}"))
    got = triples(spark, tmp_path, m, c__csv="id,k\n1,a\n2,zz\n", p__csv="k,w\na,2\na,1\na,1\n")
    assert [(s, o) for s, _, o in got] == [(E("1"), '"0 1"'), (E("1"), '"1 2"')]
    fields = f'{ref("id", "@id")} ; r:field [ r:fieldName "kid" ; r:iterator "kids/kid" ; {ref("n", "name")} ; {ref("a", "@age")} ]'
    m = view("x", "x.xml", fields, "ql:XPath", '; r:iterator "/all/one"') + over("x", "http://ex.org/{id}", literal("k", "{kid.#} {kid.n} {kid.a}"))
    got = triples(spark, tmp_path, m, x__xml='<all><one id="1"><kids><kid age="3"><name>A</name></kid><kid age="4"><name>B</name></kid></kids></one><one id="2"></one></all>')
    assert [(s, o) for s, _, o in got] == [(E("1"), '"0 A 3"'), (E("1"), '"1 B 4"')]


def test_views_of_split_and_whole_xml(spark, tmp_path):
    """A view's file is split too, and its rows keep the places they have in it; rows of a whole file are dealt over the
    cores."""
    fields = f'{ref("id", "@id")} ; r:field [ r:fieldName "place" ; r:iterator "home" ; {ref("city")} ]'
    m = view("x", "x.xml", fields, "ql:XPath", '; r:iterator "/all/person"') + over("x", "http://ex.org/{id}", literal("at", "{AT} {place.city}"))
    with small_splits(spark):
        for at in ("#", "place.#"):
            engine = make(spark, tmp_path, m.replace("{AT}", f"{{{at}}}"), x__xml=f"<all>{people(200)}</all>")
            got = sorted((r["s"], r["o"]) for r in engine.graph().collect())
            assert got == sorted((E(i), f'"{i if at == "#" else 0} C{i % 7}"') for i in range(200))
        [rows] = engine.read.values()
        assert rows.df.rdd.getNumPartitions() > 20
        engine = make(spark, tmp_path, m.replace("{AT}", "{place.#}"), x__xml=f'<all><person id="7"/>{people(5)}</all>')
        assert len(engine.graph().collect()) == 5
        [rows] = engine.read.values()
        assert rows.df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_subject_keys_and_shared_items(spark):
    from tripleweave.operators.terms import Options, Terms
    from tripleweave.operators.views import shared_items
    from tripleweave.sources.readers import flat

    df = spark.createDataFrame([("a", "b", None), ("c", "c", "c")], "x string, y string, z string")
    terms = Terms(flat(df, "csv"), Options())
    key = terms.subject_key(["x", "y"])
    assert [r[0] for r in terms.frame().select(key).collect()] == ["a_b", "c_c"]
    assert [r[0] for r in df.select(shared_items([F.col("x"), F.col("z")], [F.col("y"), F.lit(None)])).collect()] == [1, 1]
