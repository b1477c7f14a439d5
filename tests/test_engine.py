import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tripleweave.operators.terms import Options, ReferenceError_, condition_of, tokens_of
from tripleweave.plans.engine import Engine
from tripleweave.plans.loader import load_text
from tripleweave.sources import readers

HEAD = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix r: <http://w3id.org/rml/> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix ex: <http://ex.org/> . @prefix fnml: <http://semweb.mmlab.be/ns/fnml#> . @prefix fno: <https://w3id.org/function/ontology#> . @prefix f: <http://f#> .
@base <http://ex.org/> .
"""


def make(spark, tmp_path, mapping, options=None, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return Engine(spark, load_text(HEAD + mapping, str(tmp_path)), options)


def triples(*args, **files):
    return sorted((r["s"], r["p"], r["o"]) + ((r["g"],) if r["g"] else ()) for r in make(*args, **files).graph().collect())


def source(name, kind="ql:CSV", more=""):
    return f'rml:logicalSource [ rml:source "{name}" ; rml:referenceFormulation {kind} {more} ]'


def pom(p, o):
    return f"rr:predicateObjectMap [ rr:predicate ex:{p} ; rr:objectMap [ {o} ] ]"


E = "<http://ex.org/{}>".format


def test_join_of_repeated_rows(spark, tmp_path):
    """The shape of a two-file join with many repeats: distinct triples only, in any multiplicity."""
    left = "gene,kind\n" + "".join(f"g{i % 4},k{i % 2}\n" for i in range(30))
    right = "name,chrom\n" + "".join(f"g{i % 5},c1\n" for i in range(30))
    got = triples(spark, tmp_path, f'<#a> {source("a.csv")} ; rr:subjectMap [ rr:template "http://ex.org/kind/{{kind}}" ; rr:class ex:Kind ] ; {pom("on", "rr:parentTriplesMap <#b> ; rr:joinCondition [ rr:child " + chr(34) + "gene" + chr(34) + " ; rr:parent " + chr(34) + "name" + chr(34) + " ]")} . <#b> {source("b.csv")} ; rr:subjectMap [ rr:template "http://ex.org/chrom/{{chrom}}" ; rr:class ex:Chrom ] .', a__csv=left, b__csv=right)
    a = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    assert got == sorted([(E("kind/k0"), a, E("Kind")), (E("kind/k1"), a, E("Kind")), (E("chrom/c1"), a, E("Chrom")), (E("kind/k0"), E("on"), E("chrom/c1")), (E("kind/k1"), E("on"), E("chrom/c1"))])


def test_nulls_sentinels_and_literals(spark, tmp_path):
    rows = 'id,v\n1,\n2,"  "\n3,|\n4,nan\n5,N/A\n6,None\n7,NULL\n8,"a ""q"" \'s\' \\"\n9,"two\nlines"\n10,\u00a0\n'
    got = triples(spark, tmp_path, f'<#m> {source("n.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "v" + chr(34))} .', n__csv=rows)
    assert got == [(E("8"), E("v"), '"a \\"q\\" \'s\' \\\\"'), (E("9"), E("v"), '"two\\nlines"')]
    raw = triples(spark, tmp_path, f'<#m> {source("n.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "v" + chr(34))} .', Options(null_tokens=False))
    assert len(raw) == 6


def test_templates_encode_and_normalise(spark, tmp_path):
    rows = "id,v\n1,a b/c\n2,http://x y\n3,1.50\n4,é%\n"
    got = triples(spark, tmp_path, f'<#m> {source("t.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rr:template " + chr(34) + "http://ex.org/v/{v}" + chr(34))} , [ rr:predicate ex:w ; rr:objectMap [ rr:template "x \\\\{{{{v}}\\\\}}" ; rr:termType rr:Literal ] ] .', t__csv=rows)
    assert [o for _, p, o in got if p == E("v")] == [E("v/a%20b%2Fc"), E("v/http://x%20y"), E("v/1.5"), E("v/%C3%A9%")]
    assert got[1][2] == '"x {a b/c}"'


def test_term_types_base_and_languages(spark, tmp_path):
    rows = "id,url,lang\n1,http://a/b,en\n2,rel,de-AT\n3,has space,\n"
    got = triples(spark, tmp_path, f'<#m> {source("u.csv")} ; rr:subjectMap [ rml:reference "id" ; rr:termType rr:BlankNode ] ; {pom("u", "rml:reference " + chr(34) + "url" + chr(34) + " ; rr:termType rr:IRI")} , [ rr:predicate ex:l ; rr:objectMap [ rml:reference "url" ; rml:languageMap [ rml:reference "lang" ] ] ] .', u__csv=rows)
    assert [x for x in got if x[1] == E("u")] == [("_:1", E("u"), "<http://a/b>"), ("_:2", E("u"), E("rel"))]
    assert [o for _, p, o in got if p == E("l")] == ['"http://a/b"@en', '"rel"@de-AT', '"has space"']


def test_graphs_and_shared_scan(spark, tmp_path):
    engine = make(spark, tmp_path, f'<#m> {source("g.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{a}}" ; rr:graph ex:g , rr:defaultGraph ] ; {pom("b", "rml:reference " + chr(34) + "b" + chr(34))} . <#n> {source("g.csv")} ; rr:subjectMap [ rr:template "http://ex.org/n/{{a}}" ] ; {pom("b", "rml:reference " + chr(34) + "b" + chr(34))} .', g__csv="a,b\n1,x\n")
    assert {(r["s"], r["g"]) for r in engine.graph().collect()} == {(E("1"), E("g")), (E("1"), None), (E("n/1"), None)}
    plan = engine.graph()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1  # one scan for both maps
    assert engine.predicates() == {"http://ex.org/b": 2}


def test_composite_keys_and_null_keys(spark, tmp_path):
    join = 'rr:parentTriplesMap <#b> ; rr:joinCondition [ rr:child "x" ; rr:parent "x" ] , [ rr:child "y" ; rr:parent "y" ]'
    got = triples(spark, tmp_path, f'<#a> {source("a.csv")} ; rr:subjectMap [ rr:template "http://ex.org/a/{{id}}" ] ; {pom("j", join)} . <#b> {source("b.csv")} ; rr:subjectMap [ rr:template "http://ex.org/b/{{id}}" ] .', a__csv="id,x,y\n1,a_b,c\n2,a,b_c\n3,,c\n4,q,\n", b__csv="id,x,y\n1,a_b,c\n2,a,b_d\n3,,c\n4,q,\n")
    assert got == [(E("a/1"), E("j"), E("b/1"))]


def test_json(spark, tmp_path):
    data = {"rows": [{"id": 1, "n": 12.5, "name": "A b", "tags": ["x", "y"], "addr": {"city": "Ü"}, "items": [{"t": "p", "v": 1}, {"t": "q", "v": 2}, {"t": "p", "v": 3}], "on": True}, {"id": 2, "tags": [], "items": []}]}
    got = triples(spark, tmp_path, f'<#m> {source("d.json", "ql:JSONPath", "; rml:iterator " + chr(34) + "$.rows[*]" + chr(34))} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; ' + " ; ".join(pom(p, o) for p, o in [("n", 'rr:template "http://ex.org/n/{n}"'), ("f", 'rml:reference "n"'), ("tag", 'rml:reference "tags[*]"'), ("city", 'rr:template "http://ex.org/c/{addr.city}"'), ("v", 'rml:reference "items[*].v"'), ("last", "rr:template \"http://ex.org/l/{items[?(@.t=='p')].v}\""), ("first", 'rml:reference "items[0].v"'), ("on", 'rml:reference "on"'), ("no", 'rml:reference "addr"'), ("none", 'rml:reference "nothing"')]) + " .", d__json=json.dumps(data))
    assert got == sorted([(E("1"), E(p), o) for p, o in [("n", E("n/13")), ("f", '"12.5"'), ("tag", '"x"'), ("tag", '"y"'), ("city", E("c/%C3%9C")), ("v", '"1"'), ("v", '"2"'), ("v", '"3"'), ("last", E("l/3")), ("first", '"1"'), ("on", '"true"')]])


def test_json_root_list_and_single_root(spark, tmp_path):
    m = f'<#m> {source("d.json", "ql:JSONPath")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("v", "rml:reference " + chr(34) + "v" + chr(34))} .'
    want = [(E("1"), E("v"), '"a"'), (E("2"), E("v"), '"b"')]
    assert triples(spark, tmp_path, m, d__json='[{"id":1,"v":"a"},{"id":2,"v":"b"}]') == want
    assert triples(spark, tmp_path, m, d__json='{"all":[{"id":1,"v":"a"},{"id":2,"v":"b"}]}') == want


def test_xml(spark, tmp_path):
    text = '<people city="B"><group no="7"><person id="1"><name>A</name><phone>1</phone><phone>2</phone><home zip="9">x</home></person><person id="2"><name>C</name></person></group></people>'
    got = triples(spark, tmp_path, f'<#m> {source("p.xml", "ql:XPath", "; rml:iterator " + chr(34) + "/people/group/person" + chr(34))} ; rr:subjectMap [ rr:template "http://ex.org/{{@id}}" ] ; ' + " ; ".join(pom(p, f'rml:reference "{o}"') for p, o in [("name", "name"), ("phone", "phone/text()"), ("zip", "home/@zip"), ("home", "home"), ("group", "../@no"), ("city", "../../@city")]) + " .", p__xml=text)
    assert got == sorted([(E("1"), E(p), f'"{o}"') for p, o in [("name", "A"), ("phone", "1"), ("phone", "2"), ("zip", "9"), ("home", "x"), ("group", "7"), ("city", "B")]] + [(E("2"), E(p), f'"{o}"') for p, o in [("name", "C"), ("group", "7"), ("city", "B")]])


def test_relational(spark, tmp_path):
    spark.sql("select 1 a, '-' b, 2.5D c, date'2020-01-02' d, true e union all select 1, '-', 2.5D, date'2020-01-02', true").createOrReplaceTempView("made_table")
    m = '<#m> rr:logicalTable [ rr:tableName "made_table" ] ; rr:subjectMap [ rr:template "http://ex.org/{a}/{b}/{c}" ] ; ' + " ; ".join(pom(c, f'rr:column "{c}"') for c in "cde") + " ."
    s = E("1/UnKnown/3")
    assert triples(spark, tmp_path, m) == [(s, E("c"), '"2.5"'), (s, E("d"), '"2020-01-02"'), (s, E("e"), '"true"')]
    q = '<#m> rr:logicalTable [ rr:sqlQuery "SELECT a + 1 AS n FROM made_table;" ] ; rr:subjectMap [ rr:template "http://ex.org/{n}" ; rr:class ex:N ] .'
    assert [x[0] for x in triples(spark, tmp_path, q)] == [E("2")]
    assert readers.table_query("t", ["a", "b", "a"], "mysql") == "SELECT DISTINCT `a`, `b` FROM t"
    assert readers.table_query("t", ["a"], "postgres") == 'SELECT "a" FROM t' and readers.table_query("t", ["a"], "sqlserver") == "SELECT DISTINCT a FROM t"


def test_ntriples_and_patterns(spark, tmp_path):
    nt = '<http://a> <http://p> "x \\"y\\"" .\n# no\n\n<http://a> <http://q> <http://b> .\n<http://b> <http://p> "z"@en .\n_:c <http://p> "w"^^<http://t> <http://g> .\n'
    (tmp_path / "d.nt").write_text(nt)
    assert readers.read_ntriples(spark, str(tmp_path / "d.nt")).count() == 4
    m = f'<#m> rml:logicalSource [ rml:source "d.nt" ; rml:referenceFormulation ql:NTriples ; rml:query "SELECT ?x ?n WHERE {{ ?x <http://q> ?y . ?y <http://p> ?n }}" ] ; rr:subjectMap [ rml:reference "x" ] ; {pom("n", "rml:reference " + chr(34) + "n" + chr(34))} .'
    assert triples(spark, tmp_path, m) == [("<http://a>", E("n"), '"z"')]


def test_sparql_endpoint(spark, tmp_path):
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            import re
            import urllib.parse

            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            asked.append(query)
            rows = [{"x": {"type": "uri", "value": "http://a"}, "n": {"type": "literal", "value": "N"}}, {"x": {"type": "uri", "value": "http://b"}}, {"x": {"type": "uri", "value": "http://c"}, "n": {"type": "literal", "value": "C"}}]
            head = ["x", "n"]
            if "COUNT(*)" in query:
                head, rows = ["results"], [{"results": {"type": "literal", "value": str(len(rows))}}]
            elif page := re.search(r"LIMIT (\d+) OFFSET (\d+)$", query):
                rows = rows[int(page[2]) : int(page[2]) + int(page[1])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"head": {"vars": head}, "results": {"bindings": rows}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/sparql"
    m = f'@prefix sd: <http://www.w3.org/ns/sparql-service-description#> . <#s> sd:endpoint <{url}> . <#m> rml:logicalSource [ rml:source <#s> ; rml:query "SELECT ?x ?n WHERE {{ ?x ?p ?n }} ORDER BY ?x" ; rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rml:reference "x" ] ; {pom("n", "rml:reference " + chr(34) + "n" + chr(34))} .'
    want = [("<http://a>", E("n"), '"N"'), ("<http://c>", E("n"), '"C"')]
    try:
        assert triples(spark, tmp_path, m) == want
        assert triples(spark, tmp_path, m, Options(sparql_page=2)) == want and len({q for q in asked if "OFFSET" in q}) == 2
    finally:
        server.shutdown()


def test_legacy_and_new_functions(spark, tmp_path):
    old = 'rr:predicateObjectMap [ rr:predicate ex:up ; rr:objectMap [ fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:objectMap [ rr:constant f:toUpperCase ] ] , [ rr:predicate f:valueParam ; rr:objectMap [ rml:reference "v" ] ] ] ] ]'
    new = pom("low", 'r:functionExecution [ r:function f:toLowerCase ; r:input [ r:parameter f:valueParam ; r:inputValueMap [ r:functionExecution [ r:function f:concat2 ; r:input [ r:parameter f:value1 ; r:inputValueMap [ r:reference "v" ] ] , [ r:parameter f:value2 ; r:inputValue "X" ] ] ] ] ]')
    got = triples(spark, tmp_path, f'<#m> {source("f.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {old} ; {new} .', f__csv="id,v\n1,aB\n2,\n")
    assert got == [(E("1"), E("low"), '"abx"'), (E("1"), E("up"), '"AB"'), (E("2"), E("low"), '""')]


def test_quoted_triples_nest(spark, tmp_path):
    rows = "s,p,o,c\n1,likes,2,0.5\n"
    inner = f'<#q> a r:NonAssertedTriplesMap ; {source("q.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{s}}" ] ; rr:predicateObjectMap [ rr:predicateMap [ rr:template "http://ex.org/{{p}}" ] ; rr:objectMap [ rr:template "http://ex.org/{{o}}" ] ] .'
    outer = f'<#m> {source("q.csv")} ; rr:subjectMap [ r:quotedTriplesMap <#q> ] ; {pom("conf", "rml:reference " + chr(34) + "c" + chr(34))} . <#n> {source("q.csv")} ; rr:subjectMap [ rr:template "http://ex.org/doc" ] ; {pom("says", "r:quotedTriplesMap <#m>")} .'
    q = "<< <http://ex.org/1> <http://ex.org/likes> <http://ex.org/2> >>"
    assert triples(spark, tmp_path, inner + outer, q__csv=rows) == sorted([(q, E("conf"), '"0.5"'), (E("doc"), E("says"), f'<< {q} {E("conf")} "0.5" >>')])


def test_templates_make_valid_iris(spark, tmp_path):
    """Whatever a template's values hold, no character stands in an IRI that none may hold; compat_iri keeps the older rule."""
    rows = "n\na b\nx>y http\nq|{r}\n"
    m = f'<#m> {source("i.csv")} ; rr:subjectMap [ rr:template "urn:x:{{n}}" ] ; {pom("v", "rr:template " + chr(34) + "http://ex.org/a b/{n}" + chr(34))} .'
    got = triples(spark, tmp_path, m, i__csv=rows)
    assert {s for s, _, _ in got} == {"<urn:x:a%20b>", "<urn:x:x%3Ey%20http>", "<urn:x:q%7C%7Br%7D>"}
    assert {o for _, _, o in got} == {E("a%20b/a%20b"), E("a%20b/x%3Ey%20http"), E("a%20b/q%7C%7Br%7D")}
    assert "<urn:x:a b>" in {s for s, _, _ in triples(spark, tmp_path, m, Options(compat_iri=True))}


def test_list_keys_join(spark, tmp_path):
    """A gather's members and a view's rows that are joined by a list of keys."""
    data = json.dumps([{"id": 1, "keys": ["a", "b"]}, {"id": 2, "keys": []}, {"id": 3, "keys": ["z"]}])
    side = "k,v\na,1\nb,2\nb,3\n"
    member = '[ rr:parentTriplesMap <#p> ; rr:joinCondition [ rr:child "keys[*]" ; rr:parent "k" ] ]'
    m = f'<#m> {source("l.json", "ql:JSONPath")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ] ; {pom("has", f"r:gather ( {member} ) ; r:gatherAs rdf:Bag")} . <#p> {source("s.csv")} ; rr:subjectMap [ rr:template "http://ex.org/p/{{v}}" ] .'
    got = triples(spark, tmp_path, m, l__json=data, s__csv=side)
    (node,) = [o for s, p, o in got if s == E("1") and p == E("has")]
    assert [o for s, p, o in got if s == node and not p.endswith("type>")] == [E("p/1"), E("p/2"), E("p/3")] and not [x for x in got if x[0] in (E("2"), E("3"))]
    v = '<#n> a r:LogicalView ; r:viewOn [ r:source "s.csv" ; r:referenceFormulation ql:CSV ] ; r:field [ r:fieldName "k" ; r:reference "k" ] ; r:field [ r:fieldName "v" ; r:reference "v" ] . <#v> a r:LogicalView ; r:viewOn [ r:source "l.json" ; r:referenceFormulation ql:JSONPath ] ; r:field [ r:fieldName "id" ; r:reference "id" ] ; r:leftJoin [ r:parentLogicalView <#n> ; r:joinCondition [ r:child "keys[*]" ; r:parent "k" ] ; r:field [ r:fieldName "w" ; r:reference "v" ] ] .'
    over = f'<#m> rml:logicalSource <#v> ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ; rr:class ex:C ] ; {pom("w", "rml:reference " + chr(34) + "w" + chr(34))} .'
    got = triples(spark, tmp_path, v + over)
    assert [(s, o) for s, p, o in got if p == E("w")] == [(E("1"), '"1"'), (E("1"), '"2"'), (E("1"), '"3"')] and len(got) == 6


def test_files_that_can_be_split_are(spark, tmp_path):
    """Line ends in quotes and documents over lines make a file one task; without them it is split."""
    (tmp_path / "a.csv").write_text('k,v\n1,"a ""b"" c"\n')
    (tmp_path / "b.csv").write_text('k,v\n1,"a\nb"\n')
    assert not readers.open_quotes(spark, str(tmp_path / "a.csv")) and readers.open_quotes(spark, str(tmp_path / "b.csv"))
    for name, text, want in (("l.json", '{"a":1}\n\n{"a":2}\n', True), ("d.json", '{"rows":[\n{"a":1},\n{"a":2}\n]}', False), ("p.json", '[{"a":1},{"a":2}]', False), ("e.json", "", False)):
        (tmp_path / name).write_text(text)
        assert readers.one_a_line(spark, str(tmp_path / name)) == want
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(readers.SourceError):
        triples(spark, tmp_path, f'<#m> {source("f.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{a}}" ; rr:class ex:T ] .', Options(csv_check=True))


@contextmanager
def small_splits(spark):
    """Spark splits files after some hundred bytes."""
    sizes = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "800"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in sizes:
            spark.conf.unset(k)


def people(n):
    return "".join(f"<person id=\"{i}\" mark='>{i}'>\n <name>N {i} é &lt;b&gt;</name>\r\n<personal/>" + (f"<!-- <name>no</name> --><name><![CDATA[<x> {i}]]></name>" if i % 3 == 0 else "") + f'<home no="{i % 5}"><city>C{i % 7}</city></home></person>\n' for i in range(n))


def test_xml_files_are_split(spark, tmp_path):
    """One file over many tasks, with all of its rows, wherever a task's part ends."""
    m = f'<#m> {source("p.xml", "ql:XPath", "; rml:iterator " + chr(34) + "/all/person" + chr(34))} ; rr:subjectMap [ rr:template "http://ex.org/{{@id}}" ] ; {pom("name", "rml:reference " + chr(34) + "name" + chr(34))} ; {pom("city", "rml:reference " + chr(34) + "home/city" + chr(34))} .'
    want = sorted([(E(i), E("name"), f'"N {i} é <b>"') for i in range(200)] + [(E(i), E("name"), f'"<x> {i}"') for i in range(0, 200, 3)] + [(E(i), E("city"), f'"C{i % 7}"') for i in range(200)])
    with small_splits(spark):
        engine = make(spark, tmp_path, m, p__xml=f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- all -->\n<all>{people(200)}<other><person_/></other></all>\n')
        got = sorted((r["s"], r["p"], r["o"]) for r in engine.graph().collect())
        [rows] = engine.read.values()
    assert got == want and not rows.whole_files and rows.df.rdd.getNumPartitions() > 20


def test_parents_in_split_xml(spark, tmp_path):
    """References that climb meet their ancestor in files that are split at the ancestors' ends, by steps over lists too."""
    m = f'<#m> {source("p.xml", "ql:XPath", "; rml:iterator " + chr(34) + "/all/person/home" + chr(34))} ; rr:subjectMap [ rr:template "http://ex.org/{{../@id}}/{{@no}}" ] ; {pom("of", "rml:reference " + chr(34) + "../nick" + chr(34))} .'
    text = "".join(f'<person id="{i}"><nick>N{i}</nick>' + "".join(f'<home no="{k}"/>' for k in range(i % 3)) + "</person>\n" for i in range(150))
    with small_splits(spark):
        engine = make(spark, tmp_path, m, p__xml=f"<all>\n{text}</all>")
        got = sorted((r["s"], r["p"], r["o"]) for r in engine.graph().collect())
        [rows] = engine.read.values()
    assert got == sorted((E(f"{i}/{k}"), E("of"), f'"N{i}"') for i in range(150) for k in range(i % 3)) and rows.df.rdd.getNumPartitions() > 5


def test_xml_files_that_cannot_be_split(spark, tmp_path):
    """Where the text does not tell a record's ends, rows are as Spark reads them whole, and are dealt over the cores."""
    one = '<person id="1"><name>A</name></person>'
    for n, text in enumerate((f'<all><person id="2"/>{one}</all>', f'<all>{one}<person id="2"/></all>', f'<all>{one}<person id="2"><name>B</name></person ></all>', f'<all>{one}<person id="2"><person id="3"/></person></all>', f"<all>{one}<!-- </person> -->{one}</all>", f"<all>{one}<!-- {one} --></all>", f'<all><person id="2"><name><![CDATA[</person>]]></name></person>{one}</all>', f'<!DOCTYPE all [<!ENTITY e "x">]><all>{one}{one}</all>', f'<all>{one}<person id="2"><name>B', f'<all>{one}<person id="2"><name>B</nam></person></all>', f"{one}{one}", f'<?xml version="1.0" encoding="ISO-8859-1"?><all>{one}{one}</all>')):
        (tmp_path / f"{n}.xml").write_text(text)
        with small_splits(spark):
            df, whole = readers.load_xml(spark, str(tmp_path / f"{n}.xml"), "person", "all")
        plain = spark.read.format("xml").option("rowTag", "person").load(str(tmp_path / f"{n}.xml"))
        assert whole and sorted(map(str, df.collect())) == sorted(map(str, plain.collect())), text
    m = f'<#m> {source("w.xml", "ql:XPath", "; rml:iterator " + chr(34) + "/all/person" + chr(34))} ; rr:subjectMap [ rr:template "http://ex.org/{{@id}}" ; rr:class ex:T ] .'
    engine = make(spark, tmp_path, m, w__xml=f'<all><person id="2"/>{one}</all>')
    assert len(engine.graph().collect()) == 2
    [rows] = engine.read.values()
    assert rows.whole_files and rows.df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_partitioned_jdbc(spark, tmp_path):
    """A real database over JDBC: in one task, in ranges of a column, and with no rows to part."""
    if not spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver"):
        pytest.skip("no embedded database")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(500).selectExpr("id AS K", "concat('v', id) AS V").write.format("jdbc").option("url", url).option("dbtable", "T").save()
    connection = {"jdbcDSN": url}
    split = readers.read_jdbc(spark, connection, "SELECT K, V FROM T", {"partitionColumn": "K", "numPartitions": "4"})
    assert split.rdd.getNumPartitions() == 4 and split.count() == 500
    assert readers.read_jdbc(spark, connection, "SELECT K FROM T", {}).count() == 500
    assert readers.read_jdbc(spark, connection, "SELECT K FROM T WHERE K < 0", {"partitionColumn": "K"}).count() == 0


def test_join_side_is_shuffled_once(spark, tmp_path):
    """Two objects joined to one parent by one key share the exchange of the parent's side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        join = 'rr:parentTriplesMap <#b> ; rr:joinCondition [ rr:child "k" ; rr:parent "k" ]'
        graph = make(spark, tmp_path, f'<#a> {source("a.csv")} ; rr:subjectMap [ rr:template "http://ex.org/a/{{id}}" ] ; {pom("x", join)} ; {pom("y", join)} . <#b> {source("b.csv")} ; rr:subjectMap [ rr:template "http://ex.org/b/{{id}}" ] .', a__csv="id,k\n1,p\n2,q\n", b__csv="id,k\n7,p\n").graph()
        assert len(graph.collect()) == 2 and "ReusedExchange" in graph._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_missing_reference(spark, tmp_path):
    m = f'<#m> {source("a.csv")} ; rr:subjectMap [ rr:template "http://ex.org/{{id}}" ; rr:class ex:T ] ; {pom("v", "rml:reference " + chr(34) + "gone" + chr(34))} .'
    with pytest.raises(ReferenceError_):
        triples(spark, tmp_path, m, a__csv="id\n1\n")
    assert len(triples(spark, tmp_path, m, Options(ignore=True))) == 1


def test_csv_faults(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    assert readers.csv_faults(spark, str(tmp_path / "x.csv")) == 2


def test_template_tokens():
    assert tokens_of("a{b}c\\{d\\}{e}") == [(False, "a"), (True, "b"), (False, "c{d}"), (True, "e")]
    assert condition_of("v[k=x]") == ("v", "k=x") and condition_of("v") == ("v", None)
    with pytest.raises(ValueError):
        tokens_of("a{b")
