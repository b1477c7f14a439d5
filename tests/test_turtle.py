import pytest

from tripleweave.plans.loader import MappingError, load_text
from tripleweave.plans.model import ParentMap
from tripleweave.plans.turtle import RDF, XSD, Blank, Iri, Literal, TurtleError, parse

DOC = """
@prefix ex: <http://ex.org/> . # a comment
PREFIX : <http://ex.org/d/>
@base <http://ex.org/base/> .
<a> a ex:T ; ex:p "x\\"y\\n\\u00e9"@en-GB , 'q' , 5 , -1.5 , 2e3 , true , "z"^^ex:dt ; ;
    ex:q [ ex:r ( 1 <b> ) ] , [] .
:local\\,name ex:p \"\"\"long "quoted"
text\"\"\" . _:n ex:p <> .
"""


def test_terms():
    g = parse(DOC)
    a = Iri("http://ex.org/base/a")
    assert g.base == "http://ex.org/base/" and g.prefixes == {"ex": "http://ex.org/", "": "http://ex.org/d/"}
    assert g.values(a, RDF + "type") == [Iri("http://ex.org/T")]
    assert g.values(a, "http://ex.org/p") == [Literal('x"y\né', None, "en-GB"), Literal("q"), Literal("5", XSD + "integer"), Literal("-1.5", XSD + "decimal"), Literal("2e3", XSD + "double"), Literal("true", XSD + "boolean"), Literal("z", "http://ex.org/dt")]
    node, empty = g.values(a, "http://ex.org/q")
    assert g.items(g.values(node, "http://ex.org/r")[0]) == [Literal("1", XSD + "integer"), Iri("http://ex.org/base/b")] and isinstance(empty, Blank)
    assert g.values(Iri("http://ex.org/d/local,name"), "http://ex.org/p") == [Literal('long "quoted"\ntext')]
    assert g.values(Blank("n"), "http://ex.org/p") == [Iri("http://ex.org/base/")]


@pytest.mark.parametrize("text", ["<a> <b> .", "<a> <b> <c>", "x:a <b> <c> .", "<a> <b> ^ .", "<a> [ <b> ] ."])
def test_faults(text):
    with pytest.raises(TurtleError):
        parse(text)


def test_old_and_new_vocabularies_and_r2rml_agree():
    old = load_text('@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . <http://m> rml:logicalSource [ rml:source "a.csv" ; rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "http://x/{a}" ] ; rr:predicateObjectMap [ rr:predicate <http://p> ; rr:objectMap [ rml:reference "b" ] ] , [ rr:predicate <http://p> ; rr:objectMap [ rml:reference "b" ] ] .')
    new = load_text('@prefix r: <http://w3id.org/rml/> . <http://m> r:logicalSource [ r:source [ r:path "a.csv" ] ; r:referenceFormulation r:CSV ] ; r:subjectMap [ r:template "http://x/{a}" ] ; r:predicateObjectMap [ r:predicate <http://p> ; r:objectMap [ r:reference "b" ] ] .')
    assert old.maps == new.maps and len(old.maps["http://m"].poms) == 1
    r2 = load_text('@prefix rr: <http://www.w3.org/ns/r2rml#> . <http://m> rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://x/{a}" ] ; rr:predicateObjectMap [ rr:predicate <http://p> ; rr:objectMap [ rr:column "\\"b\\"" ] ] .')
    assert r2.maps["http://m"].source.table == "t" and r2.maps["http://m"].poms[0].objects == old.maps["http://m"].poms[0].objects


def test_sources_and_parents():
    m = load_text('@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix d: <http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#> . <http://db> a d:Database ; d:jdbcDSN "jdbc:postgresql://h/x" ; d:username "u" . <http://m> rml:logicalSource [ rml:source <http://db> ; rml:iterator "SELECT a FROM t" ] ; rr:subjectMap [ rr:template "http://x/{a}" ; rr:graph <http://g> ] ; rr:predicateObjectMap [ rr:predicate <http://p> ; rr:objectMap [ rr:parentTriplesMap <http://n> ; rr:joinCondition [ rr:child "a" ; rr:parent "b" ] ] ] . <http://n> rml:logicalSource [ rml:source "folder/b.json" ; rml:iterator "$.rows[*]" ; rml:referenceFormulation <http://semweb.mmlab.be/ns/ql#JSONPath> ] ; rr:subject <http://c> .', "/data")
    source = m.maps["http://m"].source
    assert source.query == "SELECT a FROM t" and dict(source.connection) == {"jdbcDSN": "jdbc:postgresql://h/x", "username": "u"}
    assert m.maps["http://n"].source.location == "/data/folder/b.json" and isinstance(m.maps["http://m"].poms[0].objects[0], ParentMap)


def test_map_without_subject_is_an_error():
    with pytest.raises(MappingError):
        load_text('@prefix rr: <http://www.w3.org/ns/r2rml#> . <http://m> rr:subjectMap [ rr:template "x" ] .')
