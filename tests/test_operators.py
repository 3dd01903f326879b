"""Rules, validation, updates, formats, graph utilities, geometry, probabilistic programs."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import graphs as G
from lattica.sources import documents as D
from lattica.sources import results as R
from lattica.sources import text as L
from lattica.terms import RDF_TYPE, Term, bnode, from_n3, iri, literal

EX = "http://example.org/"


def e(name):
    return iri(EX + name)


def turtle(spark, text):
    return D.to_frame(spark, D.parse_turtle(f"@prefix : <{EX}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . " + text)).drop("g")


def names(df):
    return {(r.s.v.replace(EX, ""), r.p.replace(EX, ""), r.o.v.replace(EX, "")) for r in df.collect()}


def test_terms():
    for t in (iri("http://a/b"), bnode("x"), literal('a"b\\c\n'), literal("x", lang="en-GB"), literal(5), literal("x", "http://d")):
        assert from_n3(t.n3()) == t


def test_datalog(spark):
    from lattica.operators.rules import RuleError, inferences, parse_rules, reason, strata

    g = turtle(spark, ":a :p :b . :b :p :c . :c :p :d .")
    rules = f"@prefix : <{EX}> . {{ ?x :p ?y . ?y :p ?z }} => {{ ?x :p ?z }} ."
    assert names(inferences(g, rules)) == {("a", "p", "c"), ("b", "p", "d"), ("a", "p", "d")}
    two = f"@prefix : <{EX}> . {{ ?x :p ?y }} => {{ ?x a :Source . ?y a :Target }} . {{ ?x a :Source . not {{ ?x a :Target }} }} => {{ ?x a :Root }} ."
    assert {s for s, p, o in names(reason(g, two)) if o == "Root"} == {"a"}
    with pytest.raises(RuleError):
        strata(parse_rules(f"@prefix : <{EX}> . {{ ?x :p ?y . not {{ ?x :q ?y }} }} => {{ ?x :q ?y }} .")[1])
    with pytest.raises(RuleError):
        parse_rules(f"@prefix : <{EX}> . {{ ?x :p ?y }} => {{ ?x :q ?z }} .")


def test_builtins(spark):
    from lattica.operators.rules import reason

    g = turtle(spark, ":a :n 4 . :b :n 9 . :a :t 'abc' .")
    rules = f"""@prefix : <{EX}> . @prefix math: <http://www.w3.org/2000/10/swap/math#> . @prefix string: <http://www.w3.org/2000/10/swap/string#> .
        {{ ?x :n ?v . ?v math:lessThan 5 . (?v 3) math:sum ?w }} => {{ ?x :sum ?w }} . {{ ?x :n ?v . ?v math:sqrt ?w }} => {{ ?x :root ?w }} .
        {{ ?x :t ?v . ?v string:upperCase ?w . (?v 'x') string:concatenation ?c }} => {{ ?x :up ?w . ?x :cat ?c }} ."""
    assert {t for t in names(reason(g, rules)) if t[1] in ("sum", "root", "up", "cat")} == {("a", "sum", "7"), ("a", "root", "2"), ("b", "root", "3"), ("a", "up", "ABC"), ("a", "cat", "abcx")}


def test_owl(spark):
    from lattica.operators.rules import entails, owl_rl_closure

    g = turtle(spark, ":t a owl:TransitiveProperty . :x :t :y . :y :t :z . :f a owl:FunctionalProperty . :m :f :n . :m :f :o . :i owl:inverseOf :j . :u :i :w .")
    got = names(owl_rl_closure(g))
    assert {("x", "t", "z"), ("n", "http://www.w3.org/2002/07/owl#sameAs", "o"), ("w", "j", "u")} <= got
    assert entails(g, [(bnode("q"), EX + "t", e("z"))]) and not entails(g, [(e("x"), EX + "t", e("z"))])
    assert entails(g, [(e("x"), EX + "t", e("z"))], "owl")


def test_shacl(spark):
    from lattica.operators.shacl import conforms, validate

    data = turtle(spark, ":a a :P ; :name 'A' ; :age 5 ; :lo 1 ; :hi 2 . :b a :P ; :age 'x' ; :lo 3 ; :hi 2 ; :odd 1 . :c a :Q ; :name 'C','D','E' . :Q rdfs:subClassOf :P .")
    shape = f"""@prefix : <{EX}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
        :S a sh:NodeShape ; sh:targetClass :P ; sh:closed true ; sh:ignoredProperties ( <{RDF_TYPE}> ) ;
          sh:property [ sh:path :name ; sh:minCount 1 ; sh:maxCount 2 ; sh:pattern "^[A-D]$" ] ; sh:property [ sh:path :age ; sh:datatype xsd:integer ] ;
          sh:property [ sh:path :lo ; sh:lessThan :hi ] ; sh:property [ sh:path :hi ] ; sh:not [ sh:property [ sh:path :age ; sh:hasValue 'x' ] ] ."""
    got = {(r.focus[len(EX) + 1 : -1], r.component.removesuffix("ConstraintComponent")) for r in validate(data, shape).collect()}
    assert got == {("b", "MinCount"), ("b", "Datatype"), ("b", "LessThan"), ("b", "Closed"), ("b", "Not"), ("c", "MaxCount"), ("c", "Pattern")}
    assert not conforms(data, shape) and conforms(turtle(spark, ":a a :P ; :name 'A' ."), shape)


def test_shex(spark):
    from lattica.operators.shex import validate

    data = turtle(spark, ":a :name 'A' ; :age 5 ; :knows :b . :b :name 'B' ; :age 50 . :c :age 5 .")
    schema = "PREFIX : <http://example.org/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> :P { :name xsd:string ; :age xsd:integer MAXEXCLUSIVE 60 ? ; :knows @:P * } :Q @:P AND { :age [ 50 51 ] }"
    assert {(r.node.v.replace(EX, ""), r.conforms) for r in validate(data, schema, EX + "P", [e("a"), e("b"), e("c")]).collect()} == {("a", True), ("b", True), ("c", False)}
    assert {(r.node.v.replace(EX, ""), r.conforms) for r in validate(data, schema, EX + "Q", [e("a"), e("b")]).collect()} == {("a", False), ("b", True)}


def test_updates(spark):
    from lattica.operators.update import State, UpdateError

    s = State.of(spark).update("PREFIX : <http://example.org/> INSERT DATA { :a :p 1 . GRAPH :g { :b :p 2 } } ; INSERT { ?s :q ?o } WHERE { ?s :p ?o } ; CREATE GRAPH :empty")
    assert names(s.quads.where("g is null")) == {("a", "p", "1"), ("a", "q", "1")}
    assert s.names() == {EX + "g", EX + "empty"}
    s2 = s.update("PREFIX : <http://example.org/> WITH :g DELETE { ?s :p ?o } INSERT { ?s :p 3 } WHERE { ?s :p ?o } ; MOVE :g TO :h ; DELETE DATA { :a :q 1 }")
    assert names(s2.quads.where("g is null")) == {("a", "p", "1")}
    assert names(s2.quads.where(f"g = '{EX}h'")) == {("b", "p", "3")}
    assert names(s2.undone().quads.where("g is null")) == {("a", "p", "1"), ("a", "q", "1")}
    with pytest.raises(UpdateError):
        s2.update("DROP GRAPH <http://none/>")
    assert s2.update("DROP ALL").quads.isEmpty()


def test_line_formats(spark, tmp_path):
    g = D.to_frame(spark, D.parse_trig('@prefix : <http://example.org/> . :a :p "x\\n\\"q\\"\\\\"@en , 5 , _:b . :g { :c :p <<( :a :b "z" )>> }'))
    for write, read in ((L.write_nquads, L.read_nquads), (L.write_triples_table, L.read_triples_table)):
        write(g, str(tmp_path / write.__name__))
        back = read(spark, str(tmp_path / write.__name__)).select("s", "p", "o", "g")
        assert back.exceptAll(g).isEmpty() and g.exceptAll(back).isEmpty()
    plain = g.where("o.k <> 4")
    L.write_hextuples(plain, str(tmp_path / "hext"))
    back = L.read_hextuples(spark, str(tmp_path / "hext")).select(*g.columns)
    assert back.exceptAll(plain).isEmpty() and back.count() == plain.count()
    a, b = turtle(spark, ":a :p 1, 2 ."), turtle(spark, ":a :p 2, 3 .")
    assert names(L.apply_patch(a, L.patch_lines(a, b))) == names(b)


def test_document_formats(spark):
    text = '@prefix : <http://example.org/> . :a a :T ; :p "x"@en , 5 , ( 1 2 ) ; :q [ :r "<&>" ] .'
    quads = D.parse_turtle(text)
    g = D.to_frame(spark, quads).drop("g")
    for name in ("turtle", "longturtle", "rdfxml", "jsonld", "trix"):
        back = D.PARSERS[name.removeprefix("long")](D.WRITERS[name](quads))
        assert G.canonical_text([q[:3] for q in back]) == G.canonical_text([q[:3] for q in quads]), name
    other = D.to_frame(spark, [(bnode("z" + s.v) if s.k == 2 else s, p, bnode("z" + o.v) if o.k == 2 else o, x) for s, p, o, x in quads]).drop("g")
    assert G.isomorphic(g, other) and not G.isomorphic(g, turtle(spark, ":a :p 1 ."))
    doc = {"@context": {"name": "http://schema.org/name", "knows": {"@id": "http://schema.org/knows", "@type": "@id"}}, "@id": "http://a", "name": "A", "knows": "http://b"}
    expanded = D.expand_jsonld(doc)
    assert expanded == [{"@id": "http://a", "http://schema.org/name": [{"@value": "A"}], "http://schema.org/knows": [{"@id": "http://b"}]}]
    assert D.compact_jsonld(expanded, doc["@context"]) == doc


def test_result_formats(spark):
    rows = [(tuple(iri("http://a")), tuple(literal("x,\"y", lang="en"))), (tuple(bnode("b")), None)]
    from lattica.terms import TERM
    from pyspark.sql import types as T

    df = spark.createDataFrame(rows, T.StructType([T.StructField("a", TERM), T.StructField("b", TERM)]))
    for write, read in ((R.to_json, R.from_json), (R.to_xml, R.from_xml), (R.to_tsv, R.from_tsv)):
        assert [tuple(r) for r in read(spark, write(df)).collect()] == [tuple(r) for r in df.collect()], write.__name__
    assert R.to_csv(df) == 'a,b\r\nhttp://a,"x,""y"\r\n_:b,\r\n'
    assert json.loads(R.to_json(df))["head"]["vars"] == ["a", "b"]


def test_graph_utilities(spark):
    g = turtle(spark, ":a :p :b . :b :p :c . :d :p :e . :l :items ( 1 2 3 ) .")
    parts = {}
    for r in G.connected_components(g.where(F.col("p") == EX + "p")).collect():
        parts.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, parts.values())) == [2, 3]
    head = G.value(g, e("l"), EX + "items")
    assert sorted((r.position, r["item"].v) for r in G.collection_items(g, head).collect()) == [(0, "1"), (1, "2"), (2, "3")]
    assert {r.node.v for r in G.transitive(g, e("a"), EX + "p").collect()} == {EX + x for x in "abc"}
    assert G.de_skolemize(G.skolemize(g)).exceptAll(g).isEmpty()
    assert G.contains(g, e("a"), EX + "p", e("b")) and not G.contains(g, e("a"), EX + "p", e("c"))
    assert G.merge_graphs(g, g).count() == g.count() + g.where("s.k = 2 or o.k = 2").count()


def test_text_index(spark):
    from lattica.operators.textsearch import build_index, search

    g = turtle(spark, ":a :t 'Quick brown fox' . :b :t 'quick red dog' .")
    index = build_index(g)
    assert {r.s.v for r in search(index, "quick fo*").collect()} == {EX + "a"}
    assert search(index, "QUICK").count() == 2 and search(index, "").count() == 0


def test_ottr(spark):
    from lattica.operators.ottr import ottr_map, parse_ottr

    text = f"""@prefix : <{EX}> . @prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
        :Named[ ottr:IRI ?s, xsd:string ?n ] :: {{ ottr:Triple(?s, :name, ?n) }} .
        :Person[ ottr:IRI ?id, xsd:string ?name, ? xsd:integer ?age ] :: {{ :Named(?id, ?name), ottr:Triple(?id, :age, ?age), ottr:Triple(?id, :note, _:x) }} ."""
    frame = spark.createDataFrame([(EX + "a", "A", 5), (EX + "b", "B", None), (EX + "c", None, 1)], "id string, name string, age int")
    got = ottr_map(frame, parse_ottr(text), EX + "Person").collect()
    assert {(r.s.v.replace(EX, ""), r.p.replace(EX, "")) for r in got} == {("a", "name"), ("a", "age"), ("a", "note"), ("b", "name"), ("b", "note")}
    assert len({r.o.v for r in got if r.p == EX + "note"}) == 2


def test_problog(spark):
    from lattica.operators.problog import probabilities, solve

    assert solve("0.5::heads1. 0.6::heads2. some :- heads1. some :- heads2. query(some).") == {"some": pytest.approx(0.8)}
    got = solve("0.3::stress(X). 0.2::influences(a,b). person(a). person(b). smokes(a) :- s1. 0.3::s1. smokes(b) :- influences(a,b), smokes(a). query(smokes(b)).")
    assert got == {"smokes(b)": pytest.approx(0.06)}
    assert solve("0.4::a. 0.5::b. c :- a, \\+b. evidence(c, false). query(a).")["a"] == pytest.approx(0.4 * 0.5 / 0.8)
    lineage = spark.createDataFrame([("q", 1, "x", 0.5), ("q", 1, "y", 0.5), ("q", 2, "x", 0.5), ("r", 1, "z", 0.1)], "query string, proof int, fact string, p double")
    assert {r["query"]: round(r.probability, 6) for r in probabilities(lineage).collect()} == {"q": 0.5, "r": 0.1}


def test_geometry():
    from lattica.functions import geo

    g = geo.parse_wkt
    square, inner, far, line = g("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), g("POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))"), g("POLYGON((9 9, 10 9, 10 10, 9 10, 9 9))"), g("LINESTRING(-1 2, 5 2)")
    p = geo.PREDICATES
    assert p["sfContains"](square, inner) and p["sfWithin"](inner, square) and p["sfDisjoint"](square, far) and p["sfCrosses"](line, square)
    assert p["sfTouches"](square, g("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))")) and p["sfOverlaps"](square, g("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"))
    assert geo.area(square) == 16 and geo.length(line) == 6 and geo.centroid(square) == (2, 2)
    assert geo.distance(g("POINT(7 2)"), square) == 3 and geo.distance(g("POINT(0 0)"), g("POINT(3 4)")) == 5
    assert geo.area(geo.intersection(square, g("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"))) == 4
    assert geo.to_wkt(geo.envelope(line)) == "POLYGON((-1 2, 5 2, 5 2, -1 2, -1 2))" and g("POINT(") is None
    assert geo.matches(geo.relate(square, inner), "T*TFF*FF*") and geo.to_wkt(g("POINT EMPTY")) == "POINT EMPTY"


def test_stream(spark, tmp_path):
    from lattica.streaming.events import windowed

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.limit(200).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 200


def test_containers(spark):
    g = D.to_frame(spark, D.parse_rdfxml('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Bag rdf:about="http://b"><rdf:li>x</rdf:li><rdf:li>y</rdf:li></rdf:Bag></rdf:RDF>')).drop("g")
    assert sorted((r.position, r["item"].v) for r in G.container_items(g, iri("http://b")).collect()) == [(1, "x"), (2, "y")]
    head, rows = G.list_triples([literal(1), literal(2)])
    assert len(rows) == 4 and isinstance(head, Term)


def test_service_and_stores(spark):
    import threading
    import urllib.request

    from lattica.operators.stores import AuditedStore, RemoteStore
    from lattica.operators.update import State
    from lattica.server import negotiate, serve

    server = serve(State.of(spark, turtle(spark, ":a :p 1 ; :q :b .")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    store = RemoteStore(spark, at + "/sparql")
    assert names(store.triples(p=EX + "p")) == {("a", "p", "1")}
    urllib.request.urlopen(urllib.request.Request(at + "/update", f"INSERT DATA {{ <{EX}c> <{EX}p> 2 }}".encode(), {"Content-Type": "application/sparql-update"}))
    assert {s for s, _, _ in names(store.triples(p=EX + "p"))} == {"a", "c"}
    assert b"@prefix" in urllib.request.urlopen(at + "/data?default").read()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(at + "/sparql?query=nonsense")
    server.shutdown()
    assert negotiate("text/csv;q=0.5, application/sparql-results+xml", ["text/csv", "application/sparql-results+xml"]) == "application/sparql-results+xml"
    audit = AuditedStore(State.of(spark, turtle(spark, ":a :p 1 ."))).update(f"DELETE DATA {{ <{EX}a> <{EX}p> 1 }}").update(f"INSERT DATA {{ <{EX}b> <{EX}p> 1 }}")
    assert {(r.change, r.s.v) for r in audit.changes().collect()} == {("remove", EX + "a"), ("add", EX + "b")}
    assert audit.undo().undo().state.quads.count() == 1


def test_csv_and_dot(spark, tmp_path):
    from lattica.cli import convert, csv_to_triples
    from lattica.sources.dot import schema_dot, to_dot

    (tmp_path / "x.csv").write_text("id,name,age\n1,A B,5\n2,,6\n")
    got = csv_to_triples(spark, str(tmp_path / "x.csv"), "id", EX)
    assert names(got) == {("1", "id", "1"), ("1", "name", "A B"), ("1", "age", "5"), ("2", "id", "2"), ("2", "age", "6")}
    (tmp_path / "x.ttl").write_text(f"@prefix : <{EX}> . :a :p :b .")
    assert convert(spark, str(tmp_path / "x.ttl"), "ntriples") == f"<{EX}a> <{EX}p> <{EX}b> .\n"
    quads = D.parse_turtle(f"@prefix : <{EX}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :A rdfs:subClassOf :B . :p rdfs:domain :A ; rdfs:range :B .")
    assert to_dot(quads).count("->") == 3 and schema_dot(quads).count("->") == 2
