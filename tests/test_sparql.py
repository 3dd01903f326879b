"""Queries over generic triples: unbound variables, typed literals, named graphs, paths, errors."""

import pytest

from lattica.operators.graphs import from_triples
from lattica.plans.builder import select
from lattica.plans.compiler import Dataset
from lattica.plans.parser import SparqlError, parse_query, parse_update
from lattica.sources.documents import parse_trig, to_frame

DATA = """
@prefix ex: <http://example.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:alice a ex:Person ; ex:name "Alice" ; ex:age 30 ; ex:knows ex:bob , ex:carol ; ex:label "Alice"@en .
ex:bob a ex:Person ; ex:name "Bob" ; ex:age 25 ; ex:knows ex:carol .
ex:carol a ex:Person ; ex:name "Carol" ; ex:knows ex:alice .
ex:v1 ex:val 5 . ex:v2 ex:val "5" . ex:v3 ex:val "5"@en . ex:v4 ex:val 7.5e0 . ex:v5 ex:val ex:alice . ex:v6 ex:val "05"^^xsd:integer . ex:v7 ex:val true .
ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:p ex:d . ex:d ex:p ex:b . ex:a ex:q ex:x . ex:loop ex:p ex:loop .
_:n ex:name "Nobody" .
"""
PREFIX = {"ex": "http://example.org/"}


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(spark, quads=to_frame(spark, parse_trig(DATA)).drop("g").cache(), prefixes=PREFIX)


def rows(data, text):
    cut = lambda x: x.replace("http://example.org/", ":") if isinstance(x, str) else x
    return sorted((tuple(map(cut, r)) for r in data.query(text).df.collect()), key=repr)


def test_optional_and_unbound(data):
    assert rows(data, "SELECT ?n ?a { ?x a ex:Person ; ex:name ?n OPTIONAL { ?x ex:age ?a } }") == [("Alice", "30"), ("Bob", "25"), ("Carol", None)]
    got = rows(data, "SELECT ?n ?m { ?x ex:name ?n OPTIONAL { ?x ex:age ?a FILTER(?a > 26) } OPTIONAL { ?y ex:age ?a ; ex:name ?m } }")
    assert got == sorted([("Alice", "Alice"), *[(n, m) for n in ("Bob", "Carol", "Nobody") for m in ("Alice", "Bob")]], key=repr)


def test_equality_and_order(data):
    assert rows(data, "SELECT ?x { ?x ex:val ?v FILTER(?v = 5) }") == [(":v1",), (":v6",)]
    assert rows(data, "SELECT ?x { ?x ex:val '5' }") == [(":v2",)]
    assert rows(data, "SELECT ?x { ?x ex:val ?v FILTER(?v != 5) }") == [(":v2",), (":v3",), (":v4",), (":v5",), (":v7",)]
    assert rows(data, "SELECT ?x { ?x ex:val ?v FILTER(?v > 6) }") == [(":v4",)]
    got = [r[0].rpartition("/")[2] for r in data.query("SELECT ?x { ?x ex:val ?v } ORDER BY ?v").df.collect()]
    assert got == ["v5", "v6", "v1", "v4", "v2", "v3", "v7"] or got == ["v5", "v1", "v6", "v4", "v2", "v3", "v7"]


def test_aggregates_over_terms(data):
    assert rows(data, "SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) (COUNT(?a) AS ?n) { ?x ex:age ?a }") == [("55", "27.5", 2)]
    assert rows(data, "SELECT (SUM(?v) AS ?s) { ?x ex:val ?v }") == [(None,)]
    assert rows(data, "SELECT (COUNT(DISTINCT ?v) AS ?n) { ?x ex:val ?v }") == [(7,)]
    assert rows(data, "SELECT (MAX(?v) AS ?m) { ?x ex:val ?v FILTER(ISNUMERIC(?v)) }") == [("7.5",)] or rows(data, "SELECT (MAX(?v) AS ?m) { ?x ex:val ?v FILTER(ISNUMERIC(?v)) }") == [("7.5e0",)]


def test_paths(data):
    assert rows(data, "SELECT ?y { ex:a ex:p+ ?y }") == [(":b",), (":c",), (":d",)]
    assert rows(data, "SELECT ?y { ex:a ex:p* ?y }") == [(":a",), (":b",), (":c",), (":d",)]
    assert rows(data, "SELECT ?x { ?x ex:p+ ex:d }") == [(":a",), (":b",), (":c",), (":d",)]
    assert rows(data, "SELECT ?y { ex:a (ex:p|ex:q)/ex:p ?y }") == [(":c",)]
    assert rows(data, "SELECT ?x { ?x ^ex:p ex:b }") == [(":c",)]
    assert rows(data, "SELECT ?y { ex:a !(ex:p) ?y }") == [(":x",)]
    assert rows(data, "SELECT ?x { ?x ex:p ?x }") == [(":loop",)]
    assert rows(data, "SELECT ?x { ?x ex:p+ ?x }") == [(":b",), (":c",), (":d",), (":loop",)]
    assert rows(data, "SELECT ?y { ex:nowhere ex:p* ?y }") == [(":nowhere",)]
    assert rows(data, "SELECT ?y { ex:alice ex:knows/ex:knows ?y }") == [(":alice",), (":carol",)]
    assert rows(data, "SELECT ?y { ex:alice ex:knows? ?y }") == [(":alice",), (":bob",), (":carol",)]


def test_minus_exists_values(data):
    assert rows(data, "SELECT ?n { ?x ex:name ?n MINUS { ?x ex:age ?a } }") == [("Carol",), ("Nobody",)]
    assert rows(data, "SELECT ?n { ?x ex:name ?n FILTER NOT EXISTS { ?x ex:knows ?y . ?y ex:knows ?x } FILTER(ISIRI(?x)) }") == [("Bob",)]
    assert rows(data, "SELECT ?n ?t { ?x ex:name ?n VALUES (?n ?t) { ('Bob' 1) (UNDEF 2) } }") == sorted([("Bob", 1), *[(n, 2) for n in ("Alice", "Bob", "Carol", "Nobody")]])
    assert rows(data, "SELECT (LANG(?l) AS ?t) (STRLEN(?l) AS ?n) { ?x ex:label ?l }") == [("en", 5)]


def test_construct_describe_ask(data):
    assert data.query("ASK { ex:alice ex:knows ex:bob }").df.collect()[0].result is True
    got = rows(data, "CONSTRUCT { ?x ex:friend [ ex:of ?y ] } WHERE { ?x ex:knows ?y }")
    assert len(got) == 8 and len({r[0] for r in got if r[1] == "<:of>"}) == 4
    assert len(rows(data, "DESCRIBE ex:bob")) == 4


def test_triple_terms(spark):
    text = "@prefix ex: <http://example.org/> . ex:s ex:says <<( ex:a ex:b 1 )>> . ex:t ex:says <<( ex:a ex:c 2 )>> ."
    d = Dataset(spark, quads=to_frame(spark, parse_trig(text)).drop("g"), prefixes=PREFIX)
    assert rows(d, "SELECT ?x ?o { ?x ex:says <<( ex:a ex:b ?o )>> }") == [(":s", "1")]
    assert rows(d, "SELECT (PREDICATE(?t) AS ?p) { ex:t ex:says ?t FILTER(ISTRIPLE(?t)) }") == [(":c",)]


def test_named_graphs(spark):
    text = "@prefix ex: <http://example.org/> . ex:d ex:p 1 . ex:g1 { ex:a ex:p 1 } ex:g2 { ex:a ex:p 2 . ex:b ex:p 1 }"
    d = Dataset(spark, quads=to_frame(spark, parse_trig(text)), prefixes=PREFIX)
    assert rows(d, "SELECT ?s { ?s ex:p ?o }") == [(":d",)]
    assert rows(d, "SELECT ?g ?s { GRAPH ?g { ?s ex:p 1 } }") == [(":g1", ":a"), (":g2", ":b")]
    assert rows(d, "SELECT ?s { GRAPH ex:g2 { ?s ex:p ?o } }") == [(":a",), (":b",)]
    assert rows(d, "SELECT ?s FROM ex:g1 FROM ex:g2 { ?s ex:p ?o }") == [(":a",), (":a",), (":b",)]
    assert rows(d, "SELECT ?g FROM NAMED ex:g2 { GRAPH ?g { ?s ex:p ?o } }") == [(":g2",), (":g2",)]


def test_service(spark):
    d = Dataset(spark, quads=from_triples(spark, []), services={"http://e/": lambda text: spark.createDataFrame([(1,), (2,)], "x long")})
    assert rows(d, "SELECT ?x { SERVICE <http://e/> { ?s ?p ?x } }") == [(1,), (2,)]
    assert len(rows(d, "SELECT * { SERVICE SILENT <http://none/> { ?s ?p ?x } }")) == 1


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?x { ?x ?p ?o", "SELECT ?x ?x { ?x ?p ?o }", "SELECT (1 AS ?x) { ?x ?p ?o }", "SELECT ?y (COUNT(*) AS ?n) { ?x ?p ?y }",
        "SELECT (SUM(COUNT(?x)) AS ?n) { ?x ?p ?y }", "SELECT * { ?x ?p ?y BIND(1 AS ?y) }", "SELECT * { ?x nope:p ?y }", "SELECT * { ?x ?p ?y } GROUP BY ?x",
    ],
)
def test_errors(text):
    with pytest.raises(SparqlError):
        parse_query(text)


def test_update_parsing():
    ops = parse_update("INSERT DATA { <a> <b> 1 } ; WITH <g> DELETE { ?s ?p ?o } INSERT { ?s ?p 2 } WHERE { ?s ?p ?o } ; DROP SILENT ALL ; MOVE <a> TO DEFAULT")
    assert [o["op"] for o in ops] == ["insert_data", "modify", "drop", "move"] and ops[1]["with"] == "g"
    with pytest.raises(SparqlError):
        parse_update("INSERT DATA { ?x <b> 1 }")


def test_builder(data):
    q = select("?n").prefix("ex", "http://example.org/").where("?x ex:name ?n").filter("?n > 'B'").order_by("?n").limit(2)
    assert [r.n for r in q.run(data).df.collect()] == ["Bob", "Carol"]


def test_filter_reaches_scan(spark):
    """A star over a mapped table reads its columns alone, with the filter pushed down."""
    from lattica.operators.mapping import star_schema

    d = Dataset(spark, star_schema(spark, "/root/testdata/sf0.001"), prefixes={"v": "http://ex.org/v#"})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = d.query("SELECT ?p { ?o v:o_totalprice ?p ; v:o_orderstatus 'F' FILTER(?p > 1000) }").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan and "Exchange" not in plan
