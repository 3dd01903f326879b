"""Numbered graphs, Arrow files, sibling shapes, change events, remote updates and the server's further routes."""

import pytest

from lattica.operators.graphs import from_triples
from lattica.operators.indexed import IsomorphicGraph, from_simple_graph, to_simple_graph
from lattica.operators.shacl import validate
from lattica.operators.stores import ObservedState, RemoteStore
from lattica.operators.update import State
from lattica.server import Service
from lattica.sources import documents as D
from lattica.sources.arrow import read_arrow, write_arrow
from lattica.terms import RDF, RDFS, bnode, iri, literal

X = "http://x/"
TRIPLES = [(iri(X + "a"), X + "p", iri(X + "b")), (iri(X + "a"), X + "q", iri(X + "b")), (bnode("n"), X + "p", literal("é \n"))]


def rows(g):
    return sorted((tuple(r["s"]), r["p"], tuple(r["o"])) for r in g.select("s", "p", "o").collect())


def test_simple_graph(spark):
    edges, nodes = to_simple_graph(from_triples(spark, TRIPLES))
    assert (edges.count(), nodes.count()) == (2, 4)
    assert rows(from_simple_graph(edges, nodes)) == sorted((tuple(s), RDF + "value", tuple(o)) for s, _, o in TRIPLES[1:])


def test_isomorphic_graphs_are_one_key(spark):
    a = from_triples(spark, TRIPLES)
    b = from_triples(spark, [*TRIPLES[:2], (bnode("other"), X + "p", literal("é \n"))])
    assert len({IsomorphicGraph(a), IsomorphicGraph(b)}) == 1
    assert IsomorphicGraph(a) != IsomorphicGraph(from_triples(spark, TRIPLES[:2]))


@pytest.mark.parametrize("triples", [TRIPLES, []])
def test_arrow_round_trip(spark, tmp_path, triples):
    g = from_triples(spark, triples)
    write_arrow(g, str(tmp_path / "out"))
    assert rows(read_arrow(spark, str(tmp_path / "out"))) == rows(g)


def test_disjoint_siblings(spark):
    """A thumb is a finger too: only where siblings are disjoint it doesn't count as one."""
    data = D.to_frame(spark, D.parse_turtle("@prefix e: <http://x/> . e:h a e:Hand ; e:digit e:t, e:f . e:t a e:Thumb, e:Finger . e:f a e:Finger ."))
    shape = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://x/> .
        e:S sh:targetClass e:Hand ;
          sh:property e:P1, [ sh:path e:digit ; sh:qualifiedValueShape e:IsFinger ; sh:qualifiedMinCount 2 FLAG ] .
        e:P1 sh:path e:digit ; sh:qualifiedValueShape e:IsThumb ; sh:qualifiedMinCount 1 .
        e:IsThumb sh:class e:Thumb . e:IsFinger sh:class e:Finger ."""
    assert validate(data, shape.replace("FLAG", "")).count() == 0
    assert validate(data, shape.replace("FLAG", "; sh:qualifiedValueShapesDisjoint true")).count() == 1


def test_events_and_remote_updates(spark):
    seen = []
    state = ObservedState(State.of(spark, from_triples(spark, TRIPLES)))
    state.on("add", lambda rows: seen.append(("add", rows.count())))
    state.on("remove", lambda rows: seen.append(("remove", rows.count())))
    state.update("INSERT DATA { <http://x/c> <http://x/p> 1 , 2 }")
    state.update("DELETE DATA { <http://x/a> <http://x/p> <http://x/b> }")
    assert seen == [("add", 2), ("remove", 1)]
    sent = []
    store = RemoteStore(spark, "http://e/q", update_endpoint="http://e/u", sender=lambda *x: sent.append(x))
    store.update("CLEAR ALL")
    with pytest.raises(ValueError):
        store.update("CLEAR NOTHING AT ALL")
    assert sent == [("http://e/u", "CLEAR ALL")]


def test_patch_and_reason_routes(spark):
    service = Service(State.of(spark, from_triples(spark, TRIPLES[:1])))
    service.patch(None, "TX .\nD <http://x/a> <http://x/p> <http://x/b> .\nA <http://x/a> <http://x/p> \"v\" .\nTC .", "application/rdf-patch")
    assert rows(service.graph(None)) == [(tuple(iri(X + "a")), X + "p", tuple(literal("v")))]
    service.put("http://x/g", f"<http://x/i> a <http://x/C> . <http://x/C> <{RDFS}subClassOf> <http://x/D> .", "text/turtle", False)
    service.reason("http://x/g", "rdfs")
    assert (tuple(iri(X + "i")), RDF + "type", tuple(iri(X + "D"))) in rows(service.graph("http://x/g"))
    assert service.stats()[""] == 1


def test_save_by_extension(spark, tmp_path):
    g = from_triples(spark, TRIPLES[:2])
    for name in ("a.ttl", "b.nt"):
        D.save(g, f"file://{tmp_path / name}")
        assert rows(D.load(spark, f"file://{tmp_path / name}")) == rows(g)
    with pytest.raises(ValueError):
        D.save(g, "c.unknown")
