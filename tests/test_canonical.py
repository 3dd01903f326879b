"""Canonical labels are the same for every renaming; documents are parsed in tasks."""

import random

import pytest

from lattica.operators.graphs import canonical_text
from lattica.terms import bnode, iri, literal

P = "http://x/p"


def renamed(triples, seed):
    rng = random.Random(seed)
    nodes = sorted({t for s, _, o in triples for t in (s, o) if t.k == 2})
    new = dict(zip(nodes, rng.sample([bnode(f"n{i}") for i in range(100)], len(nodes)), strict=True))
    out = [(new.get(s, s), p, new.get(o, o)) for s, p, o in triples]
    rng.shuffle(out)
    return out


def cycle(n, name):
    return [(bnode(f"{name}{i}"), P, bnode(f"{name}{(i + 1) % n}")) for i in range(n)]


GRAPHS = {
    "cycles of 4 and 7": cycle(4, "a") + cycle(7, "b"),
    "two equal cycles": cycle(5, "a") + cycle(5, "b"),
    "star": [(bnode("c"), P, bnode(f"l{i}")) for i in range(5)],
    "both ways": [t for s, p, o in cycle(6, "a") for t in ((s, p, o), (o, p, s))],
    "mixed": [*cycle(3, "a"), (bnode("a0"), "http://x/q", literal("x")), (iri("http://x/i"), P, bnode("b")), (bnode("b"), P, bnode("b"))],
    "no blank nodes": [(iri("http://x/a"), P, literal(1))],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_labels_do_not_depend_on_names(name):
    texts = {canonical_text(renamed(GRAPHS[name], i)) for i in range(12)}
    assert len(texts) == 1 and next(iter(texts)).count("\n") == len(GRAPHS[name])


def test_different_graphs_differ():
    assert canonical_text(cycle(11, "a")) != canonical_text(GRAPHS["cycles of 4 and 7"])


def test_known_labels():
    """The specification's example of unique hashes: two nodes told apart by their own triples."""
    e = "http://example.com/#"
    text = canonical_text([(iri(e + "p"), e + "q", bnode("e0")), (iri(e + "p"), e + "r", bnode("e1")), (bnode("e0"), e + "s", iri(e + "u")), (bnode("e1"), e + "t", iri(e + "u"))])
    assert text == f"<{e}p> <{e}q> _:c14n0 .\n<{e}p> <{e}r> _:c14n1 .\n_:c14n0 <{e}s> <{e}u> .\n_:c14n1 <{e}t> <{e}u> .\n"


def test_files_are_parsed_apart(spark, tmp_path):
    from lattica.sources.documents import load

    for i in range(3):
        (tmp_path / f"{i}.ttl").write_text(f"_:b <{P}> {i} , 'same' .")
    g = load(spark, f"file://{tmp_path}/*.ttl", "turtle")
    assert g.count() == 6 and g.select("s").distinct().count() == 3
    assert load(spark, f"file://{tmp_path}/1.ttl").select("s.v").distinct().first()[0] == "b"


def test_malformed_lines_fail(spark, tmp_path):
    from lattica.sources.text import malformed_lines, read_ntriples

    path = tmp_path / "a.nt"
    path.write_text(f"<http://x/a> <{P}> <http://x/b> .\n# comment\n\n<http://x/a> {P} .\nnothing\n")
    with pytest.raises(Exception, match="malformed line"):
        read_ntriples(spark, f"file://{path}").collect()
    assert read_ntriples(spark, f"file://{path}", skip_malformed=True).count() == 1
    assert malformed_lines(spark, f"file://{path}").count() == 2
