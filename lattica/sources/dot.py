"""Graphs and schemas as DOT text, for graphs small enough to draw."""

from __future__ import annotations

from lattica.namespaces import NamespaceManager
from lattica.terms import LITERAL, RDF_TYPE, RDFS, Term


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def to_dot(quads: list, ns: NamespaceManager | None = None) -> str:
    """Nodes for subjects and objects, an edge for each triple; literals are boxes."""
    ns = ns or NamespaceManager()
    show = lambda t: ns.qname(t.v) if t.k == 1 else t.n3()
    lines, seen = [], set()
    for s, p, o, *_ in sorted(quads):
        for t in (s, o):
            if t not in seen:
                seen.add(t)
                lines.append(f"  {_quoted(t.n3())} [label={_quoted(show(t))}, shape={'box' if t.k == LITERAL else 'ellipse'}];")
        lines.append(f"  {_quoted(s.n3())} -> {_quoted(o.n3())} [label={_quoted(ns.qname(p))}];")
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def schema_dot(quads: list, ns: NamespaceManager | None = None) -> str:
    """Classes with their subclasses, and properties from domain to range."""
    ns = ns or NamespaceManager()
    find = lambda p: [(s, o) for s, q, o, *_ in sorted(quads) if q == p]
    domain, ranges = dict(find(RDFS + "domain")), dict(find(RDFS + "range"))
    lines = [f"  {_quoted(ns.qname(s.v))} -> {_quoted(ns.qname(o.v))} [arrowhead=empty];" for s, o in find(RDFS + "subClassOf")]
    lines += [f"  {_quoted(ns.qname(c.v))} -> {_quoted(ns.qname(ranges[p].v))} [label={_quoted(ns.qname(p.v))}];" for p, c in domain.items() if p in ranges]
    lines += [f"  {_quoted(ns.qname(s.v))};" for s, o in find(RDF_TYPE) if o == Term(1, RDFS + "Class")]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"
