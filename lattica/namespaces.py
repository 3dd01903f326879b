"""Prefixes and their expansion."""

from __future__ import annotations

from lattica.terms import OWL, RDF, RDFS, SH, XSD

WELL_KNOWN = {
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "xsd": XSD,
    "sh": SH,
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "void": "http://rdfs.org/ns/void#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "geof": "http://www.opengis.net/def/function/geosparql/",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "http://schema.org/",
    "ex": "http://example.org/",
}


class Namespace(str):
    """``Namespace(base).name`` and ``Namespace(base)["name"]`` are IRIs."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return self + name

    def __getitem__(self, name):
        return self + name if isinstance(name, str) else super().__getitem__(name)


class DefinedNamespace(Namespace):
    """A namespace whose terms are listed; others are errors."""

    def __new__(cls, base: str, names):
        self = super().__new__(cls, base)
        self._names = frozenset(names)
        return self

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._names:
            raise AttributeError(f"{self} has no term {name}")
        return str(self) + name


class NamespaceManager:
    def __init__(self, known: dict[str, str] | None = None):
        self.prefixes = dict(WELL_KNOWN if known is None else known)

    def bind(self, prefix: str, base: str, replace: bool = True) -> None:
        if replace or prefix not in self.prefixes:
            self.prefixes[prefix] = str(base)

    def expand(self, curie: str) -> str:
        prefix, colon, name = curie.partition(":")
        if not colon or prefix not in self.prefixes:
            raise KeyError(f"unknown prefix in {curie}")
        return self.prefixes[prefix] + name

    def qname(self, iri: str) -> str:
        """The shortest prefixed name, or the IRI in angle brackets."""
        best = max((b for b in self.prefixes.values() if iri.startswith(b) and b), key=len, default=None)
        if best is None or any(c in iri[len(best) :] for c in "/#:?"):
            return f"<{iri}>"
        return next(p for p, b in self.prefixes.items() if b == best) + ":" + iri[len(best) :]
