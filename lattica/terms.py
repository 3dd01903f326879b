"""RDF terms: a struct column in frames, a named tuple on the driver.

``TERM`` fields are never null; an absent datatype, language or direction is the empty string, so that
struct equality is term identity.  Plain and xsd:string literals both have an empty datatype.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL, TRIPLE = 1, 2, 3, 4
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
RDF_TYPE = RDF + "type"

TERM = T.StructType([T.StructField("k", T.ByteType()), *(T.StructField(n, T.StringType()) for n in ("v", "dt", "lang", "dir"))])
TRIPLES = T.StructType([T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM)])
QUADS = T.StructType([*TRIPLES.fields, T.StructField("g", T.StringType())])


class Term(NamedTuple):
    k: int
    v: str
    dt: str = ""
    lang: str = ""
    dir: str = ""

    def n3(self) -> str:
        """N-Triples text."""
        if self.k == IRI:
            return f"<{self.v}>"
        if self.k == BNODE:
            return f"_:{self.v}"
        if self.k == TRIPLE:
            return self.v
        text = '"' + escape(self.v) + '"'
        if self.lang:
            return f"{text}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return f"{text}^^<{self.dt}>" if self.dt else text


def iri(v: str) -> Term:
    return Term(IRI, v)


def bnode(v: str) -> Term:
    return Term(BNODE, v)


def literal(v, dt: str = "", lang: str = "", dir: str = "") -> Term:
    """A literal from a Python value, or from text with a datatype or language."""
    if isinstance(v, bool):
        return Term(LITERAL, "true" if v else "false", XSD + "boolean")
    if isinstance(v, int):
        return Term(LITERAL, str(v), XSD + "integer")
    if isinstance(v, float):
        return Term(LITERAL, repr(v), XSD + "double")
    return Term(LITERAL, v, "" if dt == XSD + "string" or lang else dt, lang.lower(), dir)


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_UNESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def escape(text: str) -> str:
    return re.sub(r'[\\"\n\r\t\b\f]', lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _UNESCAPES.get(m[3], m[3]), text)


_TERM_TEXT = re.compile(r'<(?P<iri>[^>]*)>|_:(?P<b>[\w.\-·]+)|"(?P<l>(?:[^"\\]|\\.)*)"(?:@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(?P<dir>ltr|rtl))?|\^\^<(?P<dt>[^>]*)>)?', re.S)


def from_n3(text: str) -> Term:
    """The term of one N-Triples token."""
    text = text.strip()
    if text.startswith("<<"):
        return Term(TRIPLE, text)
    m = _TERM_TEXT.fullmatch(text)
    if not m:
        raise ValueError(f"not a term: {text[:80]}")
    if m["iri"] is not None:
        return iri(unescape(m["iri"]))
    if m["b"] is not None:
        return bnode(m["b"])
    return literal(unescape(m["l"]), m["dt"] or "", m["lang"] or "", m["dir"] or "")


def triple_term(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, f"<<( {s.n3()} {p.n3()} {o.n3()} )>>")


def term_col(k: int | Column, v: Column, dt: str | Column = "", lang: str | Column = "", dir: str | Column = "") -> Column:
    """A TERM struct; null where ``v`` is null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    whole = F.struct(as_col(k).cast("byte").alias("k"), v.cast("string").alias("v"), as_col(dt).alias("dt"), as_col(lang).alias("lang"), as_col(dir).alias("dir"))
    return F.when(v.isNotNull(), whole)


def lit_term(t: Term) -> Column:
    return F.struct(F.lit(t.k).cast("byte").alias("k"), F.lit(t.v).alias("v"), F.lit(t.dt).alias("dt"), F.lit(t.lang).alias("lang"), F.lit(t.dir).alias("dir"))


def n3_col(t: Column) -> Column:
    """N-Triples text of a TERM column."""
    v = t["v"]
    for a, b in _ESCAPES.items():
        v = F.replace(v, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), v, F.lit('"'))
    tail = F.when(t["dir"] != "", F.concat(F.lit("@"), t["lang"], F.lit("--"), t["dir"])).when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).when(t["dt"] != "", F.concat(F.lit("^^<"), t["dt"], F.lit(">"))).otherwise("")
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).when(t["k"] == TRIPLE, t["v"]).otherwise(F.concat(quoted, tail))
