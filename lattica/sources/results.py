"""SPARQL result formats: JSON, XML, CSV and TSV, written row by row in tasks and read back."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.terms import BNODE, IRI, LITERAL, RDF, TERM, Term, from_n3, literal, n3_col

_SR = "{http://www.w3.org/2005/sparql-results#}"


def json_rows(terms: DataFrame) -> DataFrame:
    """One JSON binding per row of TERM columns; unbound variables are left out."""

    def cell(c):
        t = F.col(f"`{c}`")
        kind = F.when(t["k"] == IRI, "uri").when(t["k"] == BNODE, "bnode").when(t["k"] == LITERAL, "literal").otherwise("triple")
        blank = lambda x: F.when(x != "", x)
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), t["v"].alias("value"), blank(t["lang"]).alias("xml:lang"), blank(t["dir"]).alias("its:dir"), blank(t["dt"]).alias("datatype"))).alias(c)

    return terms.select(F.to_json(F.struct(*[cell(c) for c in terms.columns])).alias("value"))


def to_json(terms: DataFrame) -> str:
    rows = ",\n".join(r[0] for r in json_rows(terms).toLocalIterator())
    return json.dumps({"head": {"vars": terms.columns}})[:-1] + f', "results": {{"bindings": [{rows}]}}}}'


def ask_json(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})


def csv_rows(terms: DataFrame) -> DataFrame:
    """Native strings of the terms, ready for ``.write.csv``."""
    name = lambda t: F.when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).otherwise(t["v"])
    return terms.select(*[F.coalesce(name(F.col(f"`{c}`")), F.lit("")).alias(c) for c in terms.columns])


def to_csv(terms: DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(terms.columns)
    for r in csv_rows(terms).toLocalIterator():
        w.writerow(list(r))
    return out.getvalue()


def to_tsv(terms: DataFrame) -> str:
    rows = terms.select(*[F.coalesce(n3_col(F.col(f"`{c}`")), F.lit("")).alias(c) for c in terms.columns])
    return "\n".join(["\t".join("?" + c for c in terms.columns), *["\t".join(r) for r in rows.toLocalIterator()]]) + "\n"


def to_xml(terms: DataFrame) -> str:
    root = ET.Element(_SR + "sparql")
    head = ET.SubElement(root, _SR + "head")
    for c in terms.columns:
        ET.SubElement(head, _SR + "variable", name=c)
    results = ET.SubElement(root, _SR + "results")
    for r in terms.toLocalIterator():
        e = ET.SubElement(results, _SR + "result")
        for c in terms.columns:
            if r[c] is not None:
                t = Term(*r[c])
                b = ET.SubElement(ET.SubElement(e, _SR + "binding", name=c), _SR + {IRI: "uri", BNODE: "bnode"}.get(t.k, "literal"))
                b.text = t.v
                if t.dt:
                    b.set("datatype", t.dt)
                if t.lang:
                    b.set("{http://www.w3.org/XML/1998/namespace}lang", t.lang)
    return ET.tostring(root, encoding="unicode")


def _frame(spark, names: list[str], rows: list[dict]) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, TERM) for n in names])
    return spark.createDataFrame([tuple(tuple(r[n]) if r.get(n) is not None else None for n in names) for r in rows], schema)


def from_json(spark, text: str):
    """A frame of TERM columns, or the answer of an ASK."""
    doc = json.loads(text)
    if "boolean" in doc:
        return doc["boolean"]

    def term(x):
        return Term(IRI, x["value"]) if x["type"] == "uri" else Term(BNODE, x["value"]) if x["type"] == "bnode" else literal(x["value"], x.get("datatype", ""), x.get("xml:lang", ""), x.get("its:dir", ""))

    return _frame(spark, doc["head"]["vars"], [{k: term(v) for k, v in b.items()} for b in doc["results"]["bindings"]])


def from_xml(spark, text: str):
    root = ET.fromstring(text)
    answer = root.find(_SR + "boolean")
    if answer is not None:
        return answer.text.strip() == "true"
    names = [v.get("name") for v in root.iter(_SR + "variable")]

    def term(e):
        kind = e.tag.removeprefix(_SR)
        return Term(IRI, e.text) if kind == "uri" else Term(BNODE, e.text) if kind == "bnode" else literal(e.text or "", e.get("datatype", ""), e.get("{http://www.w3.org/XML/1998/namespace}lang", ""))

    return _frame(spark, names, [{b.get("name"): term(b[0]) for b in r} for r in root.iter(_SR + "result")])


def from_tsv(spark, text: str) -> DataFrame:
    lines = text.rstrip("\n").split("\n")
    names = [n.lstrip("?") for n in lines[0].split("\t")]
    number = lambda x: literal(x, "http://www.w3.org/2001/XMLSchema#" + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
    term = lambda x: None if not x else from_n3(x) if x[0] in '<_"' else number(x)
    return _frame(spark, names, [dict(zip(names, map(term, line.split("\t")), strict=True)) for line in lines[1:]])


def from_csv(spark, text: str) -> DataFrame:
    """Values without types: IRIs by their scheme, blank nodes by ``_:``, everything else as strings."""
    rows = list(csv.reader(io.StringIO(text)))
    term = lambda x: None if x == "" else Term(BNODE, x[2:]) if x.startswith("_:") else Term(IRI, x) if x.startswith(("http://", "https://", "urn:")) else literal(x)
    return _frame(spark, rows[0], [dict(zip(rows[0], map(term, r), strict=True)) for r in rows[1:]])


_ = RDF
