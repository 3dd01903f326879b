"""OTTR templates: rows of a table become triples by a template, expanded on the driver into one select.

``parse_ottr`` reads stOTTR; ``ottr_map`` applies a template to every row of a frame.  Nested templates
are expanded before the plan is made, so a table is scanned once whatever the depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.values import from_spark, to_term
from lattica.plans.parser import Parser, SparqlError
from lattica.terms import BNODE, IRI, LITERAL, TERM, XSD, Term, lit_term, term_col

TRIPLE = "http://ns.ottr.xyz/0.4/Triple"


@dataclass
class Parameter:
    name: str
    type: str = ""
    optional: bool = False
    nonblank: bool = False
    default: Term | None = None
    list: bool = False


@dataclass
class Template:
    iri: str
    parameters: list[Parameter]
    body: list = field(default_factory=list)  # (template, arguments, expander or None)


class OttrParser(Parser):
    def __init__(self, text: str):
        super().__init__(text.replace("?:", "?_:").replace("++", "+ +"), {"ottr": "http://ns.ottr.xyz/0.4/"})

    def document(self) -> dict[str, Template]:
        out = {}
        while self.kind != "end":
            if self.kind == "lang" and self.value == "@prefix":
                self.next()
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
                self.want(".")
                continue
            if self.word("PREFIX", "BASE"):
                self.prologue()
                continue
            name = self.iri().v
            self.want("[")
            parameters = []
            while not self.at("]"):
                parameters.append(self.parameter())
                self.take(",")
            self.want("]")
            t = Template(name, parameters)
            if self.kind == "pn" and self.value == ":" or self.kind == "pn" and self.value.startswith(":"):
                self.next()
            if self.take("{"):
                pass
            else:
                self.fail("'{'")
            while not self.at("}"):
                t.body.append(self.instance())
                self.take(",")
            self.want("}")
            self.want(".")
            out[name] = t
        return out

    def parameter(self) -> Parameter:
        p = Parameter("")
        while True:
            if self.take("?"):
                p.optional = True
            elif self.take("!"):
                p.nonblank = True
            elif self.kind in ("pn", "iri"):
                p.type = self.iri().v
            elif self.word("LIST"):
                self.next()
                self.want("<")
                p.list, p.type = True, self.iri().v
                self.want(">")
            else:
                break
        p.name = self.var()
        if self.take("="):
            p.default = self.constant()
        return p

    def instance(self):
        expander = None
        if self.kind == "word" and self.value in ("cross", "zipMin", "zipMax"):
            expander = self.next()[1]
            self.want("|")
        name = self.iri().v
        self.want("(")
        args = []
        while not self.at(")"):
            spread = self.at("+")
            while self.take("+"):
                pass
            if self.kind == "var":
                args.append(("var", self.var(), spread))
            elif self.kind == "bn":
                args.append(("bnode", self.next()[1][2:], spread))
            elif self.word("A") and self.value == "a":
                self.next()
                args.append(("term", Term(IRI, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), spread))
            else:
                t = self.constant()
                if t is None:
                    self.fail("an argument")
                args.append(("term", t, spread))
            self.take(",")
        self.want(")")
        return name, args, expander


def parse_ottr(text: str) -> dict[str, Template]:
    """Templates by IRI; the signature and the body are divided by ``::``."""
    return OttrParser(text.replace("::", " ")).document()


def column_value(frame: DataFrame, name: str, type_: str) -> Column:
    """A column as a TERM by the parameter's type; IRIs stay IRIs, columns without a type follow their own."""
    kind = frame.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _scalar(x, kind.elementType, type_))
    return _scalar(c, kind, type_)


def _scalar(c: Column, kind, type_: str) -> Column:
    if type_.endswith(("#IRI", "/IRI", "#Resource")) or type_ in ("http://ns.ottr.xyz/0.4/IRI",):
        return term_col(IRI, c).cast(TERM)
    if type_.startswith(XSD) and type_ != XSD + "anyURI":
        return term_col(LITERAL, c.cast("string"), "" if type_ == XSD + "string" else type_).cast(TERM)
    if type_ == XSD + "anyURI":
        return term_col(IRI, c).cast(TERM)
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^(https?://|urn:)"), term_col(IRI, c)).otherwise(term_col(LITERAL, c)).cast(TERM)
    return to_term(from_spark(c, kind)).cast(TERM)


def ottr_map(frame: DataFrame, templates: dict[str, Template], name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Triples of every row: parameters take the columns of their names, or those ``columns`` names.

    A null for an optional parameter leaves out the instances that need it; for any other one, the row.
    """
    t = templates[name]
    row = frame.withColumn("_row", F.monotonically_increasing_id().cast("string"))
    bound, needed = {}, F.lit(True)
    for p in t.parameters:
        source = (columns or {}).get(p.name, p.name)
        if source in frame.columns:
            c = column_value(frame, source, p.type)
            if p.default is not None:
                c = F.coalesce(c, lit_term(p.default).cast(TERM))
        elif p.default is not None:
            c = lit_term(p.default).cast(TERM)
        else:
            c = F.lit(None).cast(TERM)
        bound[p.name] = c
        if not p.optional and p.default is None:
            needed = needed & c.isNotNull()
    cells = []
    _expand(templates, t, bound, "b", cells, ())
    triples = [F.struct(F.when(p["k"] == IRI, p["v"]).alias("p"), s.cast(TERM).alias("s"), o.cast(TERM).alias("o")) if not many else None for s, p, o, many in cells]
    parts = [x for x in triples if x is not None]
    out = row.where(needed).select(F.inline(F.array(*parts))) if parts else None
    for s, p, o, many in cells:
        if many:
            spread = row.where(needed).select(s.alias("s"), F.when(p["k"] == IRI, p["v"]).alias("p"), F.explode(many).alias("o"))
            out = spread.select("p", "s", "o") if out is None else out.union(spread.select("p", "s", "o"))
    return out.where("s is not null and p is not null and o is not null").select("s", "p", "o").distinct()


def _expand(templates: dict, t: Template, bound: dict, path: str, cells: list, stack: tuple) -> None:
    if t.iri in stack:
        raise SparqlError(f"template {t.iri} contains itself")
    for i, (name, args, expander) in enumerate(t.body):
        made, lists = [], []
        for kind, v, spread in args:
            c = bound[v] if kind == "var" else lit_term(v).cast(TERM) if kind == "term" else term_col(BNODE, F.concat(F.lit(f"{path}_{v}_"), F.col("_row"))).cast(TERM)
            made.append(c)
            if spread or (expander and spread):
                lists.append(len(made) - 1)
        if name == TRIPLE:
            cells.append((made[0], made[1], made[2], made[2] if 2 in lists else None))
            continue
        inner = templates[name]
        _expand(templates, inner, dict(zip([p.name for p in inner.parameters], made, strict=True)), f"{path}{i}", cells, (*stack, t.iri))
