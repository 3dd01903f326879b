"""ShEx validation of typical shapes: each (node, triple constraint) is an aggregate, shapes combine as sets of failing nodes.

Supported: node constraints (kinds, datatypes, facets, value sets), triple constraints with cardinalities,
EachOf, AND, OR, NOT and references.  CLOSED and EXTRA are read and not enforced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.expressions import compare
from lattica.functions.values import Val
from lattica.plans.parser import Parser
from lattica.terms import BNODE, IRI, LITERAL, TERM, XSD, Term, iri, lit_term, literal

MANY = 10**9


class ShexParser(Parser):
    def schema(self) -> dict[str, tuple]:
        out = {}
        self.prologue()
        while self.kind != "end":
            if self.kind == "word" and self.value.lower() == "start":
                self.next()
                self.want("=")
                out["START"] = self.shape_or()
                continue
            name = self.iri().v
            out[name] = self.shape_or()
        return out

    def shape_or(self):
        parts = [self.shape_and()]
        while self.take_word("OR"):
            parts.append(self.shape_and())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def shape_and(self):
        parts = [self.shape_not()]
        while self.take_word("AND"):
            parts.append(self.shape_not())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def shape_not(self):
        return ("not", self.shape_atom()) if self.take_word("NOT") else self.shape_atom()

    def shape_atom(self):
        if self.take("("):
            s = self.shape_or()
            self.want(")")
            return s
        if self.at("@") or self.kind == "lang":
            t = self.next()[1]
            if len(t) > 1:  # the tokenizer takes @name:... for a language tag
                prefix = t[1:]
                rest = self.next()[1]
                return ("ref", self.prefixes[prefix] + rest[1:])
            return ("ref", self.iri().v)
        while self.take_word("CLOSED", "EXTRA"):
            while self.at_iri():
                self.iri()
        if self.take("{"):
            out = []
            while not self.at("}"):
                out.append(self.triple_constraint())
                self.take(";")
            self.want("}")
            return ("shape", out)
        return ("node", self.node_tests())

    def triple_constraint(self):
        inverse = self.take("^")
        p = self.verb()
        inner = self.shape_or()
        low, high = 1, 1
        if self.take("*"):
            low, high = 0, MANY
        elif self.take("+"):
            high = MANY
        elif self.take("?"):
            low = 0
        elif self.take("{"):
            low = high = int(self.next()[1])
            if self.take(","):
                high = MANY if self.take("*") or self.at("}") else int(self.next()[1])
            self.want("}")
        return p.v, inverse, inner, low, high

    def verb(self):
        if self.word("A") and self.value == "a":
            self.next()
            return iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
        return self.iri()

    def node_tests(self) -> list:
        tests = []
        while True:
            if self.take("."):
                pass
            elif self.word("IRI", "BNODE", "LITERAL", "NONLITERAL"):
                tests.append(("kind", self.next()[1].upper()))
            elif self.word("MININCLUSIVE", "MINEXCLUSIVE", "MAXINCLUSIVE", "MAXEXCLUSIVE"):
                tests.append((self.next()[1].upper(), self.constant()))
            elif self.word("LENGTH", "MINLENGTH", "MAXLENGTH"):
                tests.append((self.next()[1].upper(), int(self.next()[1])))
            elif self.word("PATTERN"):
                self.next()
                tests.append(("PATTERN", self.string()))
            elif self.at_iri():
                tests.append(("datatype", self.iri().v))
            elif self.take("["):
                values = []
                while not self.at("]"):
                    t = literal("a") if False else self.constant()
                    stem = self.take("~")
                    values.append((t, stem))
                self.want("]")
                tests.append(("values", values))
            else:
                return tests


def parse_shex(text: str, prefixes: dict | None = None) -> dict[str, tuple]:
    return ShexParser(text, prefixes).schema()


class _Checker:
    def __init__(self, data: DataFrame, schema: dict):
        self.data, self.schema = data.select("s", "p", "o"), schema

    def failing(self, e, nodes: DataFrame, stack: tuple = ()) -> DataFrame:
        """The ``node`` rows that don't satisfy a shape expression; a shape that asks for itself holds."""
        tag = e[0]
        if tag == "ref":
            return nodes.limit(0) if e[1] in stack else self.failing(self.schema[e[1]], nodes, (*stack, e[1]))
        if tag == "not":
            return nodes.join(self.failing(e[1], nodes, stack), "node", "left_anti")
        if tag == "and":
            out = self.failing(e[1][0], nodes, stack)
            for x in e[1][1:]:
                out = out.union(self.failing(x, nodes, stack))
            return out.distinct()
        if tag == "or":
            out = nodes
            for x in e[1]:
                out = out.join(self.failing(x, nodes, stack), "node", "left_semi")
            return out
        if tag == "node":
            return nodes.where(~F.coalesce(self.test(e[1], Val("any", F.col("node"))), F.lit(False)))
        out = nodes.limit(0)
        for p, inverse, inner, low, high in e[1]:
            here, there = ("o", "s") if inverse else ("s", "o")
            pairs = self.data.where(F.col("p") == p).select(F.col(here).alias("node"), F.col(there).alias("v")).join(nodes, "node", "left_semi")
            values = pairs.select(F.col("v").alias("node")).distinct()
            bad = self.failing(inner, values, stack).withColumnRenamed("node", "v")
            wrong = pairs.join(bad, "v", "left_semi").select("node")
            n = nodes.join(pairs.groupBy("node").count(), "node", "left").where((F.coalesce("count", F.lit(0)) < low) | (F.coalesce("count", F.lit(0)) > high)).select("node")
            out = out.union(wrong).union(n)
        return out.distinct()

    def test(self, tests: list, v: Val):
        t, good = v.col, F.lit(True)
        for name, x in tests:
            if name == "kind":
                good = good & t["k"].isin({"IRI": [IRI], "BNODE": [BNODE], "LITERAL": [LITERAL], "NONLITERAL": [IRI, BNODE]}[x])
            elif name == "datatype":
                valid = V.number(v).isNotNull() if x in V.NUMERIC_IRIS else V.moment(v).isNotNull() if x in (XSD + "dateTime", XSD + "date") else F.lit(True)
                good = good & (t["k"] == LITERAL) & (t["dt"] == ("" if x == XSD + "string" else x)) & valid
            elif name in ("MININCLUSIVE", "MINEXCLUSIVE", "MAXINCLUSIVE", "MAXEXCLUSIVE"):
                o = {"MININCLUSIVE": ">=", "MINEXCLUSIVE": ">", "MAXINCLUSIVE": "<=", "MAXEXCLUSIVE": "<"}[name]
                good = good & compare(o, v, V.term_val(x))
            elif name == "PATTERN":
                good = good & F.rlike(t["v"], F.lit(x))
            elif name == "values":
                some = F.lit(False)
                for term, stem in x:
                    some = some | (t["v"].startswith(term.v) if stem else t == lit_term(term))
                good = good & some
            else:
                n = F.length(t["v"])
                good = good & {"LENGTH": n == x, "MINLENGTH": n >= x, "MAXLENGTH": n <= x}[name]
        return good


def validate(data: DataFrame, schema: str | dict, shape: str, nodes: DataFrame | list[Term]) -> DataFrame:
    """(node, conforms) for the nodes of a shape map."""
    schema = parse_shex(schema) if isinstance(schema, str) else schema
    if isinstance(nodes, list):
        nodes = data.sparkSession.createDataFrame([(tuple(n),) for n in nodes], "node struct<k:tinyint,v:string,dt:string,lang:string,dir:string>")
    nodes = nodes.select(F.col("node").cast(TERM).alias("node")).distinct()
    bad = _Checker(data, schema).failing(("ref", shape), nodes).withColumn("bad", F.lit(True))
    return nodes.join(bad, "node", "left").select("node", F.col("bad").isNull().alias("conforms"))
