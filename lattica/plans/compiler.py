"""Syntax tree to DataFrame: every operator becomes a relational one, and Catalyst plans the rest.

A solution sequence is a frame with one nullable column per variable (null: unbound).  ``sure`` are the
variables that no row leaves unbound; only joins on others pay for SPARQL's "unbound is compatible with
anything".
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geo
from lattica.functions import values as V
from lattica.functions.expressions import Expressions
from lattica.functions.values import NUMERIC, Val, lit
from lattica.operators.mapping import TableMap
from lattica.operators.paths import Paths
from lattica.plans import parser as P
from lattica.storage import shuffle_tasks
from lattica.terms import BNODE, IRI, LITERAL, RDF_TYPE, TERM, TRIPLE, XSD, Term, lit_term, n3_col, term_col

_names = itertools.count()


def fresh(prefix: str = "c") -> str:
    return f"{prefix}{next(_names)}"


@dataclass
class Sol:
    """A solution sequence."""

    df: DataFrame
    vals: dict[str, Val] = field(default_factory=dict)
    sure: frozenset = frozenset()
    unit: bool = False
    even: bool = False  # rows are dealt over many tasks

    def pinned(self) -> Sol:
        """The same with every value in a column of its own."""
        names = {v: fresh() for v in self.vals}
        df = self.df.select(*[x.col.alias(names[v]) for v, x in self.vals.items()])
        return Sol(df, {v: x.at(F.col(names[v])) for v, x in self.vals.items()}, self.sure)


def calls_geometry(e) -> bool:
    """Whether a geometry function, which works in Python, stands in an expression."""
    if e[0] == "fn" and e[1].startswith(geo.GEOF):
        return True
    if e[0] in ("op", "call", "fn"):
        return any(map(calls_geometry, e[2]))
    if e[0] == "in":
        return any(map(calls_geometry, [e[1], *e[2]]))
    return e[0] == "agg" and e[3] is not None and calls_geometry(e[3])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@dataclass
class Result:
    """``df`` has native columns (IRIs as strings); ``terms()`` has TERM structs."""

    df: DataFrame
    names: list[str]
    vals: dict[str, Val]
    source: DataFrame

    def terms(self) -> DataFrame:
        return self.source.select(*[V.to_term(self.vals[n]).cast(TERM).alias(n) for n in self.names])


@dataclass
class Dataset:
    """What a query runs on: virtual tables, or triples with an optional graph column ``g`` (null: default graph)."""

    spark: SparkSession
    tables: list[TableMap] = field(default_factory=list)
    quads: DataFrame | None = None
    graphs: frozenset = frozenset()
    union_default: bool = False
    services: dict[str, Callable] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)

    def triples(self, graph=None, templates: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
        """s, p, o of the default graph, of one named graph (its IRI), or with ``g`` of all named ones (``"*"``).

        ``subjects`` are the only IRIs and ``templates`` the only templates of IRIs that the caller asks for as
        subjects: tables whose entities can't be among them stay closed, and of others only rows with such keys are read.
        """
        if self.tables:
            chosen = [t for t in self.tables if graph in (None, "*") or graph_name(t) == graph]
            if templates is not None:
                chosen = [t for t in chosen if any(may_meet(t.template, x) for x in templates)]
            keys = {id(t): [k for x in subjects if (k := key_of(t.template, x)) is not None] if subjects is not None else None for t in chosen}
            chosen = [t for t in chosen if keys[id(t)] != []]
            parts = [t.triples(keys[id(t)]).withColumn("g", F.lit(graph_name(t))) for t in chosen]
            if not parts:
                return self.spark.createDataFrame([], "s struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, p string, o struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, g string")
            df = parts[0]
            for x in parts[1:]:
                df = df.unionByName(x)
            return df if graph == "*" else df.drop("g")
        df = self.quads
        if "g" not in df.columns:
            return df.limit(0).withColumn("g", F.lit(None).cast("string")) if graph == "*" else df if graph is None else df.limit(0)
        if graph == "*":
            return df.where("g is not null")
        if graph is None:
            return df.select("s", "p", "o").distinct() if self.union_default else df.where("g is null").drop("g")
        return df.where(F.col("g") == graph).drop("g")

    def query(self, text: str) -> Result:
        return Compiler(self).run(P.parse_query(text, self.prefixes))


def may_meet(a: str, b: str) -> bool:
    """Whether IRIs of two templates can be equal."""
    (head, tail), (start, end) = a.split("{}"), b.split("{}")
    return (head.startswith(start) or start.startswith(head)) and (tail.endswith(end) or end.endswith(tail))


def key_of(template: str, text: str) -> str | None:
    """The key for which a template gives this IRI."""
    head, tail = template.split("{}")
    return text[len(head) : len(text) - len(tail)] if len(text) >= len(head) + len(tail) and text.startswith(head) and text.endswith(tail) else None


def graph_name(t: TableMap) -> str:
    return f"http://ex.org/graph/{t.name}"


class Compiler:
    def __init__(self, data: Dataset):
        self.data, self.spark = data, data.spark

    # -- query forms ----------------------------------------------------------
    def run(self, q: dict) -> Result:
        data = self.dataset_of(q)
        if data is not self.data:
            return Compiler(data).run(q | {"from": [], "named": []})
        if q["form"] == "select":
            return self.result(*self.select(q))
        if q["form"] == "ask":
            sol = self.group(q["where"])
            found = sol.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
            return Result(found, ["result"], {"result": lit(F.col("result"), "boolean")}, found)
        if q["form"] == "construct":
            return self.triple_result(self.construct(q))
        return self.triple_result(self.describe(q))

    def dataset_of(self, q: dict) -> Dataset:
        """FROM and FROM NAMED choose graphs; blank nodes of merged graphs are kept apart."""
        if not q.get("from") and not q.get("named"):
            return self.data
        if self.data.tables or "g" not in self.data.quads.columns:
            return self.data
        quads, parts = self.data.quads, []
        for i, g in enumerate(q["from"]):
            part = quads.where(F.col("g") == g)
            for c in ("s", "o"):
                t = F.col(c)
                part = part.withColumn(c, F.when(t["k"] == BNODE, term_col(BNODE, F.concat(F.lit(f"f{i}_"), t["v"]))).otherwise(t))
            parts.append(part.withColumn("g", F.lit(None).cast("string")))
        parts.append(quads.where(F.col("g").isin(q["named"])) if q["named"] else quads.limit(0))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return Dataset(self.spark, quads=df.distinct(), services=self.data.services, prefixes=self.data.prefixes)

    def triple_result(self, df: DataFrame) -> Result:
        vals = {"s": Val("any", F.col("s")), "p": Val("iri", F.col("p")), "o": Val("any", F.col("o"))}
        text = df.select(n3_col(F.col("s")).alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), n3_col(F.col("o")).alias("o"))
        return Result(text, ["s", "p", "o"], vals, df)

    def result(self, sol: Sol, names: list[str]) -> Result:
        names = [n for n in names if not n.startswith("_:")]
        df = sol.df.select(*[V.native(sol.vals[n]).alias(n) for n in names])
        return Result(df, names, {n: sol.vals[n] for n in names}, sol.df)

    def construct(self, q: dict) -> DataFrame:
        sol = self.solve(q)
        return self.instantiate(sol, [(*t, None) for t in q["template"]]).select("s", "p", "o").distinct()

    def instantiate(self, sol: Sol, template: list) -> DataFrame:
        """Quads of a template for every solution; blank nodes are new for each, invalid triples are left out."""
        row = F.monotonically_increasing_id().cast("string")

        def term(x) -> Column:
            if P.is_var(x):
                return V.to_term(sol.vals[x[1]]) if x[1] in sol.vals else F.lit(None).cast(TERM)
            if isinstance(x, Term):
                return term_col(BNODE, F.concat(F.lit(x.v + "_"), row)) if x.k == BNODE else lit_term(x)
            parts = [term(y) for y in x[1:]]
            return term_col(TRIPLE, F.concat(F.lit("<<( "), n3_col(parts[0]), F.lit(" "), n3_col(parts[1]), F.lit(" "), n3_col(parts[2]), F.lit(" )>>")))

        if not template:
            return self.spark.createDataFrame([], "s struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, p string, o struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, g string")
        cells = []
        for s, p, o, g in template:
            pt = term(p)
            cells.append(F.struct(term(s).cast(TERM).alias("s"), F.when(pt["k"] == IRI, pt["v"]).alias("p"), term(o).cast(TERM).alias("o"), (F.lit(None).cast("string") if g is None else term(g)["v"]).alias("g"), F.lit(g is not None).alias("n")))
        out = sol.df.select(F.inline(F.array(*cells)))
        return out.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & F.col("s.k").isin(IRI, BNODE, TRIPLE) & (~F.col("n") | F.col("g").isNotNull())).drop("n")

    def describe(self, q: dict) -> DataFrame:
        if q["star"] and not q["where"]:
            return self.data.triples()
        from lattica.operators.graphs import bounded_description

        starts = [self.spark.createDataFrame([(t.v,)], "v string").select(term_col(IRI, F.col("v")).cast(TERM).alias("s")) for t in q["describe"] if isinstance(t, Term)]
        if q["where"]:
            sol = self.solve(q)
            names = list(sol.vals) if q["star"] else [x[1] for x in q["describe"] if P.is_var(x)]
            starts += [sol.df.select(V.to_term(sol.vals[n]).cast(TERM).alias("s")) for n in names if n in sol.vals]
        if not starts:
            return self.data.triples()
        start = starts[0]
        for x in starts[1:]:
            start = start.union(x)
        start = start.where("s is not null").distinct()
        if self.data.tables:  # no blank nodes, so nothing beyond the nodes themselves
            found = self.data.triples(subjects=[t.v for t in q["describe"] if isinstance(t, Term)]) if not q["where"] else self.data.triples(templates=self.templates([sol.vals[n] for n in names if n in sol.vals], q["describe"]))
            return found.join(start, "s", "left_semi").distinct()
        return bounded_description(self.data.triples(), start)

    @staticmethod
    def templates(vals: list[Val], terms: list = ()) -> list[str] | None:
        """Templates that hold all these values and IRIs; None if some may be any IRI."""
        if any(v.kind == "iri" and not v.template or v.kind == "any" for v in vals):
            return None
        return [v.template for v in vals if v.kind == "iri"] + [t.v + "{}" for t in terms if isinstance(t, Term)]

    def solve(self, q: dict) -> Sol:
        sol = self.group(q["where"])
        if q.get("values"):
            sol = self.join(sol, self.values(q["values"]))
        if q["order"]:
            sol = self.ordered(sol, q["order"], self.expressions(sol))
        return self.sliced(sol, q)

    def sliced(self, sol: Sol, q: dict) -> Sol:
        df = sol.df
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return Sol(df, sol.vals, sol.sure)

    def ordered(self, sol: Sol, order: list, ex: Expressions) -> Sol:
        keys = []
        for e, desc in order:
            for k in V.sort_keys(ex.value(e)):
                keys.append(k.desc_nulls_last() if desc else k.asc_nulls_first())
        return Sol(sol.df.orderBy(*keys), sol.vals, sol.sure)

    def select(self, q: dict) -> tuple[Sol, list[str]]:
        sol = self.group(q["where"])
        if q["values"]:
            sol = self.join(sol, self.values(q["values"]))
        grouped = bool(q["group"] or q["having"] or any(e is not None and P.has_aggregate(e) for e, _ in q["select"]))
        stash: dict = {}
        if grouped:
            sol, stash = self.aggregate(sol, q)
        for e, v in q["select"]:
            if e is not None:
                sol = self.extend(sol, e, v, stash)
        names = [v for v in sol.vals if not v.startswith("_:")] if q["star"] else [v for _, v in q["select"]]
        for n in names:
            if n not in sol.vals:
                sol = Sol(sol.df, sol.vals | {n: lit(F.lit(None).cast("string"), "string")}, sol.sure)
        if q["distinct"]:
            # order keys of a distinct query are projected variables, or expressions of them
            cut = Sol(sol.df, {n: sol.vals[n] for n in names}, sol.sure & set(names)).pinned()
            cut = Sol(cut.df.distinct(), cut.vals, cut.sure)
            if q["order"]:
                cut = self.ordered(cut, q["order"], self.expressions(cut, stash))
            return self.sliced(cut, q), names
        if q["order"]:
            sol = self.ordered(sol, q["order"], self.expressions(sol, stash))
        sol = self.sliced(sol, q)
        return Sol(sol.df, {n: sol.vals[n] for n in names}, sol.sure & set(names)), names

    # -- groups ---------------------------------------------------------------
    def unit(self) -> Sol:
        return Sol(self.spark.range(1).select(F.lit(True).alias(fresh("u"))), unit=True)

    def group(self, elements: list, graph=None) -> Sol:
        sol, filters = self.unit(), []
        for e in elements:
            tag = e[0]
            if tag == "triples":
                sol = self.join(sol, self.bgp(e[1], graph))
            elif tag == "filter":
                filters.append(e[1])
            elif tag == "bind":
                sol = self.extend(sol, e[1], e[2])
            elif tag == "optional":
                sol = self.optional(sol, e[1], graph)
            elif tag == "union":
                sol = self.join(sol, self.union([self.group(g, graph) for g in e[1]]))
            elif tag == "minus":
                sol = self.minus(sol, self.group(e[1], graph))
            elif tag == "values":
                sol = self.join(sol, self.values(e))
            elif tag in ("group", "lateral"):
                sol = self.lateral(sol, e[1], graph) if tag == "lateral" else self.join(sol, self.group(e[1], graph))
            elif tag == "select":
                inner, names = self.select(e[1])
                sol = self.join(sol, Sol(inner.df, inner.vals, inner.sure).pinned())
            elif tag == "graph":
                sol = self.join(sol, self.graph(e[1], e[2]))
            elif tag == "service":
                sol = self.join(sol, self.service(e))
            else:
                raise ValueError(tag)
        for f in filters:
            sol = self.filter(sol, f, graph)
        return sol

    def graph(self, name, body: list) -> Sol:
        if isinstance(name, Term):
            return self.group(body, name.v)
        if self.data.tables:
            parts = []
            for t in self.data.tables:
                inner = self.group(body, graph_name(t))
                parts.append(self.bind_value(inner, name[1], Val("iri", F.lit(graph_name(t)))))
            return self.union(parts)
        v = name[1]
        return self.group(body, ("var", v))

    def bind_value(self, sol: Sol, name: str, value: Val) -> Sol:
        if name in sol.vals:
            return Sol(sol.df.where(V.to_term(sol.vals[name]) == V.to_term(value)), sol.vals, sol.sure)
        c = fresh()
        return Sol(sol.df.withColumn(c, value.col), sol.vals | {name: value.at(F.col(c))}, sol.sure | {name})

    def service(self, e) -> Sol:
        _, name, body, silent, text = e
        handler = self.data.services.get(name.v if isinstance(name, Term) else "")
        if handler is None:
            if silent:
                return self.unit()
            raise RuntimeError("no resolver for this SERVICE")
        try:
            return self.terms_solution(handler(text))
        except Exception:
            if silent:
                return self.unit()
            raise

    def terms_solution(self, df: DataFrame) -> Sol:
        """A frame of TERM columns (or native ones) as a solution."""
        vals = {}
        for f in df.schema.fields:
            vals[f.name] = Val("any", F.col(f"`{f.name}`")) if f.dataType == TERM else V.from_spark(F.col(f"`{f.name}`"), f.dataType)
        return Sol(df, vals, frozenset()).pinned()

    def lateral(self, sol: Sol, body: list, graph) -> Sol:
        """A correlated join: a sub-select's LIMIT holds for each outer row."""
        if len(body) == 1 and body[0][0] == "select" and (body[0][1]["limit"] is not None or body[0][1]["order"]):
            q = body[0][1]
            inner, names = self.select(q | {"limit": None, "offset": 0, "order": [], "star": True, "select": []} if not q["group"] else q)
            keep = names if q["star"] else [v for _, v in q["select"]]
            row = fresh("r")
            left = Sol(sol.df.withColumn(row, F.monotonically_increasing_id()), sol.vals, sol.sure)
            both = self.join(left, inner.pinned())
            from pyspark.sql import Window

            keys = [k.desc_nulls_last() if desc else k.asc_nulls_first() for e, desc in q["order"] for k in V.sort_keys(self.expressions(both).value(e))] or [F.lit(1)]
            n = fresh("n")
            df = both.df.withColumn(n, F.row_number().over(Window.partitionBy(row).orderBy(*keys))).where((F.col(n) > q["offset"]) & (F.col(n) <= q["offset"] + (q["limit"] if q["limit"] is not None else 2**31 - 2 - q["offset"])))
            return Sol(df, {v: x for v, x in both.vals.items() if v in sol.vals or v in keep}, both.sure)
        return self.join(sol, self.group(body, graph))

    def values(self, e) -> Sol:
        _, names, rows = e
        cols = {n: fresh() for n in names}
        kinds = {}
        for i, n in enumerate(names):
            found = [V.constant(r[i]) for r in rows if r[i] is not None]
            kinds[n] = found[0] if found and all(found[0].like(x) for x in found) and found[0].kind != "any" else None
        structs = []
        for r in rows:
            cells = []
            for i, n in enumerate(names):
                t = r[i]
                if kinds[n] is not None:
                    c = V.constant(t).col if t is not None else F.lit(None)
                    c = c.cast(V.NATIVE.get(kinds[n].dt, "string"))
                else:
                    c = (lit_term(t) if t is not None else F.lit(None)).cast(TERM)
                cells.append(c.alias(cols[n]))
            structs.append(F.struct(*cells))
        base = self.spark.range(1)
        if not rows or not names:
            df = base.select(*[F.lit(None).cast(TERM).alias(cols[n]) for n in names]).limit(0 if not rows else 1)
            return Sol(df, {n: Val("any", F.col(cols[n])) for n in names}, frozenset(names))
        df = base.select(F.inline(F.array(*structs)))
        sure = frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows))
        return Sol(df, {n: (kinds[n].at(F.col(cols[n])) if kinds[n] is not None else Val("any", F.col(cols[n]))) for n in names}, sure)

    def union(self, parts: list[Sol]) -> Sol:
        """A multiset union; variables of one branch alone are unbound in the others."""
        names = list(dict.fromkeys(v for p in parts for v in p.vals))
        made = []
        types = {}
        for n in names:
            present = [p.vals[n] for p in parts if n in p.vals]
            first = present[0]
            types[n] = "same" if all(first.like(x) for x in present) else "iri" if all(x.kind == "iri" for x in present) else "any"
        vals = {}
        for n in names:
            first = next(p.vals[n] for p in parts if n in p.vals)
            vals[n] = first if types[n] == "same" else Val(types[n], first.col)
        cols = {n: fresh() for n in names}
        for p in parts:
            out = []
            for n in names:
                x = p.vals.get(n)
                if x is None:
                    c = F.lit(None)
                elif types[n] == "same":
                    c = x.col
                else:
                    c = V.iri_text(x) if types[n] == "iri" else V.to_term(x).cast(TERM)
                out.append(c.alias(cols[n]))
            made.append(p.df.select(*out) if out else p.df.select(F.lit(True).alias("u")))
        df = made[0]
        for m in made[1:]:
            df = df.union(m)
        sure = frozenset(n for n in names if all(n in p.sure for p in parts))
        return Sol(df, {n: vals[n].at(F.col(cols[n])) for n in names}, sure)

    def evenly(self, sol: Sol, e) -> Sol:
        """Rows that functions in Python wait for are dealt over many tasks: a table of one row group is read by one."""
        if sol.even or sol.unit or not calls_geometry(e):
            return sol
        return replace(sol, df=sol.df.repartition(shuffle_tasks(self.spark)), even=True)

    def extend(self, sol: Sol, e, name: str, stash: dict | None = None) -> Sol:
        sol = self.evenly(sol, e)
        x = self.expressions(sol, stash).value(e)
        c = fresh()
        df = sol.df.withColumn(c, x.col)
        sure = sol.sure | ({name} if e[0] == "term" or (e[0] == "var" and e[1] in sol.sure) else set())
        return Sol(df, sol.vals | {name: x.at(F.col(c))}, frozenset(sure), even=sol.even)

    def expressions(self, sol: Sol, stash: dict | None = None, exists=None) -> Expressions:
        return Expressions(sol.vals, exists, stash)

    # -- filters and existence ------------------------------------------------
    def filter(self, sol: Sol, e, graph=None) -> Sol:
        if e[0] == "op" and e[1] == "&&":
            for part in e[2]:
                sol = self.filter(sol, part, graph)
            return sol
        if e[0] == "op" and e[1] == "!" and e[2][0][0] == "exists":
            _, body, negated = e[2][0]
            return self.existence(sol, body, not negated, graph)
        if e[0] == "exists":
            return self.existence(sol, e[1], e[2], graph)
        if e[0] == "op" and e[1] in ("<", ">", "<=", ">="):
            # in a filter an error is as good as false: plain comparisons reach the scan
            sol = self.evenly(sol, e)
            x, y = (self.expressions(sol).value(a) for a in e[2])
            if x.kind == y.kind == "lit" and x.dt in NUMERIC and y.dt in NUMERIC:
                df = sol.df.where({"<": x.col < y.col, ">": x.col > y.col, "<=": x.col <= y.col, ">=": x.col >= y.col}[e[1]])
                for v, a in ((x, e[2][0]), (y, e[2][1])):
                    if v.dt != "integer" and a[0] != "term":
                        df = df.where(~F.isnan(v.col))
                return Sol(df, sol.vals, sol.sure, even=sol.even)
        sol, marks = self.marked(self.evenly(sol, e), e, graph)
        return Sol(sol.df.where(self.expressions(sol, marks).truth(e)), sol.vals, sol.sure, even=sol.even)

    def marked(self, sol: Sol, e, graph) -> tuple[Sol, dict]:
        """EXISTS within an expression becomes a boolean column."""
        found: list = []

        def walk(x):
            if x[0] == "exists":
                found.append(x)
            elif x[0] in ("op", "call", "fn"):
                for y in x[2]:
                    walk(y)
            elif x[0] == "in":
                for y in [x[1], *x[2]]:
                    walk(y)

        walk(e)
        marks: dict = {}
        for x in found:
            inner, cond = self.correlated(sol, x[1], graph)
            c, flag = fresh(), fresh()
            row = fresh("r")
            df = sol.df.withColumn(row, F.monotonically_increasing_id())
            hit = df.join(inner.df, cond, "left_semi").select(F.col(row).alias(flag))
            df = df.join(hit, F.col(row) == F.col(flag), "left").withColumn(c, F.col(flag).isNull() if x[2] else F.col(flag).isNotNull()).drop(row, flag)
            sol = Sol(df, sol.vals, sol.sure)
            marks[repr(x)] = lit(F.col(c), "boolean")
        return sol, marks

    def correlated(self, sol: Sol, body: list, graph) -> tuple[Sol, Column]:
        """A group and the condition under which its rows go with outer ones."""
        inner, rest = self.inner_group(sol, body, graph)
        return inner, self.condition(sol, inner) & rest

    def inner_group(self, sol: Sol, body: list, graph) -> tuple[Sol, Column]:
        """A group and what its filters ask of outer variables."""
        filters = [x[1] for x in body if x[0] == "filter"]
        inner = self.group([x for x in body if x[0] != "filter"], graph)
        outer = []
        for f in filters:
            if P.variables(f) <= set(inner.vals) or f[0] == "exists":
                inner = self.filter(inner, f, graph)
            else:
                outer.append(f)
        cond = F.lit(True)
        vals = inner.vals | sol.vals
        for f in outer:
            cond = cond & F.coalesce(Expressions(vals).truth(f), F.lit(False))
        return inner, cond

    def existence(self, sol: Sol, body: list, negated: bool, graph) -> Sol:
        inner, rest = self.inner_group(sol, body, graph)
        shared = [v for v in sol.vals if v in inner.vals]
        parts = []
        for df, bound in self.split(sol, shared):
            # inner rows that leave a variable unbound go with any value of it: one equi-join for each case
            for right, also in self.split(inner, sorted(bound)):
                cond = self.equal(sol, inner, also) & rest
                if not negated:
                    parts.append(df.join(right, cond, "left_semi"))
                df = df.join(right, cond, "left_anti")
            if negated:
                parts.append(df)
        return Sol(_union(parts), sol.vals, sol.sure)

    def split(self, sol: Sol, among: list[str] | None = None) -> list[tuple[DataFrame, set]]:
        """(rows, variables that they bind) for each way in which variables (of ``among``) may be bound or not; disjoint."""
        loose = [v for v in (sol.vals if among is None else among) if v not in sol.sure]
        firm = {v for v in (sol.vals if among is None else among) if v in sol.sure}
        out = []
        for case in itertools.product((True, False), repeat=len(loose)):
            df = sol.df
            for v, bound in zip(loose, case, strict=True):
                c = sol.vals[v].col
                df = df.where(c.isNotNull() if bound else c.isNull())
            out.append((df, firm | {v for v, bound in zip(loose, case, strict=True) if bound}))
        return out

    def equal(self, a: Sol, b: Sol, on) -> Column:
        """Equality of both sides' values: nothing but an equi-join's keys."""
        cond = F.lit(True)
        for v in sorted(on):
            x, y = self.pair(a.vals[v], b.vals[v])
            cond = cond & (x == y)
        return cond

    # -- joins ----------------------------------------------------------------
    def pair(self, a: Val, b: Val) -> tuple[Column, Column]:
        if a.like(b):
            return a.col, b.col
        if a.kind == b.kind == "iri":
            return V.iri_text(a), V.iri_text(b)
        return V.to_term(a), V.to_term(b)

    def condition(self, a: Sol, b: Sol) -> Column:
        cond = F.lit(True)
        for v in a.vals:
            if v in b.vals:
                x, y = self.pair(a.vals[v], b.vals[v])
                test = x == y
                if v not in a.sure:
                    test = test | x.isNull()
                if v not in b.sure:
                    test = test | y.isNull()
                cond = cond & test
        return cond

    def merged(self, a: Sol, b: Sol, how: str) -> dict[str, Val]:
        vals = dict(a.vals)
        for v, y in b.vals.items():
            if v not in vals:
                vals[v] = y
            elif v not in a.sure:
                x, y = V.unified([vals[v], y])
                vals[v] = x.at(F.coalesce(x.col, y.col))
        return vals

    def join(self, a: Sol, b: Sol) -> Sol:
        """Compatible inner join."""
        if a.unit:
            return b
        if b.unit:
            return a
        shared = [v for v in a.vals if v in b.vals]
        loose = [v for v in shared if v not in a.sure or v not in b.sure]
        sure = a.sure | b.sure
        vals = self.merged(a, b, "inner")
        if not shared:  # every pair, tested by a later filter: dealt over tasks, as tables of one row group would meet in one
            return Sol(a.df.repartition(shuffle_tasks(self.spark)).crossJoin(b.df), vals, sure)
        if not loose:
            return Sol(a.df.join(b.df, self.equal(a, b, shared)), vals, sure)
        # rows are split by which loose variables are bound, so that each part is an equi-join
        parts = []
        for left, bound in self.split(a, shared):
            for right, also in self.split(b, sorted(bound)):
                parts.append(left.join(right, self.equal(a, b, also)) if also else left.crossJoin(right))
        return Sol(_union(parts), vals, sure).pinned()

    def optional(self, sol: Sol, body: list, graph) -> Sol:
        """Left join; the group's own filters see the outer variables and belong to the join condition."""
        filters = [x[1] for x in body if x[0] == "filter"]
        inner = self.group([x for x in body if x[0] != "filter"], graph)
        held = []
        for f in filters:
            if P.variables(f) <= set(inner.vals) or f[0] == "exists" or (f[0] == "op" and f[1] == "!" and f[2][0][0] == "exists"):
                inner = self.filter(inner, f, graph)
            else:
                held.append(f)
        if sol.unit:
            sol = Sol(sol.df, {}, frozenset())
        rest = F.lit(True)
        for f in held:
            rest = rest & F.coalesce(Expressions(inner.vals | sol.vals).truth(f), F.lit(False))
        shared = [v for v in sol.vals if v in inner.vals]
        vals = self.merged(sol, inner, "left")
        columns = [*sol.df.columns, *inner.df.columns]
        parts = []
        for df, bound in self.split(sol, shared):
            weak = [v for v in bound if v not in inner.sure]
            if not weak:
                parts.append(df.join(inner.df, self.equal(sol, inner, bound) & rest, "left"))
                continue
            # inner rows that leave a variable unbound go with any value of it: one equi-join for each case
            alone = df
            for right, also in self.split(inner, list(bound)):
                cond = self.equal(sol, inner, also) & rest
                parts.append(df.join(right, cond))
                alone = alone.join(right, cond, "left_anti")
            kinds = inner.df.schema
            parts.append(alone.select(*sol.df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]))
        return Sol(_union([p.select(*columns) for p in parts]), vals, sol.sure)

    def minus(self, a: Sol, b: Sol) -> Sol:
        """Rows go that agree with some inner row on all shared bound variables, one at least; disjoint domains remove nothing."""
        shared = [v for v in a.vals if v in b.vals]
        if not shared:
            return a
        parts = []
        for df, bound in self.split(a, shared):
            if bound:
                for right, also in self.split(b, sorted(bound)):
                    if also:
                        df = df.join(right, self.equal(a, b, also), "left_anti")
            parts.append(df)
        return Sol(_union(parts), a.vals, a.sure)

    # -- basic graph patterns -------------------------------------------------
    def bgp(self, triples: list, graph) -> Sol:
        stars: dict = {}
        rest = []
        for s, p, o in triples:
            simple = isinstance(p, Term) and not (isinstance(o, tuple) and o and o[0] == "tt") and not (isinstance(s, tuple) and s and s[0] == "tt")
            if simple and self.data.tables:
                stars.setdefault(repr(s), (s, []))[1].append((p, o))
            else:
                rest.append((s, p, o))
        parts = [self.star(s, po, graph) for s, po in stars.values()]
        held = {s[1]: v for (s, _), sol in zip(stars.values(), parts, strict=True) if P.is_var(s) and (v := sol.vals[s[1]]).template}
        parts += [self.pattern(s, p, o, graph, held.get(s[1]) if P.is_var(s) else None) for s, p, o in rest]
        if not parts:
            return self.unit()
        sol = parts.pop(0)
        while parts:  # connected parts first: no product where a join is possible
            i = next((i for i, p in enumerate(parts) if set(p.vals) & set(sol.vals)), 0)
            sol = self.join(sol, parts.pop(i))
        return sol

    def star(self, s, po: list, graph) -> Sol:
        """All patterns on one subject: a single scan of each table that has the predicates."""
        parts = []
        for t in self.data.tables:
            if isinstance(graph, str) and graph_name(t) != graph:
                continue
            types = [o for p, o in po if p.v == RDF_TYPE]
            if any(isinstance(o, Term) and o.v != t.type for o in types) or any(p.v != RDF_TYPE and p.v not in t.predicates for p, _ in po):
                continue
            parts.append(self.table_star(t, s, po))
        if not parts:
            names = list(dict.fromkeys(x[1] for x in [s, *(o for _, o in po)] if P.is_var(x)))
            cols = {n: fresh() for n in names}
            df = self.spark.range(0).select(*[F.lit(None).cast(TERM).alias(cols[n]) for n in names], F.lit(True).alias(fresh("u")))
            return Sol(df, {n: Val("any", F.col(cols[n])) for n in names}, frozenset(names))
        return parts[0] if len(parts) == 1 else self.union(parts)

    def table_star(self, t: TableMap, s, po: list) -> Sol:
        vals: dict[str, Val] = {}
        conds: list[Column] = []

        def meet(x, value: Val) -> None:
            if P.is_var(x):
                if x[1] in vals:
                    a, b = self.pair(vals[x[1]], value)
                    conds.append(a == b)
                else:
                    vals[x[1]] = value
            else:
                conds.append(self.is_term(value, x))

        meet(s, t.subject())
        for p, o in po:
            if p.v == RDF_TYPE:
                meet(o, Val("iri", F.lit(t.type)))
                continue
            value = t.value(p.v)
            conds.append(value.col.isNotNull())
            meet(o, value)
        df = t.rows()
        for c in conds:
            df = df.where(c)
        sol = Sol(df, vals, frozenset(vals))
        return sol.pinned() if vals else Sol(df.select(F.lit(True).alias(fresh("u"))), {}, frozenset())

    def is_term(self, value: Val, t: Term) -> Column:
        """Whether a value is just this term."""
        if value.kind == "iri" and t.k == IRI:
            if not value.template:
                return value.col == t.v
            head, tail = value.template.split("{}")
            if t.v.startswith(head) and t.v.endswith(tail):
                return value.col.cast("string") == t.v[len(head) : len(t.v) - len(tail)]
            return F.lit(False)
        c = V.constant(t)
        if value.like(c):
            return value.col == c.col
        return V.to_term(value) == lit_term(t) if value.kind == "any" else F.lit(False)

    def pattern(self, s, p, o, graph, subject: Val | None = None) -> Sol:
        """One triple pattern; p may be a variable or a path, and s and o quoted triples with variables.

        ``subject`` is what a join will meet the pattern's subject with.
        """
        if isinstance(p, tuple) and not isinstance(p, Term) and p[0] == "path":
            return Paths(self).pattern(s, p, o, graph)
        named = isinstance(graph, tuple)
        subjects = [s.v] if isinstance(s, Term) and s.k == IRI else None
        df = self.data.triples("*" if named else graph, self.templates([subject]) if subject is not None else None, subjects)
        cols = {"s": fresh(), "p": fresh(), "o": fresh(), "g": fresh()}
        df = df.select(*[F.col(c).alias(n) for c, n in cols.items() if c != "g" or named])
        vals: dict[str, Val] = {}
        conds: list[Column] = []

        def meet(x, value: Val) -> None:
            if P.is_var(x):
                if x[1] in vals:
                    a, b = self.pair(vals[x[1]], value)
                    conds.append(a == b)
                else:
                    vals[x[1]] = value
            elif isinstance(x, Term):
                conds.append(self.is_term(value, x))
            else:
                ex = Expressions({"t": value})
                conds.append(value.col["k"] == TRIPLE)
                for part, y in zip(("SUBJECT", "PREDICATE", "OBJECT"), x[1:], strict=True):
                    meet(y, ex.value(("call", part, [("var", "t")])))

        meet(s, Val("any", F.col(cols["s"])))
        meet(p, Val("iri", F.col(cols["p"])))
        meet(o, Val("any", F.col(cols["o"])))
        if named:
            meet(graph, Val("iri", F.col(cols["g"])))
        for c in conds:
            df = df.where(c)
        return Sol(df, vals, frozenset(vals)).pinned() if vals else Sol(df.select(F.lit(True).alias(fresh("u"))), {}, frozenset())

    def edges(self, predicate: Term, graph) -> Sol:
        """(s, o) of one predicate as variables ``s`` and ``o``."""
        s, o = ("var", "s"), ("var", "o")
        return self.star(s, [(predicate, o)], graph) if self.data.tables else self.pattern(s, predicate, o, graph)

    # -- aggregation ----------------------------------------------------------
    def aggregate(self, sol: Sol, q: dict) -> tuple[Sol, dict]:
        found: dict[str, tuple] = {}

        def walk(e):
            if e[0] == "agg":
                found.setdefault(repr(e), e)
            elif e[0] in ("op", "call", "fn"):
                for x in e[2]:
                    walk(x)
            elif e[0] == "in":
                for x in [e[1], *e[2]]:
                    walk(x)

        for e, _ in q["select"]:
            if e is not None:
                walk(e)
        for e in q["having"]:
            walk(e)
        for e, _ in q["order"]:
            walk(e)
        stash: dict[str, Val] = {}
        keys, vals = [], {}
        sol = self.evenly(sol, ("call", "", [e for e, _ in q["group"]]))
        for e, v in q["group"]:
            x = self.expressions(sol).value(e)
            c = fresh()
            keys.append(x.col.alias(c))
            if v or e[0] == "var":
                vals[v or e[1]] = x.at(F.col(c))
            stash[repr(e)] = x.at(F.col(c))
        sol = self.evenly(sol, ("call", "", [e[3] for e in found.values() if e[3] is not None]))
        ex = self.expressions(sol)
        made, later = [], {}
        for k, e in found.items():
            cols, finish = aggregate_columns(e, ex, sol)
            names = [fresh() for _ in cols]
            made += [c.alias(n) for c, n in zip(cols, names, strict=True)]
            later[k] = finish(*[F.col(n) for n in names])
        made = made or [F.count(F.lit(1)).alias(fresh())]
        df = sol.df.groupBy(*keys).agg(*made) if keys else sol.df.agg(*made)
        extra = {k: fresh() for k in later}
        df = df.withColumns({extra[k]: v.col for k, v in later.items()}) if later else df
        stash |= {k: v.at(F.col(extra[k])) for k, v in later.items()}
        out = Sol(df, vals, frozenset(v for v in vals if v in sol.sure))
        for e in q["having"]:
            out = Sol(out.df.where(self.expressions(out, stash).truth(e)), out.vals, out.sure)
        return out, stash


def aggregate_columns(e, ex: Expressions, sol: Sol) -> tuple[list[Column], Callable[..., Val]]:
    """Spark aggregates of one SPARQL aggregate, and how its value follows from them."""
    _, name, distinct, arg, separator = e
    if name == "COUNT" and arg is None:
        if distinct:
            whole = F.struct(*[F.coalesce(n3_col(V.to_term(x)), F.lit("")).alias(f"f{i}") for i, x in enumerate(sol.vals.values())])
            return [F.count_distinct(whole)], lambda c: lit(c, "integer")
        return [F.count(F.lit(1))], lambda c: lit(c, "integer")
    x = ex.value(arg)
    if name == "COUNT":
        return [F.count_distinct(x.col) if distinct else F.count(x.col)], lambda c: lit(c, "integer")
    if name in ("SUM", "AVG"):
        n = x.col if x.kind == "lit" and x.dt in NUMERIC else V.number(x)
        add = (F.sum_distinct if distinct else F.sum) if name == "SUM" else None
        total = add(n) if add else (F.avg(F.when(n.isNotNull(), n)) if not distinct else F.sum_distinct(n) / F.count_distinct(n))
        # one bound value that isn't a number makes the sum an error; no value at all makes it 0
        cols = [total, F.count(x.col), F.count(n), F.max((~V.is_integer(x)).cast("int"))]

        def finish(t, bound, numeric, mixed) -> Val:
            if x.kind == "lit" and x.dt in NUMERIC:
                dt = ("integer" if x.dt == "integer" else x.dt) if name == "SUM" else ("decimal" if x.dt == "integer" else x.dt)
                zero = F.lit(0).cast("bigint" if dt == "integer" else "double")
                return lit(F.coalesce(t, zero), dt)
            value = F.when(bound == numeric, F.coalesce(t.cast("double"), F.lit(0.0)))
            dt = F.when(F.coalesce(mixed, F.lit(0)) == 0, XSD + ("integer" if name == "SUM" else "decimal")).otherwise(XSD + "double")
            return Val("any", term_col(LITERAL, V.double_text(value), dt))

        return cols, finish
    if name in ("MIN", "MAX"):
        if x.kind in ("lit", "iri"):
            f = F.min if name == "MIN" else F.max
            return [f(x.col if x.kind == "lit" else V.iri_text(x))], lambda c: x.at(c) if x.kind == "lit" else Val("iri", c)
        by = F.min_by if name == "MIN" else F.max_by
        bound = F.when(x.col.isNotNull(), V.sort_keys(x)[0])
        return [by(x.col, bound)], lambda c: x.at(c)
    if name == "SAMPLE":
        if x.kind == "any":
            return [F.min_by(x.col, F.when(x.col.isNotNull(), V.sort_keys(x)[0]))], lambda c: x.at(c)
        return [F.min(x.col)], lambda c: x.at(c)
    if name == "GROUP_CONCAT":
        text = V.lexical(x)
        gathered = F.collect_set(text) if distinct else F.collect_list(text)
        return [F.array_join(F.array_sort(gathered), separator)], lambda c: lit(c, "string")
    if name == "MEDIAN":
        return [F.median(V.number(x))], lambda c: lit(c, "double")
    return [F.mode(x.col, True) if x.kind != "any" else F.mode(x.col)], lambda c: x.at(c)
