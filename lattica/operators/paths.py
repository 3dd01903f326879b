"""Property paths: joins and unions for the fixed-length ones (multisets), fixpoints for ``*`` and ``+`` (sets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.values import Val
from lattica.storage import Tables, fixpoint
from lattica.terms import IRI, Term, term_col


class Paths:
    def __init__(self, compiler):
        self.c = compiler

    def pattern(self, s, path, o, graph):
        """Solutions of ``s path o``; constant ends are the seed of a closure, not a filter after it."""
        from lattica.plans.compiler import Sol
        from lattica.plans.parser import is_var

        _, op, args = path
        if op in ("*", "+", "?"):
            sol = self.closure(op, args[0], s if isinstance(s, Term) else None, o if isinstance(o, Term) else None, graph)
        else:
            sol = self.pairs(path, graph)
        vals, df = {}, sol.df
        for end, x in (("s", s), ("o", o)):
            v = sol.vals[end]
            if isinstance(x, Term):
                df = df.where(self.c.is_term(v, x))
            elif is_var(x) and x[1] in vals:
                a, b = self.c.pair(vals[x[1]], v)
                df = df.where(a == b)
            else:
                vals[x[1]] = v
        out = Sol(df, vals, frozenset(vals))
        return out.pinned() if vals else Sol(df.select(F.lit(True).alias("u")), {}, frozenset())

    def pairs(self, path, graph):
        """(s, o) of a path as variables ``s`` and ``o``."""
        from lattica.plans.compiler import Sol

        if isinstance(path, Term):
            return self.c.edges(path, graph)
        _, op, args = path
        if op == "/":
            sol = self.pairs(args[0], graph)
            for a in args[1:]:
                right = self.pairs(a, graph)
                left = Sol(sol.df, {"s": sol.vals["s"], "m": sol.vals["o"]}, frozenset("sm"))
                joined = self.c.join(left, Sol(right.df, {"m": right.vals["s"], "o": right.vals["o"]}, frozenset("mo")))
                sol = Sol(joined.df, {"s": joined.vals["s"], "o": joined.vals["o"]}, frozenset("so")).pinned()
            return sol
        if op == "|":
            return self.c.union([self.pairs(a, graph) for a in args])
        if op == "^":
            sol = self.pairs(args[0], graph)
            return Sol(sol.df, {"s": sol.vals["o"], "o": sol.vals["s"]}, sol.sure)
        if op == "!":
            return self.negated(args, graph)
        return self.closure(op, args[0], None, None, graph)

    def negated(self, members, graph):
        from lattica.plans.compiler import Sol

        ahead = [m.v for m in members if isinstance(m, Term)]
        back = [m[2][0].v for m in members if not isinstance(m, Term)]
        parts = []
        t = self.c.data.triples(graph if isinstance(graph, str) else None)
        if ahead or not back:
            parts.append(t.where(~F.col("p").isin(ahead)).select("s", "o"))
        if back:
            parts.append(t.where(~F.col("p").isin(back)).select(F.col("o").alias("s"), F.col("s").alias("o")))
        df = parts[0]
        for p in parts[1:]:
            df = df.union(p)
        return Sol(df.distinct(), {"s": Val("any", F.col("s")), "o": Val("any", F.col("o"))}, frozenset("so")).pinned()

    def nodes(self, graph):
        t = self.c.data.triples(graph if isinstance(graph, str) else None)
        return t.select("s").union(t.select(F.col("o").alias("s"))).distinct()

    def closure(self, op, inner, start, end, graph):
        """Semi-naive closure.  A constant start or end bounds the frontier; zero-length pairs are added for ``*`` and ``?``."""
        from lattica.plans.compiler import Sol, fresh

        sol = self.pairs(inner, graph)
        a, b = V.unified([sol.vals["s"], sol.vals["o"]])
        zero = op in ("*", "?")
        if zero and start is None and end is None and a.kind != "any":
            a, b = Val("any", V.to_term(a)), Val("any", V.to_term(b))
        tables = Tables(self.c.spark, "path")
        edges = tables.keep(sol.df.select(a.col.alias("s"), b.col.alias("o")).distinct())
        kind = lambda c: a.at(F.col(c))
        seed = edges
        if start is not None:
            seed = edges.where(self.c.is_term(kind("s"), start))
        elif end is not None:
            seed = edges.where(self.c.is_term(kind("o"), end))
        if op == "?":
            found = seed
        elif start is None and end is not None:
            step = lambda d, _: d.withColumnRenamed("s", "m").join(edges.withColumnRenamed("o", "m"), "m").select("s", "o")
            found = fixpoint(seed, step, ["s", "o"], tables)
        else:
            step = lambda d, _: d.withColumnRenamed("o", "m").join(edges.withColumnRenamed("s", "m"), "m").select("s", "o")
            found = fixpoint(seed, step, ["s", "o"], tables)
        if zero:
            if start is not None or end is not None:
                t = start if start is not None else end
                same = self.c.spark.range(1).select(self.constant(a, t).alias("s"))
                if start is not None and end is not None and start != end:
                    same = same.limit(0)
            else:
                same = self.nodes(graph)
            same = same.where("s is not null").select("s", F.col("s").alias("o"))
            found = found.union(same.select(*[F.col(c).cast(found.schema[c].dataType) for c in ("s", "o")])).distinct()
        x, y = fresh(), fresh()
        return Sol(found.select(F.col("s").alias(x), F.col("o").alias(y)), {"s": kind("s").at(F.col(x)), "o": kind("o").at(F.col(y))}, frozenset("so"))

    def constant(self, like: Val, t: Term):
        if like.kind == "iri" and like.template:
            head, tail = like.template.split("{}")
            inside = t.v[len(head) : len(t.v) - len(tail)] if t.k == IRI and t.v.startswith(head) and t.v.endswith(tail) else None
            return F.lit(inside)
        if like.kind == "iri":
            return F.lit(t.v if t.k == IRI else None).cast("string")
        if like.kind == "any":
            return term_col(t.k, F.lit(t.v), t.dt, t.lang, t.dir)
        c = V.constant(t)
        return c.col if c.like(like) else F.lit(None)
