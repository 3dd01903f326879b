"""SHACL validation: every constraint is a join or a filter over (focus, value) pairs of all focus nodes at once.

The shapes graph is read on the driver (it is schema, not data); the data graph is only ever a frame.
The report has one row per violation: focus, path, value, component, shape, severity, message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.expressions import compare, equals
from lattica.functions.values import Val
from lattica.operators.graphs import match
from lattica.operators.paths import Paths
from lattica.plans.compiler import Compiler, Dataset
from lattica.sources.documents import parse_turtle
from lattica.storage import Tables, fixpoint
from lattica.terms import BNODE, IRI, LITERAL, OWL, RDF, RDF_TYPE, RDFS, SH, TERM, XSD, Term, iri, lit_term, n3_col

_none = lambda: F.lit(None).cast(TERM)  # noqa: E731  (a column needs a session)


class Shapes:
    """A shapes graph on the driver."""

    def __init__(self, quads: list):
        self.by: dict[Term, dict[str, list[Term]]] = {}
        for s, p, o, _ in quads:
            self.by.setdefault(s, {}).setdefault(p, []).append(o)

    def get(self, s: Term, name: str) -> list[Term]:
        return self.by.get(s, {}).get(name if ":" in name else SH + name, [])

    def one(self, s: Term, name: str) -> Term | None:
        return next(iter(self.get(s, name)), None)

    def items(self, head: Term) -> list[Term]:
        out = []
        while head != iri(RDF + "nil") and head in self.by:
            out.append(self.by[head][RDF + "first"][0])
            head = self.by[head][RDF + "rest"][0]
        return out

    def path(self, t: Term):
        if t.k == IRI:
            return t
        if self.get(t, RDF + "first"):
            return ("path", "/", [self.path(x) for x in self.items(t)])
        for name, op in (("inversePath", "^"), ("zeroOrMorePath", "*"), ("oneOrMorePath", "+"), ("zeroOrOnePath", "?")):
            if self.get(t, name):
                return ("path", op, [self.path(self.one(t, name))])
        return ("path", "|", [self.path(x) for x in self.items(self.one(t, "alternativePath"))])

    def targeted(self) -> list[Term]:
        names = [SH + n for n in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")]
        implicit = lambda s: iri(RDFS + "Class") in self.get(s, RDF_TYPE) and any(t.v in (SH + "NodeShape", SH + "PropertyShape") for t in self.get(s, RDF_TYPE))
        return [s for s, ps in self.by.items() if any(n in ps for n in names) or implicit(s)]


class Validator:
    def __init__(self, data: DataFrame, shapes: Shapes):
        self.spark, self.shapes = data.sparkSession, shapes
        self.tables = Tables(self.spark, "shacl")
        self.data = data.select("s", "p", "o")
        self.paths = Paths(Compiler(Dataset(self.spark, quads=self.data)))
        sub = match(self.data, p=RDFS + "subClassOf").select(F.col("s").alias("a"), F.col("o").alias("b"))
        self.above = None if sub.isEmpty() else fixpoint(sub, lambda d, _: d.withColumnRenamed("b", "m").join(sub.withColumnRenamed("a", "m"), "m").select("a", "b"), ["a", "b"], self.tables)

    # -- targets ----------------------------------------------------------------
    def instances(self, cls: Term) -> DataFrame:
        typed = match(self.data, p=RDF_TYPE)
        if self.above is None:
            return typed.where(F.col("o") == lit_term(cls)).select(F.col("s").alias("focus")).distinct()
        below = self.above.where(F.col("b") == lit_term(cls)).select(F.col("a").alias("o"))
        below = below.union(self.spark.range(1).select(lit_term(cls).cast(TERM).alias("o"))).distinct()
        return typed.join(below, "o", "left_semi").select(F.col("s").alias("focus")).distinct()

    def targets(self, s: Term) -> DataFrame:
        parts = [self.instances(c) for c in self.shapes.get(s, "targetClass")]
        nodes = self.shapes.get(s, "targetNode")
        if nodes:
            parts.append(self.spark.createDataFrame([(tuple(n),) for n in nodes], "focus struct<k:tinyint,v:string,dt:string,lang:string,dir:string>"))
        parts += [match(self.data, p=p.v).select(F.col("s").alias("focus")) for p in self.shapes.get(s, "targetSubjectsOf")]
        parts += [match(self.data, p=p.v).select(F.col("o").alias("focus")) for p in self.shapes.get(s, "targetObjectsOf")]
        if iri(RDFS + "Class") in self.shapes.get(s, RDF_TYPE):
            parts.append(self.instances(s))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def report(self) -> DataFrame:
        out = None
        for s in self.shapes.targeted():
            v = self.violations(s, self.targets(s), ())
            out = v if out is None else out.unionByName(v)
        columns = ("focus", "path", "value", "component", "shape", "severity", "message")
        if out is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        text = lambda c: n3_col(F.col(c)).alias(c)
        return self.tables.keep(out.select(text("focus"), "path", text("value"), "component", "shape", "severity", "message").distinct())

    # -- shapes -----------------------------------------------------------------
    def violations(self, s: Term, foci: DataFrame, stack: tuple) -> DataFrame:
        """focus, path, value, component, shape, severity, message of a shape for some focus nodes; a shape within itself conforms."""
        get, one = self.shapes.get, self.shapes.one
        empty = foci.limit(0).select("focus", F.lit("").alias("path"), F.col("focus").alias("value"), *[F.lit("").alias(c) for c in ("component", "shape", "severity", "message")])
        if s in stack or (one(s, "deactivated") or Term(0, "")).v == "true":
            return empty
        stack = (*stack, s)
        path = one(s, "path")
        if path is not None:
            sol = self.paths.pairs(self.shapes.path(path), None)
            pairs = sol.df.select(V.to_term(sol.vals["s"]).cast(TERM).alias("focus"), V.to_term(sol.vals["o"]).cast(TERM).alias("value")).distinct()
            pairs = pairs.join(foci, "focus", "left_semi")
        else:
            pairs = foci.select("focus", F.col("focus").alias("value"))
        severity = (one(s, "severity") or iri(SH + "Violation")).v
        message = (one(s, "message") or Term(LITERAL, "")).v
        out = empty

        def add(rows: DataFrame, component: str, value="value") -> None:
            nonlocal out
            v = F.col("value") if value == "value" else _none()
            out = out.unionByName(rows.select("focus", F.lit(path.n3() if path is not None and path.k == IRI else "path" if path is not None else "").alias("path"), v.alias("value"), F.lit(component).alias("component"), F.lit(s.v).alias("shape"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))

        value = Val("any", F.col("value"))
        for name, test in self.value_tests(s, value):
            add(pairs.where(~F.coalesce(test, F.lit(False))), name)
        for c in get(s, "class"):
            good = self.instances(c).withColumnRenamed("focus", "value")
            add(pairs.join(good, "value", "left_anti"), "ClassConstraintComponent")
        counts = foci.join(pairs.groupBy("focus").agg(F.count(F.lit(1)).alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        for c in get(s, "minCount"):
            add(counts.where(F.col("n") < int(c.v)), "MinCountConstraintComponent", "")
        for c in get(s, "maxCount"):
            add(counts.where(F.col("n") > int(c.v)), "MaxCountConstraintComponent", "")
        for c in get(s, "hasValue"):
            add(foci.join(pairs.where(F.col("value") == lit_term(c)), "focus", "left_anti"), "HasValueConstraintComponent", "")
        if (one(s, "uniqueLang") or Term(0, "")).v in ("true", "1"):
            add(pairs.where(F.col("value.lang") != "").groupBy("focus", F.col("value.lang").alias("l")).count().where("count > 1").select("focus").distinct(), "UniqueLangConstraintComponent", "")
        self.pair_tests(s, foci, pairs, add)
        for c in get(s, "not"):
            add(pairs.join(self.failing(c, pairs, stack), "value", "left_anti"), "NotConstraintComponent")
        for c in get(s, "node"):
            add(pairs.join(self.failing(c, pairs, stack), "value", "left_semi"), "NodeConstraintComponent")
        for head in get(s, "and"):
            for c in self.shapes.items(head):
                add(pairs.join(self.failing(c, pairs, stack), "value", "left_semi"), "AndConstraintComponent")
        for head in get(s, "or"):
            bad = pairs
            for c in self.shapes.items(head):
                bad = bad.join(self.failing(c, pairs, stack), "value", "left_semi")
            add(bad, "OrConstraintComponent")
        for head in get(s, "xone"):
            members = self.shapes.items(head)
            fails = pairs.select("value").distinct().withColumn("f", F.lit(0))
            for c in members:
                f = self.failing(c, pairs, stack).withColumn("x", F.lit(1))
                fails = fails.join(f, "value", "left").select("value", (F.col("f") + F.coalesce("x", F.lit(0))).alias("f"))
            add(pairs.join(fails.where(F.col("f") != len(members) - 1), "value", "left_semi"), "XoneConstraintComponent")
        for c in get(s, "qualifiedValueShape"):
            good = pairs.join(self.failing(c, pairs, stack), "value", "left_anti")
            if (one(s, "qualifiedValueShapesDisjoint") or Term(0, "")).v in ("true", "1"):
                for other in self.siblings(s, c):  # a value that conforms to a sibling's shape doesn't count
                    good = good.join(self.failing(other, good, stack), "value", "left_semi")
            n = foci.join(good.groupBy("focus").count(), "focus", "left").withColumn("count", F.coalesce("count", F.lit(0)))
            for k in get(s, "qualifiedMinCount"):
                add(n.where(F.col("count") < int(k.v)), "QualifiedMinCountConstraintComponent", "")
            for k in get(s, "qualifiedMaxCount"):
                add(n.where(F.col("count") > int(k.v)), "QualifiedMaxCountConstraintComponent", "")
        if (one(s, "closed") or Term(0, "")).v == "true":
            allowed = [self.shapes.one(p, "path").v for p in get(s, "property") if self.shapes.one(p, "path") is not None]
            allowed += [x.v for head in get(s, "ignoredProperties") for x in self.shapes.items(head)]
            extra = self.data.join(foci.withColumnRenamed("focus", "s"), "s", "left_semi").where(~F.col("p").isin(allowed))
            add(extra.select(F.col("s").alias("focus"), F.col("o").alias("value")), "ClosedConstraintComponent")
        for c in get(s, "sparql"):
            add(self.by_query(c, foci), "SPARQLConstraintComponent")
        for p in get(s, "property"):
            values = pairs.select(F.col("value").alias("focus")).distinct()
            out = out.unionByName(self.violations(p, values, stack))
        return out

    def siblings(self, s: Term, own: Term) -> list[Term]:
        """Qualified value shapes of the other property shapes of each shape that has ``s`` as a property."""
        parents = [p for p in self.shapes.by if s in self.shapes.get(p, "property")]
        found = {q for p in parents for x in self.shapes.get(p, "property") for q in self.shapes.get(x, "qualifiedValueShape")}
        return sorted(found - {own})

    def failing(self, c: Term, pairs: DataFrame, stack: tuple) -> DataFrame:
        """Values that don't conform to a shape."""
        foci = pairs.select(F.col("value").alias("focus")).distinct()
        return self.violations(c, foci, stack).select(F.col("focus").alias("value")).distinct()

    def value_tests(self, s: Term, v: Val) -> list:
        get, t = self.shapes.get, v.col
        out = []
        for c in get(s, "datatype"):
            want = "" if c.v == XSD + "string" else c.v
            good = (t["k"] == LITERAL) & (t["dt"] == want) & (t["lang"] == "")
            if c.v == RDF + "langString":
                good = t["lang"] != ""
            elif c.v in V.NUMERIC_IRIS:
                good = good & V.number(v).isNotNull()
            elif c.v in (XSD + "dateTime", XSD + "date"):
                good = good & V.moment(v).isNotNull()
            elif c.v == XSD + "boolean":
                good = good & t["v"].isin("true", "false", "0", "1")
            out.append(("DatatypeConstraintComponent", good))
        for c in get(s, "nodeKind"):
            kinds = [k for k, n in ((IRI, "IRI"), (BNODE, "BlankNode"), (LITERAL, "Literal")) if n in c.v]
            out.append(("NodeKindConstraintComponent", t["k"].isin(kinds)))
        for name, o in (("minInclusive", ">="), ("minExclusive", ">"), ("maxInclusive", "<="), ("maxExclusive", "<")):
            out += [(name[0].upper() + name[1:] + "ConstraintComponent", compare(o, v, V.term_val(c))) for c in get(s, name)]
        text = F.when(t["k"] != BNODE, t["v"])
        out += [("MinLengthConstraintComponent", F.length(text) >= int(c.v)) for c in get(s, "minLength")]
        out += [("MaxLengthConstraintComponent", F.length(text) <= int(c.v)) for c in get(s, "maxLength")]
        flags = next((f"(?{c.v})" for c in get(s, "flags")), "")
        out += [("PatternConstraintComponent", F.rlike(text, F.lit(flags + c.v))) for c in get(s, "pattern")]
        for head in get(s, "languageIn"):
            test = F.lit(False)
            for x in self.shapes.items(head):
                test = test | (t["lang"] == x.v.lower()) | t["lang"].startswith(x.v.lower() + "-")
            out.append(("LanguageInConstraintComponent", test))
        for head in get(s, "in"):
            test = F.lit(False)
            for x in self.shapes.items(head):
                test = test | (t == lit_term(x))
            out.append(("InConstraintComponent", test))
        return out

    def pair_tests(self, s: Term, foci: DataFrame, pairs: DataFrame, add) -> None:
        other = lambda p: match(self.data, p=p.v).select(F.col("s").alias("focus"), F.col("o").alias("other")).join(foci, "focus", "left_semi")
        for p in self.shapes.get(s, "equals"):
            o = other(p).withColumnRenamed("other", "value")
            add(pairs.join(o, ["focus", "value"], "left_anti").unionByName(o.join(pairs, ["focus", "value"], "left_anti")), "EqualsConstraintComponent")
        for p in self.shapes.get(s, "disjoint"):
            add(pairs.join(other(p).withColumnRenamed("other", "value"), ["focus", "value"], "left_semi"), "DisjointConstraintComponent")
        for name, o in (("lessThan", "<"), ("lessThanOrEquals", "<=")):
            for p in self.shapes.get(s, name):
                test = compare(o, Val("any", F.col("value")), Val("any", F.col("other")))
                add(pairs.join(other(p), "focus").where(~F.coalesce(test, F.lit(False))).select("focus", "value").distinct(), name[0].upper() + name[1:] + "ConstraintComponent")

    def by_query(self, c: Term, foci: DataFrame) -> DataFrame:
        """``sh:select``: compiled once, with all focus nodes for ``$this``."""
        from lattica.plans.compiler import Sol
        from lattica.plans.parser import parse_query

        text = self.shapes.one(c, "select").v
        compiler = Compiler(Dataset(self.spark, quads=self.data))
        q = parse_query(text)
        this = Sol(foci.where(F.col("focus.k") != BNODE), {"this": Val("any", F.col("focus"))}, frozenset(["this"])).pinned()
        sol = compiler.join(this, compiler.group(q["where"]))
        v = V.to_term(sol.vals["value"]).cast(TERM) if "value" in sol.vals else V.to_term(sol.vals["this"])
        return sol.df.select(V.to_term(sol.vals["this"]).cast(TERM).alias("focus"), v.alias("value")).distinct()


def validate(data: DataFrame, shapes: str | list) -> DataFrame:
    """The validation report of ``data`` (triples) against shapes in Turtle or as quads; no row means it conforms."""
    return Validator(data, Shapes(parse_turtle(shapes) if isinstance(shapes, str) else shapes)).report()


def conforms(data: DataFrame, shapes: str | list) -> bool:
    return validate(data, shapes).where(F.col("severity") == SH + "Violation").isEmpty()


_ = (OWL, equals)
