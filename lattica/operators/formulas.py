"""N3 built-ins on lists, quoted formulas and goals, as steps between solution sequences.

A list is an array column of TERM structs, a formula an array of (s, p, o) structs: both are values of the row
that made them, so their built-ins are array functions.  Built-ins that ask for what holds in the graph
(``log:call``, ``log:collectAllIn``, ...) are joins with the compiled body of the formula.  In the triples of a rule's
head a list or formula is a literal of its N3 text with datatype rdf:List or log:Formula.

Lists and formulas come from the text of a rule and from other built-ins.  A formula's blank nodes are
variables; its unbound variables make it a pattern.  Formulas that hold rules are closed when the rule is
compiled, so they must be constant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.builtins import LIST, LOG, RESULTS, STRING, SWAP
from lattica.functions.expressions import equals
from lattica.functions.values import Val, lit
from lattica.plans.compiler import Sol, fresh
from lattica.plans.parser import is_var
from lattica.terms import BNODE, IRI, LITERAL, RDF, TERM, TRIPLE, Term, iri, lit_term, n3_col, term_col

GRAPH = SWAP + "graph#"
NIL = RDF + "nil"
_TERM = "struct<k:tinyint,v:string,dt:string,lang:string,dir:string>"
TERMS = f"array<{_TERM}>"
ATOMS = f"array<struct<s:{_TERM},p:string,o:{_TERM}>>"


def is_formula(x) -> bool:
    return isinstance(x, tuple) and not isinstance(x, Term) and bool(x) and x[0] == "formula"


def is_list(x) -> bool:
    return isinstance(x, tuple) and not isinstance(x, Term) and bool(x) and x[0] == "list"


def variables(x) -> set:
    """Variables of a node: of a list its items', of a formula its atoms'."""
    if is_var(x):
        return {x[1]}
    if is_list(x):
        return set().union(*map(variables, x[1])) if x[1] else set()
    if is_formula(x):
        return {v for atom in x[1] for y in atom for v in variables(y)}
    return set()


def value_of(engine, sol: Sol, x) -> Val:
    """The value of a node: a term, an array for a list, or an array of triples for a formula."""
    if is_list(x):
        items = [V.to_term(value_of(engine, sol, y)).cast(TERM) for y in x[1]]
        return Val("list", F.array(*items) if items else F.array().cast(TERMS))
    if is_formula(x):
        if len(x) > 2 and x[2]:
            return formula_literal(engine.closed(x[1], x[2], whole=True))
        loose = variables(x) - set(sol.vals)
        if loose:
            raise ValueError(f"?{sorted(loose)[0]} of a formula is unbound where its value is needed")
        return Val("graph", triples_column([[V.to_term(value_of(engine, sol, y)).cast(TERM) for y in atom] for atom in x[1]]))
    if is_var(x):
        if x[1] not in sol.vals:
            raise ValueError(f"?{x[1]} is unbound where its value is needed")
        return sol.vals[x[1]]
    if isinstance(x, Term) and x.k == IRI and x.v == NIL:
        return Val("list", F.array().cast(TERMS))
    return V.constant(x)


def triples_column(atoms: list) -> Column:
    if not atoms:
        return F.array().cast(ATOMS)
    return F.array_distinct(F.array(*[F.struct(s.alias("s"), F.when(p["k"] == IRI, p["v"]).alias("p"), o.alias("o")) for s, p, o in atoms]).cast(ATOMS))


def formula_literal(triples: list) -> Val:
    return Val("graph", triples_column([[lit_term(s).cast(TERM), lit_term(iri(p)).cast(TERM), lit_term(o).cast(TERM)] for s, p, o in triples]))


def text_of(v: Val) -> Column:
    """N3 text of a list, formula or term."""
    if v.kind == "list":
        return F.concat(F.lit("("), F.array_join(F.transform(v.col, lambda t: n3_col(t)), " "), F.lit(")"))
    if v.kind == "graph":
        lines = F.array_sort(F.transform(v.col, lambda t: F.concat(n3_col(t["s"]), F.lit(" <"), t["p"], F.lit("> "), n3_col(t["o"]), F.lit(" ."))))
        return F.concat(F.lit("{ "), F.array_join(lines, " "), F.lit(" }"))
    return n3_col(V.to_term(v).cast(TERM))


def as_terms(sol: Sol) -> Sol:
    """Lists and formulas as literals of their text, for the triples of a head."""
    kinds = {"list": RDF + "List", "graph": LOG + "Formula"}
    return Sol(sol.df, {n: Val("any", term_col(LITERAL, text_of(v), kinds[v.kind])) if v.kind in kinds else v for n, v in sol.vals.items()}, sol.sure)


def items_of(v: Val) -> Column:
    if v.kind == "list":
        return v.col
    return F.when(V.to_term(v)["v"] == NIL, F.array().cast(TERMS)) if v.kind in ("iri", "any") else F.lit(None).cast(TERMS)


def atoms_of(v: Val) -> Column:
    return v.col if v.kind == "graph" else F.lit(None).cast(ATOMS)


def same(a: Val, b: Val) -> Column:
    if a.kind == b.kind == "graph":
        return F.array_sort(F.transform(a.col, _line)) == F.array_sort(F.transform(b.col, _line))
    if "graph" in (a.kind, b.kind):
        return F.lit(False)
    if "list" in (a.kind, b.kind):
        return F.coalesce(items_of(a) == items_of(b), F.lit(False))
    return F.coalesce(equals(a, b), F.lit(False))


def _line(t: Column) -> Column:
    return F.concat_ws(" ", n3_col(t["s"]), t["p"], n3_col(t["o"]))


def bind(engine, sol: Sol, x, made: Val) -> Sol:
    """``made`` under a new variable (rows without a value go), or a test against what ``x`` is already."""
    if is_var(x) and x[1] not in sol.vals:
        c = fresh()
        return Sol(sol.df.withColumn(c, made.col).where(F.col(c).isNotNull()), sol.vals | {x[1]: made.at(F.col(c))}, sol.sure | {x[1]})
    if is_list(x) and variables(x) - set(sol.vals):  # a pattern: as many items, each bound
        c = fresh()
        out = Sol(sol.df.withColumn(c, items_of(made)).where(F.size(F.col(c)) == len(x[1])), sol.vals, sol.sure)
        for i, y in enumerate(x[1]):
            out = bind(engine, out, y, Val("any", F.get(F.col(c), F.lit(i))))
        return out
    if is_formula(x) and variables(x) - set(sol.vals):
        return match(engine, sol, atoms_of(made), x[1])
    return Sol(sol.df.where(same(made, value_of(engine, sol, x))), sol.vals, sol.sure)


def match(engine, sol: Sol, triples: Column, atoms: list) -> Sol:
    """Every way in which the atoms stand among a row's triples."""
    held = fresh()
    sol = Sol(sol.df.withColumn(held, triples), sol.vals, sol.sure)
    for s, p, o in atoms:
        t = fresh()
        sol = Sol(sol.df.withColumn(t, F.explode(F.col(held))), sol.vals, sol.sure)
        for x, v in ((s, Val("any", F.col(t)["s"])), (p, Val("iri", F.col(t)["p"])), (o, Val("any", F.col(t)["o"]))):
            sol = bind(engine, sol, x, v)
    return Sol(sol.df.drop(held), sol.vals, sol.sure)


# -- what holds in the graph ------------------------------------------------------------
def goal(engine, sol: Sol, formula, known: DataFrame, how: str = "inner") -> Sol:
    """``sol`` joined with what the formula finds in ``known``; ``how``: inner, left, left_semi or left_anti.

    The formula's built-ins see the variables of ``sol``, so they are applied to the joined rows.
    """
    if not is_formula(formula):
        raise ValueError("a goal must be written as a formula")
    plain = [x for x in formula[1] if not engine.is_builtin(x[1])]
    steps = [x for x in formula[1] if engine.is_builtin(x[1])]
    if steps:
        found = goal(engine, sol, ("formula", plain), known) if plain else sol
        for s, p, o in steps:
            found = engine.builtin(found, s, p.v, o, known)
        return found if how == "inner" else rejoined(sol, found, how)
    inner = engine.goal_body(plain, known)
    if not inner.vals:
        return Sol(sol.df.join(inner.df.select(F.lit(True).alias(fresh())).limit(1), F.lit(True), how), sol.vals, sol.sure)
    df = sol.df.join(inner.df, engine.compiler(known).condition(sol, inner), how)
    if how in ("left_semi", "left_anti"):
        return Sol(df, sol.vals, sol.sure)
    return Sol(df, inner.vals | sol.vals, sol.sure | (inner.sure if how == "inner" else frozenset()))


def rejoined(sol: Sol, found: Sol, how: str) -> Sol:
    """Rows of ``sol`` with (left), with or without (semi, anti) the rows that they have become in ``found``."""
    keys = sol.df.columns
    more = [c for c in found.df.columns if c not in keys] if how == "left" else []
    right = found.df.select(*[F.col(c).alias(f"_{c}") for c in keys], *more).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], F.lit(True))
    df = sol.df.join(right, cond, how)
    if how == "left":
        return Sol(df.select(*keys, *more), found.vals, sol.sure)
    return Sol(df, sol.vals, sol.sure)


def includes(engine, sol: Sol, s, o, known: DataFrame, how: str) -> Sol:
    """Whether (inner: and how) the object formula stands in the subject formula, or in the graph if the subject is unbound."""
    if is_formula(s) or (is_var(s) and s[1] in sol.vals):
        scope = value_of(engine, sol, s)
        if is_formula(o) and variables(o) - set(sol.vals):
            if how == "inner":
                return match(engine, sol, atoms_of(scope), o[1])
            return rejoined(sol, match(engine, sol, atoms_of(scope), o[1]), how)
        inside = F.size(F.array_except(atoms_of(value_of(engine, sol, o)), atoms_of(scope))) == 0
        return Sol(sol.df.where(~inside if how == "left_anti" else inside), sol.vals, sol.sure)
    return goal(engine, sol, o, known, how)


def collect_all(engine, sol: Sol, s, o, known: DataFrame) -> Sol:
    """``(template {clause} list) log:collectAllIn scope``: all values of the template, sorted; none is an empty list."""
    template, clause, target = s[1]
    found = goal(engine, sol, clause, known, "left")
    keys = sol.df.columns
    some = reduce(lambda a, b: a & b, [found.vals[v].col.isNotNull() for v in variables(clause) if v in found.vals], F.lit(True))
    got = fresh()
    each = F.when(some, V.to_term(value_of(engine, found, template)).cast(TERM))
    df = found.df.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias(got)) if keys else found.df.agg(F.sort_array(F.collect_list(each)).alias(got))
    return bind(engine, Sol(df, sol.vals, sol.sure), target, Val("list", F.col(got)))


def if_then_else(engine, sol: Sol, s, o, known: DataFrame) -> Sol:
    cond, then, other = s[1]
    yes = goal(engine, goal(engine, sol, cond, known), then, known)
    no = goal(engine, goal(engine, sol, cond, known, "left_anti"), other, known)
    return engine.compiler(known).union([yes, no])


def for_all(engine, sol: Sol, s, o, known: DataFrame) -> Sol:
    """``({a} {b}) log:forAllIn scope``: no way in which a holds without b."""
    a, b = s[1]
    found = goal(engine, sol, a, known)
    return rejoined(sol, goal(engine, found, b, known, "left_anti"), "left_anti")


def cut(engine, sol: Sol, s, o, known: DataFrame) -> Sol:
    """The first way alone in which the goals hold: one row for each row (ties: the least values)."""
    found = goal(engine, goal(engine, sol, s, known), o, known) if is_formula(o) else goal(engine, sol, s, known)
    keys, more = sol.df.columns, [c for c in found.df.columns if c not in sol.df.columns]
    if not more:
        return found
    first = found.df.groupBy(*keys).agg(F.min(F.struct(*more)).alias("_first"))
    return Sol(first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in more]), found.vals, found.sure)


# -- lists ------------------------------------------------------------------------------
def _list(f):
    """A built-in from the subject's items to the object."""
    return lambda e, sol, s, o, known: bind(e, sol, o, f(items_of(value_of(e, sol, s))))


def _pair(f):
    """A built-in on ``(list x)``; ``x`` may be a list itself."""

    def run(e, sol, s, o, known):
        first, second = s[1] if is_list(s) else ((), ())
        return bind(e, sol, o, f(items_of(value_of(e, sol, first)), value_of(e, sol, second)))

    return run


def _rest(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))


def _sorted(a: Column) -> Column:
    """Numbers by value, then the rest by text."""
    keyed = F.transform(a, lambda t: F.struct(V.number(Val("any", t)).isNull().alias("n"), V.number(Val("any", t)).alias("x"), t["v"].alias("v"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda k: k["t"])


def _append(e, sol, s, o, known):
    parts = [items_of(value_of(e, sol, x)) for x in s[1]]
    return bind(e, sol, o, Val("list", F.concat(*parts) if parts else F.array().cast(TERMS)))


def _remove(a: Column, x: Val) -> Val:
    if x.kind == "list":
        return Val("list", F.filter(a, lambda t: ~F.array_contains(x.col, t)))
    one = V.to_term(x).cast(TERM)
    return Val("list", F.filter(a, lambda t: t != one))


def _index(x: Val) -> Column:
    return V.number(x).cast("int")


def _remove_at(a: Column, x: Val) -> Val:
    return Val("list", F.when(_index(x).between(0, F.size(a) - 1), F.filter(a, lambda t, i: i != _index(x))))


def _member_at(e, sol, s, o, known):
    items, at = s[1]
    a = items_of(value_of(e, sol, items))
    if variables(at) - set(sol.vals):
        i, t = fresh(), fresh()
        both = Sol(sol.df.select("*", F.posexplode(a).alias(i, t)), sol.vals, sol.sure)
        return bind(e, bind(e, both, at, lit(F.col(i).cast("bigint"), "integer")), o, Val("any", F.col(t)))
    i = _index(value_of(e, sol, at))
    return bind(e, sol, o, Val("any", F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i))))


def _iterate(e, sol, s, o, known):
    """A row for each (index item), from 0."""
    i, t = fresh(), fresh()
    both = Sol(sol.df.select("*", F.posexplode(items_of(value_of(e, sol, s))).alias(i, t)), sol.vals, sol.sure)
    number = lit(F.col(i).cast("bigint"), "integer")
    if is_list(o):
        return bind(e, bind(e, both, o[1][0], number), o[1][1], Val("any", F.col(t)))
    return bind(e, both, o, Val("list", F.array(V.to_term(number).cast(TERM), F.col(t))))


def _first_rest(e, sol, s, o, known):
    a = items_of(value_of(e, sol, s))
    out = Sol(sol.df.where(F.size(a) > 0), sol.vals, sol.sure)
    return bind(e, bind(e, out, o[1][0], Val("any", F.get(a, F.lit(0)))), o[1][1], Val("list", _rest(a)))


def _equal(distinct: bool, wanted: bool):
    def run(e, sol, s, o, known):
        a, b = (items_of(value_of(e, sol, x)) for x in (s, o))
        a, b = (F.array_sort(F.array_distinct(x) if distinct else x) for x in (a, b))
        return Sol(sol.df.where((a == b) if wanted else (a != b)), sol.vals, sol.sure)

    return run


def _map(e, sol, s, o, known):
    """``(list predicate) list:map result``: a function of one value, for each item; items without a result go."""
    items, predicate = s[1]
    f = RESULTS[predicate.v]
    a = items_of(value_of(e, sol, items))
    return bind(e, sol, o, Val("list", F.filter(F.transform(a, lambda t: V.to_term(f(Val("any", t))).cast(TERM)), lambda t: t.isNotNull())))


def _members(e, sol, s, o, known):
    t = fresh()
    return bind(e, Sol(sol.df.withColumn(t, F.explode(items_of(value_of(e, sol, s)))), sol.vals, sol.sure), o, Val("any", F.col(t)))


# -- formulas -----------------------------------------------------------------------------
def _graphs(f):
    def run(e, sol, s, o, known):
        return bind(e, sol, o, Val("graph", reduce(f, [atoms_of(value_of(e, sol, x)) for x in s[1]])))

    return run


def _quoted(t: Column) -> Column:
    return term_col(TRIPLE, F.concat(F.lit("<<( "), n3_col(t["s"]), F.lit(" <"), t["p"], F.lit("> "), n3_col(t["o"]), F.lit(" )>>"))).cast(TERM)


def _graph_member(e, sol, s, o, known):
    t = fresh()
    each = Sol(sol.df.withColumn(t, F.explode(atoms_of(value_of(e, sol, s)))), sol.vals, sol.sure)
    return bind(e, each, o, Val("graph", F.array(F.col(t))))


def _raw_type(e, sol, s, o, known):
    v = value_of(e, sol, s)
    if v.kind in ("list", "graph"):
        kind = F.lit(RDF + "List" if v.kind == "list" else LOG + "Formula")
    else:
        k = V.to_term(v)["k"]
        kind = F.when(k == LITERAL, LOG + "Literal").when(k == BNODE, LOG + "LabeledBlankNode").when(k == TRIPLE, LOG + "Formula").otherwise(LOG + "Other")
    return bind(e, sol, o, Val("iri", kind))


def _prefix(e, sol, s, o, known):
    """An IRI and the prefix of the namespace that it is, either way."""
    pairs = sorted(e.prefixes.items())
    if is_var(s) and s[1] not in sol.vals:
        name = V.lexical(value_of(e, sol, o))
        found = reduce(lambda c, p: c.when(name == p[0], F.lit(p[1])), pairs, F.when(F.lit(False), F.lit("")))
        return bind(e, sol, s, Val("iri", found))
    where = V.lexical(value_of(e, sol, s))
    return bind(e, sol, o, lit(reduce(lambda c, p: c.when(where == p[1], F.lit(p[0])), pairs, F.when(F.lit(False), F.lit(""))), "string"))


def _has_prefix(e, sol, s, o, known):
    """Whether a known namespace begins the IRI."""
    where = V.lexical(value_of(e, sol, s))
    some = reduce(lambda c, n: c | where.startswith(n), sorted(e.prefixes.values()), F.lit(False))
    return Sol(sol.df.where(some if not (isinstance(o, Term) and o.v == "false") else ~some), sol.vals, sol.sure)


def _repeat(e, sol, s, o, known):
    i, n = fresh(), V.number(value_of(e, sol, s)).cast("bigint")
    rows = sol.df.where(n > 0).withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return bind(e, Sol(rows, sol.vals, sol.sure), o, lit(F.col(i), "integer"))


def _satisfiable(e, sol, s, o, known):
    """False for a formula that says that one of its formulas implies false."""
    false = Term(LITERAL, "false", "http://www.w3.org/2001/XMLSchema#boolean")
    if is_formula(s):
        return bind(e, sol, o, lit(F.lit(not any(head == false for _, head in (s[2] if len(s) > 2 else []))), "boolean"))
    bad = F.exists(atoms_of(value_of(e, sol, s)), lambda t: (t["p"] == LOG + "implies") & (t["o"]["v"] == "false"))
    return bind(e, sol, o, lit(~bad, "boolean"))


def _isomorphic(e, sol, s, o, known):
    """Equal triples; a rule's formulas hold no blank nodes (they are variables)."""
    return Sol(sol.df.where(same(value_of(e, sol, s), value_of(e, sol, o))), sol.vals, sol.sure)


def _true(e, sol, s, o, known):
    return sol


def _output(e, sol, s, o, known):
    """Keeps (key, text) for ``outputs``, which the caller may write where it likes."""
    row = [V.to_term(value_of(e, sol, x)).cast(TERM) for x in (s, o)]
    e.outputs.append(sol.df.select(row[0]["v"].alias("key"), row[1]["v"].alias("text")))
    return sol


def _becomes(e, sol, s, o, known):
    """The subject's triples give way to the object's once the rules are done."""
    gone, new = (atoms_of(value_of(e, sol, x)) for x in (s, o))
    e.changes.append((sol.df.select(F.inline(gone)).select("s", "p", "o"), sol.df.select(F.inline(new)).select("s", "p", "o")))
    return sol


def _where(x) -> str:
    if not (isinstance(x, Term) and x.k in (IRI, LITERAL)):
        raise ValueError("the document of log:semantics and log:content must be named by a constant")
    return x.v


def _semantics(on_error: bool):
    def run(e, sol, s, o, known):
        from lattica.sources.documents import collect_quads, load

        try:
            triples = [q[:3] for q in collect_quads(load(e.spark, _where(s)))]
        except Exception as error:
            if not on_error:
                return Sol(sol.df.where(F.lit(False)), sol.vals, sol.sure)
            return bind(e, sol, o, lit(F.lit(str(error).splitlines()[0]), "string"))
        return bind(e, sol, o, formula_literal(triples))

    return run


def _content(e, sol, s, o, known):
    found = e.spark.read.text(_where(s), wholetext=True).first()
    return bind(e, sol, o, lit(F.lit(found[0] if found else ""), "string"))


def _parsed(e, sol, s, o, known):
    """The formula that a text holds, parsed in the tasks; null for texts with errors."""

    def parse(text):
        from lattica.sources.documents import parse_turtle

        try:
            return None if text is None else [{"s": a._asdict(), "p": p, "o": c._asdict()} for a, p, c, *_ in parse_turtle(text)]
        except ValueError:
            return None

    return bind(e, sol, o, Val("graph", F.udf(parse, ATOMS)(V.lexical(value_of(e, sol, s)))))


def _conclusion(whole: bool):
    """The closure of a formula under the rules in it, or what that adds."""

    def run(e, sol, s, o, known):
        if is_formula(s) and len(s) > 2 and s[2]:
            return bind(e, sol, o, formula_literal(e.closed(s[1], s[2], whole)))
        made = value_of(e, sol, s)  # without rules nothing follows
        return bind(e, sol, o, made if whole else Val("graph", F.when(made.col.isNotNull(), F.array().cast(ATOMS))))

    return run


def _replace_all(e, sol, s, o, known):
    """``(text (patterns) (replacements))``, or one of each; $1 stands for what the pattern's group, or it itself, met."""
    text, patterns, new = s[1]
    out = V.lexical(value_of(e, sol, text))
    pairs = zip(patterns[1], new[1], strict=True) if is_list(patterns) else [(patterns, new)]
    for p, r in pairs:
        p, r = (V.lexical(value_of(e, sol, x)) for x in (p, r))
        out = F.regexp_replace(out, F.when(p.contains("("), p).otherwise(F.concat(F.lit("("), p, F.lit(")"))), r)
    return bind(e, sol, o, lit(out, "string"))


def _scrape_all(e, sol, s, o, known):
    text, pattern = (V.lexical(value_of(e, sol, x)) for x in s[1])
    found = F.when(pattern.contains("("), F.regexp_extract_all(text, pattern, F.lit(1))).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))
    return bind(e, sol, o, Val("list", F.transform(found, lambda x: term_col(LITERAL, x).cast(TERM))))


def _text(e, sol, s, o, known):
    return bind(e, sol, o, lit(text_of(value_of(e, sol, s)), "string"))


def _asks(how: str):
    return lambda e, sol, s, o, known: includes(e, sol, s, o, known, how)


def _call(how: str):
    def run(e, sol, s, o, known):
        out = goal(e, sol, s, known, how)
        return goal(e, out, o, known, "left" if how == "left" else how) if is_formula(o) else out

    return run


#: predicate -> step(engine, solutions, subject, object, known triples)
STEPS = {
    LIST + "first": _list(lambda a: Val("any", F.get(a, F.lit(0)))),
    LIST + "last": _list(lambda a: Val("any", F.get(a, F.size(a) - 1))),
    LIST + "rest": _list(lambda a: Val("list", _rest(a))),
    LIST + "length": _list(lambda a: lit(F.size(a).cast("bigint"), "integer")),
    LIST + "sort": _list(lambda a: Val("list", _sorted(a))),
    LIST + "unique": _list(lambda a: Val("list", F.array_distinct(a))),
    LIST + "removeDuplicates": _list(lambda a: Val("list", F.array_distinct(a))),
    LIST + "remove": _pair(_remove),
    LIST + "removeAt": _pair(_remove_at),
    LIST + "append": _append,
    LIST + "memberAt": _member_at,
    LIST + "iterate": _iterate,
    LIST + "firstRest": _first_rest,
    LIST + "setEqualTo": _equal(True, True),
    LIST + "setNotEqualTo": _equal(True, False),
    LIST + "multisetEqualTo": _equal(False, True),
    LIST + "multisetNotEqualTo": _equal(False, False),
    LIST + "map": _map,
    LIST + "member": _members,
    LIST + "in": lambda e, sol, s, o, known: _members(e, sol, o, s, known),
    GRAPH + "length": lambda e, sol, s, o, known: bind(e, sol, o, lit(F.size(atoms_of(value_of(e, sol, s))).cast("bigint"), "integer")),
    GRAPH + "member": _graph_member,
    GRAPH + "union": _graphs(lambda a, b: F.array_union(a, b)),
    GRAPH + "intersection": _graphs(lambda a, b: F.array_intersect(a, b)),
    GRAPH + "difference": _graphs(lambda a, b: F.array_except(a, b)),
    GRAPH + "list": lambda e, sol, s, o, known: bind(e, sol, o, Val("list", F.transform(atoms_of(value_of(e, sol, s)), _quoted))),
    LOG + "conjunction": _graphs(lambda a, b: F.array_union(a, b)),
    LOG + "includes": _asks("inner"),
    LOG + "notIncludes": _asks("left_anti"),
    LOG + "includesNotBind": _asks("left_semi"),
    LOG + "supports": lambda e, sol, s, o, known: includes(e, sol, ("formula", [(a, iri(b), c) for a, b, c in e.closed(s[1], s[2], True)]) if is_formula(s) and len(s) > 2 and s[2] else s, o, known, "inner"),
    LOG + "rawType": _raw_type,
    LOG + "outputString": _output,
    LOG + "prefix": _prefix,
    LOG + "hasPrefix": _has_prefix,
    LOG + "n3String": _text,
    LOG + "localN3String": _text,
    LOG + "repeat": _repeat,
    LOG + "satisfiable": _satisfiable,
    LOG + "isomorphic": _isomorphic,
    LOG + "becomes": _becomes,
    LOG + "trace": _true,
    LOG + "semantics": _semantics(False),
    LOG + "semanticsOrError": _semantics(True),
    LOG + "content": _content,
    LOG + "parsedAsN3": _parsed,
    LOG + "collectAllIn": collect_all,
    LOG + "forAllIn": for_all,
    LOG + "ifThenElseIn": if_then_else,
    LOG + "call": _call("inner"),
    LOG + "callWithOptional": _call("left"),
    LOG + "callWithCut": cut,
    LOG + "callWithCleanup": _call("inner"),
    LOG + "conclusion": _conclusion(True),
    LOG + "inferences": _conclusion(False),
    STRING + "replaceAll": _replace_all,
    STRING + "scrapeAll": _scrape_all,
}
