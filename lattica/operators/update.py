"""SPARQL Update as functions from one dataset state to the next.

A state is a frame of quads (``g`` null: default graph) and the set of graph names, which may name empty
graphs.  Deletions come before insertions; a WHERE clause is evaluated once, on a written result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans import parser as P
from lattica.plans.compiler import Compiler, Dataset, Sol
from lattica.storage import Tables, distinct_rows
from lattica.terms import QUADS, TERM, Term

_EMPTY = "s struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, p string, o struct<k:tinyint,v:string,dt:string,lang:string,dir:string>, g string"


class UpdateError(ValueError):
    """An update that can't be done, without SILENT."""


@dataclass(frozen=True)
class State:
    spark: SparkSession
    quads: DataFrame
    graphs: frozenset = frozenset()
    loader: Callable | None = None
    journal: tuple = field(default=())

    @classmethod
    def of(cls, spark: SparkSession, quads: DataFrame | None = None, graphs=(), loader=None) -> State:
        if quads is None:
            quads = spark.createDataFrame([], QUADS)
        if "g" not in quads.columns:
            quads = quads.withColumn("g", F.lit(None).cast("string"))
        return cls(spark, quads.select("s", "p", "o", "g"), frozenset(graphs), loader)

    def dataset(self) -> Dataset:
        return Dataset(self.spark, quads=self.quads, graphs=self.graphs)

    def query(self, text: str):
        return self.dataset().query(text)

    def names(self) -> set:
        return set(self.graphs) | {r[0] for r in self.quads.where("g is not null").select("g").distinct().toLocalIterator()}

    # -- changes ----------------------------------------------------------------
    def added(self, rows: DataFrame) -> State:
        return self.at(distinct_rows(self.quads.unionByName(rows.select("s", "p", "o", "g"))))

    def removed(self, rows: DataFrame) -> State:
        r = rows.select(*[F.col(c).alias(f"_{c}") for c in ("s", "p", "o", "g")])
        q = self.quads
        cond = (q["s"] == r["_s"]) & (q["p"] == r["_p"]) & (q["o"] == r["_o"]) & q["g"].eqNullSafe(r["_g"])
        return self.at(q.join(r, cond, "left_anti"))

    def at(self, quads: DataFrame) -> State:
        return replace(self, quads=quads, journal=(*self.journal, self.quads))

    def undone(self, steps: int = 1) -> State:
        """The state before the last changes."""
        if not self.journal:
            return self
        return replace(self, quads=self.journal[-steps], journal=self.journal[:-steps])

    def update(self, text: str, prefixes: dict | None = None) -> State:
        state = self
        for op in P.parse_update(text, prefixes):
            state = apply(state, op)
        return state


def data_rows(state: State, quads: list, default: str | None = None) -> DataFrame:
    rows = []
    for s, p, o, g in quads:
        rows.append((tuple(ground(s)), p.v, tuple(ground(o)), g.v if g is not None else default))
    return state.spark.createDataFrame(rows, QUADS)


def ground(x) -> Term:
    if isinstance(x, Term):
        return x
    from lattica.terms import triple_term

    return triple_term(*[ground(y) for y in x[1:]])


def apply(state: State, op: dict) -> State:
    kind = op["op"]
    if kind == "insert_data":
        return state.added(data_rows(state, op["quads"]))
    if kind == "delete_data":
        return state.removed(data_rows(state, op["quads"]))
    if kind == "modify":
        return modify(state, op)
    if kind == "load":
        try:
            rows = state.loader(op["source"]) if state.loader else _no_loader()
        except Exception:
            if op["silent"]:
                return state
            raise
        into = F.lit(op["into"]).cast("string")
        return state.added(rows.select("s", "p", "o", into.alias("g")))
    if kind in ("clear", "drop", "create"):
        return manage(state, op)
    return transfer(state, op)


def _no_loader():
    raise UpdateError("no loader for LOAD")


def modify(state: State, op: dict) -> State:
    here = op["with"]
    data = state.dataset()
    graph = here
    if op["using"] or op["named"]:
        data = Compiler(data).dataset_of({"from": op["using"], "named": op["named"]})
        graph = None
    sol = Compiler(data).group(op["where"], graph)
    tables = Tables(state.spark, "update")
    if sol.vals:
        sol = sol.pinned()
        written = tables.keep(sol.df)
        sol = Sol(written, sol.vals, sol.sure)
    default = lambda quads: [(s, p, o, g if g is not None else (Term(1, here) if here else None)) for s, p, o, g in quads]
    compiler = Compiler(data)
    if op["delete"]:
        state = state.removed(tables.keep(compiler.instantiate(sol, default(op["delete"]))))
    if op["insert"]:
        state = state.added(tables.keep(compiler.instantiate(sol, default(op["insert"]))))
    return replace(state, quads=tables.keep(state.quads))  # the next operation reads it, and isn't planned with this one


def manage(state: State, op: dict) -> State:
    g, kind = op["graph"], op["op"]
    if kind == "create":
        if g in state.names() and not op["silent"]:
            raise UpdateError(f"graph {g} exists")
        return replace(state, graphs=state.graphs | {g})
    if g not in ("DEFAULT", "NAMED", "ALL") and g not in state.names() and not op["silent"]:
        raise UpdateError(f"no graph {g}")
    keep = {"DEFAULT": F.col("g").isNotNull(), "NAMED": F.col("g").isNull(), "ALL": F.lit(False)}.get(g, F.col("g").isNull() | (F.col("g") != g))
    out = state.at(state.quads.where(keep))
    if kind == "drop":
        out = replace(out, graphs=frozenset() if g in ("NAMED", "ALL") else state.graphs - {g})
    elif g not in ("DEFAULT", "NAMED", "ALL"):
        out = replace(out, graphs=state.graphs | {g})
    return out


def transfer(state: State, op: dict) -> State:
    source, target = op["source"], op["target"]
    is_ = lambda g: F.col("g").isNull() if g == "DEFAULT" else F.col("g") == g
    if source != "DEFAULT" and source not in state.names() and not op["silent"]:
        raise UpdateError(f"no graph {source}")
    if source == target:
        return state
    name = F.lit(None if target == "DEFAULT" else target).cast("string").alias("g")
    moved = state.quads.where(is_(source)).select("s", "p", "o", name)
    rest = state.quads
    if op["op"] in ("copy", "move"):
        rest = rest.where(~F.coalesce(is_(target), F.lit(False)))
    if op["op"] == "move":
        rest = rest.where(~F.coalesce(is_(source), F.lit(False)))
    out = state.at(rest.unionByName(moved).distinct())
    return replace(out, graphs=(state.graphs | ({target} if target != "DEFAULT" else set())) - ({source} if op["op"] == "move" else set()))


class BatchWriter:
    """Collects triples on the driver and adds them ``size`` at a time."""

    def __init__(self, state: State, size: int = 1000):
        self.state, self.size, self.rows = state, size, []
        self.listeners: list[Callable] = []

    def on_add(self, f: Callable) -> None:
        self.listeners.append(f)

    def add(self, s: Term, p: str, o: Term, g: str | None = None) -> None:
        self.rows.append((tuple(s), p, tuple(o), g))
        for f in self.listeners:
            f(s, p, o)
        if len(self.rows) >= self.size:
            self.flush()

    def flush(self) -> State:
        if self.rows:
            self.state = self.state.added(self.state.spark.createDataFrame(self.rows, QUADS))
            self.rows = []
        return self.state


TERM_TYPE = TERM
