"""Stores: where a graph's frame comes from, and what is kept of its changes."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.update import State
from lattica.plans.parser import parse_update
from lattica.sources import results as R
from lattica.terms import Term


class RemoteStore:
    """A SPARQL endpoint as a graph; ``transport`` sends a query's text and returns a JSON result, ``sender`` sends an update's."""

    def __init__(self, spark: SparkSession, endpoint: str, transport: Callable[[str, str], str] | None = None, update_endpoint: str | None = None, sender: Callable[[str, str], None] | None = None):
        self.spark, self.endpoint, self.transport = spark, endpoint, transport or _post
        self.update_endpoint, self.sender = update_endpoint or endpoint, sender or _post_update

    def update(self, text: str) -> None:
        """Checked here, done there: an update that doesn't parse is not sent."""
        parse_update(text)
        self.sender(self.update_endpoint, text)

    def query(self, text: str):
        return R.from_json(self.spark, self.transport(self.endpoint, text))

    def triples(self, s: Term | None = None, p: str | None = None, o: Term | None = None) -> DataFrame:
        """The triples of a pattern; bound places are sent along."""
        show = lambda t, name: t.n3() if t is not None else f"?{name}"
        text = f"SELECT * WHERE {{ {show(s, 's')} {f'<{p}>' if p else '?p'} {show(o, 'o')} }}"
        df = self.query(text)
        from lattica.terms import TERM, lit_term

        get = lambda t, name: F.col(name) if t is None else lit_term(t).cast(TERM)
        return df.select(get(s, "s").alias("s"), (F.lit(p) if p else F.col("p.v")).alias("p"), get(o, "o").alias("o"))

    def resolver(self) -> Callable[[str], DataFrame]:
        """For ``Dataset.services``: answers a SERVICE block, each text once."""
        known: dict[str, DataFrame] = {}

        def answer(block: str) -> DataFrame:
            if block not in known:
                known[block] = self.query(f"SELECT * WHERE {block}")
            return known[block]

        return answer


def _post(endpoint: str, text: str) -> str:
    data = urllib.parse.urlencode({"query": text}).encode()
    request = urllib.request.Request(endpoint, data, {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=60) as r:
        return r.read().decode()


def _post_update(endpoint: str, text: str) -> None:
    request = urllib.request.Request(endpoint, text.encode(), {"Content-Type": "application/sparql-update"})
    with urllib.request.urlopen(request, timeout=60) as r:
        r.read()


class ObservedState:
    """A state whose changes call back: ``on("add", f)`` and ``on("remove", f)``, each with a frame of the quads concerned."""

    def __init__(self, state: State):
        self.state, self.listeners = state, {"add": [], "remove": []}

    def on(self, event: str, f: Callable[[DataFrame], None]) -> None:
        self.listeners[event].append(f)

    def off(self, event: str, f: Callable[[DataFrame], None]) -> None:
        self.listeners[event].remove(f)

    def update(self, text: str) -> ObservedState:
        before, self.state = self.state, self.state.update(text)
        old, new = before.quads, self.state.quads
        for event, rows in (("add", new.subtract(old)), ("remove", old.subtract(new))):
            if self.listeners[event] and not rows.isEmpty():
                for f in list(self.listeners[event]):
                    f(rows)
        return self


class AuditedStore:
    """A state with a journal: (change, quad text) rows, and undo."""

    def __init__(self, state: State):
        self.state, self.log = state, []

    def update(self, text: str) -> AuditedStore:
        before, self.state = self.state, self.state.update(text)
        self.log.append((text, before))
        return self

    def changes(self) -> DataFrame:
        """Added and removed quads since the beginning."""
        first = self.log[0][1].quads if self.log else self.state.quads
        now = self.state.quads
        return now.subtract(first).withColumn("change", F.lit("add")).unionByName(first.subtract(now).withColumn("change", F.lit("remove")))

    def undo(self) -> AuditedStore:
        if self.log:
            self.state = self.log.pop()[1]
        return self


def describe_log(store: AuditedStore) -> str:
    return json.dumps([text for text, _ in store.log])
