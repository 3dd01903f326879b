"""Full-text search over literals: exact tokens, ``prefix*`` tokens, all of several tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.terms import LITERAL

_SPLIT = r"[\s\p{Punct}]+"


def build_index(g: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(token, s, p): an inverted index of the literals; write it partitioned or bucketed by token to keep it."""
    rows = g.where(F.col("o.k") == LITERAL)
    if predicates:
        rows = rows.where(F.col("p").isin(predicates))
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.col("o.v")), _SPLIT), lambda x: x != ""))
    return rows.select(F.explode(tokens).alias("token"), "s", "p").distinct()


def search(index: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Subjects whose literals (of one predicate) hold every token of ``query``."""
    wanted = list(dict.fromkeys(query.lower().split()))
    if not wanted:
        return index.select("s", "p").limit(0)
    test = F.lit(None).cast("int")
    for i, w in enumerate(wanted):
        test = F.when(F.startswith("token", F.lit(w[:-1])) if w.endswith("*") else F.col("token") == w, i).otherwise(test)
    # one filter reads the postings of all tokens; a subject is a hit when each of them is there
    parts = None
    for i, w in enumerate(wanted):
        hit = index.where(F.startswith("token", F.lit(w[:-1])) if w.endswith("*") else F.col("token") == w).select("s", "p", F.lit(i).alias("i"))
        parts = hit if parts is None else parts.union(hit)
    found = parts.groupBy("s", "p").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(wanted)).select("s", "p")
    return found.limit(limit) if limit is not None else found


def search_columns(frame: DataFrame, column: str, query: str) -> DataFrame:
    """Rows of a table whose text holds every token: a filter, without an index."""
    tokens = F.split(F.lower(F.col(column)), _SPLIT)
    test = F.lit(True)
    for w in query.lower().split():
        test = test & (F.exists(tokens, lambda t, w=w: t.startswith(w[:-1])) if w.endswith("*") else F.array_contains(tokens, w))
    return frame.where(test)
