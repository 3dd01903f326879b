"""Graphs as numbered nodes and edges between numbers, for graph algorithms that know nothing of terms."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graphs import graph_hash, isomorphic
from lattica.storage import Tables
from lattica.terms import BNODE, IRI, RDF, TRIPLE


def numbered(terms: DataFrame, tables: Tables) -> DataFrame:
    """``id`` (unique, with gaps) and ``term`` of the distinct terms of one column; written, so that numbers stay."""
    return tables.keep(terms.toDF("term").distinct().select(F.monotonically_increasing_id().alias("id"), "term"))


def to_simple_graph(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges ``src``, ``dst`` without repeats, nodes ``id``, ``term``): subjects and objects are nodes, predicates are lost."""
    nodes = numbered(g.select("s").union(g.select("o")), Tables(g.sparkSession, "simple"))
    src = nodes.select(F.col("id").alias("src"), F.col("term").alias("s"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("term").alias("o"))
    return g.select("s", "o").distinct().join(src, "s").join(dst, "o").select("src", "dst"), nodes


def from_simple_graph(edges: DataFrame, nodes: DataFrame, predicate: str = RDF + "value") -> DataFrame:
    """One triple for each edge whose source may be a subject."""
    src = nodes.select(F.col("id").alias("src"), F.col("term").alias("s"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("term").alias("o"))
    out = edges.join(src.where(F.col("s.k").isin(IRI, BNODE, TRIPLE)), "src").join(dst, "dst")
    return out.select("s", F.lit(predicate).alias("p"), "o").distinct()


class IsomorphicGraph:
    """A graph that equals every graph which differs in the names of blank nodes alone, and hashes like it."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    @cached_property
    def digest(self) -> str:
        return graph_hash(self.triples.distinct())

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, IsomorphicGraph):
            return NotImplemented
        return self.digest == other.digest and isomorphic(self.triples, other.triples)

    def __hash__(self) -> int:
        return hash(self.digest)
