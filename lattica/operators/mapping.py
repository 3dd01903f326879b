"""Tables as graphs: virtual property tables, and their triples where a query needs them.

A row is an entity, ``template`` with its key; a column is a predicate.  Rows are never exploded unless
a query asks for a variable predicate or a rule engine needs triples.  Null cells make no triple, and
rows with a null or empty key none at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.values import Val, from_spark, iri_text, to_term
from lattica.terms import IRI, RDF_TYPE, TERM, XSD, term_col


@dataclass
class TableMap:
    """How a frame is a graph."""

    name: str
    source: DataFrame | Callable[[], DataFrame]  # a frame, or what opens it where a query needs the table
    key: Callable[[], Column]
    template: str
    type: str
    predicates: dict[str, tuple[str, str]]  # predicate -> (column, "" or the template of the entities it names)
    kinds: dict[str, str] = field(default_factory=dict)  # predicate -> datatype, "iri" or "@lang", where it isn't the column's own
    schema: T.StructType | None = None  # known without opening

    def __post_init__(self):
        self._frame = None if callable(self.source) else self.source
        self.schema = self.schema or self.frame.schema

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = self.source()
        return self._frame

    def value(self, predicate: str) -> Val:
        column, template = self.predicates[predicate]
        if template:
            return Val("iri", F.col(f"`{column}`"), template=template)
        kind = self.kinds.get(predicate)
        if kind == "iri":
            return Val("iri", F.col(f"`{column}`").cast("string"))
        if kind and kind.startswith("@"):
            return Val("any", term_col(3, F.col(f"`{column}`"), "", kind[1:].lower()))
        if kind:
            name = kind.removeprefix(XSD)
            from lattica.functions.values import NATIVE, lit

            if name in NATIVE:
                return lit(F.col(f"`{column}`").try_cast(NATIVE[name]), name)
            return Val("any", term_col(3, F.col(f"`{column}`").cast("string"), kind))
        return from_spark(F.col(f"`{column}`"), self.schema[column].dataType)

    def subject(self) -> Val:
        return Val("iri", self.key(), template=self.template)

    def rows(self) -> DataFrame:
        k = self.key()
        kind = self.frame.select(k).schema[0].dataType
        good = k.isNotNull() & (k != "") if isinstance(kind, T.StringType) else k.isNotNull()
        return self.frame.where(good)

    def triples(self, keys: list[str] | None = None) -> DataFrame:
        """s, p, o of every cell, or of the rows with some keys."""
        s = term_col(IRI, iri_text(self.subject()))
        cells = [F.struct(F.lit(RDF_TYPE).alias("p"), term_col(IRI, F.lit(self.type)).alias("o"))] if self.type else []
        cells += [F.struct(F.lit(p).alias("p"), to_term(self.value(p)).cast(TERM).alias("o")) for p in self.predicates]
        rows = self.rows() if keys is None else self.rows().where(self.key().cast("string").isin(keys))
        return rows.select(s.alias("s"), F.inline(F.array(*cells))).where(F.col("o").isNotNull()).select(F.col("s").cast(TERM).alias("s"), "p", "o")


ENTITY, VOCABULARY = "http://ex.org/{}/{{}}", "http://ex.org/v#"
#: table -> (key columns, {foreign key column: table})
STAR = {
    "region": (["r_regionkey"], {}),
    "nation": (["n_nationkey"], {"n_regionkey": "region"}),
    "customer": (["c_custkey"], {"c_nationkey": "nation"}),
    "supplier": (["s_suppkey"], {"s_nationkey": "nation"}),
    "part": (["p_partkey"], {}),
    "orders": (["o_orderkey"], {"o_custkey": "customer"}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": (["event_id"], {"user_id": "user"}),
    "documents": (["doc_id"], {}),
    "labels": (["doc_id"], {"doc_id": "documents"}),
    "pages": (["page_id"], {}),
    "conversations": (["conv_id", "turn"], {}),
    "benchmark": (["item_id"], {}),
}


def table_map(frame: DataFrame | Callable[[], DataFrame], name: str, key: list[str], links: dict[str, str] | None = None, vocabulary: str = VOCABULARY, entity: str = ENTITY, iri_columns: tuple[str, ...] = (), schema: T.StructType | None = None) -> TableMap:
    """The default mapping: one predicate per column of a plain type, one type for the table.  A frame that is a function is opened when it is read; it needs its ``schema``."""
    links = links or {}
    schema = schema or frame.schema
    plain = [f.name for f in schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    # a single key column is the entity itself and no property, unless it links to another table
    own = [c for c in plain if c not in key or c in links or len(key) > 1]
    cols = [F.col(f"`{c}`") for c in key]
    make = (lambda: cols[0]) if len(cols) == 1 else (lambda: F.concat_ws("-", *cols))
    return TableMap(name, frame, make, entity.format(name), f"{vocabulary}{name.capitalize()}", {vocabulary + c: (c, entity.format(links[c]) if c in links else "") for c in own}, {vocabulary + c: "iri" for c in iri_columns}, schema)


#: Schemas by path: a table's footers are read once, not for every query.
_SCHEMAS: dict[str, T.StructType] = {}


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return _SCHEMAS[path]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema_of(spark, path)).parquet(path)


def star_schema(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[TableMap]:
    """The test tables as one graph; a query opens only those that it reads."""
    out = []
    for name in names or STAR:
        key, links = STAR[name]
        path = f"{folder}/{name}.parquet"
        out.append(table_map(partial(read_table, spark, path), name, key, links, iri_columns=("url",) if name == "pages" else (), schema=schema_of(spark, path)))
    return out
