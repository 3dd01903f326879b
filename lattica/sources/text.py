"""Line formats, read and written by all tasks: N-Triples, N-Quads, Hextuples, RDF Patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.expressions import parse_n3
from lattica.terms import BNODE, IRI, LITERAL, QUADS, TERM, TRIPLE, XSD, n3_col, term_col

# subject, predicate, object and graph of a statement line
_NODE = r'(<[^>]*>|_:[^\s]+|<<\(.*\)>>)'
_LINE = rf'(?s)^\s*{_NODE}\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\(.*\)>>)\s*(<[^>]*>|_:[^\s]+)?\s*\.\s*(?:#.*)?$'


#: Lines without a statement: blank ones and comments.
_NO_STATEMENT = r"^\s*(#.*)?$"


def _statements(lines: DataFrame, column: str = "value", skip_malformed: bool = False) -> DataFrame:
    """Statements of lines; a line that is neither a statement, a comment nor blank is an error unless it is to be skipped."""
    if not skip_malformed:
        error = F.raise_error(F.concat(F.lit("malformed line: "), F.substring(column, 1, 200))).cast("boolean")
        lines = lines.where(F.when(F.rlike(column, F.lit(_LINE)), True).when(F.rlike(column, F.lit(_NO_STATEMENT)), False).otherwise(error))
    part = lambda n: F.regexp_extract(column, _LINE, n)
    found = lines.where(F.rlike(column, F.lit(_LINE))).select(*[part(i + 1).alias(c) for i, c in enumerate("spog")])
    term = lambda c: parse_n3(F.col(c)).cast(TERM).alias(c)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return found.select(term("s"), inner("p").alias("p"), term("o"), F.when(F.col("g") != "", F.when(F.col("g").startswith("<"), inner("g")).otherwise(F.col("g"))).alias("g"))


def read_ntriples(spark: SparkSession, path: str, skip_malformed: bool = False) -> DataFrame:
    """Triples of N-Triples files; comments and blank lines are passed over, malformed lines fail unless they are skipped."""
    return _statements(spark.read.text(path), skip_malformed=skip_malformed).drop("g").distinct()


def read_nquads(spark: SparkSession, path: str, skip_malformed: bool = False) -> DataFrame:
    return _statements(spark.read.text(path), skip_malformed=skip_malformed).distinct()


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither statements, comments nor blank."""
    return spark.read.text(path).where(~F.rlike("value", F.lit(_LINE)) & ~F.rlike("value", F.lit(_NO_STATEMENT)))


def ntriples_lines(g: DataFrame) -> DataFrame:
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit("> "))).otherwise("") if "g" in g.columns else F.lit("")
    return g.select(F.concat(n3_col(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), n3_col(F.col("o")), F.lit(" "), graph, F.lit(".")).alias("value"))


def write_ntriples(g: DataFrame, path: str) -> None:
    """N-Triples, or N-Quads if the frame has a graph column; one file per task."""
    ntriples_lines(g).write.mode("overwrite").text(path)


write_nquads = write_ntriples


def read_hextuples(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON arrays of subject, predicate, value, datatype, language, graph."""
    a = F.from_json("value", "array<string>")
    rows = spark.read.text(path).where(F.trim("value") != "").select(a.alias("a"))
    node = lambda c: F.when(c.startswith("_:"), term_col(BNODE, F.substring(c, F.lit(3), F.length(c)))).otherwise(term_col(IRI, c)).cast(TERM)
    v, dt, lang, g = (F.get("a", F.lit(i)) for i in (2, 3, 4, 5))
    literal = term_col(LITERAL, v, F.when((lang != "") | (dt == XSD + "string"), "").otherwise(dt), F.lower(lang))
    o = F.when(dt == "globalId", term_col(IRI, v)).when(dt == "localId", node(v)).otherwise(literal).cast(TERM)
    return rows.select(node(F.get("a", F.lit(0))).alias("s"), F.get("a", F.lit(1)).alias("p"), o.alias("o"), F.when(g != "", g).alias("g"))


def write_hextuples(g: DataFrame, path: str) -> None:
    s, o = F.col("s"), F.col("o")
    name = lambda t: F.when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).otherwise(t["v"])
    dt = F.when(o["k"] == IRI, "globalId").when(o["k"] == BNODE, "localId").when(o["lang"] != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").when(o["dt"] == "", XSD + "string").otherwise(o["dt"])
    graph = F.coalesce("g", F.lit("")) if "g" in g.columns else F.lit("")
    g.select(F.to_json(F.array(name(s), F.col("p"), name(o), dt, o["lang"], graph)).alias("value")).write.mode("overwrite").text(path)


def patch_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """RDF Patch from one graph to another: deletions, then additions."""
    d = ntriples_lines(before.subtract(after.select(*before.columns))).select(F.concat(F.lit("D "), "value").alias("value"))
    a = ntriples_lines(after.subtract(before.select(*after.columns))).select(F.concat(F.lit("A "), "value").alias("value"))
    return d.union(a)


def apply_patch(g: DataFrame, lines: DataFrame) -> DataFrame:
    """``g`` after a patch (frame of lines ``A ...`` and ``D ...``)."""
    body = lines.select(F.substring("value", 1, 1).alias("op"), F.substring("value", F.lit(3), F.length("value")).alias("value"))
    add, drop = _statements(body.where("op = 'A'")), _statements(body.where("op = 'D'"))
    columns = g.columns
    return g.subtract(drop.select(*columns)).unionByName(add.select(*columns)).distinct()


def read_triples_table(spark: SparkSession, path: str) -> DataFrame:
    """Columnar storage: Parquet written by ``write_triples_table``, laid out by predicate."""
    return spark.read.parquet(path)


def write_triples_table(g: DataFrame, path: str) -> None:
    """Parquet partitioned by predicate and sorted by subject: a pattern reads only its predicate's files."""
    named = g.withColumn("predicate", F.col("p"))
    named.repartition("predicate", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("s").write.mode("overwrite").partitionBy("predicate").parquet(path)


_ = (TRIPLE, QUADS)
