"""Arrow IPC: a table of terms and a table of triples of their numbers, a file for each partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.indexed import numbered
from lattica.storage import Tables
from lattica.terms import IRI, TERM, TRIPLES

_TERMS = "id long, k tinyint, v string, dt string, lang string, dir string"
_TRIPLES = "s long, p long, o long"


def _write(df: DataFrame, folder: str) -> None:
    """Each task writes one file, named by its partition and moved to its place when whole, so that a task may run again."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where):
        raise ValueError(f"{folder} is there already")
    files.mkdirs(where)  # a frame without rows has no tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, writer = TaskContext.get(), None
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part = f"{root}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        rows = 0
        with files.open_output_stream(part) as sink:
            for b in batches:
                writer = writer or pa.ipc.new_file(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
            if writer:
                writer.close()
        if writer:
            files.move(part, f"{root}/part-{context.partitionId():05d}.arrow")
        else:
            files.delete_file(part)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    df.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with pa.ipc.open_file(content.as_buffer()) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return files.mapInArrow(run, schema)


def write_arrow(g: DataFrame, path: str) -> None:
    """Write triples to ``path``/terms and ``path``/triples (a URI or an absolute path of a folder that is not there yet)."""
    term_of = F.struct(F.lit(IRI).cast("tinyint").alias("k"), F.col("p").alias("v"), *[F.lit("").alias(c) for c in ("dt", "lang", "dir")]).cast(TERM)
    flat = g.select("s", term_of.alias("p"), "o").distinct()
    terms = numbered(flat.select("s").union(flat.select("p")).union(flat.select("o")), Tables(g.sparkSession, "arrow"))
    for c in ("s", "p", "o"):
        number = terms.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(c))
        flat = flat.join(number, c)
    _write(terms.select("id", "term.*"), f"{path}/terms")
    _write(flat.select(*[F.col(f"{c}_id").alias(c) for c in ("s", "p", "o")]), f"{path}/triples")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Triples written by ``write_arrow``."""
    terms = _read(spark, f"{path}/terms", _TERMS)
    term = F.struct("k", "v", "dt", "lang", "dir").cast(TERM)
    out = _read(spark, f"{path}/triples", _TRIPLES).toDF("s_id", "p_id", "o_id")
    for c in ("s", "p", "o"):
        out = out.join(terms.select(F.col("id").alias(f"{c}_id"), (F.col("v") if c == "p" else term).alias(c)), f"{c}_id")
    return out.select("s", "p", "o").to(TRIPLES)
