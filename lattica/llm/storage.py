"""Where intermediate tables live, and small helpers that every operator shares.

Operators cut lineage by writing Parquet under ``spark.checkpoint.dir`` (a folder that the driver and
all executors share) and reading it again: the files survive a lost executor.  Nothing is kept in
executor memory or in machine-local folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session without one (a local test) gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """A folder of written tables below the shared folder."""

    #: Folders of this process that ``release`` may delete, in the order in which they were made.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        Scratch.made.append(self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads the files."""
        path = self.place(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in written:
            remove(self.spark, df._scratch_path)


def reads(df: DataFrame) -> str:
    """The folders and files that a frame's plan reads, in one text."""
    from py4j.protocol import Py4JError

    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        try:
            out.append(leaves.apply(i).relation().location().rootPaths().mkString(" "))
        except Py4JError:  # no files
            continue
    return " ".join(out)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders whose tables nothing reads any more."""
    for path in paths:
        remove(spark, path)
        if path in Scratch.made:
            Scratch.made.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be megabytes long, and a batch is held whole in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z alone in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
