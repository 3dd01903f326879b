"""Written intermediate tables for iterative operators.

Iterations cut lineage by writing Parquet below ``spark.checkpoint.dir``, a folder that the driver and
all executors share, so that a lost executor costs no results.  Nothing is kept on executors.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shuffle_tasks(spark: SparkSession) -> int:
    """Over how many tasks rows are dealt: as many as a shuffle has, and twice the cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def plain_shuffle(spark: SparkSession) -> int:
    """How many partitions a shuffle can have whose writing tasks hold no rows in memory."""
    return int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """DISTINCT of rows that hardly repeat: dealt over tasks first, so that no reading task holds all of its rows in a hash table.

    The number of tasks follows the size that Spark expects of the rows, 128 kB each: terms hold many times what is expected of them.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(shuffle_tasks(df.sparkSession), min(size >> 17, plain_shuffle(df.sparkSession))), *df.columns).distinct()


_BROADCAST, _MEASURED, _SIZE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_FIRST, _SKEWED, _READ = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.files.maxPartitionBytes"


@contextmanager
def planned_for_terms(spark: SparkSession):
    """Plans that don't trust the size of terms in files and shuffles, where they shrink to a thirtieth.

    Joins are broadcast by what a side has been measured to hold, as adaptive execution does, and never by the size of
    files: below the threshold there may be gigabytes.  Shuffles start with 200 partitions at least, which are joined up to 4 MB
    instead of 64, and one key's rows (a class, a nation) are split in joins beyond 4 MB instead of 256; files are read
    16 MB at a time instead of 128.  So a task's sort or hash table doesn't grow with the input.
    """
    before = {k: spark.conf.get(k, None) for k in (_BROADCAST, _MEASURED, _SIZE, _FIRST, _SKEWED, _READ)}
    spark.conf.set(_MEASURED, before[_MEASURED] or spark.conf.get(_BROADCAST))
    spark.conf.set(_BROADCAST, "-1")
    spark.conf.set(_SIZE, "4m")
    spark.conf.set(_FIRST, str(max(plain_shuffle(spark), shuffle_tasks(spark), int(before[_FIRST] or 0))))
    spark.conf.set(_SKEWED, "4m")
    spark.conf.set(_READ, "16m")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """A folder of written tables; ``keep`` writes one and returns a frame that reads it."""

    def __init__(self, spark: SparkSession, name: str = "tables"):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:04d}"
        with planned_for_terms(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fixpoint(start: DataFrame, step, columns: list[str], tables: Tables, limit: int = 1000) -> DataFrame:
    """Semi-naive iteration: ``step(delta, all)`` gives candidates; rows not known yet are the next delta."""
    delta = tables.keep(start.select(*columns).distinct())
    parts = [delta]
    for _ in range(limit):
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        new = step(delta, known).select(*columns).distinct()
        on = [new[c].eqNullSafe(known[c]) for c in columns]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        delta = tables.keep(new.join(known, cond, "left_anti"))
        if delta.isEmpty():
            return known
        parts.append(delta)
        if len(parts) > 8:  # few files to read, whatever the depth
            parts = [tables.keep(known.union(delta))]
    raise RuntimeError(f"no fixpoint after {limit} rounds")
