"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.jaccard import jaccard_groups
from lattica.llm.linededup import deduplicate_lines
from lattica.llm.mixing import mix, topic_and_tokens
from lattica.llm.packing import pack_documents
from lattica.llm.quality import judge_quality
from lattica.llm.storage import Scratch, reads, release
from lattica.llm.tokencount import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: By input folder: the stages begun there and the intermediate tables that each has made.
_made: dict[str, list[tuple[int, list[str]]]] = {}


def _stage(number: int):
    """A stage; as it begins, the intermediate tables of earlier stages on the same input are deleted.

    What a stage returns reads its tables until it is written, and stages run on what the one before has written.
    Tables that ``docs`` still reads (a caller that chains stages without writing) stay.
    """

    def wrap(f):
        @wraps(f)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            done = _made.setdefault(sf_dir, [])
            held, before = reads(docs), set(Scratch.made)
            if not any(p.rpartition("/")[2] in held for n, paths in done if n < number for p in paths):  # names are unique
                release(spark, [p for n, paths in done if n < number for p in paths])
                done[:] = [x for x in done if x[0] >= number]
            out = f(spark, docs, sf_dir)
            done.append((number, [p for p in Scratch.made if p not in before]))
            return out

        return stage

    return wrap


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test reject; null and empty texts fail the base rules, repeated rows share a verdict."""
    return _columns(judge_quality(_columns(docs), keep=COLUMNS).where("kept"))


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go; n_chars follows the text.  Documents that lose every word go."""
    out = deduplicate_lines(_columns(docs))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _columns(out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", n))


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: of each group the document with the smallest doc_id stays."""
    docs = _columns(docs)
    groups = jaccard_groups(docs, k=5, num=80, den=100)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    out = docs.join(stay.hint("merge"), docs["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    # a row that is stored twice is one document
    return _columns(out.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]))


@_stage(3)
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source, language and topic raked to flattened shares; a calibrated sample of documents stays.  Nulls are a value of their own, repeated rows stay or go together."""
    return _columns(mix(topic_and_tokens(_columns(docs))).where("sampled"))


@_stage(4)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: one row per piece.  Null and empty texts are a piece of the end token alone."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Robust estimates, raking and local search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one returns is written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
