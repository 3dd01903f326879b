"""Sources mixed to target weights by iterative proportional fitting (raking).

Tokens are summed by cell (source, language, topic).  Raking scales the cells' weights in turn until the
weighted tokens of each source, language and topic meet the target shares; a document is then taken
with its cell's calibrated probability.  Whether it is taken depends on a keyed hash of the document
alone, so a sample can be repeated and does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

DIMS = ("source", "lang", "topic")
TOPICS = 6


def topic_and_tokens(docs: DataFrame, text: str = "text", topics: int = TOPICS) -> DataFrame:
    """``docs`` with ``n_tokens`` (words between white space) and ``topic``: ``t0``, ``t1``, ...

    The topic is a lexical one: each distinct word of six bytes or more falls into one of ``topics`` hashed
    vocabularies, and the largest share wins (ties: the first).  Texts without such words are ``t0``.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_tokens", "topic")]
    kept = docs.select(*own)
    at = own.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["n_tokens long", "topic string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            n, names = [], []
            for t in b.column(at).to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                votes = [0] * topics
                for w in set(words):
                    if len(w) >= 6:
                        votes[zlib.crc32(w) % topics] += 1
                n.append(len(words))
                names.append(f"t{votes.index(max(votes))}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(names, pa.string())], [*own, "n_tokens", "topic"])

    return kept.mapInArrow(run, schema)


def rake(cells: list[dict], targets: dict[str, dict], total: float, rounds: int = 200, tolerance: float = 1e-9, ceiling: float = 1.0) -> list[float]:
    """Probability of each cell, ``ceiling`` at most.

    ``cells``: dicts with the dimensions and ``tokens``; ``targets``: share of each value by dimension.  Cells
    at the ceiling keep it while the others go on being fitted: the closest that sampling without
    repetition can come.
    """
    tokens = np.array([c["tokens"] for c in cells], float)
    if not len(cells) or not tokens.sum():
        return [ceiling] * len(cells)
    index = {}
    for d in targets:
        values = sorted({c[d] for c in cells}, key=repr)
        place = {v: i for i, v in enumerate(values)}
        index[d] = (np.array([place[c[d]] for c in cells]), np.array([targets[d].get(v, 0.0) for v in values]) * total, len(values))
    p = np.minimum(np.full(len(cells), total / tokens.sum()), ceiling)
    for _ in range(rounds):
        before = p.copy()
        for at, want, size in index.values():
            have = np.bincount(at, p * tokens, size)
            factor = np.divide(want, have, out=np.ones(size), where=have > 0)
            p = np.minimum(p * factor[at], ceiling)
        if np.abs(p - before).max() < tolerance:
            break
    return [float(x) for x in p]


def flattened(shares: dict, power: float) -> dict:
    """Shares raised to ``power`` and normed: 1 leaves them, 0 makes them equal."""
    raised = {k: (v**power if v > 0 else 0.0) for k, v in shares.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake_frame(cells: DataFrame, targets: dict[str, DataFrame], total: float, scratch: Scratch, rounds: int = 200, tolerance: float = 1e-9, ceiling: float = 1.0) -> DataFrame:
    """``rake`` for any number of cells: (dimensions, tokens, p).  ``targets``: frames of (dimension, share)."""
    whole = cells.agg(F.sum("tokens")).first()[0]
    p = scratch.write(cells.withColumn("p", F.lit(min(total / whole, ceiling) if whole else ceiling)), "cells")
    for _ in range(rounds):
        q = p.withColumn("_before", F.col("p"))
        for d, share in targets.items():
            factor = q.groupBy(d).agg(F.sum(F.col("p") * F.col("tokens")).alias("have")).join(share, d, "left")
            factor = factor.select(d, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(1.0).alias("f"))
            q = q.join(factor, d).withColumn("p", F.least(F.col("p") * F.col("f"), F.lit(ceiling))).drop("f")
        q = scratch.write(q.select(*cells.columns, "p", "_before"), "cells")
        scratch.drop(p)
        p = q
        change = p.agg(F.max(F.abs(F.col("p") - F.col("_before")))).first()[0]
        if change is None or change < tolerance:
            break
    return p.select(*cells.columns, "p")


def mix(docs: DataFrame, dims: tuple[str, ...] = DIMS, tokens: str = "n_tokens", key: str = "doc_id", text: str = "text", targets: dict[str, dict] | None = None, budget: float = 0.7, power: float = 0.5, seed: int = 42, listed: int = 200_000) -> DataFrame:
    """``docs`` with ``probability`` (double) and ``sampled`` (boolean).

    ``targets`` gives the share of tokens for each value of each dimension; without them a dimension's
    own shares raised to ``power`` are the target.  ``budget`` is the share of all tokens to take.  Nulls in a
    dimension are a value of their own; null token counts are 0; documents without tokens
    keep their cell's probability.  Repeated rows are taken or left together.  An empty table gives an
    empty result.

    ``docs`` is read twice, for the sums and for the sample; texts are neither shuffled nor written in between.
    Tokens are summed before they are shuffled, so a source with a third of all rows is a row for each task.
    Up to ``listed`` cells are raked on the driver; with more the same steps run as joins.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    own = [c for c in docs.columns if c not in ("probability", "sampled")]
    none = "\0"
    base = docs.select(*own, *[F.coalesce(F.col(d).cast("string"), F.lit(none)).alias(f"_{d}") for d in dims], F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_u"))
    cells = base.groupBy(*[f"_{d}" for d in dims]).agg(F.sum(F.coalesce(F.col(tokens).cast("decimal(20,0)"), F.lit(0))).cast("double").alias("tokens"))
    cells = scratch.write(cells, "cells")
    marginals = {f"_{d}": cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("share")) for d in dims}
    n, whole = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = budget * (whole or 0.0)
    wanted = {f"_{d}": v for d, v in (targets or {}).items()}
    if n <= listed:
        rows = sorted((r.asDict() for r in cells.collect()), key=lambda r: [r[f"_{d}"] for d in dims])
        for d in (f"_{d}" for d in dims):
            if d not in wanted:
                sums: dict = {}
                for r in rows:
                    sums[r[d]] = sums.get(r[d], 0.0) + r["tokens"]
                wanted[d] = flattened(sums, power)
        p = rake(rows, wanted, total)
        schema = ", ".join(f"_{d} string" for d in dims) + ", probability double"
        probability = spark.createDataFrame([(*[r[f"_{d}"] for d in dims], x) for r, x in zip(rows, p, strict=True)], schema)
    else:
        shares = {}
        for d, m in marginals.items():
            if d in wanted:
                shares[d] = spark.createDataFrame(list(wanted[d].items()), f"{d} string, share double")
            else:
                raised = m.select(d, F.pow("share", F.lit(power)).alias("share"))
                shares[d] = raised.crossJoin(F.broadcast(raised.agg(F.sum("share").alias("all")))).select(d, (F.col("share") / F.col("all")).alias("share"))
        probability = rake_frame(cells, shares, total, scratch).select(*[f"_{d}" for d in dims], F.col("p").alias("probability"))
    u = (F.shiftrightunsigned("_u", 11)).cast("double") / float(1 << 53)
    return base.join(probability, [f"_{d}" for d in dims]).select(*own, "probability", (u < F.col("probability")).alias("sampled"))
