"""SimHash fingerprints and the search for all pairs within a Hamming radius.

Terms are the words of a text (A-Z in lower case) and the pairs of neighbouring words; a term that
occurs c times weighs 1 + ln c, and a pair weighs twice as much as a word.  Each term's hash bits vote,
one for set and minus one for unset bits, with its weight; a fingerprint's bit is set where the votes
are positive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

BITS = 128


def fingerprint(h: np.ndarray, bits: int = BITS) -> bytes:
    """The fingerprint of a sequence of word hashes; of no words all zeros."""
    from lattica.llm.words import mixed, shingles

    if not len(h):
        return bytes(bits // 8)
    terms = [np.unique(mixed(h), return_counts=True)]
    if len(h) > 1:
        terms.append(np.unique(shingles(h, 2), return_counts=True))
    votes = np.zeros(bits, np.float64)
    for scale, (term, count) in zip((1.0, 2.0), terms, strict=False):
        for part in range(0, len(term), 8192):
            t, c = term[part : part + 8192], count[part : part + 8192]
            seeds = np.arange(bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = mixed(t[:, None] ^ seeds[None, :])
            on = np.unpackbits(x.view(np.uint8), axis=1)
            once = c == 1
            sums = on[once].sum(axis=0, dtype=np.int64).astype(np.float64)
            total = float(once.sum())
            if not once.all():
                w = 1 + np.log(c[~once])
                sums += w @ on[~once]
                total += w.sum()
            votes += scale * (2 * sums - total)
    return np.packbits(votes > 1e-9).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, bits: int = BITS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``fingerprint`` (lower-case hex).  Null and empty texts: all zeros.  No shuffle."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("_text"))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.words import hashed_batch

        for b in batches:
            found = [fingerprint(h, bits).hex() for h in hashed_batch(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.string())], [*keep, "fingerprint"])

    return kept.mapInArrow(run, schema)


def tables_of(bits: int, radius: int, spare: int = 1) -> tuple[int, list[tuple[int, ...]]]:
    """(number of blocks, the block choices): any two fingerprints within ``radius`` agree on some choice of blocks."""
    blocks = radius + spare
    return blocks, list(combinations(range(blocks), blocks - radius))


def _filed(distinct: DataFrame, radius: int, bits: int, spare: int) -> DataFrame:
    """(tab, bucket, f): each fingerprint in every permuted table, under the blocks of the table's choice."""
    blocks, choices = tables_of(bits, radius, spare)
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f in b.column(0).to_pylist():
                x = int(f, 16)
                part = [(x >> edges[i]) & ((1 << (edges[i + 1] - edges[i])) - 1) for i in range(blocks)]
                out += [(t, ".".join(f"{part[i]:x}" for i in choice), f) for t, choice in enumerate(choices)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["tab", "bucket", "f"])

    return distinct.mapInArrow(run, "tab int, bucket string, f string")


def neighbours(prints: DataFrame, radius: int = 3, bits: int = BITS, spare: int = 1) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints (hex) within ``radius`` bits, with ``distance``.

    Equal fingerprints are one row here (join ``prints`` for the members), so groups of copies cause no
    pairs.  Each of the permuted tables files a fingerprint under the blocks of one choice; pairs that
    meet in a table are compared by all bits.  A table's bucket is joined by equality of its key, which Spark
    splits where it is skewed.  Nulls are left out; an empty table gives an empty result.  The result is
    quadratic in a family of near fingerprints; ``near_links`` connects such a family with few rows.
    """
    distinct = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    filed = _filed(distinct, radius, bits, spare)
    left, right = filed.withColumnRenamed("f", "a"), filed.withColumnRenamed("f", "b")
    words = [(i, 15) for i in range(0, bits // 4, 15)]
    distance = sum(
        (F.bit_count(F.conv(F.substring("a", i + 1, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", i + 1, n), 16, 10).cast("long"))) for i, n in words),
        F.lit(0),
    )
    met = left.join(right, ["tab", "bucket"]).where("a < b").select("a", "b", distance.cast("int").alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()


def near_forest(prints: list[str], sides: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever pairs within ``radius`` connect: of side 0 with side 1, or of one side with itself."""
    n = len(prints)
    x = np.frombuffer(b"".join(map(bytes.fromhex, prints)), np.uint64).reshape(n, -1)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, both, side = [], 1 in sides, np.array(sides)
    for i in range(n):
        apart = np.bitwise_count(x[i + 1 :] ^ x[i]).sum(axis=1, dtype=np.int64)
        for j in (np.flatnonzero((apart <= radius) & ((side[i + 1 :] != side[i]) | (not both))) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    return out


def near_links(prints: DataFrame, scratch: Scratch, radius: int = 3, bits: int = BITS, spare: int = 1, block: int = 256) -> DataFrame:
    """Links (a, b) of distinct fingerprints within ``radius`` bits that connect all that pairs within it connect.

    Buckets of the permuted tables are dealt into blocks of about ``block``; each pair of a bucket's blocks is
    compared in one piece and gives a spanning forest, so no family's pairs become rows and no bucket is held whole.
    """
    distinct = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    filed = scratch.write(_filed(distinct, radius, bits, spare), "filed")
    parts = filed.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    held = filed.join(parts, ["tab", "bucket"]).withColumn("p", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    # the pairs of blocks that a member takes part in: itself with every part, as side 1 of earlier ones
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
    unit = held.select("tab", "bucket", "f", "p", other).select("tab", "bucket", "f", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2"), (F.col("p") > F.col("q")).cast("int").alias("side"))
    where = ["tab", "bucket", "p1", "p2"]
    dealt = unit.repartition(*where).sortWithinPartitions(*where, "side", "f").select(F.concat_ws("/", *where).alias("unit"), "side", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(members: list[tuple[int, str]]) -> list[tuple[str, str]]:
            return [(members[i][1], members[j][1]) for i, j in near_forest([f for _, f in members], [s for s, _ in members], radius)] if len(members) > 1 else []

        at, members = None, []
        for b in batches:
            out = []
            for u, side, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if u != at:
                    out += links(members)
                    at, members = u, []
                members.append((side, f))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["a", "b"])
        out = links(members)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["a", "b"])

    out = scratch.write(dealt.mapInArrow(run, "a string, b string").distinct(), "near")
    scratch.drop(filed)
    return out


def near_classes(prints: DataFrame, radius: int = 3, bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """``prints`` with ``class_id``: the smallest key among documents reachable by fingerprints within ``radius`` bits.

    Null fingerprints have their own key as class; an empty table gives an empty result.
    """
    from lattica.llm.jaccard import connected

    scratch = Scratch(prints.sparkSession, "simhash-near")
    links = near_links(prints, scratch, radius, bits)
    comp = connected(links, scratch).select(F.col("node").alias("fingerprint"), "comp")
    keyed = prints.join(comp, "fingerprint", "left").withColumn("comp", F.coalesce("comp", "fingerprint"))
    least = keyed.where("comp is not null").groupBy("comp").agg(F.min(key).alias("class_id"))
    out = keyed.join(least, "comp", "left").withColumn("class_id", F.coalesce("class_id", key))
    return out.select(*prints.columns, "class_id")


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 3) characters replaced by as many from the start of ``following`` (or all of it)."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def edited_fingerprints(docs: DataFrame, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's and its edited text's fingerprint, and how alike they and the next document's are.

    The next document is the one of next smaller key (after the last: the first).  Null keys come after
    all others; rows of one key follow by descending text.  Null texts count as empty, repeated rows
    as documents of their own; a single document follows itself; an empty table gives an empty result.

    One range shuffle sorts the documents; a task reads its share in order and only needs the next one's
    text.  What the last row of a task needs stands at the beginning of a following one: those
    boundary rows, one each for a task, are joined afterwards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "simhash")
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    order = [F.col("k").desc_nulls_last(), F.col("t").desc()]
    ranges = [F.col("k").desc_nulls_last(), F.substring("t", 1, 64).desc()]  # bounds are sampled to the driver: no whole texts
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = rows.schema["k"].dataType.simpleString()
    ranged = rows.repartitionByRange(parts, *ranges).sortWithinPartitions(*order)
    own = f"k {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in own.split(", ")]

    def judged(k, t, f, following, g):
        from lattica.llm.words import hashed_batch

        e = edited_text(t, following)
        h = hashed_batch(pa.array([e], pa.large_string()))[0]
        x = fingerprint(h, bits)
        return k, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f.hex(), x.hex(), likeness(f, x), likeness(f, g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.words import hashed_batch

        part, last = TaskContext.get().partitionId(), None
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch(rows, key_type, edge):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(c, t or key_type) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32()), pa.array([edge[0]] * len(rows), pa.string()), pa.array([edge[1]] * len(rows), pa.string())], [*names, "part", "edge", "text"])

        for b in batches:
            if not b.num_rows:
                continue
            key_type, ks, ts = b.column(0).type, b.column(0).to_pylist(), b.column(1).to_pylist()
            prints = [fingerprint(h, bits) for h in hashed_batch(b.column(1))]
            if last is None:
                yield batch([(ks[0], 0, None, prints[0].hex(), None, None, None)], key_type, ("first", ts[0]))
            line = ([last] if last else []) + list(zip(ks, ts, prints, strict=True))
            edits = [edited_text(x[1], y[1]) for x, y in zip(line, line[1:], strict=False)]
            marks = [fingerprint(h, bits) for h in hashed_batch(pa.array(edits, pa.large_string()))]
            out = [(x[0], len(x[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), x[2].hex(), m.hex(), likeness(x[2], m), likeness(x[2], y[2])) for x, y, e, m in zip(line, line[1:], edits, marks, strict=False)]
            yield batch(out, key_type, ("", None))
            last = line[-1]
        if last is not None:
            yield batch([(last[0], 0, None, last[2].hex(), None, None, None)], key_type, ("last", last[1]))

    done = scratch.write(ranged.mapInArrow(run, own + ", part int, edge string, text string"), "prints")
    first = done.where("edge = 'first'").select("part", F.col("fingerprint").alias("g"), F.col("text").alias("following"))
    ends = done.where("edge = 'last'").select("k", "part", "fingerprint", "text")
    # numbers of tasks alone reach the driver
    used = sorted(r[0] for r in first.select("part").collect())
    after = dict(zip(used, used[1:] + used[:1], strict=True))
    link = spark.createDataFrame([(a, b) for a, b in after.items()] or [(-1, -1)], "part int, next int")
    first = first.withColumnRenamed("part", "next")
    pending = ends.join(link, "part").join(first, "next").select("k", "fingerprint", "text", "g", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(r["k"], r["text"], bytes.fromhex(r["fingerprint"]), r["following"], bytes.fromhex(r["g"])) for r in b.to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    whole = done.where("edge = ''").select(*names).unionByName(pending.mapInArrow(close, own))
    return whole.withColumnRenamed("k", key)
