"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and its connected groups.

Documents are sets of k-word shingles; two link when ``den * |A & B| >= num * |A | B|``.

1. Equal sets become one class (grouped by a 128-bit hash of the set), so copies never meet in pairs.
2. Classes that can have no partner leave first: among the shingles with the least hashes (a ``fraction``
   of all) they have so many that no other class holds that these alone fill their prefix.
3. For the rest all shingles are counted and ordered, rare ones first.  Linked sets share a shingle within
   the first ``n - ceil(t n) + 1`` of either, and m shingles within prefixes that are m - 1 longer.
   Each class picks the m that costs least by the counts of its prefix: longer prefixes read more
   postings, but a pair must share more of them (the smaller m of the two) before its sets are compared.
4. Posting lists of up to ``SHORT`` classes are joined with themselves.  Longer lists stand for groups of
   near copies: their classes are dealt into blocks, and each pair of blocks of near sizes that hold
   members of one long list is one task's work, in which pairs are counted, compared, and skipped once
   links already connect them.  A task returns links of a spanning forest: no pair of a group is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

MOST = 4
SHORT = 24
BLOCK = 256


def need(n: int, num: int, den: int) -> int:
    """The least intersection of a set of n with any set it links to: ceil(n * num / den)."""
    return -(-n * num // den)


def set_of(h: np.ndarray, k: int) -> np.ndarray:
    from lattica.llm.words import shingles

    return np.unique(shingles(h, k))


def _sets(docs: DataFrame, k: int, fraction: float, text: str, key: str) -> DataFrame:
    """row, key, th (hash of the text), n, sig, tokens (its shingles with hashes in the least ``fraction``)."""
    rows = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    border = np.uint64(min(fraction, 0.999999) * 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.words import hashed_batch

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            n, sig, tokens = [], [], []
            for h in hashed_batch(b.column(2)):
                u = set_of(h, k)
                n.append(len(u)), tokens.append(u[: int(np.searchsorted(u, border))].view(np.int64))
                sig.append(xxhash.xxh3_128_digest(u.tobytes()) + len(u).to_bytes(4, "little"))
            ends = np.cumsum([0, *map(len, tokens)])
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            rows = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["row", "k", "th", "n", "sig", "tokens"])

    return rows.mapInArrow(run, f"row long, k {kind}, th long, n int, sig binary, tokens array<long>")


def choose_prefix(n: int, counts: list[int], ranks: list[int], num: int, den: int, most: int) -> tuple[int, int]:
    """(m, prefix length) of least estimated cost.  ``ranks`` and ``counts``: place and count of the shared shingles, in order."""
    base, best = n - need(n, num, den), None
    for m in range(1, min(most, n - base) + 1):
        read = sum(c - 1 for c, r in zip(counts, ranks, strict=True) if r < base + m)
        cost = read + (read / m**2) * (4 + n / 64)  # postings read, then pairs compared
        if best is None or cost < best[0]:
            best = (cost, m, base + m)
    return best[1], best[2]


def _postings(full: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """token, cls, n, m: the prefixes' shingles that more than one class holds.  ``full``: cls, n, tokens."""
    each = full.select("cls", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").count().where("count > 1")
    held = each.join(shared.hint("merge"), "token").groupBy("cls", "n").agg(F.collect_list(F.struct(F.col("count").alias("df"), "token")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cls, n, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                df, token = (np.asarray(held.values.field(i)) for i in range(2))
                order = np.lexsort((token.view(np.uint64), np.log2(df).astype(np.int64)))
                single = n - len(order)
                last = n - need(n, num, den) + most - single  # nothing beyond the longest prefix matters
                order = order[: max(0, last)]
                m, length = choose_prefix(n, [int(x) for x in df[order]], list(range(single, single + len(order))), num, den, most)
                out += [(t, cls, n, m) for t in token[order[: max(0, length - single)]].tolist()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["token", "cls", "n", "m"])

    return held.mapInArrow(run, "token long, cls long, n int, m int")


def forest(sets: list[np.ndarray], prefixes: list[list[int]], m: list[int], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links between members that connect whatever links connect: of side 0 with side 1, or of one side with itself.

    Candidates share enough prefix shingles and are near in size; they are compared unless they are connected.
    """
    n = len(sets)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    met: dict[int, list[int]] = {}
    for i, p in enumerate(prefixes):
        for t in p:
            met.setdefault(t, []).append(i)
    shared = np.zeros((n, n), np.uint16)
    for members in met.values():
        if len(members) > 1:
            at = np.array(members)
            shared[np.ix_(at, at)] += 1
    size, least = np.array([len(x) for x in sets]), np.array(m)
    fits = (shared >= np.minimum(least[:, None], least[None, :])) & (den * np.minimum(size[:, None], size[None, :]) >= num * np.maximum(size[:, None], size[None, :]))
    if 1 in sides:
        side = np.array(sides)
        fits &= side[:, None] != side[None, :]
    out = []
    a, b = np.nonzero(np.triu(fits, 1))
    order = np.argsort(-shared[a, b].astype(np.int64), kind="stable")  # likely links first: they spare the most comparisons
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y and linked(sets[i], sets[j], num, den):
            root[y] = x
            out.append((i, j))
    return out


def linked(u: np.ndarray, v: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(u) + len(v) - same)


def _grouped(postings: DataFrame, full: DataFrame, groups: DataFrame, long_lists: DataFrame, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes that share a long posting list, and (cls, lead): each class's least long token.

    Classes with one lead stand in one block, or in several by their hash where they are more than ``BLOCK``;
    rare leads share blocks.  Only blocks that hold members of one long list are compared.
    """
    held = postings.join(long_lists.select("token"), "token", "left_semi")
    leads = scratch.write(held.groupBy("cls").agg(F.min("token").alias("lead")), "leads")
    members = postings.groupBy("cls").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.collect_list("token").alias("prefix")).join(groups, "cls").join(leads, "cls")
    step = float(np.log(den / num)) or 1.0
    members = members.withColumn("level", F.floor(F.log("n") / step).cast("int"))
    by_lead = members.groupBy("grp", "level", "lead").agg(F.count(F.lit(1)).alias("of_lead"))
    rare = by_lead.where(F.col("of_lead") <= BLOCK).groupBy("grp", "level").agg(F.ceil(F.sum("of_lead") / BLOCK).alias("parts"))
    dealt = by_lead.join(rare, ["grp", "level"], "left")
    own = F.col("of_lead") > BLOCK
    members = members.join(dealt, ["grp", "level", "lead"]).withColumn(
        "block",
        F.when(own, F.xxhash64("grp", "level", "lead", F.pmod(F.xxhash64("cls"), F.ceil(F.col("of_lead") / BLOCK)))).otherwise(F.xxhash64("grp", "level", F.lit("rare"), F.pmod(F.xxhash64("lead"), F.col("parts")))),
    )
    members = scratch.write(members.select("cls", "m", "prefix", "level", "block"), "members")
    at = held.select("token", "cls").join(members.select("cls", "level", "block"), "cls").select("token", "level", "block").distinct()
    at = scratch.write(at, "places")
    x = at.select("token", F.col("level").alias("l1"), F.col("block").alias("b1"))
    y = at.select("token", F.col("level").alias("l2"), F.col("block").alias("b2"))
    near = (F.col("l2") == F.col("l1") + 1) | ((F.col("l2") == F.col("l1")) & (F.col("b2") >= F.col("b1")))
    work = x.join(y, "token").where(near).select("b1", "b2").distinct()
    work = work.select(F.xxhash64("b1", "b2").alias("unit"), (F.col("b1") == F.col("b2")).alias("same"), F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side"))).alias("ends"))
    ends = work.select("unit", "same", F.inline("ends")).where("not same or side = 0").drop("same")
    dealt = ends.join(members.select("block", "cls", "m", "prefix"), "block").select("unit", "side", "cls", "m", "prefix").join(full.select("cls", "members"), "cls")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("cls", "ascending")])
        cls = t.column("cls").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
        found = forest(sets, t.column("prefix").to_pylist(), t.column("m").to_pylist(), t.column("side").to_pylist(), num, den)
        return pa.table([pa.array([cls[i] for i, _ in found], pa.int64()), pa.array([cls[j] for _, j in found], pa.int64())], names=["a", "b"])

    links = scratch.write(dealt.groupBy("unit").applyInArrow(run, "a long, b long"), "links")
    scratch.drop(members, at)
    return links, leads


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with ``ok``: whether the whole sets link."""
    x = full.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    y = full.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                ok.append(linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return both.mapInArrow(run, "a long, b long, ok boolean")


def connected(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node of each node's connected component, for the nodes of ``edges``.

    Alternating large-star and small-star steps on a written edge table; the work of a step is in
    proportion to the edges, and a node with very many neighbours is only ever a group-by key.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, was = scratch.write(e, "edges"), None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.where("u <> v").distinct(), "edges")
        scratch.drop(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, most: int = MOST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``row`` (its number here), ``n_shingles`` (long) and ``component_id``.

    ``component_id`` is the smallest key (nulls last) among the documents reachable by links, itself
    included.  Texts without words, and null texts, have empty sets and link with nothing, so their
    component is their own key.  Texts shorter than ``k`` words are one shingle: the whole sequence.
    Repeated rows are documents with equal sets.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    # a prefix takes a share (1 - t) of a set; rather more is looked at for shingles that nobody else has
    fraction = min(1.0, 1.6 * (den - num) / den)
    sets = scratch.write(_sets(docs, k, fraction, text, key), "sets")
    rows = scratch.write(sets.drop("tokens"), "rows")
    one = F.struct(F.col("k").isNull().alias("no"), "k", "th", "row")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min(one).alias("one"), F.first("n").alias("n"))
    classes = scratch.write(classes.select("sig", "n", F.col("one.row").alias("cls"), F.col("one.k").alias("k"), F.col("one.th").alias("th")), "classes")
    reps = sets.join(classes.select(F.col("cls").alias("row")).hint("merge"), "row", "left_semi")
    alone = reps.select(F.col("row").alias("cls"), F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("cls"))
    alone = alone.where("df = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    least = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    wanted = classes.join(alone.hint("merge"), "cls", "left").where(F.coalesce("own", F.lit(0)) < least).select("cls", F.col("k").alias("_k"), F.col("th").alias("_th"))
    wanted = scratch.write(wanted, "wanted")
    scratch.drop(sets)

    # whole sets of the classes that may have partners; one member's text is read again for each
    source = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("t"))
    found = source.join(wanted.hint("merge"), source["k"].eqNullSafe(wanted["_k"]) & (source["th"] == wanted["_th"])).select("cls", "t")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.words import hashed_batch

        for b in batches:
            u = [set_of(h, k) for h in hashed_batch(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in u], pa.int32()), pa.array([x.tobytes() for x in u], pa.binary())], ["cls", "n", "members"])

    full = scratch.write(found.mapInArrow(whole, "cls long, n int, members binary").dropDuplicates(["cls"]), "full")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            flat = pa.array(np.concatenate(u) if u else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, u)]), pa.int32()), flat)], ["cls", "n", "tokens"])

    postings = scratch.write(_postings(full.mapInArrow(opened, "cls long, n int, tokens array<long>"), num, den, most), "postings")
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("least")).where("size > 1")
    lists = scratch.write(lists, "lists")

    links = None
    leads = None
    long_lists = lists.where(F.col("size") > SHORT)
    if not long_lists.isEmpty():
        ties = postings.join(long_lists, "token").select(F.col("cls").alias("a"), F.col("least").alias("b"))
        groups = scratch.write(connected(ties, scratch).select(F.col("node").alias("cls"), F.col("comp").alias("grp")), "groups")
        links, leads = _grouped(postings, full, groups, long_lists, num, den, scratch)
        scratch.drop(groups)
    # pairs with a long list in common have met in the blocks; those with one lead are left out here, the rest may meet twice
    p = postings.join(lists.where(F.col("size") <= SHORT).select("token"), "token", "left_semi")
    p = p.join(leads, "cls", "left") if leads is not None else p.withColumn("lead", F.lit(None).cast("long"))
    x = p.select("token", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "m", "lead")])
    y = p.select("token", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "m", "lead")])
    near = F.lit(den) * F.least("n_a", "n_b") >= F.lit(num) * F.greatest("n_a", "n_b")
    met = x.join(y, "token").where((F.col("cls_a") < F.col("cls_b")) & near & ~F.coalesce(F.col("lead_a") == F.col("lead_b"), F.lit(False)))
    pairs = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), F.least("m_a", "m_b").alias("m")).count().where("count >= m")
    ok = _verified(pairs, full, num, den).where("ok").select("a", "b")
    ok = scratch.write(ok, "verified")
    scratch.drop(full, postings, lists, wanted)
    comp = connected(ok if links is None else ok.union(links), scratch)

    labelled = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = labelled.groupBy("comp").agg(F.min("k").alias("component_id"))
    of_class = scratch.write(labelled.join(least, "comp").select("sig", "component_id"), "components")
    scratch.drop(classes, ok)
    out = rows.select("k", "row", "n", "sig").join(of_class, "sig", "left")
    return out.select(F.col("k").alias(key), "row", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))
