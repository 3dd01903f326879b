"""Documents packed into sequences of bounded length: best fit, then swap-based local search.

Pieces are dealt by a hash of their key into blocks of bounded size.  Each block is packed by best-fit
decreasing and then improved: items are moved, exchanged one for one or two for one between underfull
bins as long as the sum of squared fills grows, until bins empty.  Bins that stay underfull are opened
again and dealt to fewer blocks; full bins never move.  Once that leaves most of them underfull, the
emptiest bins of all blocks, as many as a block holds, are packed together at last.  Only keys and lengths are
shuffled, never token ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

CAPACITY = 4096
BLOCK_ITEMS = 20_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items are placed longest first into the fullest bin that takes them."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the space they have left
    spaces: list[int] = []  # the spaces that some bin has, sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            b = room[space].pop()
            if not room[space]:
                spaces.pop(at)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = space - n
        if not room[left]:
            insort(spaces, left)
        room[left].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between the underfull bins until a whole pass changes nothing.

    The fuller half of the underfull bins takes from the emptier half: a move, an exchange of one item for
    one, or of two for one (or for none), whichever fills most.  Each change makes the fuller of two bins
    fuller still and so raises the sum of squared fills, which ends the search.  What the emptier half
    has is listed anew for each pass.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    while True:
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        half = (len(under) + 1) // 2
        stock, changed = _Stock(bins, lengths, list(reversed(under[half:])), capacity), False
        for a in under[:half]:
            while fill[a] < capacity and (found := stock.best(bins[a], capacity - fill[a])) is not None:
                gain, out, take, d = found
                for i in take:
                    bins[d].remove(i)
                    bins[a].append(i)
                if out is not None:
                    bins[a].remove(out)
                    bins[d].append(out)
                stock.move(take, out, d)
                fill[a], fill[d], changed = fill[a] + gain, fill[d] - gain, True
        if not changed:
            return [b for b in bins if b]


class _Stock:
    """What the donor bins hold: items by length, and pairs of one bin by their sum, the emptiest bin's first.

    Pairs of equal lengths in one bin count once, so a bin gives few of them however many items it has.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], donors: list[int], capacity: int):
        self.lengths, self.owner = lengths, {}
        self.one: dict[int, list] = {}
        self.two: dict[int, list] = {}
        for d in reversed(donors):  # the last listed, the emptiest bin's, is taken first
            by_length: dict[int, list[int]] = {}
            for i in bins[d]:
                self.owner[i] = d
                self.one.setdefault(lengths[i], []).append(((i,), d))
                by_length.setdefault(lengths[i], []).append(i)
            sizes = sorted(by_length)
            for x, m in enumerate(sizes):
                for n in sizes[x:]:
                    if m + n <= capacity and (m != n or len(by_length[m]) > 1):
                        self.two.setdefault(m + n, []).append(((by_length[m][0], by_length[n][-1]), d))
        self.sizes = {id(x): sorted(x) for x in (self.one, self.two)}

    def largest(self, table: dict[int, list], least: int, most: int):
        """(sum, items, bin) with the greatest sum above ``least`` and up to ``most``."""
        sizes = self.sizes[id(table)]
        at = bisect_right(sizes, most) - 1
        while at >= 0 and sizes[at] > least:
            entries = table[sizes[at]]
            while entries:
                items, d = entries[-1]
                if all(self.owner.get(i) == d for i in items):
                    return sizes[at], items, d
                entries.pop()  # an item of it has gone
            del sizes[at]
            at -= 1
        return None

    def best(self, own: list[int], space: int):
        """The (gain, item given or None, items taken, donor) that fills most, or None."""
        best = None
        given = {self.lengths[i]: i for i in own}
        for table in (self.one, self.two):
            for n, i in [(0, None), *sorted(given.items())]:
                found = self.largest(table, n + (best[0] if best else 0), n + space)
                if found is not None:
                    best = (found[0] - n, i, found[1], found[2])
                    if best[0] == space:
                        return best
        return best

    def move(self, take: tuple[int, ...], out: int | None, donor: int) -> None:
        for i in take:
            del self.owner[i]
        if out is not None:
            self.owner[out] = donor
            n = self.lengths[out]
            if not self.one.get(n):
                self.one[n] = []
                insort(self.sizes[id(self.one)], n) if n not in self.sizes[id(self.one)] else None
            self.one[n].append(((out,), donor))


def _packer(names: list[str], capacity: int, level: int):
    """Packs one block; a sequence is named by its first item and its level."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("_item", "ascending")])
        lengths, keys = t.column("length").to_pylist(), t.column("_item").to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        seq, off, full = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for b in bins:
            b.sort()
            name, at, whole = keys[b[0]] * 64 + level, 0, sum(lengths[i] for i in b) == capacity
            for i in b:
                seq[i], off[i], full[i] = name, at, whole
                at += lengths[i]
        return t.select(names).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64())).append_column("_full", pa.array(full, pa.bool_()))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``pieces`` (with ``length`` between 0 and ``capacity``) with ``sequence_id`` and ``offset`` (long).

    Sequences hold ``capacity`` at most; their pieces stand without gaps from offset 0.  Each row is one
    piece, so repeated rows are packed each; further columns pass through, but for the two results and
    ``_item``, ``_block``, ``_bin``, ``_full``.  Null lengths count as 0.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pack")
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_item", "_block", "_bin", "_full")]
    base = pieces.select(*own, F.monotonically_increasing_id().alias("_item"))
    base = scratch.write(base.withColumn("length", F.coalesce("length", F.lit(0)).cast("long")), "items")
    done = base.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("_item") * 64, "offset": F.lit(0).cast("long")}).drop("_item")
    left, level, parts = base.where(F.col("length") < capacity), 1, [done]
    names = [*own, "_item"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields] + ["sequence_id long", "offset long", "_full boolean"])
    rows = left.count()

    def packed_in(rows_of: DataFrame, blocks: int, level: int) -> DataFrame:
        dealt = rows_of.select(*names, F.pmod(F.xxhash64("_item"), F.lit(blocks)).alias("_block"))
        return scratch.write(dealt.groupBy("_block").applyInArrow(_packer(names, capacity, level), schema), f"level{level}")

    while True:
        blocks = max(1, -(-rows // block_items))
        packed = packed_in(left, blocks, level)
        if blocks == 1:
            parts.append(packed.drop("_item", "_full"))
            break
        parts.append(packed.where("_full").drop("_item", "_full"))
        left = packed.where(~F.col("_full")).drop("_full", "sequence_id", "offset")
        fewer, level = left.count(), level + 1
        if fewer > 0.7 * rows:
            # blocks can't fill their bins alone: the emptiest of all blocks meet in one (a row for each fill is collected)
            under = packed.where(~F.col("_full"))
            fills = under.groupBy("sequence_id").agg(F.sum("length").alias("_bin"), F.count(F.lit(1)).alias("n"))
            most, held = -1, 0
            for fill, n in sorted(tuple(r) for r in fills.groupBy("_bin").agg(F.sum("n")).collect()):
                held += n
                if held > block_items:
                    break
                most = fill
            last = scratch.write(under.join(fills.where(F.col("_bin") <= most).select("sequence_id"), "sequence_id", "left_semi"), "emptiest")
            parts.append(under.join(fills.where(F.col("_bin") > most).select("sequence_id"), "sequence_id", "left_semi").select(packed.columns).drop("_item", "_full"))
            parts.append(packed_in(last, 1, level).drop("_item", "_full"))
            break
        rows = fewer
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each text's ids (null: empty) followed by ``end_id``, cut into pieces of ``capacity`` ids where longer.

    Columns: key, ``piece`` (int), ``start``, ``length`` (long), ``ids_crc32`` (of little-endian unsigned
    32-bit ids) and, if asked for, ``ids`` (array<int>).  Repeated rows are cut each.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(docs[key].alias(key), F.coalesce(docs[text], F.lit("")).alias("_text"))
    schema = f"`{key}` {kept.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from lattica.llm.tokens import word_encoder

        encoder = word_encoder(tokenizer)
        end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, found in enumerate(encoder.encode_many(b.column(1).to_pylist())):
                data = found.astype("<u4").tobytes() + end
                for p in range(0, len(data), size):
                    x = data[p : p + size]
                    row.append(r), piece.append(p // size), start.append(p // 4), length.append(len(x) // 4), crc.append(zlib.crc32(x))
                    if with_ids:
                        ids.append(np.frombuffer(x, "<u4").astype(np.int32))
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return kept.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """All documents in as few sequences as the search finds: the pieces' columns with ``sequence_id`` and ``offset``."""
    return pack(tokenized_pieces(docs, tokenizer, end_id, capacity, text, key, with_ids), capacity)
