"""Repeated passages removed line by line, found by winnowing (built-in functions only).

Lines are compared without their outer white space; blank lines take no part and always stay.  A run
of consecutive lines with ``min_words`` words or more that stands earlier in the corpus (by doc_id,
then position) is deleted where it stands again; its first place stays.  Repeats that start or end within a
line count by their whole lines alone; the README has figures on what that leaves.

1. Each line becomes a hash.  A window opens at every line and takes lines until it holds
   ``min_words`` words; another closes at every line, backwards.  The line with the least hash of each window is
   selected (ties: the first).  Windows that select one line are one fingerprint, with its position and the
   windows around it, so a text has far fewer fingerprints than lines, and two equal passages always share one.
2. Fingerprints are joined by hash with the positions of their first and last occurrence
   (pre-aggregated); those that stand at one place only are done with.
3. From a shared fingerprint the match is extended both ways, to the windows that selected it: each is
   compared by its whole content with the place where that content stands first.  Overlapping windows
   together reach exactly as far as the longest equal run.
4. Lines of windows that are not the first of their content are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch

MIN_WORDS = 50
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` freed of later repeats, and ``n_lines``, ``n_removed`` (long), ``removed_lines`` (array of line numbers from 0).

    Null texts stay null with no lines; a document that loses every line keeps an empty text.  Rows that
    repeat a whole row (same key, same text) are one document stored twice and get the same result;
    rows with one key and different texts are different documents, ordered by a hash of the text.  Null
    keys come last.  Empty tables give empty results; further columns are passed through, but for
    those named like a result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = ("n_lines", "n_removed", "removed_lines")
    t = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines")).where(F.col("lines").isNotNull())
    line = F.transform("lines", lambda x: F.regexp_replace(x, rf"^{_SPACE}|{_SPACE}$", ""))
    facts = F.transform(line, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("h2"), F.regexp_count(x, F.lit(_WORD)).cast("long").alias("w")))
    rows = t.select("k", "th", facts.alias("facts")).dropDuplicates(["k", "th"])
    rows = rows.select("k", "th", F.posexplode("facts").alias("pos", "f")).where("f.w > 0").select("k", "th", "pos", "f.h", "f.h2", "f.w")

    doc = Window.partitionBy("k", "th")
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("w").over(upto)).withColumn("before", F.col("upto") - F.col("w"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy(F.col("upto").desc()).rangeBetween(0, min_words - 1)

    def content(w):
        return F.struct(F.xxhash64(F.collect_list("h").over(w)).alias("x"), F.xxhash64(F.lit(7), F.collect_list("h2").over(w)).alias("y"))

    def window(name, w, start):
        return F.struct(
            F.min(F.struct("h", "pos")).over(w).alias("mark"),
            content(w).alias("content"),
            F.min("pos").over(w).alias("first"),
            F.max("pos").over(w).alias("last"),
            (F.sum("w").over(w) >= min_words).alias("full"),
            F.lit(start).alias("ahead"),
        ).alias(name)

    both = rows.select("k", "th", window("a", ahead, True), window("b", back, False))
    windows = both.select("k", "th", F.explode(F.array("a", "b")).alias("v")).where("v.full")
    around = F.collect_list(F.struct("v.content", "v.first", "v.last", "v.ahead")).alias("windows")
    prints = windows.groupBy("k", "th", F.col("v.mark.pos").alias("at"), F.col("v.mark.h").alias("mark")).agg(around)
    prints = scratch.write(prints, "fingerprints")

    spot = F.struct("k", "th", "at")
    shared = prints.groupBy("mark").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one != other").select("mark")
    near = prints.join(shared, "mark", "left_semi").select("k", "th", F.inline("windows"))
    place = F.struct(F.col("k").isNull().alias("late"), "k", "th", "first")
    first = near.groupBy("content", "ahead").agg(F.min(place).alias("origin"), F.max(place).alias("end")).where("origin < end").drop("end")
    later = near.join(first, ["content", "ahead"]).where(place > F.col("origin"))
    gone = later.select("k", "th", F.sequence("first", "last").alias("s")).groupBy("k", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("gone"))
    gone = scratch.write(gone, "gone").select(F.col("k").alias("_k"), F.col("th").alias("_th"), "gone")

    base = docs.drop(*own).withColumn("_h", F.xxhash64(text))
    # the list of deletions grows with the corpus: the same join at every size, never a broadcast
    out = base.join(gone.hint("merge"), base[key].eqNullSafe(gone["_k"]) & (base["_h"] == gone["_th"]), "left")
    lines = F.split(text, "\n", -1)
    blank = F.transform(lines, lambda x: ~x.rlike(_WORD))
    drop = F.coalesce("gone", F.array().cast("array<int>"))
    removed = F.filter(drop, lambda i: ~F.get(blank, i))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed_lines"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"))
    out = out.withColumn("removed_lines", F.when(F.col("gone").isNull(), drop).otherwise(removed))
    out = out.withColumn("n_removed", F.size("removed_lines").cast("long"))
    out = out.withColumn(text, F.when(F.col("n_removed") == 0, F.col(text)).otherwise(kept))
    return out.select(*[c for c in docs.columns if c not in own], *own)
