"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each text becomes four statistics that vary in every text: mean word length, share of marks (ASCII characters
that are neither letters nor white space), variety of words (the logarithm of distinct words over that of
all words; repeated lines and passages lower it), and share of short words.  Per (language, source) the
minimum covariance determinant estimate is searched by concentration steps from three deterministic
starts: the ``support`` share of rows with the least Mahalanobis distances gives the next mean and covariance,
and the start with the least determinant goes on until nothing changes.  Then rows within the 97.5 % quantile
are weighted in once more, and documents beyond the chi-square quantile of ``tail`` are rejected.

Small groups borrow: a group's estimate is weighted by its rows against ``PRIOR`` rows of its language's
estimate, and a language's likewise against that of all.  So every row has a distance, and no estimate is singular.

Statistics are whole numbers and sums are exact, so results don't depend on partitioning.  A step groups rows
by (language, source, distance in steps of a hundredth of its logarithm) before anything is shuffled, and
estimates are joined to rows by a salted key, whatever share of rows one group has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

#: Units in which statistics are whole numbers.
SCALE = 2_000
#: Rows of the wider estimate that a group's own rows are weighed against.
PRIOR = 50
SALTS = 16
SYMBOLS = "#*$%&|<>"
DIM = 4
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_short long, n_marks long"
#: Bytes that are no marks: letters, white space, and all of other scripts.
_NO_MARKS = bytes([*range(65, 91), *range(97, 123), 9, 10, 11, 12, 13, 32, *range(128, 256)])


def text_stats(text: str | None) -> tuple[int, ...]:
    """The columns of ``STATS`` for one text.  Short words have three bytes of UTF-8 at most."""
    from lattica.llm.words import shingles

    if not text:
        return (0,) * 8
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated, distinct = 0, len(set(words))
    if n >= 8 and distinct < n:
        ids: dict[bytes, int] = {}
        for w in words:
            ids.setdefault(w, len(ids) + 1)
        g = shingles(np.fromiter(map(ids.__getitem__, words), np.uint64, n), 8)
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        if same.any():
            twice = np.zeros(len(g), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + 8, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, chars, symbols, dup, repeated, distinct, sum(len(w) <= 3 for w in words), len(data.translate(None, _NO_MARKS))


def chi2_quantile(tail: float, k: int) -> float:
    """The value that a chi-square variable with ``k`` degrees of freedom exceeds with probability ``tail``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, k) > tail else (lo, mid)
    return hi


def chi2_tail(x: float, k: int) -> float:
    """For even ``k``: exp(-x/2) * sum((x/2)^i / i!)."""
    assert k % 2 == 0
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _vector() -> list:
    """The transformed statistics, in units of 1 / SCALE.  Additive constants (about 60 usual words) calm short texts."""
    c = F.col
    v = [
        F.log((c("word_chars") + 300) / (c("n_words") + 60)),
        F.log((c("n_marks") + 30) / (c("word_chars") + 1200)),
        F.log(c("n_distinct") + 1) / F.log(c("n_words") + 2),
        F.sqrt((c("n_short") + 24) / (c("n_words") + 60)),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"v{i}") for i, x in enumerate(v)]


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_VECTOR = [f"v{i}" for i in range(DIM)]
_SUMS = ["n", *[f"s{i}" for i in range(DIM)], *[f"q{i}{j}" for i, j in _PAIRS]]
_PARAMS = [f"m{i}" for i in range(DIM)] + [f"p{i}{j}" for i, j in _PAIRS]
_GROUP = ("_lang", "_source")


def _distance():
    total = F.lit(0.0)
    for i, j in _PAIRS:
        x = (F.col(f"v{i}") - F.col(f"m{i}")) * (F.col(f"v{j}") - F.col(f"m{j}")) * F.col(f"p{i}{j}")
        total = total + (x if i == j else 2 * x)
    return total


def consistency(share: float) -> float:
    """The factor that makes the covariance of the nearest ``share`` of rows that of a normal sample."""
    return share / (1 - chi2_tail(chi2_quantile(1 - share, DIM), DIM + 2))


def moments(sums: list[int], factor: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance times ``factor``) from count, sums and products (whole numbers: exact up to the division)."""
    if not sums[0]:
        return 0, np.zeros(DIM), np.zeros((DIM, DIM))
    n, s, q = int(sums[0]), [int(x) for x in sums[1 : 1 + DIM]], [int(x) for x in sums[1 + DIM :]]
    cov = np.zeros((DIM, DIM))
    for (i, j), x in zip(_PAIRS, q, strict=True):
        cov[i, j] = cov[j, i] = (n * x - s[i] * s[j]) / (n * n)
    return n, np.array([x / n for x in s]), cov * factor


def borrowed(levels: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last level, each level weighted by its rows against ``PRIOR`` of the one before."""
    _, mean, cov = levels[0]
    cov = cov + np.eye(DIM) / 12  # what rounding to whole numbers adds
    for n, m, c in levels[1:]:
        mean, cov = (n * m + PRIOR * mean) / (n + PRIOR), (n * c + PRIOR * cov) / (n + PRIOR)
    return mean, cov


def correlated(sums: list[int], spread: np.ndarray) -> np.ndarray:
    """A covariance from the correlations of bounded (tanh) statistics and robust spreads."""
    cov = moments(sums, 1.0)[2] + np.eye(DIM)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd) * np.outer(spread, spread)


def _params(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """Means and the upper triangle of the inverse covariance, then the logarithm of the determinant."""
    p = np.linalg.inv(cov)
    return [*map(float, mean), *[float(p[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])]


def text_statistics(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and ``STATS`` of each text; null texts have no words, repeated rows count each."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + [STATS])
    names = [*keep, *[x.split()[0] for x in STATS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_stats(t) for t in b.column(len(keep)).to_pylist()]
            cols = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names)

    return kept.mapInArrow(run, schema)


def _sums(prefix: str = "") -> list:
    v = [F.col(f"{prefix}v{i}") for i in range(DIM)]
    return [F.sum(v[i]).alias(f"{prefix}s{i}") for i in range(DIM)] + [F.sum(v[i] * v[j]).alias(f"{prefix}q{i}{j}") for i, j in _PAIRS]


class _Estimates:
    """Parameters by (language, source, start): ``_PARAMS`` and ``logdet``."""

    def __init__(self, fit: DataFrame, scratch: Scratch, support: float):
        self.fit, self.scratch, self.support = fit, scratch, support
        self.schema = "_lang string, _source string, start int, " + ", ".join(f"{p} double" for p in _PARAMS) + ", logdet double"

    def salted(self, small: DataFrame) -> DataFrame:
        return small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))

    def rows(self, small: DataFrame) -> DataFrame:
        """Rows with what ``small`` says of their group; the key is salted, so no task has all of a hot group."""
        return self.fit.join(self.salted(small), [*_GROUP, "_salt"])

    def wider(self, sums: DataFrame) -> DataFrame:
        """Sums by group and start with those of the language and of all rows (prefixes ``l_`` and ``a_``)."""
        of_lang = sums.groupBy("_lang", "start").agg(*[F.sum(x).alias(f"l_{x}") for x in _SUMS])
        of_all = of_lang.groupBy("start").agg(*[F.sum(f"l_{x}").alias(f"a_{x}") for x in _SUMS])
        return sums.join(of_lang, ["_lang", "start"]).join(of_all, "start")

    def estimated(self, sums: DataFrame, share: float) -> DataFrame:
        factor = consistency(share) if share < 1 else 1.0
        sums = self.scratch.write(sums, "sums")  # a row for each group: read three times
        wide = self.wider(sums).select(*_GROUP, "start", *[f"{p}{x}" for p in ("a_", "l_", "") for x in _SUMS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for lang, source, start, *sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    levels = [moments(sums[i : i + len(_SUMS)], factor) for i in range(0, 3 * len(_SUMS), len(_SUMS))]
                    out.append([lang, source, start, *_params(*borrowed(levels))])
                yield _batch(out)

        return self.scratch.write(wide.mapInArrow(run, self.schema), "params")

    def starts(self) -> DataFrame:
        """Three starts for each group: medians and quartile ranges, all rows' moments, correlations of bounded statistics."""
        quartiles = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        whole = self.fit.agg(*[quartiles(v).alias(v) for v in _VECTOR]).first()
        if whole[0] is None:
            return self.fit.sparkSession.createDataFrame([], self.schema)
        middle_of = np.array([x[1] for x in whole])
        spread_of = np.maximum(np.array([x[2] - x[0] for x in whole]) / 1.349, 1.0)
        marks = self.fit.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), *[quartiles(v).alias(f"m{i}") for i, v in enumerate(_VECTOR)])
        weight = [F.col("n") / (F.col("n") + PRIOR), PRIOR / (F.col("n") + PRIOR)]
        marks = marks.select(
            *_GROUP,
            *[(weight[0] * F.col(f"m{i}")[1] + weight[1] * float(middle_of[i])).alias(f"c{i}") for i in range(DIM)],
            *[F.sqrt(weight[0] * F.pow((F.col(f"m{i}")[2] - F.col(f"m{i}")[0]) / 1.349, 2) + weight[1] * float(spread_of[i] ** 2)).alias(f"w{i}") for i in range(DIM)],
        )
        marks = self.scratch.write(marks, "marks")
        near = self.rows(marks).withColumns({f"b_v{i}": F.round(F.tanh((F.col(f"v{i}") - F.col(f"c{i}")) / F.col(f"w{i}")) * 1000).cast("long") for i in range(DIM)})
        sums = near.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), *_sums(), *_sums("b_")).join(marks, [*_GROUP])
        sums = self.scratch.write(sums, "sums")
        wide = self.wider(sums.withColumn("start", F.lit(1)).select(*_GROUP, "start", *_SUMS)).join(sums.drop(*_SUMS), [*_GROUP])
        bounded = [f"b_{x}" for x in _SUMS[1:]]
        wide = wide.select(*_GROUP, *[f"c{i}" for i in range(DIM)], *[f"w{i}" for i in range(DIM)], *bounded, *[f"{p}{x}" for p in ("a_", "l_", "") for x in _SUMS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for lang, source, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    center, spread, x = np.array(x[:DIM]), np.array(x[DIM : 2 * DIM]), x[2 * DIM :]
                    bounded, x = x[: len(_SUMS) - 1], x[len(_SUMS) - 1 :]
                    levels = [moments(x[i : i + len(_SUMS)], 1.0) for i in range(0, 3 * len(_SUMS), len(_SUMS))]
                    out.append([lang, source, 0, *_params(center, np.diag(spread**2))])
                    out.append([lang, source, 1, *_params(*borrowed(levels))])
                    out.append([lang, source, 2, *_params(center, correlated([levels[2][0], *bounded], spread))])
                yield _batch(out)

        return self.scratch.write(wide.mapInArrow(run, self.schema), "starts")

    def nearest(self, params: DataFrame) -> DataFrame:
        """Sums over the ``support`` share of each group's rows with the least distances (ties: all of a step)."""
        step = F.floor(F.log1p(_distance()) * 100).cast("int").alias("step")
        by_step = self.rows(params.drop("logdet", "_was")).select(*_GROUP, "start", *_VECTOR, step).groupBy(*_GROUP, "start", "step").agg(F.count(F.lit(1)).alias("n"), *_sums())
        group = Window.partitionBy(*_GROUP, "start")
        upto = F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        taken = by_step.withColumns({"_before": upto - F.col("n"), "_all": F.sum("n").over(group)}).where(F.col("_before") < self.support * F.col("_all"))
        return taken.groupBy(*_GROUP, "start").agg(*[F.sum(x).alias(x) for x in _SUMS])

    def within(self, params: DataFrame, limit: float) -> DataFrame:
        """Sums over rows within ``limit``; a group without any keeps a row of zeros, so that it borrows."""
        inside = _distance() <= limit
        rows = self.rows(params.drop("logdet", "_was")).select(*_GROUP, "start", inside.cast("long").alias("n"), *[F.when(inside, F.col(v)).otherwise(0).alias(v) for v in _VECTOR])
        return rows.groupBy(*_GROUP, "start").agg(F.sum("n").alias("n"), *_sums())

    def least(self, *params: DataFrame) -> DataFrame:
        """The start, or the round, with the least determinant in each group (ties: the first named); ``_was``: that of the first frame."""
        whole = params[0].drop("_was").withColumn("_round", F.lit(0))
        for i, p in enumerate(params[1:], 1):
            whole = whole.unionByName(p.withColumn("_round", F.lit(i)))
        best = F.min(F.struct("logdet", "_round", "start", *_PARAMS)).alias("b")
        was = F.min(F.when(F.col("_round") == 0, F.col("logdet"))).alias("_was")
        best = whole.groupBy(*_GROUP).agg(best, was).select(*_GROUP, F.lit(0).alias("start"), *[f"b.{p}" for p in _PARAMS], "b.logdet", "_was")
        return self.scratch.write(best, "least")


def _batch(rows: list[list]) -> pa.RecordBatch:
    names = [*_GROUP, "start", *_PARAMS, "logdet"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.float64()] * (len(_PARAMS) + 1)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def judge_quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", language: str = "lang", source: str = "source", support: float = 0.75, tail: float = 1e-15, steps: int = 30) -> DataFrame:
    """``keep`` columns, ``STATS``, ``base_failed``, ``distance`` (squared; null where the base rules fail) and ``kept``.

    Rows that fail the base rules (under 20 words, or over 30 % repeated words) take no part in the
    estimates and are not kept.  Null language or source is a value of its own; null texts have no words;
    repeated rows count and are judged each; an empty table gives an empty result.  ``tail`` is far
    below any share of rows because the tails of clean prose are longer than a normal sample's.  Estimates
    go on until no group's determinant falls by a thousandth any more, for ``steps`` rounds at most; the
    least determinant of all rounds is taken.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    c = F.col
    extra = docs.select(*[docs[k] for k in keep], F.coalesce(docs[language], F.lit("\0")).alias("_lang"), F.coalesce(docs[source], F.lit("\0")).alias("_source"), docs[text].alias("_t"))
    stats = text_statistics(extra, (*keep, *_GROUP), "_t")
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    salt = (F.monotonically_increasing_id() % SALTS).cast("int").alias("_salt")
    stats = scratch.write(stats.withColumn("base_failed", failed).select("*", *_vector(), salt), "stats")

    e = _Estimates(stats.where("not base_failed").select(*_GROUP, "_salt", *_VECTOR), scratch, support)
    start = e.starts()
    first = e.estimated(e.nearest(start), support)
    params = e.least(e.estimated(e.nearest(first), support))
    for _ in range(steps):
        params = e.least(params, e.estimated(e.nearest(params), support))
        if params.where(c("_was") - c("logdet") > 1e-3).isEmpty():
            break
    params = e.estimated(e.within(params, chi2_quantile(0.025, DIM)), 0.975).drop("start", "logdet")

    judged = stats.join(e.salted(params), [*_GROUP, "_salt"], "left").withColumn("distance", F.when(~c("base_failed"), _distance()))
    names = [x.split()[0] for x in STATS.split(", ")]
    inside = F.coalesce(c("distance") <= chi2_quantile(tail, DIM), F.lit(False))
    return judged.select(*keep, *names, "base_failed", "distance", (~c("base_failed") & inside).alias("kept"))
