"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each text becomes a vector of transformed statistics. For every (language, source) group, and for every language,
a location and scatter are estimated by the deterministic MCD: three robust starts (standardised norm, tanh
correlation, spatial signs), each refined by concentration steps that keep the ``H_SHARE`` of the rows nearest by
Mahalanobis distance, and the start with the smallest determinant wins. A text is rejected when its distance
exceeds a chi-square quantile.

The vectors are fixed-point integers, so sums and cross products are exact and do not depend on the order in which
executors deliver them. One concentration step is one aggregation: rows are summed by (group, start, distance
bucket), and the buckets are then taken from the nearest until they hold the wanted share. A group of any size is
thus spread over all tasks and never gathered. ``FLOOR`` is the least standard deviation of each statistic; it keeps
the determinant positive where most texts agree exactly (say, no symbols at all).

Groups below ``MIN_ROWS`` fitting rows use their language's estimate; languages below it their own medians with the scatter
estimated over all rows. Where all rows are fewer than that, none is rejected but by the base rule.
Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their own.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.llm.common import join_params, pinned, utf8

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
SPACES = " \t\n\x0b\x0c\r"

#: Statistics of the vector: log mean word length; square roots of the shares of symbols, repeated words, repeated
#: lines and capitals; each with pseudo-counts, so that short texts vary little more than long ones.
VECTOR = ("word_length", "symbols", "repeats", "dup_lines", "capitals")
FLOOR = (0.10, 0.05, 0.13, 0.13, 0.06)
UNIT = 4096          # fixed-point units of a statistic
H_SHARE = 0.75       # share of the rows that a concentration step keeps
STEPS = 6            # concentration steps
MIN_ROWS = 60
QUANTILE = 0.9995    # chi-square quantile beyond which a text is an outlier
OCTAVE = 4           # distance buckets per doubling of the squared distance

P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in (*BASE, "n_lines", "n_upper")])


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for step, a in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = (h[:-step] * np.uint64(a)) ^ (h[step:] + (h[:-step] >> np.uint64(29)))
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of one whole text."""
    if not text:
        return (0,) * 7
    data = utf8(text)
    words = data.split()           # bytes.split() splits at exactly \x20 and \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - (len(data) - sum(map(len, words))), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(data) - len(data.translate(None, UPPER)))


@F.pandas_udf(STATS_TYPE)
def _stats(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in text], columns=[*BASE, "n_lines", "n_upper"], dtype="int64")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Fixed-point statistics of a text."""
    share = lambda n, of, pseudo: F.sqrt(n / (of + F.lit(float(pseudo))))
    x = [F.log((s["word_chars"] + 100.0) / (s["n_words"] + 20.0)), share(s["n_symbols"], s["word_chars"], 100),
         share(s["n_repeat_words"], s["n_words"], 20), share(s["n_dup_lines"], s["n_lines"], 5),
         share(s["n_upper"], s["word_chars"], 100)]
    return [F.round(c * UNIT).cast("long").alias(f"x{i}") for i, c in enumerate(x)]


# --- small dense algebra, one row per group ------------------------------------------------------------------------

def _chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with ``k`` degrees of freedom (series of the incomplete gamma function)."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(max(mid, 1e-9), k) < q else (low, mid)
    return high


CONSISTENCY = H_SHARE / _chi2_cdf(chi2_quantile(H_SHARE, P), P + 2)
CUTOFF = chi2_quantile(QUANTILE, P)

PARAM_COLS = [f"m{i}" for i in range(P)] + [f"w{i}{j}" for i, j in PAIRS] + ["logdet"]
PARAM_TYPE = ", ".join(f"{c} double" for c in PARAM_COLS)


def _params(mean: np.ndarray, cov: np.ndarray) -> dict:
    """Mean, weights of the squared distance (off-diagonals doubled) and log determinant; UNIT-free, with floors."""
    cov = cov + np.diag(np.square(FLOOR))
    inv = np.linalg.inv(cov)
    return ({f"m{i}": mean[i] for i in range(P)} | {f"w{i}{j}": inv[i, j] * (1 if i == j else 2) for i, j in PAIRS}
            | {"logdet": float(np.linalg.slogdet(cov)[1])})


def _moments(row) -> tuple[np.ndarray, np.ndarray]:
    n = float(row.n)
    mean = np.array([float(getattr(row, f"s{i}")) for i in range(P)]) / n
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = float(getattr(row, f"s{i}{j}")) / n - mean[i] * mean[j]
    return mean / UNIT, cov / UNIT**2


def _fit_batches(batches):
    """Sums of the kept rows of a (group, start) -> parameters."""
    for pdf in batches:
        yield pd.DataFrame([{"g": r.g, "start": r.start} | _params(*_moments(r)) for r in pdf.itertuples()],
                           columns=["g", "start", *PARAM_COLS])


def _start_batches(batches):
    """Medians, scales and sums of a transform (0: none, 1: tanh, 2: spatial signs) -> first parameters."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            scale = np.array([getattr(r, f"scale{i}") for i in range(P)])
            centre = np.array([getattr(r, f"med{i}") for i in range(P)]) / UNIT
            corr = np.eye(P)
            if r.start:
                _, cov = _moments(r)
                d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = 0.95 * cov / np.outer(d, d) + 0.05 * np.eye(P)
            out.append({"g": r.g, "start": r.start} | _params(centre, corr * np.outer(scale, scale)))
        yield pd.DataFrame(out, columns=["g", "start", *PARAM_COLS])


def _sums(cols: list[Column]) -> list[Column]:
    """Exact sums; with statistics below 3 x UNIT a BIGINT holds 6e10 rows of one bucket, and ANSI mode raises beyond."""
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
            + [F.sum(cols[i] * cols[j]).alias(f"s{i}{j}") for i, j in PAIRS])


def _squared(prefix_x=lambda i: F.col(f"x{i}") / UNIT) -> Column:
    d = [prefix_x(i) - F.col(f"m{i}") for i in range(P)]
    return sum((F.col(f"w{i}{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def fit(rows: DataFrame) -> DataFrame:
    """MCD parameters by group: ``g`` and ``PARAM_COLS``, and ``n`` fitting rows. ``rows``: g, x0.. (pinned)."""
    xs = [F.col(f"x{i}") for i in range(P)]
    # Exact medians of fixed-point values: what a task holds is bounded by the number of different values.
    med = pinned(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *[F.median(x).alias(f"med{i}") for i, x in enumerate(xs)]))
    near = join_params(rows, med, ["g"], "inner")
    mad = near.groupBy("g").agg(*[F.median(F.abs(x - F.col(f"med{i}"))).alias(f"mad{i}") for i, x in enumerate(xs)])
    scale = pinned(med.join(mad, "g").select(
        "g", "size", *[f"med{i}" for i in range(P)],
        *[F.greatest(F.col(f"mad{i}") * (1.4826 / UNIT), F.lit(FLOOR[i])).alias(f"scale{i}") for i in range(P)]))

    z = [(x / UNIT - F.col(f"med{i}") / UNIT) / F.col(f"scale{i}") for i, x in enumerate(xs)]
    norm = F.sqrt(sum((c * c for c in z), F.lit(0.0)) + F.lit(1e-12))
    turned = join_params(rows, scale, ["g"], "inner").select(
        "g", F.explode(F.array(F.struct(F.lit(1).alias("start"), *[F.round(F.tanh(c) * UNIT).cast("long").alias(f"x{i}") for i, c in enumerate(z)]),
                               F.struct(F.lit(2).alias("start"), *[F.round(c / norm * UNIT).cast("long").alias(f"x{i}") for i, c in enumerate(z)]))).alias("t"))
    sums = turned.select("g", "t.*").groupBy("g", "start").agg(*_sums(xs))
    starts = scale.select("g", F.explode(F.array(*map(F.lit, range(3)))).alias("start"), *[c for c in scale.columns if c not in ("g", "size")])
    params = pinned(starts.join(sums, ["g", "start"], "left")
                    .mapInPandas(_start_batches, f"g string, start int, {PARAM_TYPE}"))

    nearest = Window.partitionBy("g", "start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("g", "start")
    for _ in range(STEPS):
        wide = params.groupBy("g").agg(F.collect_list(F.struct("start", *PARAM_COLS)).alias("p"))   # three starts a group
        at = join_params(rows, wide, ["g"], "inner").select("g", *xs, F.explode("p").alias("p")).select("g", *xs, "p.*")
        bucket = F.floor(F.log2(F.greatest(_squared(), F.lit(2.0**-4))) * OCTAVE).cast("int").alias("bucket")
        by = at.select("g", "start", *xs, bucket).groupBy("g", "start", "bucket").agg(*_sums(xs))   # a few hundred buckets a start
        kept = (by.withColumn("before", F.coalesce(F.sum("n").over(nearest), F.lit(0)))
                  .withColumn("all", F.sum("n").over(everything))
                  .filter(F.col("before") < F.ceil(F.col("all") * H_SHARE)))
        total = kept.groupBy("g", "start").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]])
        params = pinned(total.mapInPandas(_fit_batches, f"g string, start int, {PARAM_TYPE}"))
    best = params.groupBy("g").agg(F.min_by(F.struct(*PARAM_COLS), F.struct("logdet", "start")).alias("p")).select("g", "p.*")
    return pinned(best.join(scale.select("g", F.col("size").alias("n")), "g"))


def _group(*cols: str) -> Column:
    """Null-safe group key: a JSON text (a null field is left out, so it differs from every value)."""
    return F.to_json(F.struct(*cols))


def _pooled(ok: DataFrame, rows: DataFrame, small: DataFrame) -> DataFrame:
    """(lang_g, wide) of languages too small for an estimate: their own medians, and the scatter of all rows.

    All rows' scatter holds the differences between languages, so it is the wider one; the medians keep a language with
    other words than most from being an outlier as a whole.
    """
    every = fit(pinned(ok.select(F.lit("").alias("g"), *vector(F.col("s"))))).filter(F.col("n") >= MIN_ROWS).first()
    if every is None:
        return small.limit(0).select("lang_g", F.struct(*[F.lit(0.0).alias(c) for c in PARAM_COLS]).alias("wide"))
    med = (rows.join(small.withColumnRenamed("lang_g", "g"), "g", "left_semi").groupBy("g")
           .agg(*[(F.median(f"x{i}") / UNIT).alias(f"m{i}") for i in range(P)]))
    return med.select(F.col("g").alias("lang_g"), F.struct(*[c if c.startswith("m") else F.lit(every[c]).alias(c) for c in PARAM_COLS]).alias("wide"))


def estimates(stats: DataFrame) -> DataFrame:
    """(g, PARAM_COLS) for each (lang, source); ``stats``: lang, source, s (pinned)."""
    ok = stats.filter(~base_failed(F.col("s")))
    rows = pinned(ok.select(F.explode(F.array(_group("lang", "source"), _group("lang"))).alias("g"), *vector(F.col("s"))))
    model = fit(rows)
    keys = stats.select(_group("lang", "source").alias("g"), _group("lang").alias("lang_g")).distinct()
    own = model.filter(F.col("n") >= MIN_ROWS)
    wider = own.select(F.col("g").alias("lang_g"), F.struct(*PARAM_COLS).alias("wide"))
    small = pinned(keys.select("lang_g").distinct().join(wider, "lang_g", "left_anti"))
    if not small.isEmpty():
        wider = wider.union(_pooled(ok, rows, small))
    narrow = own.select("g", F.struct(*PARAM_COLS).alias("own"))
    return pinned(keys.join(narrow, "g", "left").join(wider, "lang_g", "left")
                  .select("g", F.coalesce("own", "wide").alias("p")).filter("p is not null").select("g", "p.*"))


def _judged(stats: DataFrame, model: DataFrame) -> DataFrame:
    """``stats`` (with g, s) plus base_failed, distance (null without an estimate) and kept."""
    x = vector(F.col("s"))
    d = join_params(stats, model, ["g"]).withColumn("distance", F.sqrt(_squared(lambda i: x[i] / UNIT) / CONSISTENCY))
    failed = base_failed(F.col("s"))
    return (d.withColumn("base_failed", failed)
             .withColumn("kept", ~failed & F.coalesce(F.col("distance") <= math.sqrt(CUTOFF), F.lit(True))))


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, s and the whole row, whatever other columns the table has."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "lang", "source", _stats("text").alias("s"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, kept, distance."""
    stats = pinned(docs.select("doc_id", "lang", "source", _stats("text").alias("s")))
    out = _judged(stats.withColumn("g", _group("lang", "source")), estimates(stats))
    return out.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in BASE], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Statistics are taken twice, so no text is shuffled."""
    model = estimates(pinned(docs.select("lang", "source", _stats("text").alias("s"))))
    rows = _columns(docs).select("row", "s", _group("lang", "source").alias("g"))
    return _judged(rows, model).filter("kept").select("row.*")
