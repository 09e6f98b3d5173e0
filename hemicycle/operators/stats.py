"""Tests, resampling, calibration, sampling and tuning. Grouped NumPy only where no expression exists."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.clean import vote_signal
from hemicycle.functions.vectors import proportions, tempered
from hemicycle.operators.linkage import eligible
from hemicycle.operators.rows import first_row, global_rank


def benjamini_hochberg(rows: DataFrame, p: str, key: str, legacy: bool = False, bucket_rows: int = 250_000) -> DataFrame:
    """Adjusted p-values (null or NaN p: 1) and stars. legacy: a second pass of running minima in the key's order.

    Places come from global_rank(); running minima are taken from the end within its buckets and carried
    over from the buckets behind.
    """
    q = rows.withColumn("__p", F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0)))
    n = q.agg(F.count("*").alias("__n"))
    q = global_rank(q, [F.col("__p")], key, "__r", bucket_rows).crossJoin(F.broadcast(n))  # one row
    q = _least_from_here(q.withColumn("__x", F.col("__p") * F.col("__n") / F.col("__r")), "__x", "__r").withColumn("adjusted", F.least(F.lit(1.0), "__x"))
    if legacy:
        q = _least_from_here(global_rank(q.drop("__b", "__r"), [F.col(key)], key, "__r", bucket_rows), "adjusted", "__r")
    a = F.col("adjusted")
    return q.withColumn("stars", F.when(a < 0.001, "***").when(a < 0.01, "**").when(a < 0.05, "*").otherwise("")).drop("__p", "__n", "__r", "__x", "__b")


def _least_from_here(rows: DataFrame, value: str, place: str) -> DataFrame:
    """value as the least of it and of all rows behind, in buckets __b that follow one another."""
    least = rows.groupBy("__b").agg(F.min(value).alias("__m"))
    behind = least.select("__b", F.min("__m").over(Window.orderBy("__b").rowsBetween(1, Window.unboundedFollowing)).alias("__behind"))  # a row per bucket
    inside = F.min(value).over(Window.partitionBy("__b").orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(value, inside).join(F.broadcast(behind), "__b").withColumn(value, F.least(value, "__behind")).drop("__behind")


def drawn(row_id, draw, seed: int) -> Column:
    """A uniform number in [0, 1) of a row and a draw, from 32 bits of MD5: the same in every run and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(draw).cast("string"), F.col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sign_flip_tests(rows: DataFrame, keys: Sequence[str], value: str, row_id: str, rounds: int = 10_000, exact: int = 12, seed: int = 42) -> DataFrame:
    """n and the two-sided sign-flip p-value of the mean by keys; only finite values count.

    Up to `exact` values all sign vectors are weighed, and p is the share of those with a mean as far from 0. Beyond, `rounds` vectors
    are drawn by hash, each one's sum is an aggregate, and p is smoothed by one.
    """
    names = list(keys)
    x = F.col(value).cast("double")
    held = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(*names, F.col(row_id).alias("__id"), x.alias("__x"))
    sized = held.withColumn("n", F.count("*").over(Window.partitionBy(*names)))
    lists = sized.where(F.col("n") <= exact).groupBy(*names).agg(F.collect_list("__x").alias("v"))  # `exact` values at most
    flipped = lambda m: F.aggregate(F.transform("v", lambda y, i: F.when(F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1, -y).otherwise(y)), F.lit(0.0), lambda a, y: a + y)
    vectors = F.pow(F.lit(2.0), F.size("v")).cast("int")
    far = F.size(F.filter(F.sequence(F.lit(0), vectors - 1), lambda m: F.abs(flipped(m)) >= F.abs(F.aggregate("v", F.lit(0.0), lambda a, y: a + y)) - 1e-12 * F.size("v")))
    small = lists.select(*names, F.size("v").cast("long").alias("n"), (far / vectors).alias("p"))
    many = sized.where(F.col("n") > exact).withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    sign = F.when((F.col("__draw") == 0) | (drawn("__id", "__draw", seed) < 0.5), 1.0).otherwise(-1.0)  # draw 0 is the sample itself
    sums = many.groupBy(*names, "n", "__draw").agg(F.abs(F.sum(sign * F.col("__x"))).alias("s"))
    own = sums.where("__draw = 0").select(*names, F.col("s").alias("__own"))
    large = sums.join(own, names).groupBy(*names, "n").agg((F.count(F.when(F.col("s") >= F.col("__own") - 1e-12 * F.col("n"), 1)) / (rounds + 1)).alias("p"))
    return small.unionByName(large.select(*names, "n", "p"))


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _t_p(t: float, df: int) -> float:
    """Two-sided p of Student's t by Simpson's rule on its density."""
    if df < 1 or not math.isfinite(t):
        return 1.0 if math.isnan(t) else 0.0
    x = np.linspace(0, abs(t), 4001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) if t else 0.0
    return float(min(1.0, max(0.0, 1 - 2 * area)))


def _t_quantile(p: float, df: int) -> float:
    """The t below which a share p of the distribution lies, for p of 0.5 or more, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_p(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


# Royston's polynomials for the Shapiro-Wilk weights, and for the mean and deviation of ln(1 - W) from 12 values on.
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_LOG_SD = (0.0030302, -0.082676, -0.4803)


def shapiro_p(x: np.ndarray) -> float:
    """p of the Shapiro-Wilk test of normality by Royston's approximation; NaN below 12 values or without spread."""
    n, x = len(x), np.sort(x)
    spread = float(((x - x.mean()) ** 2).sum()) if n else 0.0
    if n < 12 or not spread:
        return math.nan
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    whole, u = float(m @ m), 1 / math.sqrt(n)
    last, nxt = np.polyval(_LAST, u) + m[-1] / math.sqrt(whole), np.polyval(_NEXT, u) + m[-2] / math.sqrt(whole)
    a = m / math.sqrt((whole - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2))
    a[-1], a[-2], a[0], a[1] = last, nxt, -last, -nxt
    w = min(1 - 1e-12, float(a @ x) ** 2 / spread)
    return _normal_sf((math.log(1 - w) - np.polyval(_MEAN, math.log(n))) / math.exp(np.polyval(_LOG_SD, math.log(n))))


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic (the lesser rank sum, zeros left out) and its p: exact for up to 50 differences without ties or zeros, else normal with tie correction."""
    whole, d = len(d), d[d != 0]
    n = len(d)
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = float(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    if n == whole and n <= 50 and len(np.unique(np.abs(d))) == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            ways = [x + (ways[i - r] if i >= r else 0) for i, x in enumerate(ways)]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    _, ties = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    return w, min(1.0, 2 * _normal_sf((n * (n + 1) / 4 - w) / math.sqrt(var))) if var > 0 else 1.0


def paired_test(a: np.ndarray, b: np.ndarray) -> dict:
    """Paired t for more than 30 finite pairs whose differences pass Shapiro-Wilk (p > 0.05), else Wilcoxon; t again where all differences are 0.

    The effect is Cohen's d for t and |z| / sqrt(n) for Wilcoxon; t has a 95% interval of the mean difference.
    """
    n = min(len(a), len(b))
    d = (a[:n] - b[:n])[np.isfinite(a[:n]) & np.isfinite(b[:n])]
    n = len(d)
    out = {"test": None, "n": n, "stat": None, "p": None, "effect": None, "low": None, "high": None}
    if not n:
        return out
    sd = float(d.std(ddof=1)) if n > 1 else 0.0
    if n > 30 and shapiro_p(d) > 0.05 or not d.any():
        t = float(d.mean()) / (sd / math.sqrt(n)) if sd else None
        half = _t_quantile(0.975, n - 1) * sd / math.sqrt(n) if n > 1 else 0.0
        return out | {"test": "paired_t" if d.any() else "paired_t_fallback", "stat": t, "p": None if t is None else _t_p(t, n - 1), "effect": float(d.mean()) / sd if sd else 0.0, "low": float(d.mean()) - half, "high": float(d.mean()) + half}
    w, p = wilcoxon(d)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return out | {"test": "wilcoxon", "stat": w, "p": p, "effect": abs(z) / math.sqrt(n)}


def paired_tests(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """paired_test() of two columns by keys. Order statistics need a group's pairs together: groups are links of one actor and category."""
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = paired_test(pdf["__a"].to_numpy(float), pdf["__b"].to_numpy(float))
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in names} | r])

    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*names).dtypes)
    held = rows.select(*names, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    return held.groupBy(*names).applyInPandas(run, f"{fields}, test string, n long, stat double, p double, effect double, low double, high double")


def three_way_tests(rows: DataFrame, keys: Sequence[str], said: str, moved: str, voted: str) -> DataFrame:
    """paired_tests() of what was said with what was moved, voted, and the mean of these two (where both are known), as one table with `comparison`."""
    both = (F.col(moved) + F.col(voted)) / 2
    sides = F.array(*(F.struct(F.lit(f"speech_vs_{n}").alias("comparison"), F.col(said).cast("double").alias("a"), c.cast("double").alias("b")) for n, c in (("motion", F.col(moved)), ("vote", F.col(voted)), ("combined", both))))
    long = rows.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.*")
    return paired_tests(long, [*keys, "comparison"], "a", "b")


def profile_tests(profiles: DataFrame, value: str = "proportion") -> DataFrame:
    """three_way_tests() by category across the parties that have a speech and a motion profile; a category that a modality lacks counts 0."""
    kinds = ("speech", "motion", "vote")
    wide = profiles.groupBy("party", "category").pivot("modality", list(kinds)).agg(F.avg(value))
    has = profiles.groupBy("party").agg(*(F.max((F.col("modality") == k).cast("int")).alias(f"__{k}") for k in kinds)).where("__speech = 1 and __motion = 1")
    grid = has.crossJoin(F.broadcast(profiles.select("category").distinct()))  # the axis, a fixed few
    full = grid.join(wide, ["party", "category"], "left")
    filled = {k: F.when(F.col(f"__{k}") == 1, F.coalesce(F.col(k), F.lit(0.0))) for k in kinds}
    return three_way_tests(full.withColumns(filled), ["category"], *kinds).select(F.lit("ALL_PARTIES").alias("party"), "*")


def linked_tests(links: DataFrame, first_votes: DataFrame, votes: DataFrame, order: str, excluded: Sequence[str] = ()) -> DataFrame:
    """three_way_tests() by party and category over links(party, category, item_id, said, moved).

    An item's vote is its party's answer (vote_signal) in the item's first ballot, of several answers the last by `order`.
    """
    answers = votes.groupBy("vote_id", "party").agg(F.max_by("vote", order).alias("vote"))
    known = first_votes.select("item_id", F.col("first_vote_id").alias("vote_id")).where("coalesce(vote_id, '') <> ''")
    held = links.withColumn("party", F.coalesce("party", F.lit("Unknown"))).where(~F.col("party").isin(*excluded)) if excluded else links
    full = held.join(known, "item_id", "left").join(answers, ["vote_id", "party"], "left").withColumn("voted", vote_signal("vote"))
    return three_way_tests(full, ["party", "category"], "said", "moved", "voted")


#: Chances that a Poisson(1) number is at most 0, 1, ...
_POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(9))


def bootstrap_means(rows: DataFrame, key: str, values: Sequence[str], rounds: int = 500, alpha: float = 0.05, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """Means by key with percentile intervals; nulls and NaN count neither in means nor in resamples.

    A resample's mean weighs each row by a Poisson(1) number drawn from a hash of (seed, round, row_id), so equal rows
    draw apart. Without row_id rows are numbered as they stand, and draws follow the partitioning. Sums are
    combined before the shuffle, so no task holds a group.
    """
    cols = list(values)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    held = rows.select(F.col(key), *(v.alias(c) for c, v in clean.items()), (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("__id"))
    each = held.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("__u", drawn("__id", "__draw", seed))
    w = sum(((F.col("__u") >= edge).cast("double") for edge in _POISSON), F.lit(0.0))
    each = each.withColumn("__w", w)
    means = each.groupBy(key, "__draw").agg(*(F.try_divide(F.sum(F.col(c) * F.col("__w")), F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("__w"))), F.lit(0.0))).alias(c) for c in cols))
    ends = [F.percentile(c, q).alias(f"{c}_{n}") for c in cols for n, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
    whole = held.groupBy(key).agg(*(F.avg(c).alias(f"{c}_mean") for c in cols), F.count("*").alias("n")).withColumnRenamed(key, "__key")
    both = means.groupBy(key).agg(*ends)
    return both.join(whole, both[key].eqNullSafe(whole["__key"])).drop("__key").select(key, *(f"{c}_mean" for c in cols), "n", *(f"{c}_{e}" for c in cols for e in ("low", "high")))


def latent_factor(matrix: np.ndarray, anchor: int = 0) -> np.ndarray:
    """First right singular direction's scores, turned so the anchor is positive, as z-scores."""
    x = matrix - matrix.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    score = u[:, 0] * s[0]
    score = -score if score[anchor] < 0 else score
    sd = score.std()
    return (score - score.mean()) / sd if sd else score * 0


def correlation(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman (average ranks) by key, over rows in which both are finite numbers."""
    from hemicycle.operators.profiles import average_rank

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    r = rows.where(finite(a) & finite(b)).withColumns({"__a": average_rank(a, *keys), "__b": average_rank(b, *keys)})
    corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # null without spread
    return r.groupBy(*keys).agg(corr(a, b).alias("pearson"), corr("__a", "__b").alias("spearman"), F.count("*").alias("n"))


def correlation_interval(rows: DataFrame, keys: Sequence[str], a: str, b: str, row_id: str, rounds: int = 500, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """correlation() with a percentile interval of Pearson's coefficient, from Poisson(1) weights drawn by hash of (seed, round, row_id)."""
    each = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("__u", drawn(row_id, "__draw", seed))
    w, x, y = sum(((F.col("__u") >= edge).cast("double") for edge in _POISSON), F.lit(0.0)), F.col(a).cast("double"), F.col(b).cast("double")
    sums = each.groupBy(*keys, "__draw").agg(*(F.sum(w * v).alias(n) for n, v in (("w", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    vx, vy = F.col("w") * F.col("xx") - F.col("x") ** 2, F.col("w") * F.col("yy") - F.col("y") ** 2
    r = F.when((vx > 1e-12) & (vy > 1e-12), (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy))
    ends = sums.withColumn("__r", r).groupBy(*keys).agg(F.percentile("__r", alpha / 2).alias("low"), F.percentile("__r", 1 - alpha / 2).alias("high"))
    return correlation(rows, keys, a, b).join(ends, list(keys))


def orientation(correlations: DataFrame, key: str, sign: str, value: str = "spearman") -> DataFrame:
    """Of the rows of a key that differ by a scale's sign (1 or -1), that with the largest |value|; the positive one on ties."""
    return first_row(correlations, [key], [F.abs(F.col(value)).desc_nulls_last(), F.col(sign).desc()])


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 by class."""
    t = rows.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("support"), F.count(F.when(F.col(truth) == F.col(predicted), 1)).alias("hits"))
    p = rows.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("predicted"))
    out = t.join(p, "class", "full").fillna(0, ["support", "hits", "predicted"])
    prec, rec = (F.coalesce(F.try_divide(F.col("hits"), F.col(c)), F.lit(0.0)) for c in ("predicted", "support"))
    return out.withColumns({"precision": prec, "recall": rec, "f1": F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))})


def log_loss(rows: DataFrame, probs: str, truth_index: str) -> DataFrame:
    """Mean -ln p of the true class; an unknown class is the first."""
    p = F.get(F.col(probs), F.coalesce(F.col(truth_index), F.lit(0)).cast("int"))
    return rows.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("nll"), F.count("*").alias("n"))


def temperature_grid(rows: DataFrame, probs: str, truth_index: str, low: float = 0.1, high: float = 10.0, steps: int = 120) -> DataFrame:
    """NLL at each temperature of a logarithmic grid, in one pass."""
    ts = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    at = F.coalesce(F.col(truth_index), F.lit(0)).cast("int")
    nll = [F.avg(-F.ln(F.greatest(F.get(tempered(probs, t), at), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(ts)]
    wide = rows.agg(*nll)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(str(i)).alias("nll")) for i, t in enumerate(ts)))).alias("x")).select("x.*")


def reliability(rows: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.avg(p).alias("confidence"), F.avg(F.col(hit).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def isotonic(rows: DataFrame, p: str, hit: str) -> DataFrame:
    """score, calibrated: the monotone least-squares fit of hit on p; rows of equal score are pooled first, which does not change the fit."""
    from pyspark.ml.regression import IsotonicRegression

    pooled = rows.where(F.col(p).isNotNull() & F.col(hit).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(F.avg(F.col(hit).cast("double")).alias("hit"), F.count("*").cast("double").alias("n"))
    if pooled.isEmpty():
        return pooled.select("score", F.col("hit").alias("calibrated"))
    fit = IsotonicRegression(featuresCol="score", labelCol="hit", weightCol="n", predictionCol="calibrated").fit(pooled)
    return fit.transform(pooled).select("score", "calibrated")


def one_vs_rest_isotonic(rows: DataFrame, key: str, probs: str, truth: str, classes: int) -> DataFrame:
    """key and `calibrated`: each class's probability fitted on its own, then divided by their sum (uniform where that is 0)."""
    out = rows.select(key, probs, truth)
    for c in range(classes):
        fit = isotonic(rows.select(F.get(probs, F.lit(c)).cast("double").alias("p"), (F.col(truth) == c).cast("int").alias("hit")), "p", "hit")
        out = out.withColumn("__s", F.get(probs, F.lit(c)).cast("double")).join(fit.select(F.col("score").alias("__s"), F.col("calibrated").alias(f"__{c}")), "__s", "left").drop("__s")
    return out.select(key, truth, proportions(F.array(*(F.coalesce(f"__{c}", F.lit(0.0)) for c in range(classes)))).alias("calibrated"))


def summary_metrics(metrics: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy and macro F1 of class_metrics(), over the classes that occur."""
    held = metrics.where("support > 0")
    return held.agg(F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def kmeans(rows: DataFrame, vector: str, k: int = 3, seed: int = 42) -> DataFrame:
    """rows with `cluster`, of k-means over an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(held).transform(held).drop("__v")


def ward(matrix: np.ndarray, k: int) -> list[int]:
    """Cluster numbers (by first member) of a few rows after merging, again and again, the two clusters whose union adds least to the squared distances from the means."""
    members = {i: [i] for i in range(len(matrix))}
    while len(members) > max(1, k):
        means = {i: matrix[m].mean(axis=0) for i, m in members.items()}
        names = sorted(members)
        cost = lambda a, b: len(members[a]) * len(members[b]) / (len(members[a]) + len(members[b])) * float(((means[a] - means[b]) ** 2).sum())
        a, b = min(((a, b) for n, a in enumerate(names) for b in names[n + 1 :]), key=lambda p: (round(cost(*p), 12), p))
        members[a] += members.pop(b)
    number = {a: n for n, a in enumerate(sorted(members))}
    of = {i: number[a] for a, m in members.items() for i in m}
    return [of[i] for i in range(len(matrix))]


def latent_interval(matrix: np.ndarray, anchor: int = 0, rounds: int = 500, alpha: float = 0.05, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Percentile interval of latent_factor()'s scores over resampled columns."""
    rng = np.random.default_rng(seed)
    draws = np.array([latent_factor(matrix[:, rng.integers(matrix.shape[1], size=matrix.shape[1])], anchor) for _ in range(rounds)])
    return np.quantile(draws, alpha / 2, axis=0), np.quantile(draws, 1 - alpha / 2, axis=0)


def principal(rows: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """rows with `components`, the first k principal components of a centred array column."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(held).transform(held)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return out.withColumn("components", vector_to_array("__p")).drop("__v", "__c", "__p")


def hash_order(key: str, seed: int = 42):
    """A reproducible random order, whatever the partitioning and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def examples_per_class(rows: DataFrame, cls: str, n: int, key: str, seed: int = 42, exclude: DataFrame | None = None, text: str | None = None, longer_than: int = 100) -> DataFrame:
    """n rows of each class in hash order, without keys of `exclude` and with texts of more than that many characters."""
    held = rows if exclude is None else rows.join(exclude.select(key), key, "left_anti")
    if text:
        held = held.where(F.length(text) > longer_than)
    place = F.row_number().over(Window.partitionBy(cls).orderBy(hash_order(key, seed), key))
    return held.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def stratum_quotas(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """Proportional shares of n, one at least; what rounding leaves goes to the largest (smallest name on ties)."""
    c = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = c.agg(F.sum("size").alias("total"))
    q = c.crossJoin(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1), F.floor(F.col("size") * n / F.col("total"))).cast("long"))  # one row
    rest = q.agg((F.lit(n) - F.sum("quota")).alias("rest"))
    first = F.row_number().over(Window.orderBy(F.col("size").desc(), F.col(stratum))) == 1
    return q.crossJoin(F.broadcast(rest)).withColumn("quota", F.when(first, F.greatest(F.lit(1), F.col("quota") + F.col("rest"))).otherwise(F.col("quota"))).select(stratum, "size", "quota")


def stratified_sample(rows: DataFrame, stratum: str, n: int, key: str, seed: int = 42, top_half_of: str | None = None) -> DataFrame:
    """stratum_quotas() rows of each stratum by hash; top_half_of: from the upper half by that score."""
    held = rows
    if top_half_of:
        half = F.ntile(2).over(Window.partitionBy(stratum).orderBy(F.col(top_half_of).desc(), key))
        held = rows.withColumn("__h", half).where("__h = 1").drop("__h")
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(key, seed), key))
    return held.withColumn("__r", r).join(stratum_quotas(rows, stratum, n).select(stratum, "quota"), stratum).where("__r <= quota").drop("__r", "quota")


def split(rows: DataFrame, stratum: str, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds `split`: each stratum is cut by hash order at the cumulated shares."""
    w = Window.partitionBy(stratum)
    at = (F.row_number().over(w.orderBy(hash_order(key, seed), key)) - 1) / F.count("*").over(w)
    out, edge = F.lit(None).cast("string"), 1.0
    for name, share in reversed(parts.items()):
        out = F.when(at < edge, F.lit(name)).otherwise(out) if edge >= 1.0 else F.when(at < edge - 1e-12, F.lit(name)).otherwise(out)
        edge -= share
    return rows.withColumn("split", out)


def rare_classes(labels: DataFrame, cls: str) -> DataFrame:
    n = labels.groupBy(cls).agg(F.count("*").alias("n"))
    med = n.agg(F.median("n").alias("median"))
    return n.crossJoin(F.broadcast(med)).where("n < median").select(cls, "n")  # one row


def rebalance_grid(links: DataFrame, shares: Sequence[float], margins: Sequence[float], target_ratio: float) -> DataFrame:
    """Flips and error |ln(observed / target)| of rebalance() at every (share, margin), from one aggregate."""
    ok, margin = eligible()
    base = links.agg(F.count("*").alias("n"), F.count(F.when(F.col("action_type") == "motion", 1)).alias("motions"), *(F.count(F.when(ok & (margin >= m), 1)).alias(f"e{i}") for i, m in enumerate(margins)))
    grid = F.array(*(F.struct(F.lit(s).alias("share"), F.lit(m).alias("margin"), F.col(f"e{i}").alias("eligible")) for s in shares for i, m in enumerate(margins)))
    out = base.select("n", "motions", F.explode(grid).alias("g")).select("n", "motions", "g.*")
    flips = F.least(F.greatest(F.lit(0), F.ceil(F.col("share") * F.col("n")) - F.col("motions")), F.col("eligible"))
    out = out.withColumn("flips", flips.cast("long"))
    ratio = F.try_divide((F.col("motions") + F.col("flips")).cast("double"), F.nullif(F.col("n") - F.col("motions") - F.col("flips"), F.lit(0)).cast("double"))
    return out.withColumn("ratio_error", F.abs(F.ln(ratio / target_ratio)))


def party_totals(links: DataFrame, party: str = "party") -> DataFrame:
    """Links, motions and the share of motions by party; no party is the party Unknown."""
    name = F.coalesce(party, F.lit("Unknown"))
    motion = F.count(F.when(F.col("action_type") == "motion", 1))
    return links.groupBy(name.alias("party")).agg(F.count("*").alias("total"), motion.alias("motions"), (motion / F.count("*")).alias("share"))


def fairness_grid(links: DataFrame, shares: Sequence[float], margins: Sequence[float], target_ratio: float, weights: tuple[float, float, float] = (1.0, 0.5, 0.2), min_gain: float = 0.0, party: str = "party", key: str = "item_id", score: str = "score") -> DataFrame:
    """What rebalance() at every (share, margin) does to parties: the largest and the mean change of a party's share of motions, the ratio's error, and their weighted score.

    Flips come in one global order (margin, score, key), so a setting's flips by party are counts of places up to its
    number of flips: one pass for all settings.
    """
    ok, margin = eligible()
    settings = rebalance_grid(links, shares, margins, target_ratio).select("share", F.col("margin").alias("min_margin"), "n", "motions", "flips")
    placed = global_rank(links.where(ok).select(key, score, margin.alias("__m"), F.coalesce(party, F.lit("Unknown")).alias("party")), [-F.col("__m"), -F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(-1.0)), F.lit(-1.0))], key, "__place")
    cuts = sorted({r["flips"] for r in settings.select("flips").distinct().collect()})  # one number a setting
    moved = placed.groupBy("party").agg(*(F.count(F.when(F.col("__place") <= c, 1)).alias(f"m{i}") for i, c in enumerate(cuts)))
    long = moved.select("party", F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("flips"), F.col(f"m{i}").alias("moved")) for i, c in enumerate(cuts)))).alias("x")).select("party", "x.*")
    every = settings.crossJoin(F.broadcast(party_totals(links, party).select(F.col("party").alias("__p"), "total")))  # settings x parties, a fixed few
    met = every.join(long, (every["__p"] == long["party"]) & (every["flips"] == long["flips"]), "left").drop(long["flips"])
    change = F.coalesce(F.col("moved"), F.lit(0)) / F.col("total")
    out = met.groupBy("share", "min_margin", "n", "motions", "flips").agg(F.max(change).alias("max_shift"), F.avg(change).alias("mean_shift"))
    votes = F.col("n") - F.col("motions")
    ratio = (F.col("motions") + F.col("flips")) / F.greatest(F.lit(1), votes - F.col("flips"))
    base = F.col("motions") / F.greatest(F.lit(1), votes)
    short = F.greatest(F.lit(0.0), base + max(0.0, min_gain) - ratio) * 1000.0
    error = F.abs(F.ln((ratio + 1e-9) / (target_ratio + 1e-9)))
    return out.withColumns({"ratio": ratio, "ratio_error": error}).withColumn("fitness", weights[0] * F.col("max_shift") + weights[1] * F.col("mean_shift") + weights[2] * F.col("ratio_error") + short)


def scenario_spread(parties: Mapping[str, Sequence[Mapping[str, float | None]]], params: Sequence[float], weights: tuple[float, float, float] = (1.0, 0.5, 0.5), base: str = "fair") -> float:
    """How far parties' uphold scores move between scenarios at (motion share, vote share, fulfilment fill, contradiction fill, penalty power): less is better.

    parties: scenario -> rows with party, sm, sv, voted, not_voted, contradiction, alignment. The largest range, the mean range and what
    the base scenario's deviation lacks of 0.05 are weighed.
    """
    motion, vote, fill, missing = (min(1.0, max(0.0, float(x))) for x in params[:4])
    power = min(2.5, max(0.1, float(params[4])))
    scores: dict[str, dict[str, float]] = {}
    for scenario, rows in parties.items():
        for r in rows:
            said = 1 - (motion * r["sm"] + (1 - motion) * r["sv"])
            met, unmet = r.get("voted") or 0.0, r.get("not_voted") or 0.0
            pathway = met / (met + unmet) if met + unmet > 0 else fill
            aligned = fill if r.get("alignment") is None else r["alignment"]
            against = missing if r.get("contradiction") is None else r["contradiction"]
            scores.setdefault(r["party"], {})[scenario] = said * (vote * aligned + (1 - vote) * pathway) * (1 - against) ** power
    ranges = [max(v.values()) - min(v.values()) for v in scores.values()]
    if not ranges:
        return 0.0
    first = base if base in parties else next(iter(parties))
    spread = float(np.std([v[first] for v in scores.values() if first in v]))
    return weights[0] * max(ranges) + weights[1] * sum(ranges) / len(ranges) + weights[2] * max(0.0, 0.05 - spread)


def random_search(fit_score, grid: Mapping[str, Sequence], draws: int = 20, seed: int = 42) -> tuple[dict, float]:
    """The best of `draws` settings drawn from a grid by seed (first of equals); fit_score(setting) is larger for better ones."""
    rng = np.random.default_rng(seed)
    best, top = {}, -math.inf
    for _ in range(draws):
        setting = {k: v[int(rng.integers(len(v)))] for k, v in grid.items()}
        got = float(fit_score(setting))
        if got > top:
            best, top = setting, got
    return best, top


def evolve(score, bounds: Sequence[tuple[float, float]], population: int = 40, generations: int = 30, seed: int = 42) -> tuple[np.ndarray, float]:
    """A genetic search on the driver over a few parameters; score reads aggregates computed once."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds).T
    pop = rng.uniform(lo, hi, (population, len(lo)))
    best, top = pop[0], -math.inf
    for _ in range(generations):
        fit = np.array([score(x) for x in pop])
        order = np.argsort(-fit, kind="stable")
        if fit[order[0]] > top:
            best, top = pop[order[0]].copy(), float(fit[order[0]])
        elite = pop[order[: max(2, population // 5)]]
        a, b = elite[rng.integers(len(elite), size=(2, population))]
        mix = rng.uniform(size=(population, len(lo)))
        pop = np.clip(mix * a + (1 - mix) * b + rng.normal(0, 0.05, mix.shape) * (hi - lo), lo, hi)
        pop[0] = best
    return best, top
