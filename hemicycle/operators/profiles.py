"""Weighted profiles, comparisons, say-versus-do measures, votes and trends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import vectors as V
from hemicycle.functions.clean import col, days_between, group_share
from hemicycle.operators.rows import first_row, join_null_safe, outer_merge, union_all
from hemicycle.schemas import AXIS


def profile(labels: DataFrame, keys: Sequence[str], agg: str = "avg", weight: str = "weight", times: str | None = None) -> DataFrame:
    """Mean or sum of weights by keys and category, and its share of the keys' total."""
    w = F.col(weight) if times is None else F.col(weight) * F.col(times)
    out = labels.groupBy(*keys, "category").agg((F.avg(w) if agg == "avg" else F.sum(w)).alias("value"))
    return out.withColumn("proportion", group_share("value", *keys))


def category_matrix(labels: DataFrame, keys: Sequence[str], categories: Sequence[str] = AXIS, value: str = "weight") -> DataFrame:
    """One vector per key: mean value per category, at least 0, divided by the sum (uniform if zero)."""
    wide = labels.groupBy(*keys).pivot("category", list(categories)).agg(F.avg(value))
    v = F.array(*(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)) for c in categories))
    return wide.select(*keys, V.proportions(v).alias("vector"))


def compare(vectors: DataFrame, pairs: Sequence[tuple[str, str]], key: str, kind: str = "modality") -> DataFrame:
    """Distances between the kinds' vectors of each key."""
    a, b = (vectors.select(F.col(key), F.col(kind).alias(k), F.col("vector").alias(v)) for k, v in (("left_kind", "a"), ("right_kind", "b")))
    wanted = F.array(*(F.lit(f"{x}|{y}") for x, y in pairs))
    met = a.join(b, key).where(F.array_contains(wanted, F.concat_ws("|", "left_kind", "right_kind")))
    return met.select(key, F.concat_ws("_vs_", "left_kind", "right_kind").alias("comparison"), V.js_distance("a", "b").alias("js_distance"), V.cosine_distance("a", "b").alias("cosine_distance"), V.euclidean("a", "b").alias("euclidean"))


def recency_weight(date, as_of, rate: float | None = None, half_life: float | None = None) -> Column:
    """exp(-rate * years) or 0.5 ** (years / half_life) of the age; 1 without a date."""
    years = F.greatest(days_between(as_of, date, floor_first=True) / 365.25, F.lit(0.0))
    w = F.exp(-rate * years) if rate is not None else F.exp(-math.log(2) / half_life * years)
    return F.coalesce(w, F.lit(1.0))


def recency_profile(labels: DataFrame, keys: Sequence[str], date: str, rate: float = 0.3, as_of: Column | None = None) -> DataFrame:
    """profile() of weights that fade from the latest date on."""
    last = labels.agg(F.max(date).alias("__as_of"))
    rows = labels.crossJoin(F.broadcast(last)) if as_of is None else labels.withColumn("__as_of", as_of)  # one row
    rows = rows.withColumn("weight", F.col("weight") * recency_weight(date, "__as_of", rate))
    return profile(rows, keys, "sum")


def half_life_means(rows: DataFrame, keys: Sequence[str], year: str, values: Sequence[str], half_life: float) -> DataFrame:
    """Means that weigh a year by 0.5 ** (age / half_life), nulls left out; with years seen and the latest."""
    latest = rows.agg(F.max(year).alias("__last"))
    w = F.pow(F.lit(0.5), (F.col("__last") - F.col(year)) / half_life)
    mean = lambda v: F.try_divide(F.sum(w * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v)
    return rows.crossJoin(F.broadcast(latest)).groupBy(*keys).agg(*map(mean, values), F.countDistinct(year).alias("n_years"), F.max(year).alias("latest_year"))


def weighted_mean(value, weight) -> Column:
    """Sum(w * v) / sum(w), or the plain mean where weights do not sum to more than 0."""
    v, w = col(value), col(weight)
    s = F.sum(F.when(v.isNotNull(), w))
    return F.when(s > 0, F.try_divide(F.sum(v * w), s)).otherwise(F.avg(v))


def mean_of(*cols) -> Column:
    """Row mean of those that are not null."""
    present = sum((col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(sum((F.coalesce(col(c), F.lit(0.0)) for c in cols), F.lit(0.0)), F.nullif(present, F.lit(0)))


def index_by_year(pathways: DataFrame, index: str) -> DataFrame:
    """Weighted mean index by (party, year) for counts S, M and V; action is the mean of M and V."""
    x = F.when(~F.isnan(F.col(index).cast("double")), F.col(index))
    mean = lambda w: F.when(F.sum(F.when(x.isNotNull(), F.col(w))) > 0, F.sum(x * F.col(w)) / F.sum(F.when(x.isNotNull(), F.col(w))))
    out = pathways.groupBy("party", "year").agg(mean("S").alias("speech_index"), mean("M").alias("motion_index"), mean("V").alias("vote_index"))
    return out.withColumn("action_index", mean_of("motion_index", "vote_index"))


def pathways(said: DataFrame, moved: DataFrame, voted: DataFrame, keys: Sequence[str] = ("party", "topic", "year")) -> DataFrame:
    """Counts S, M, V by nullable keys and the shares of S that were voted on, only moved, or neither."""
    s, m = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((said, "S"), (moved, "M")))
    v = voted.groupBy(*keys).agg(F.sum("vote_weight").alias("V"))
    out = join_null_safe(join_null_safe(s, m, keys), v, keys).fillna(0, ["S", "M", "V"])
    sm = F.least("S", "M")
    smv = F.least(sm, F.col("V"))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("S")), F.lit(0.0))
    return out.withColumns({"pct_vote": share(smv), "pct_motion": share(sm - smv), "pct_none": share(F.col("S") - sm)})


def mean_by(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Means by a key; rows without key are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.avg(v).alias(v) for v in values))


def drift(frames: dict[str, DataFrame], index: str = "index") -> DataFrame:
    """Mean index by party, modality and year over several sources."""
    rows = union_all(*(df.select("party", F.lit(k).alias("modality"), "year", F.col(index).alias("index")) for k, df in frames.items()))
    return rows.where("party is not null and year is not null").groupBy("party", "modality", "year").agg(F.avg("index").alias("mean_index"))


def expected_contradiction(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confidence-weighted mean score within [0, 1], with counts."""
    mean = F.try_divide(F.sum(F.col("confidence") * F.col("score")), F.nullif(F.sum("confidence"), F.lit(0.0)))
    return edges.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(mean, F.lit(0.0)))).alias("expected"), F.count("*").alias("n_edges"), F.countDistinct("item_id").alias("n_items"), F.avg("confidence").alias("mean_confidence"))


def crosstab(rows: DataFrame, a: str, b: str, keep_null: bool = False) -> DataFrame:
    """Counts of (a, b) with their share within a."""
    rows = rows if keep_null else rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def multilabel_crosstab(rows: DataFrame, key: str, group: str, flags: Sequence[str]) -> DataFrame:
    """Flags summed by group, as rows, with their share of the group's distinct keys."""
    wide = rows.groupBy(group).agg(*(F.sum(f).alias(f) for f in flags), F.countDistinct(key).alias("n_items"))
    return wide.unpivot([group, "n_items"], list(flags), "label", "n").withColumn("share", F.col("n") / F.col("n_items"))


def strata_stability(rows: DataFrame, stratum: str, value: str, strata: Sequence[str], enough: int = 100) -> DataFrame:
    """Overall and per-stratum n, mean and deviation, side by side, and each mean's distance from the whole."""
    one = lambda cond, name: [F.count(F.when(cond, F.col(value))).alias(f"n_{name}"), F.avg(F.when(cond, F.col(value))).alias(f"mean_{name}"), F.stddev_samp(F.when(cond, F.col(value))).alias(f"sd_{name}")]
    out = rows.agg(*one(F.lit(True), "all"), *(x for s in strata for x in one(F.col(stratum) == s, s)))
    return out.withColumns({f"delta_{s}": F.col(f"mean_{s}") - F.col("mean_all") for s in strata} | {f"stable_{s}": F.col(f"n_{s}") >= enough for s in strata})


def centroids(labels: DataFrame, actor: str, categories: Sequence[str]) -> DataFrame:
    """Per item the sum by category, then the mean of those by actor, as a vector."""
    item = labels.groupBy("item_id", actor).pivot("category", list(categories)).agg(F.sum("weight")).fillna(0.0)
    return item.groupBy(actor).agg(F.array(*(F.avg(f"`{c}`") for c in categories)).alias("vector"))


def polarisation(rows: DataFrame, actor: str, period: str, positions: dict[str, float]) -> DataFrame:
    """Mean position by actor and period, then the population deviation across actors."""
    pos = F.create_map(*(F.lit(x) for kv in positions.items() for x in kv))[F.col("category")]
    by = rows.groupBy(actor, period).agg((F.sum(pos * F.col("weight")) / F.sum("weight")).alias("position"))
    return by.groupBy(period).agg(F.stddev_pop("position").alias("polarisation"), F.count("*").alias("n_actors"))


def consistency(gaps: DataFrame, keys: Sequence[str], motion_share: float = 0.5) -> DataFrame:
    """Gaps by comparison to consistency and action cohesion."""
    wide = gaps.groupBy(*keys).pivot("comparison", ["speech_vs_motion", "speech_vs_vote", "motion_vs_vote"]).agg(F.avg("js_distance"))
    sm, sv, mv = (F.col(c) for c in ("speech_vs_motion", "speech_vs_vote", "motion_vs_vote"))
    share = min(1.0, max(0.0, motion_share))
    return wide.withColumns({"consistency": 1 - (share * sm + (1 - share) * sv), "cohesion": 1 - mv})


def conditional_fulfilment(voted, not_voted) -> Column:
    """Share of the statements with a motion that also reached a vote; null where none has a motion."""
    v, n = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) for c in (voted, not_voted))
    return F.try_divide(v, F.nullif(v + n, F.lit(0.0)))


def composite(rows: DataFrame, vote_alignment: str, pathway: str, contradiction: str, consistent: str, vote_share: float = 0.5, power: float = 1.0, fill: float = 0.5) -> DataFrame:
    """Vote alignment mixed with pathway fulfilment (missing: fill), times consistency and (1 - contradiction) ** power; also consistency under the penalty alone."""
    share = min(1.0, max(0.0, vote_share))
    v, m = (F.coalesce(c, F.lit(fill)) for c in (vote_alignment, pathway))
    penalty = F.pow(1 - F.coalesce(contradiction, F.lit(0.0)), F.lit(power))
    out = rows.withColumns({"fulfilment": share * v + (1 - share) * m, "penalty": penalty})
    return out.withColumns({"adjusted": F.col(consistent) * F.col("penalty"), "uphold": F.col(consistent) * F.col("fulfilment") * F.col("penalty")})


def strength(c) -> Column:
    """A number from a strength field; what is none, or 0, counts as 1."""
    n = col(c).try_cast("double")
    return F.coalesce(F.nullif(F.nanvl(n, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def half_life_profile(labels: DataFrame, keys: Sequence[str], date: str, half_life_days: float, as_of: Column, strength_col: str | None = None) -> DataFrame:
    """profile() of weights that halve every half_life_days before as_of, times a numeric strength."""
    w = F.col("weight") * recency_weight(F.col(date), as_of, half_life=half_life_days / 365.25)
    rows = labels.withColumn("weight", w if strength_col is None else w * strength(strength_col))
    return profile(rows, keys, "sum")


def yearly_statistics(rows: DataFrame, year: str, value: str, key: str) -> DataFrame:
    """Median, mean and number of distinct keys by year; NaN counts as missing."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return rows.groupBy(year).agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.countDistinct(key).alias("n_keys"))


def period_profile(labels: DataFrame, actor: str, period: str) -> DataFrame:
    """profile() of summed weights by actor and period; labels without a period are left out."""
    return profile(labels.where(F.col(period).isNotNull()), [actor, period], "sum")


def consistency_by_year(scores: DataFrame, topics: DataFrame, value: str, unknown: Sequence[str] = ("unknown", "nyd", "")) -> DataFrame:
    """A party's yearly mean of `value` over topics times its consistency; unknown parties, and years or values that are no numbers, are left out."""
    year, v = F.col("year").try_cast("double"), F.nanvl(F.col(value).try_cast("double"), F.lit(None).cast("double"))
    held = topics.where(~F.lower(F.coalesce("party", F.lit(""))).isin(*unknown)).select("party", year.alias("year"), v.alias(value)).where(F.col("year").isNotNull() & ~F.isnan("year"))
    yearly = held.groupBy("party", F.col("year").cast("int").alias("year")).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())
    return yearly.join(scores.select("party", "consistency"), "party", "left").withColumn("metric", F.col("consistency") * F.col(value))


def fill_benchmark(keys: DataFrame, waves: DataFrame, score: str = "score") -> DataFrame:
    """A score for each (party, year) of keys from a benchmark's waves: the year's own, else the last one of the party's before (of its keys' years), else the next.

    waves may hold several rows by party and year (their mean counts). `imputed` marks years without a wave; parties without any are left out.
    """
    mean = waves.where(F.col(score).isNotNull() & F.col("year").isNotNull()).groupBy("party", F.col("year").cast("int").alias("year")).agg(F.avg(score).alias("__w"))
    full = keys.select("party", F.col("year").cast("int").alias("year")).where("year is not null").distinct().join(mean, ["party", "year"], "left")
    return carry(full, "party", "year", "__w").where("filled is not null").select("party", "year", F.col("filled").alias(score), F.col("__w").isNull().alias("imputed"))


# Votes


def cohesion(votes: DataFrame, vote: str = "vote") -> DataFrame:
    """Per ballot and party the largest share of one answer; its mean, median and number by year and party. No answer is an answer."""
    by = votes.groupBy("year", "party", "vote_id", F.coalesce(vote, F.lit("none")).alias("answer")).agg(F.count("*").alias("n"))
    ballot = by.groupBy("year", "party", "vote_id").agg((F.max("n") / F.sum("n")).alias("cohesion"))
    return ballot.groupBy("year", "party").agg(F.avg("cohesion").alias("mean_cohesion"), F.median("cohesion").alias("median_cohesion"), F.count("*").alias("n_votes"))


def majority_positions(votes: DataFrame, ballot: str = "vote_id", party: str = "party", answer: str = "vote") -> DataFrame:
    """A party's most frequent answer in each ballot, the smallest on ties."""
    n = votes.where(F.col(party).isNotNull() & F.col(answer).isNotNull()).groupBy(ballot, party, answer).agg(F.count("*").alias("n"))
    return first_row(n, [ballot, party], [F.col("n").desc(), F.col(answer)]).select(ballot, party, answer)


def agreement(positions: DataFrame, ballot: str = "vote_id", party: str = "party", answer: str = "vote") -> DataFrame:
    """Share of common ballots in which two parties' positions agree; parties are few."""
    a, b = (positions.select(F.col(ballot), F.col(party).alias(p), F.col(answer).alias(x)) for p, x in (("party_a", "x"), ("party_b", "y")))
    return a.join(b, ballot).groupBy("party_a", "party_b").agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("agreement"), F.count("*").alias("n"))


def answer_shares(votes: DataFrame, key: str, answer: str, answers: Sequence[str]) -> DataFrame:
    """Percent of each answer by key, fixed columns."""
    wide = votes.where(F.col(answer).isin(*answers)).groupBy(key).pivot(answer, list(answers)).count().fillna(0, list(answers))
    total = sum((F.col(f"`{a}`") for a in answers), F.lit(0))
    return wide.select(key, *((100.0 * F.col(f"`{a}`") / total).alias(f"pct_{a}") for a in answers))


def yes_counts(votes: DataFrame, categories: DataFrame, is_yes: Column) -> DataFrame:
    """Yes votes by party and category of what was voted on."""
    return votes.where(is_yes).join(categories, "vote_id").groupBy("party", "category").agg(F.count("*").alias("n_yes"))


# Trends


def yearly_merge(**counts: DataFrame) -> DataFrame:
    """Counts by year of several tables side by side, absent ones 0."""
    return outer_merge([df.where("year is not null").groupBy("year").agg(F.count("*").alias(name)) for name, df in counts.items()], "year")


def monthly_grid(date: str = "date", value: str = "index", **sources: DataFrame) -> DataFrame:
    """Mean value by month of several sources on the gapless grid of months, and their row mean."""
    means = {n: df.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(F.avg(value).alias(n)) for n, df in sources.items()}
    ends = union_all(*(m.select("month") for m in means.values())).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    out = ends.where("lo is not null").select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    for m in means.values():
        out = out.join(m, "month", "left")
    return out.withColumn("mean", mean_of(*means))


def lead_by_value(rows: DataFrame, key: str, year: str, now: str, later: str, lead: int = 1) -> DataFrame:
    """now of a year beside later of the year `lead` on; years without such a successor are left out."""
    nxt = rows.select(F.col(key), (F.col(year) - lead).alias(year), F.col(later).alias(f"{later}_next"))
    return rows.select(key, year, now).join(nxt, [key, year])


def deviation_from_median(rows: DataFrame, year: str, value: str) -> DataFrame:
    med = rows.groupBy(year).agg(F.median(value).alias("median"))
    return rows.join(med, year).withColumn("deviation", F.col(value) - F.col("median"))


def carry(rows: DataFrame, key: str, order: str, value: str, leak: bool = False) -> DataFrame:
    """The last value known, else the next one, within a key; leak: the next one of any key."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = (Window.orderBy(key, order) if leak else w).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = rows.withColumn("__back", back)
    return filled.withColumn("filled", F.coalesce("__back", F.first("__back", ignorenulls=True).over(ahead))).drop("__back")


def interpolate(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Linear between known values by row number, the nearest one beyond the ends."""
    w = Window.partitionBy(key).orderBy(order)
    up, down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = rows.withColumn("__n", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct("__n", value))
    n = n.withColumn("__p", F.last(at, ignorenulls=True).over(up)).withColumn("__q", F.first(at, ignorenulls=True).over(down))
    p, q = F.col(f"__p.{value}"), F.col(f"__q.{value}")
    inner = p + (q - p) * F.try_divide((F.col("__n") - F.col("__p.__n")).cast("double"), F.nullif((F.col("__q.__n") - F.col("__p.__n")).cast("double"), F.lit(0.0)))
    return n.withColumn("filled", F.coalesce(F.col(value), inner, p, q)).drop("__n", "__p", "__q")


def slopes(rows: DataFrame, key: str, x: str, *ys: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.regr_slope(y, x).alias(f"slope_{y}") for y in ys))


def average_rank(value: str, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2.0


def z_score(value: str, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
