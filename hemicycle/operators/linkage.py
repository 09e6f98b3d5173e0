"""Linking statements to items: explicit references, bridges, nearest in time, similarity, ladders, rebalancing.

Every choice is a window or a join with a total order, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.clean import clean_doc_id, days_between
from hemicycle.operators.rows import first_row, global_rank
from hemicycle.storage import written


def alias_table(items: DataFrame, ids: Sequence[str], session: str | None = None, code: str | None = None, order: str = "item_id") -> DataFrame:
    """alias -> item_id over id columns and session/code spellings; of items that share an alias the last by `order`."""
    parts = [items.select(F.lower(clean_doc_id(c)).alias("alias"), "item_id", F.col(order).alias("__o")) for c in ids]
    if code:
        spaced = F.regexp_replace(F.col(code), r"^(\p{L}+)(\d+)$", "$1 $2")
        spellings = [F.col(code), spaced]
        if session:
            spellings += [F.concat(F.col(session), F.lit(sep), F.col(code)) for sep in (":", ": ", " ")]
        parts += [items.select(F.lower(clean_doc_id(s)).alias("alias"), "item_id", F.col(order).alias("__o")) for s in spellings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_row(out.where("alias is not null"), ["alias"], [F.col("__o").desc_nulls_last(), F.col("item_id").desc()]).drop("__o")


def reference_candidates(rows: DataFrame, key: str, fields: Sequence[str], texts: Sequence[str], pattern: str, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ordered distinct items a row refers to: fields in order, then ids found in texts; an id counts before an alias."""
    fixed = [F.struct(F.lit(i).alias("rank"), F.lit(0).alias("pos"), F.lit(c).alias("source"), clean_doc_id(c).alias("ref")) for i, c in enumerate(fields)]

    def found(i: int, c: str) -> Column:
        ids = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"(?U)({pattern})"), F.lit(1))
        return F.transform(ids, lambda r, p: F.struct(F.lit(len(fields) + i).alias("rank"), p.alias("pos"), F.lit(c).alias("source"), r.alias("ref")))

    refs = rows.select(F.col(key), F.explode(F.concat(F.array(*fixed), *(found(i, c) for i, c in enumerate(texts)))).alias("r")).select(key, "r.*").where("ref is not null").withColumn("ref", F.lower("ref"))
    by_id = ids.select(F.lower("item_id").alias("ref"), F.col("item_id").alias("by_id")).distinct()
    by_alias = aliases.select(F.col("alias").alias("ref"), F.col("item_id").alias("by_alias"))
    met = refs.join(by_id, "ref", "left").join(by_alias, "ref", "left").withColumn("item_id", F.coalesce("by_id", "by_alias")).where("item_id is not null")
    return first_row(met.select(key, "item_id", "source", "rank", "pos"), [key, "item_id"], [F.col("rank"), F.col("pos"), F.col("source")])


def pick_reference(candidates: DataFrame, key: str, party: str, item_party: str) -> DataFrame:
    """The first candidate of the row's own party, else the first."""
    same = F.coalesce((F.col(party) == F.col(item_party)).cast("int"), F.lit(0))
    return first_row(candidates, [key], [same.desc(), F.col("rank"), F.col("pos"), F.col("item_id")])


def pick_bridged(candidates: DataFrame, key: str, party: str, category_match: Column, date: str, item_party: str, item_date: str, weight: str) -> DataFrame:
    """Party, then category where the party-kept candidates have it, then fewest days, then most weight."""
    p = F.coalesce((F.col(party) == F.col(item_party)).cast("int"), F.lit(0))
    c = F.coalesce(category_match.cast("int"), F.lit(0))
    days = days_between(date, item_date)
    return first_row(candidates.withColumn("days_diff", days), [key], [p.desc(), c.desc(), F.col("days_diff").asc_nulls_last(), F.col(weight).desc_nulls_last(), F.col("item_id")])


def nearest_in_time(left: DataFrame, right: DataFrame, on: Sequence[str], key: str, date: str, item: str, item_date: str, window_days: int = 90) -> DataFrame:
    """key, item and days_diff: for each left row the right row of equal `on` nearest in time within the window.

    Days count as floor(|difference|), and of items at the same number of days the smallest is taken. No pairs
    are formed: the nearest times on either side are carried along the ordered rows of a day (and from
    day to day over a table of days), then the smallest item of the two one-day ranges at that distance is
    the lesser of a running minimum up to a range's end and one from its start on. Rows are ordered within
    (on, day) only, so a frequent `on` is split by day.
    """
    keys, day = list(on), 86_400_000_000
    width = window_days * day
    of = lambda c: F.floor(c / F.lit(day)).cast("long")
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    mine = left.where(there & F.col(date).isNotNull()).select(*keys, F.col(key), F.unix_micros(F.col(date).cast("timestamp")).alias("__t"))
    held = right.where(there & F.col(item_date).isNotNull()).groupBy(*keys, F.unix_micros(F.col(item_date).cast("timestamp")).alias("__t")).agg(F.min(item).alias("__item"))
    both = mine.withColumn("__r", F.lit(None).cast("long")).unionByName(held.withColumn("__r", F.col("__t")).drop("__item"), allowMissingColumns=True).withColumn("__d", of(F.col("__t")))
    w = Window.partitionBy(*keys, "__d").orderBy("__t")
    past, ahead = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumns({"__p": F.max("__r").over(past), "__n": F.min("__r").over(ahead)}).where("__r is null")
    v = Window.partitionBy(*keys).orderBy("__d")
    days = both.groupBy(*keys, "__d").agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi"))
    days = days.select(*keys, "__d", F.max("__hi").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__lo").over(v.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    near = near.join(days, [*keys, "__d"])
    gap = F.least(F.col("__t") - F.coalesce("__p", "__before"), F.coalesce("__n", "__after") - F.col("__t"))
    near = near.withColumn("__gap", gap).where(F.col("__gap") <= width).select(*keys, key, "__t", of(F.col("__gap")).alias("days_diff"))
    at = F.col("days_diff") * day
    # both ends of the range before and of the one after; at the window's very edge a range is a single moment
    edge = F.col("days_diff") == window_days
    ends = [(F.col("__t") - at, "up"), (F.col("__t") - at - F.when(edge, 0).otherwise(day - 1), "down"), (F.col("__t") + at + F.when(edge, 0).otherwise(day - 1), "up"), (F.col("__t") + at, "down")]
    probes = near.select(*keys, key, "days_diff", edge.alias("__edge"), F.explode(F.array(*(F.struct(t.alias("__t"), F.lit(d).alias("__dir")) for t, d in ends))).alias("x")).select(*keys, key, "days_diff", "__edge", "x.*")
    table = probes.unionByName(held, allowMissingColumns=True).withColumn("__d", of(F.col("__t")))
    now = w.rangeBetween(Window.currentRow, Window.currentRow)
    best = F.when(F.col("__edge"), F.min("__item").over(now)).when(F.col("__dir") == "up", F.min("__item").over(past)).otherwise(F.min("__item").over(ahead))
    return table.withColumn("__best", best).where("__dir is not null and __best is not null").groupBy(key, "days_diff").agg(F.min("__best").alias(item)).select(key, item, "days_diff")


def token_overlap(left: DataFrame, right: DataFrame, key: str, item: str, left_tokens: str, right_tokens: str, threshold: float, block: Sequence[str] = ()) -> DataFrame:
    """Per left row the right row with the largest |A & B| / |B| of at least the threshold.

    Of the n tokens of B at least ceil(threshold * n) must occur in A, so one of its n - ceil(threshold * n) + 1
    rarest ones (among all B) does: only these are indexed, and pairs that meet are compared in full.
    """
    a = left.select(key, *block, F.array_distinct(left_tokens).alias("__a"))
    b = right.select(item, *block, F.array_distinct(right_tokens).alias("__b")).withColumn("__n", F.size("__b")).where("__n > 0")
    probes = a.select(key, *block, F.explode("__a").alias("t"))
    each = b.select(item, *block, "__n", F.explode("__b").alias("t"))
    spread = each.join(each.groupBy("t").agg(F.count("*").alias("__often")), "t")
    place = F.row_number().over(Window.partitionBy(item, *block).orderBy("__often", "t"))
    rare = spread.withColumn("__k", place).where(F.col("__k") <= F.col("__n") - F.ceil(F.col("__n") * threshold - 1e-9) + 1).select(item, *block, "t")
    met = probes.join(rare, [*block, "t"]).select(key, item, *block).distinct()
    scored = met.join(a, [key, *block]).join(b, [item, *block]).withColumn("similarity", F.size(F.array_intersect("__a", "__b")) / F.col("__n")).where(F.col("similarity") >= threshold)
    return first_row(scored, [key], [F.col("similarity").desc(), F.col(item)]).select(key, item, "similarity")


def semantic_best(left: DataFrame, right: DataFrame, block: Sequence[str], key: str, item: str, left_vector: str, right_vector: str, threshold: float, k: int = 1, pack: int = 512) -> DataFrame:
    """Per left row the k right rows of its block with the highest cosine of at least the threshold (ties: the smaller item).

    A block's vectors stand in packs of about `pack`, dealt by hash; packs of the two sides meet, each pair is one
    matrix product, and k candidates a row leave it. Vectors without length have the similarity 0.
    """
    keys = list(block)

    def packs(rows: DataFrame, name: str, vector: str, ids: str, vs: str) -> DataFrame:
        held = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = held.groupBy(*keys).agg(F.ceil(F.count("*") / pack).alias("__packs"))
        dealt = held.join(n, keys).groupBy(*keys, F.pmod(F.xxhash64("id"), "__packs").alias("__pack"))
        return dealt.agg(F.collect_list(F.struct("id", "v")).alias("x")).select(*keys, F.col("x.id").alias(ids), F.col("x.v").alias(vs))

    met = packs(left, key, left_vector, "a_ids", "a").join(packs(right, item, right_vector, "b_ids", "b"), keys).select("a_ids", "a", "b_ids", "b")
    kinds = dict(left.dtypes)[key], dict(right.dtypes)[item]

    def unit(lists) -> np.ndarray:
        wide = max((len(v) for v in lists), default=0)
        m = np.array([list(v) + [0.0] * (wide - len(v)) for v in lists], float).reshape(len(lists), wide)
        m = np.nan_to_num(m)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a_ids, a, b_ids, b = (batch.column(c)[r].as_py() for c in range(4))
                x, y = unit(a), unit(b)
                wide = min(x.shape[1], y.shape[1])
                s = np.round(x[:, :wide] @ y[:, :wide].T, 9)
                order = sorted(range(len(b_ids)), key=b_ids.__getitem__)
                s, names = s[:, order], [b_ids[i] for i in order]
                out = []
                for i, own in enumerate(a_ids):
                    top = [j for j in np.argsort(-s[i], kind="stable")[: k + 1].tolist() if names[j] != own and s[i, j] >= threshold][:k]
                    out += [(own, names[j], float(s[i, j])) for j in top]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type.value_type), pa.array(cols[1], batch.column(2).type.value_type), pa.array(cols[2], pa.float64())], names=[key, item, "similarity"])

    found = met.mapInArrow(search, f"{key} {kinds[0]}, {item} {kinds[1]}, similarity double")
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), F.col(item)))
    return found.withColumn("rank", n).where(F.col("rank") <= k).select(key, item, "rank", "similarity")


def cascade(rows: DataFrame, key: str, *stages) -> DataFrame:
    """Stages (name, function of the rows still unlinked -> links with `key`), each fed what the earlier left over.

    Each stage's links are written to the shared folder, so a later stage does not compute the earlier ones again.
    """
    rest, out = rows, None
    for name, stage in stages:
        links = written(stage(rest).withColumn("link_source", F.lit(name)), f"links-{name}")
        out = links if out is None else out.unionByName(links, allowMissingColumns=True)
        rest = rest.join(links.select(key), key, "left_anti")
    return out


#: The rungs of the fallback ladder in order: name, columns that must agree, vote required.
FALLBACK = (
    ("party_category_vote", ("party", "category"), True), ("party_category", ("party", "category"), False), ("party_vote", ("party",), True), ("party", ("party",), False),
    ("category_vote", ("category",), True), ("category", ("category",), False), ("vote_any", (), True), ("any", (), False),
)
#: The rungs of the graph ladder.
GRAPH = (
    ("signatory_party_category", ("signatory", "party", "category"), False), ("signatory_party", ("signatory", "party"), False), ("signatory_category", ("signatory", "category"), False), ("signatory", ("signatory",), False),
    ("party_category", ("party", "category"), False), ("party", ("party",), False), ("category", ("category",), False), ("any", (), False),
)


def ladder(rows: DataFrame, items: DataFrame, rungs=FALLBACK, prefix: str = "fallback", multi_key_only: bool = False, best: Sequence[str] = ("has_vote", "weight"), carry: Sequence[str] = ()) -> DataFrame:
    """rows with target_id and link_source from the first rung that holds an item; with `carry` also `target`, a struct of the item's id and those columns.

    Each rung's items are first reduced to the best one per key (vote, weight, then id), so a rung is
    one join with a table of unique keys. multi_key_only leaves out the rungs with a single key.
    """
    order = [F.col(c).desc_nulls_last() for c in best] + [F.col("item_id")]
    out, chosen = rows, []
    for name, keys, vote in rungs:
        if multi_key_only and len(keys) + vote == 1 and keys:
            continue
        held = items.where("has_vote") if vote else items
        for k in keys:
            held = held.where(F.col(k).isNotNull() & (F.col(k) != ""))
        if keys:
            top = first_row(held, keys, order).select(*keys, F.struct("item_id", *carry).alias(f"__{name}"))
            out = out.join(top, list(keys), "left")
        else:
            top = held.orderBy(*order).limit(1).agg(F.first(F.struct("item_id", *carry)).alias(f"__{name}"))
            out = out.crossJoin(F.broadcast(top))  # one row
        chosen.append(name)
    target = F.coalesce(*(F.col(f"__{n}") for n in chosen))
    source = F.coalesce(*(F.when(F.col(f"__{n}").isNotNull(), F.lit(f"{prefix}:{n}")) for n in chosen))
    out = out.withColumns({"target": target, "link_source": source}).withColumn("target_id", F.col("target.item_id")).drop(*(f"__{n}" for n in chosen))
    return out if carry else out.drop("target")


def edge_score(signatory: Column, party: Column, category: Column, days: Column, prior: Column, half_life: float = 120.0) -> Column:
    """.40 signatory + .25 party + .20 category + .10 nearness in time + .05 prior; what is missing counts 0."""
    on = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    near = F.coalesce(0.10 / (1 + days / max(1.0, half_life)), F.lit(0.0))
    # in hundredths, whose sums are exact: the score's double is the decimal's nearest
    return (40 * on(signatory) + 25 * on(party) + 20 * on(category)) / 100 + near + 5 * on(prior) / 100


def accept_direct(links: DataFrame, vote_score: str, motion_score: str, fallback_score: str, min_score: float = 0.58, margin: float = 0.04) -> DataFrame:
    """The better of two candidates (the vote on ties) where it is good enough and beats the fallback by the margin."""
    v, m = F.coalesce(vote_score, F.lit(-1.0)), F.coalesce(motion_score, F.lit(-1.0))
    best = F.greatest(v, m)
    ok = (best >= min_score) & (best >= F.coalesce(fallback_score, F.lit(0.0)) + margin)
    return links.withColumns({"best_score": best, "accepted": F.when(ok, F.when(v >= m, "vote").otherwise("motion"))})


def reuse_existing(rows: DataFrame, existing: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Keep an earlier link if its item still exists; else mark the fallback as one after a stale link."""
    old = first_row(existing.select(key, F.col("target_id").alias("__t"), F.coalesce("link_source", F.lit("existing")).alias("__s")), [key], [F.col("__t").asc_nulls_last(), F.col("__s")])
    known = items.select(F.col("item_id").alias("__t")).distinct().withColumn("__known", F.lit(True))
    met = rows.join(old, key, "left").join(known, "__t", "left")
    fresh = F.col("__known").isNotNull()
    source = F.when(fresh, F.concat(F.lit("existing:"), "__s")).when(F.col("__t").isNotNull(), F.concat(F.lit("fallback_after_stale_existing:"), F.regexp_replace("link_source", "^fallback:", ""))).otherwise(F.col("link_source"))
    return met.withColumns({"target_id": F.when(fresh, F.col("__t")).otherwise(F.col("target_id")), "link_source": source}).drop("__t", "__s", "__known")


def eligible(min_margin: float | None = None) -> tuple[Column, Column]:
    """Whether a link may be turned into its motion candidate, and its margin (-1 where it is missing)."""
    margin = F.coalesce(F.nanvl(F.col("margin").cast("double"), F.lit(None).cast("double")), F.lit(-1.0))
    old = F.coalesce(F.col("link_source").startswith("existing:"), F.lit(False))
    ok = (F.col("action_type") == "vote") & ~old & F.coalesce(F.col("motion_candidate").cast("string") != "", F.lit(False))
    return (ok if min_margin is None else ok & (margin >= min_margin)), margin


def rebalance(links: DataFrame, share: float, min_margin: float = 0.0, key: str = "item_id") -> DataFrame:
    """Turn as many vote links into motion links as bring motions to `share` of all.

    Eligible: votes that are no earlier link, have a motion candidate and lose at most by the margin;
    best margin first, then score, then key. The number needed is one aggregate; the flips are those whose
    place in that order (global_rank, no single task) is within it.
    """
    need = links.agg(F.greatest(F.lit(0), F.ceil(F.lit(min(1.0, max(0.0, share))) * F.count("*")) - F.count(F.when(F.col("action_type") == "motion", 1))).alias("need"))
    ok, margin = eligible(min_margin)
    order = [-margin, F.col("score").isNull(), -F.col("score")]
    places = global_rank(links.where(ok).select(key, "margin", "score"), order, key, "__place").crossJoin(F.broadcast(need))  # one row
    flips = places.where(F.col("__place") <= F.col("need")).select(key, F.lit(True).alias("rebalanced"))
    out = links.join(flips, key, "left").withColumn("rebalanced", F.coalesce("rebalanced", F.lit(False)))
    return out.withColumns({"action_type": F.when(F.col("rebalanced"), "motion").otherwise(F.col("action_type")), "action_id": F.when(F.col("rebalanced"), F.col("motion_candidate")).otherwise(F.col("action_id")), "link_source": F.when(F.col("rebalanced"), "graph_rebalanced_motion").otherwise(F.col("link_source"))})
