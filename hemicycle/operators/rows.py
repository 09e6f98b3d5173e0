"""Row choice, duplicates, set operations and joins with pandas-like null rules made explicit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.clean import blank_to_null, clean_doc_id
from hemicycle.functions.text import repair_json


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key: the first in an order that should end in a unique column."""
    return df.withColumn("__n", _ranked(df, keys, order)).where("__n = 1").drop("__n")


def top_category(labels: DataFrame, item: str = "item_id", category: str = "category", weight: str = "weight") -> DataFrame:
    """The heaviest category of each item, the smallest name on ties; NaN and null weigh least."""
    w = F.when(~F.isnan(weight), F.col(weight))
    return first_row(labels, [item], [w.desc_nulls_last(), F.col(category).asc_nulls_last()])


def top_categories(labels: DataFrame, n: int, item: str = "item_id", category: str = "category", weight: str = "weight") -> DataFrame:
    """Each item's n heaviest categories as an ordered list."""
    order = [F.when(~F.isnan(weight), F.col(weight)).desc_nulls_last(), F.col(category).asc_nulls_last()]
    held = labels.withColumn("__n", _ranked(labels, [item], order)).where(F.col("__n") <= n)
    return held.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("__n", category))).alias("__c")).select(item, F.col(f"__c.{category}").alias("categories"))


def top_per_class(rows: DataFrame, k: int, cls: str, score: str, key: str, threshold: float | None = None) -> DataFrame:
    held = rows if threshold is None else rows.where(F.col(score) >= threshold)
    return held.withColumn("__n", _ranked(held, [cls], [F.col(score).desc_nulls_last(), F.col(key)])).where(F.col("__n") <= k).drop("__n")


def top_global(rows: DataFrame, k: int, score: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(k)


def global_rank(rows: DataFrame, order: Sequence[Column], key: str, name: str = "rank", bucket_rows: int = 250_000) -> DataFrame:
    """Adds each row's exact place (from 1) in one ascending order that ends in the unique `key`.

    Cut points from a sample of some hundred keys a bucket deal the rows out to buckets of about
    `bucket_rows`; places are counted within buckets and shifted by the sizes of those before, so no task
    sorts all rows.
    """
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(key).alias("o_key"))
    held = rows.withColumn("__o", place)
    n = rows.count()
    cuts = []
    if n > bucket_rows:
        wanted = -(-n // bucket_rows)
        keep = max(1, n // (wanted * 200))
        sample = held.where(F.pmod(F.xxhash64(key), F.lit(keep)) == 0).select("__o").orderBy("__o").collect()  # 200 a bucket or so
        cuts = [sample[len(sample) * i // wanted]["__o"] for i in range(1, wanted)] if sample else []
    bucket = F.lit(0)
    if cuts:
        edges = rows.sparkSession.createDataFrame([(cuts,)], f"c array<{held.schema['__o'].dataType.simpleString()}>")
        held = held.crossJoin(F.broadcast(edges))  # one row
        bucket = F.size(F.filter("c", lambda c: c <= F.col("__o")))
    held = held.withColumn("__b", bucket).drop("c")
    sizes = held.groupBy("__b").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per bucket
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__o"))
    return held.withColumn(name, inside).join(F.broadcast(before), "__b").withColumn(name, F.col(name) + F.col("__before")).drop("__o", "__size", "__before")


def latest_rows(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows tied at their key's latest time."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last()))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_row(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def keep_first(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_row(rows, keys, [F.col(c).asc_nulls_last() for c in order])


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which nulls match each other; the keys appear once."""
    r = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(r[f"__{k}"]) for k in keys))
    out = left.join(r, on, how)
    if how in ("full", "outer", "full_outer", "right"):
        out = out.select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in keys else F.col(c) for c in left.columns), *(c for c in r.columns if not c.startswith("__")))
    return out.drop(*(f"__{k}" for k in keys))


def outer_merge(frames: Sequence[DataFrame], key: str, fill: float | int | None = 0) -> DataFrame:
    """Full outer join of frames on one key, absent values filled."""
    out = reduce(lambda a, b: a.join(b, key, "full"), frames)
    return out if fill is None else out.fillna(fill)


def left_fill(left: DataFrame, right: DataFrame, key: str | Sequence[str], **fills) -> DataFrame:
    return left.join(right, key, "left").fillna(fills)


def anti(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return left.join(right, key, "left_anti")


def semi(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return left.join(right, key, "left_semi")


def coalesce_join(left: DataFrame, right: DataFrame, key: str, column: str, empty_is_null: bool = False) -> DataFrame:
    """left with `column` taken from right where left has none."""
    r = right.select(F.col(key), F.col(column).alias("__other"))
    mine = F.nullif(F.col(column), F.lit("")) if empty_is_null else F.col(column)
    return left.join(r, key, "left").withColumn(column, F.coalesce(mine, F.col("__other"))).drop("__other")


def lookup(left: DataFrame, table: DataFrame, key: str, *order: str) -> DataFrame:
    """n:1 lookup; of repeated keys in the table the last by `order` counts."""
    return left.join(keep_last(table, [key], *order), key, "left")


def expand_static(scores: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """A score per actor repeated over the keys at hand."""
    return keys.distinct().join(scores, on, "left")


def bridge(items: DataFrame, refs: DataFrame, votes: DataFrame) -> DataFrame:
    """Items -> reports that refer to them -> votes on those reports.

    refs(session, code, ref_ids as a JSON array); votes(session, code, vote_id). Per item: number of
    distinct votes and the first session, code and vote.
    """
    exploded = refs.select("session", "code", F.explode(F.from_json("ref_ids", "array<string>")).alias("item_id"))
    exploded = exploded.withColumn("item_id", clean_doc_id("item_id")).where("item_id is not null").distinct()
    summary = votes.groupBy("session", "code").agg(F.countDistinct("vote_id").alias("n"), F.min("vote_id").alias("first_vote_id"))
    met = exploded.join(summary, ["session", "code"]).join(items.select("item_id").distinct(), "item_id", "left_semi")
    return met.groupBy("item_id").agg(F.min("session").alias("session"), F.min("code").alias("code"), F.sum("n").alias("vote_count"), F.min("first_vote_id").alias("first_vote_id"))


def needs_label(items: DataFrame, labels: DataFrame, annotated: DataFrame, threshold: float) -> DataFrame:
    """Items whose best weight (0 without one) is below the threshold and that nobody has annotated."""
    best = labels.groupBy("item_id").agg(F.max("weight").alias("top_weight"))
    out = items.join(best, "item_id", "left").withColumn("top_weight", F.coalesce("top_weight", F.lit(0.0)))
    return out.where(F.col("top_weight") < threshold).join(annotated.select("item_id"), "item_id", "left_anti")


def find_items(items: DataFrame, ids: Sequence[str] | None = None, actor: str | None = None, text: str | None = None, column: str = "metadata", limit: int | None = None) -> DataFrame:
    """Conjunction of the filters given."""
    out = items
    if ids:
        out = out.where(F.col("item_id").isin(*ids))
    if actor:
        out = out.where(F.lower("actor") == actor.lower())
    if text:
        out = out.where(F.lower(column).contains(text.lower()))
    return out.limit(limit) if limit else out


def with_text(rows: DataFrame, column: str = "text", longer_than: int = 0) -> DataFrame:
    return rows.where(F.length(F.coalesce(F.col(column), F.lit(""))) > longer_than)


def label_sets(labels: DataFrame, threshold: float) -> DataFrame:
    held = labels.where(F.col("weight") >= threshold)
    return held.groupBy("item_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def with_min_rows(rows: DataFrame, key: str, least: int) -> DataFrame:
    n = rows.groupBy(key).count().where(F.col("count") >= least)
    return rows.join(n, key, "left_semi")


def clean_strings(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: blank_to_null(c) for c in columns})


def row_digest(df: DataFrame) -> DataFrame:
    """Number of rows and an order-independent digest of them."""
    cols = sorted(df.columns)
    h = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]
    return df.select(*(x.alias(f"h{i}") for i, x in enumerate(halves))).agg(F.count("*").alias("n_rows"), *(F.sum(f"h{i}").alias(f"digest{i}") for i in range(2)))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that either side has more often, with the side's name."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def without_values(rows: DataFrame, column: str, excluded: Sequence[str], missing: str = "Unknown") -> DataFrame:
    """Rows whose value is none of the excluded ones, by exact spelling; no value counts as `missing`."""
    held = rows.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    return held.where(~F.col(column).isin(*excluded)) if excluded else held


def with_votes(rows: DataFrame, column: str = "vote_count") -> DataFrame:
    """Rows with at least one vote; a missing or unreadable count is none."""
    return rows.where(F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) > 0)


def next_to_label(items: DataFrame, labels: DataFrame, annotated: DataFrame, threshold: float, date: str = "date") -> DataFrame:
    """The one item that needs a label most: the latest of needs_label(), the smallest id on ties."""
    return needs_label(items, labels, annotated, threshold).orderBy(F.col(date).desc_nulls_last(), "item_id").limit(1)


def progress(items: DataFrame, labels: DataFrame, annotations: DataFrame, threshold: float, done: str = "annotated") -> DataFrame:
    """One row: items that still need a label, and items with an annotation of the status `done`."""
    ready = annotations.where(F.col("status") == done).select("item_id").distinct()
    left = needs_label(items, labels, ready, threshold).agg(F.count("*").alias("low_confidence"))
    return left.crossJoin(F.broadcast(ready.agg(F.count("*").alias("labelled"))))  # one row


def lookup_statements(statements: DataFrame, predictions: DataFrame, key: str, probs: Sequence[str], ids: Sequence | None = None, speaker: str | None = None, party: str | None = None, category: str | None = None, limit: int = 100, length: int = 240) -> DataFrame:
    """Statements with truth, prediction, highest probability and a one-line preview.

    The first filter given counts, of ids, part of the speaker's name, party (any case), predicted category; at most `limit` rows in the order of the key.
    """
    top = F.greatest(*(F.col(p) for p in probs)) if len(probs) > 1 else F.col(probs[0])
    known = predictions.select(key, "truth", "pred", top.alias("top_prob"))
    if ids:
        found = statements.where(F.col(key).isin(*ids))
    elif speaker:
        found = statements.where(F.lower("speaker").contains(speaker.lower()))
    elif party:
        found = statements.where(F.lower("party") == party.lower())
    else:
        wanted = known.where(F.col("pred") == category) if category else known
        found = statements.join(wanted.select(key), key, "left_semi")
    rows = found if ids else found.orderBy(key).limit(limit)
    preview = F.translate(F.substring("text", 1, length), "\n", " ")
    return rows.join(known, key, "left").select(key, "speaker", "party", "truth", "pred", "top_prob", preview.alias("snippet"))


def digest(rows: DataFrame, name: str, value: str, n: int = 3) -> DataFrame:
    """One row: the n highest names as a list, and the names with the highest and the lowest value (the smallest name on ties)."""
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    low = held.agg(F.min(F.struct(F.col(value), F.col(name)))[name].alias("lowest"))
    top = top_global(held, n, value, name).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))), lambda x: x["n"]).alias("top"))
    return top.select("top", F.get("top", F.lit(0)).alias("highest")).crossJoin(F.broadcast(low))  # one row


def one_hot(rows: DataFrame, column: str, values: Sequence[str], prefix: str, missing: str = "<none>") -> DataFrame:
    """rows with a 0/1 column per value, in place of the column."""
    held = F.coalesce(F.col(column), F.lit(missing))
    return rows.withColumns({f"{prefix}_{v}": (held == v).cast("double") for v in values}).drop(column)


def json_columns(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """rows with a number column per key of a JSON object, 0 where it is absent; what does not parse is read again with its quotes repaired."""
    text = F.coalesce(F.col(column), F.lit("{}"))
    first = F.from_json(text, "map<string,string>")
    held = F.when(F.size(F.map_keys(first)) > 0, first).otherwise(F.from_json(repair_json(text), "map<string,string>"))
    number = lambda k: F.coalesce(F.nanvl(F.element_at(held, k).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return rows.withColumns({k: number(k) for k in keys})


def backfill(rows: DataFrame, source: DataFrame, key: str, columns: Sequence[str], shorter_than: int = 0) -> DataFrame:
    """rows with missing values of the columns (or texts shorter than that) taken from source, where it has one."""
    other = source.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    lacks = lambda c: F.col(c).isNull() | (F.length(F.col(c).cast("string")) < shorter_than)
    out = rows.join(other, key, "left").withColumns({c: F.when(lacks(c), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in columns})
    return out.drop(*(f"__{c}" for c in columns))


def normalise_raw(raw: DataFrame) -> DataFrame:
    """raw(item_id, json) as title, text, date, party, doc_type and the rest as metadata JSON with sorted keys.

    A missing text is the title. What does not parse is an object without keys. Rows without id are left out.
    """
    data = F.coalesce(F.from_json("json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    held = raw.where(F.col("item_id").isNotNull() & (F.trim("item_id") != "")).withColumn("__d", data)
    get = lambda *ks: F.coalesce(*(F.nullif(F.element_at("__d", k), F.lit("")) for k in ks))
    title = F.coalesce(get("title", "rubrik"), F.lit(""))
    rest = F.map_filter("__d", lambda k, _: ~k.isin("title", "text", "date", "party"))
    entries = F.array_sort(F.map_entries(rest))
    out = {"title": title, "text": F.coalesce(get("text", "body"), title), "date": get("date", "datum"), "party": get("party", "parti"), "doc_type": get("doc_type", "dokumenttyp"), "metadata": F.to_json(F.map_from_entries(entries))}
    return held.select("item_id", *(v.alias(k) for k, v in out.items()))
