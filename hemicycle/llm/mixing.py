"""Mixing sources to target weights (2) by entropy balancing.

Sought are document rates w that stay as near as possible (in relative entropy, a document counting
as often as it has words) to using everything once while each source's words come to its target. The
solution is w = exp(lambda of the document's source), and the lambdas solve a convex dual without
constraints; targets of at most `most` times a source's words keep every rate at `most` or below. Newton's method runs on it: each iteration computes,
over partial sums of the sources, the gradient (words used less target) and the Hessian's diagonal
(words used, as a document has one source), and moves each lambda. Rates are then rounded
to copies: a document gets the whole part, and one copy more if its hash lies below its source's cut.
The cut is found from word sums by hash range, first 1024 ranges, then 1024 within the one that
holds it, so that a source misses its target by half of one such range, or one document, at most.

Targets: `share` of all words, split by weights that repeat over the sources in code-point order (null
last), no target over `most` times its source's words; what is over is dealt out again by weight.

null text: size 0. A null source is a source. Repeated rows (ties): each is a document; rows of equal id and
text share their hash, so fall on the same side. Very long texts count whole; one is taken or left as a whole.
Sources without words have target 0. Empty table: none. mixed() keeps other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm._shared import WORD, long_id, materialise
from hemicycle.operators.rows import global_rank

_BINS = 1024
_SALTS = 64


def words_of(text):
    """Number of words, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash in [0, 2**20) of each row."""
    return docs.select(long_id("doc_id").alias("doc_id"), "source", words_of(F.col("text")).alias("size"), _hash().alias("u"))


def _hash():
    return F.pmod(F.xxhash64(long_id("doc_id"), F.col("text")), F.lit(_BINS * _BINS))


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds weight and target to sources(source, source_size), a row per source.

    Sources are numbered in one order, bucket by bucket; the refilling is a loop of plain sums, each of
    which sets at least one more source to its bound.
    """
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__place") - 1, F.lit(n)) + 1).cast("int"))
    numbered = global_rank(sources, [F.col("source").isNull()], "source", "__place")
    ranked = materialise(numbered.withColumn("weight", w.cast("double")).drop("__place", "__b"), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, bound = None, F.col("source_size") * F.lit(most)
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= bound
        used, free = ranked.agg(F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        new = None if not free else (share * total - (used or 0.0)) / free
        if new is None or new == level:
            break
        level = new
    target = bound if level is None else F.least(bound, F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target.cast("double"))


def balance(parts: DataFrame, goals: DataFrame, most: float = 2.0, tolerance: float = 1e-10, iterations: int = 60) -> DataFrame:
    """source, rate: the dual's solution by Newton's method over parts(source, words), partial sums of the sources."""
    held = parts.select("source", "words")
    goal = goals.select(F.col("source").alias("s"), "target")
    state = goal.select("s", "target", F.lit(0.0).alias("lam"))
    for step in range(iterations):
        tilted = held.join(state, held["source"].eqNullSafe(state["s"]))
        rate = F.exp("lam")
        curve = F.sum(F.col("words") * rate)
        grad = curve - F.first("target")
        moved = tilted.groupBy("s").agg(F.first("target").alias("target"), F.first("lam").alias("lam"), grad.alias("g"), curve.alias("h"))
        # a source without words, or wanted at 0, has nothing to solve; steps are held to one unit of lambda
        delta = F.when((F.col("h") > 0) & (F.col("target") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("g") / F.col("h")))).otherwise(F.lit(0.0))
        state = materialise(moved.select("s", "target", (F.col("lam") + delta).alias("lam"), (F.abs("g") / F.greatest(F.col("target"), F.lit(1.0)) * F.when(delta == 0, 0).otherwise(1)).alias("miss")), "newton")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("miss")
    return state.select(F.col("s").alias("source"), F.when(F.col("target") > 0, F.least(F.lit(most), F.exp("lam"))).otherwise(F.lit(0.0)).alias("rate"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """How sizes()' rows become copies: source, source_size, target, rate, whole and edge.

    A row's copies are `whole`, and one more if its hash u is below `edge`.
    """
    # a source's rows are first added up by hash range, of which there are few
    ranges = materialise(rows.groupBy("source", (F.col("u") / _BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words")), "ranges")
    goals = materialise(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "goals")
    parts = ranges.groupBy("source", (F.col("bin") % _SALTS).alias("salt")).agg(F.sum("words").alias("words"))
    rates = balance(parts, goals, most).withColumnRenamed("source", "rs")
    rate = F.when(F.abs(F.round("rate") - F.col("rate")) <= 1e-9, F.round("rate")).otherwise(F.col("rate"))
    g = goals.join(rates, goals["source"].eqNullSafe(F.col("rs"))).drop("rs").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    g = materialise(g.withColumn("open", F.when(F.col("rate") > F.col("whole"), F.col("target") - F.col("whole") * F.col("source_size"))), "rates")
    left = g.where("open is not null").select(F.col("source").alias("gs"), "open")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 1024 rows a source at most
    coarse = ranges.join(left, ranges["source"].eqNullSafe(left["gs"])).withColumn("to", F.sum("words").over(run))
    cut = coarse.where("to > open").groupBy("gs").agg(F.min("bin").alias("cut"), F.min_by(F.col("open") - F.col("to") + F.col("words"), "bin").alias("rest"))
    cut = materialise(cut, "cuts")
    fine = rows.join(cut, rows["source"].eqNullSafe(cut["gs"]) & ((F.col("u") / _BINS).cast("int") == F.col("cut")))
    fine = fine.groupBy("source", (F.col("u") % _BINS).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("cut").alias("cut"))
    fine = fine.withColumn("to", F.sum("words").over(run)).where("to > rest")
    last = fine.groupBy("source").agg(F.min_by(F.struct("bin", "to", "words", "rest", "cut"), "bin").alias("x"))
    # the range that crosses is taken if that comes nearer
    with_it = F.when(F.col("x.to") - F.col("x.rest") <= F.col("x.rest") - F.col("x.to") + F.col("x.words"), 1).otherwise(0)
    edge = last.select(F.col("source").alias("es"), (F.col("x.cut") * _BINS + F.col("x.bin") + with_it).alias("edge"))
    end = F.when(F.col("open").isNull(), 0).otherwise(F.coalesce("edge", F.lit(_BINS * _BINS)))
    return materialise(g.join(edge, g["source"].eqNullSafe(edge["es"]), "left").select("source", "source_size", "target", "rate", "whole", end.cast("long").alias("edge")), "plan")


def _with_plan(rows: DataFrame, plan_rows: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """rows(source, u, ...) with their source's plan and their copies; one row per source meets them."""
    p = plan_rows.withColumnRenamed("source", "__source")
    p = F.broadcast(p) if p.count() <= broadcast_rows else p
    copies = F.col("whole") + F.when(F.col("u") < F.col("edge"), 1).otherwise(0)
    return rows.join(p, rows["source"].eqNullSafe(p["__source"])).withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size) of each row of docs(doc_id, text, source)."""
    rows = materialise(sizes(docs), "sizes")
    out = _with_plan(rows, plan(rows, weights, share, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs, each row as often as the mix takes it, columns unchanged."""
    rules = plan(materialise(sizes(docs), "sizes"), weights, share, most)
    keep = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("source"), _hash().alias("u"))
    out = _with_plan(keep, rules).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
