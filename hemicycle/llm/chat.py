"""Chat formatting (5): cumulative-snapshot collapse, then rendering.

A logger that writes the whole conversation after every turn leaves conversations that are prefixes of
later ones. Each turn hashes to two 64-bit values of (place, role, text), and a prefix's hash is their
running sum, so prefixes of different conversations meet by equality. Conversations whose full hash
is a proper prefix of another's go by an anti-join against the distinct prefix hashes; of equal ones
the smallest conv_id stays. Running sums are computed in blocks: turns are range-partitioned by
(conversation, turn), so one conversation may span many partitions, and each partition's sums are
moved by the totals of the conversation's earlier partitions.

Turns are ordered by turn, null last, then by role and text (null first); repeated rows are repeated
turns. A null role or text is a value of its own and renders as empty. Rows with null conv_id are one
conversation. Long conversations render in segments of `segment` turns; very long texts are hashed and
rendered whole. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise

#: Characters of a role or text that take part in dealing turns out.
_KEY = 64


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, role, text, place (from 1) and the running prefix hashes h1, h2 of turns(conv_id, turn, role, text)."""
    order = [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    narrow = turns.select(long_id("conv_id").alias("conv"), long_id("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # the keys that are sampled are bounded; rows they do not tell apart stay in one partition
    wide = F.length(F.coalesce("role", F.lit(""))) > _KEY
    keys = [*order[:2], F.substring("role", 1, _KEY).asc_nulls_first(), wide.asc(), F.when(~wide, F.substring("text", 1, _KEY)).asc_nulls_first()]
    placed = narrow.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "turns")
    here = Window.partitionBy("part", "conv").orderBy(*order[1:])
    local = placed.withColumn("n", F.row_number().over(here))
    ends = placed.groupBy("part", "conv").agg(F.count("*").alias("turns"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    based = ends.withColumn("base", F.coalesce(F.sum("turns").over(before), F.lit(0))).select(F.col("part").alias("p"), F.col("conv").alias("c"), "base")
    meet = (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c"))
    at = local.join(based, meet).withColumn("place", F.col("n") + F.col("base")).drop("p", "c", "base")
    lack = [F.col("role").isNull(), F.col("text").isNull()]
    hashed = at.withColumn("d1", F.xxhash64(F.lit(1), "place", *lack, "role", "text").cast("decimal(38,0)")).withColumn("d2", F.xxhash64(F.lit(2), "text", "role", *lack, "place").cast("decimal(38,0)"))
    hashed = materialise(hashed, "hashed")
    mod = lambda c: F.pmod(c, F.lit(str(1 << 64)).cast("decimal(38,0)"))
    sums = hashed.groupBy("part", "conv").agg(F.sum("d1").alias("s1"), F.sum("d2").alias("s2"))
    moved = sums.select(F.col("part").alias("p"), F.col("conv").alias("c"), *(F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    rows = Window.partitionBy("part", "conv").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hashed.withColumn("r1", F.sum("d1").over(rows)).withColumn("r2", F.sum("d2").over(rows)).join(moved, meet)
    return out.select("conv", "role", "text", "place", mod(F.col("r1") + F.col("b1")).alias("h1"), mod(F.col("r2") + F.col("b2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv and n_turns of the conversations that are no proper prefix of another; of equal ones the smallest conv_id."""
    lengths = turns.groupBy("conv").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv", "c")
    full = turns.join(lengths, turns["conv"].eqNullSafe(lengths["c"])).drop("c")
    inner = full.where("place < n_turns").select("place", "h1", "h2").distinct()
    last = full.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    return last.join(inner, ["place", "h1", "h2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame, segment: int = 512, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, segment, n_turns, copies and text of kept conversations; turns stand as start role newline text end newline."""
    k = kept.withColumnRenamed("conv", "c")
    mine = turns.join(k, turns["conv"].eqNullSafe(k["c"]))
    line = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end), F.lit("\n"))
    part = ((F.col("place") - 1) / segment).cast("long").alias("segment")
    rows = mine.groupBy(F.col("conv").alias("conv_id"), part).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"))
    return rows.select("conv_id", "segment", "n_turns", "copies", F.array_join("lines.line", "").alias("text"))


def format_chats(turns: DataFrame, segment: int = 512) -> DataFrame:
    """Maximal conversations of turns(conv_id, turn, role, text), rendered."""
    at = materialise(numbered_turns(turns), "prefixes")
    return render(at, materialise(maximal(at), "maximal"), segment)
