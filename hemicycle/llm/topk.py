"""Exact top-k search (1) by MaxScore over sharded integer vectors.

A vector's terms are its components; a shard holds, term by term, the components of a few thousand
vectors (its postings) with each term's least and greatest value. For a query, a term's score bound
in a shard is the gap between the best and the worst product it can contribute. Terms are split by
these bounds: as many of the weakest as cannot lift any vector over the query's threshold are
non-essential. The essential postings are traversed for all vectors; the others are probed, most
influential first, only for vectors that still can compete.

Thresholds stand before the first shard: a first round scores every query against a sample of
vectors (at most `sample_rows`, those with the smallest hash of their id) and notes its k-th best score,
which no result can fall below. So all tasks start from a shared threshold, and raise their own as they
go; the sample only sets this bound, and every vector is searched. The tasks' lists are merged at the end.

Queries stand in blocks, and each (query block, shard) pair is one unit of an equi-join on the
shard's group, by shuffle. Only the sample is broadcast, whose size is bounded.

A null vector, or one holding null or a non-finite component, takes no part; neither does a row
without id. Vectors of unequal length are compared as if zeros followed (so however long, they are
compared whole); an empty vector scores 0. Rows that repeat a query's id are that query's own and no
candidates for it; other repeated rows are candidates (and queries) each. Ties go to the smaller id.
Scores outside the range of long are set to its nearest end. Empty tables: no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise, partitions

_TOP = "query_block long, query_place long, query_id long, vec_id long, score long"


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    held = rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad)
    return held.select(long_id(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of unequal length, filled up with zeros."""
    offsets = np.asarray(lists.offsets, np.int64)
    flat = np.asarray(lists.values, np.float64)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0)
    n = np.diff(offsets)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def pack(rows: DataFrame, size: int, name: str, scale: int) -> DataFrame:
    """`size` vectors a row at most: {name} (a number), ids, width and data (row-major, floor(scale * x) as doubles)."""

    def work(batches):
        for b in batches:
            lists = b.column(1)
            for lo in range(0, b.num_rows, size):
                m = np.clip(np.floor(scale * _matrix(lists.slice(lo, size))), -1e300, 1e300)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(0).slice(lo, size), np.int64).tobytes()]), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["ids", "width", "data"])

    return rows.mapInArrow(work, "ids binary, width int, data binary").withColumn(name, F.monotonically_increasing_id())


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q times the columns' rows, exactly: in doubles, else long, else Python integers."""
    most = float(np.abs(q).sum() * np.abs(m).max(initial=0))
    if most < 2**53:
        return q @ m
    kind = np.int64 if most < 2**63 else object
    return np.array([int(x) for x in q], kind) @ np.array([[int(x) for x in r] for r in m], kind).reshape(m.shape)


class Shard:
    """Postings by term, and each term's range of values."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.post = ids[order], np.ascontiguousarray(rows[order].T)
        self.low, self.high = self.post.min(axis=1, initial=np.inf), self.post.max(axis=1, initial=-np.inf)
        self.exact = bool(np.abs(self.post).max(initial=0) < 2**26)
        #: Postings looked at, and those that there were.
        self.seen = self.there = 0

    def search(self, query: np.ndarray, own: int, floor: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard's vectors that score at least floor (its own k best if None): ids and scores."""
        n = min(len(query), len(self.post))
        q = query[:n]
        self.there += n * len(self.ids)
        if floor is None or not self.exact or np.abs(q).sum() >= 2**26:
            self.seen += n * len(self.ids)
            s = _products(q, self.post[:n])
            at = np.flatnonzero(self.ids != own)
            return self._best(at, s[at], k)
        a, b = q * self.low[:n], q * self.high[:n]
        worst, best = np.minimum(a, b), np.maximum(a, b)
        gap = best - worst
        terms = np.argsort(-gap, kind="stable")
        # rest[t]: the most that the terms from place t on can add
        rest = np.append(np.cumsum(best[terms][::-1])[::-1], 0.0)
        if n and rest[0] < floor:  # the whole shard cannot compete
            return self.ids[:0], np.zeros(0)
        surely = np.append(0.0, np.cumsum(worst[terms]))
        essential = int(np.searchsorted(-(surely + rest), -floor, "right")) if len(terms) else 0
        essential = min(max(essential, 1), n) if n else 0
        t = terms[:essential]
        part = q[t] @ self.post[t]
        self.seen += essential * len(self.ids)
        at = np.flatnonzero((part + rest[essential] >= floor) & (self.ids != own))
        part = part[at]
        step = 4
        for lo in range(essential, n, step):
            if not len(at):
                break
            t = terms[lo : lo + step]
            self.seen += len(t) * len(at)
            part = part + q[t] @ self.post[np.ix_(t, at)]
            ok = part + rest[min(lo + step, n)] >= floor
            at, part = at[ok], part[ok]
        return self._best(at, part, k)

    def _best(self, at: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k:
            kth = np.sort(s)[-k] if s.dtype == object else np.partition(s, -k)[-k]
            keep = np.flatnonzero(s >= kth)
            keep = keep[np.argsort(-s[keep], kind="stable")][:k]  # ids ascend, so ties go to the smaller
            at, s = at[keep], s[keep]
        return self.ids[at], s


def _clipped(s: np.ndarray) -> list[int]:
    most, least = (1 << 63) - 1, -(1 << 63)
    return [max(least, min(most, int(x))) for x in s]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, shard_rows: int = 4096, block_rows: int = 512, sample_rows: int = 1024) -> DataFrame:
    """query_block, query_place, query_id, rank, vec_id and score of the k vectors with the greatest inner product with each query.

    Both inputs come from usable_vectors(); components count as floor(scale * x). query_block and
    query_place tell repeated query rows apart.
    """
    spark = vectors.sparkSession
    groups = partitions(spark)
    shards = materialise(pack(vectors, shard_rows, "shard", scale), "shards").withColumn("at", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    plain = materialise(pack(queries, block_rows, "block", scale), "query-blocks")
    some = pack(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).coalesce(1), sample_rows, "shard", scale).collect()  # sample_rows vectors
    sample = spark.sparkContext.broadcast([(r["ids"], r["width"], r["data"]) for r in some])

    def thresholds(batches):
        held = [Shard(ids, np.frombuffer(data).reshape(len(ids), width)) for ids, width, data in ((np.frombuffer(i, np.int64), w, d) for i, w, d in sample.value)]
        for b in batches:
            floors = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["data"]).reshape(len(ids), r["width"])
                least = np.full(len(ids), -np.inf)
                for i in range(len(ids)):
                    scores = sorted((x for s in held for x in _clipped(s.search(q[i], int(ids[i]), None, k)[1])), reverse=True)
                    if len(scores) >= k:
                        least[i] = scores[k - 1]
                floors.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.binary())], names=[*b.schema.names, "floors"])

    blocks = materialise(plain.mapInArrow(thresholds, "ids binary, width int, data binary, block long, floors binary"), "query-thresholds")
    # shards are dealt to groups and each block goes to every group: they meet in an equi-join on the group, by shuffle
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    spread = blocks.select("block", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"), "floors", every.alias("group"))
    units = shards.hint("shuffle_hash").join(spread, spread["group"] == shards["at"]).select("block", "q_ids", "q_width", "q_data", "floors", "ids", "width", "data")

    def search(batches):
        block = None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block:
                    if block is not None:
                        yield flush()
                    block, q_ids, floors = r["block"], np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["floors"])
                    q = np.frombuffer(r["q_data"]).reshape(len(q_ids), r["q_width"])
                    found = [([], []) for _ in q_ids]

                    def flush(block=block, q_ids=q_ids, found=found):
                        rows = [(block, i, int(q_ids[i]), v, s) for i, (ids, scores) in enumerate(found) for v, s in zip(ids, scores, strict=True)]
                        cols = list(zip(*rows, strict=True)) or [()] * 5
                        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_block", "query_place", "query_id", "vec_id", "score"])

                ids = np.frombuffer(r["ids"], np.int64)
                shard = Shard(ids, np.frombuffer(r["data"]).reshape(len(ids), r["width"]))
                for i in range(len(q_ids)):
                    had, scores = found[i]
                    own = max(floors[i], float(scores[-1]) if len(scores) == k else -np.inf)
                    v, s = shard.search(q[i], int(q_ids[i]), own if np.isfinite(own) else None, k)
                    if len(v):
                        both = sorted([*zip(scores, had, strict=True), *zip(_clipped(s), v.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                        found[i] = ([x[1] for x in both], [x[0] for x in both])
        if block is not None:
            yield flush()

    parts = units.sortWithinPartitions("block").mapInArrow(search, _TOP)
    rank = F.row_number().over(Window.partitionBy("query_block", "query_place").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_block", "query_place", "query_id", "rank", "vec_id", "score")
