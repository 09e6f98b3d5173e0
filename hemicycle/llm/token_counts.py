"""Token counts (6): pieces are counted once per distinct pre-token and joined to documents' frequencies.

First each task reduces its documents to distinct pre-tokens (in sets of bounded size), Spark reduces
these to the distinct pre-tokens of the whole table, dealt out by hash, and the model counts the pieces
of each of them once. A bucket's counts are stored as two flat arrays in the shared folder, sorted by the
pre-token's 64-bit hash. Then each document's pre-tokens are reduced to frequencies, which are joined to
the counts by looking their hashes up in the memory-mapped arrays (a map-side join: no row of a
document is shuffled), and frequency times pieces is summed. No ids of a document are ever made. Two
pre-tokens with one hash but unequal counts are noticed when the arrays are built, which is then
done again with another seed.

null text: counted as empty (0 bytes, 0 tokens). Special strings inside texts count as one token, as in the
library. Very long texts: counted whole; only their list of pre-tokens is held. Repeated rows: each is
counted. Ties do not arise. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise, new_folder, partitions, per_text, read_array, slices, write_bytes
from hemicycle.llm.bytelevel import PreTokens

_held: dict[str, PreTokens] = {}


def _pre(path: str) -> PreTokens:
    return _held.get(path) or _held.setdefault(path, PreTokens(path))


def _hashes(tokens: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in tokens), np.uint64, len(tokens))


class PieceTable:
    """File names of the sorted hash and count arrays by bucket; small, and safe to ship to workers."""

    def __init__(self, files: dict[int, str], buckets: int, seed: int):
        self.files, self.buckets, self.seed = files, buckets, seed

    def of(self, tokens: list[str], opened: dict) -> np.ndarray:
        """Number of pieces of each pre-token."""
        h = _hashes(tokens, self.seed)
        out = np.empty(len(h), np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((h, bucket))
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.unique(bucket).tolist():
            if b not in opened:
                opened[b] = read_array(f"{self.files[b]}.hash", "<u8"), read_array(f"{self.files[b]}.count", "<i4")
            have, counts = opened[b]
            where = order[edge[b] : edge[b + 1]]
            at = np.searchsorted(have, h[where])
            if (at == len(have)).any() or (have[at] != h[where]).any():
                raise KeyError("a pre-token is not in the table")
            out[where] = counts[at]
        return out


def piece_table(docs: DataFrame, tokenizer_path: str, most: int = 200_000) -> PieceTable:
    """Count the pieces of every distinct pre-token of docs(text) once."""
    spark = docs.sparkSession
    buckets = partitions(spark)

    def spot(batches):
        pre, seen = _pre(tokenizer_path), set()
        for b in slices(batches, "text"):
            for text in b.column(0).to_pylist():
                for part in pre.parts(text or ""):
                    if not isinstance(part, int):
                        seen.update(part)
                if len(seen) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["token"])
                    seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["token"])

    tokens = materialise(docs.select("text").mapInArrow(spot, "token string").distinct(), "pre-tokens")
    for seed in numbers(42):
        made = materialise(_stored(tokens, tokenizer_path, new_folder(spark, "piece-counts"), buckets, seed), "piece-files")
        rows = made.collect()  # a row per bucket
        if not any(r["clash"] for r in rows):
            return PieceTable({r["bucket"]: r["file"] for r in rows}, buckets, seed)


def _stored(tokens: DataFrame, tokenizer_path: str, folder: str, buckets: int, seed: int) -> DataFrame:
    """Count each token's pieces and write every bucket's arrays: bucket, file, and whether a hash stands for unequal counts."""

    def dealt(batches):
        for b in batches:
            h = _hashes(b.column(0).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((h % np.uint64(buckets)).astype(np.int32)), pa.array(h.view(np.int64))], names=["token", "bucket", "hash"])

    def store(table: pa.Table) -> pa.Table:
        pre = _pre(tokenizer_path)
        n = np.fromiter((len(pre.pieces(t)) for t in table.column("token").to_pylist()), np.int64, table.num_rows)
        h = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        again = np.flatnonzero(h[1:] == h[:-1])
        name = f"{folder}/{table.column('bucket')[0].as_py():06d}-{uuid.uuid4().hex}"
        write_bytes(f"{name}.hash", h.astype("<u8"))
        write_bytes(f"{name}.count", n.astype("<i4"))
        return pa.table({"bucket": table.column("bucket")[:1], "file": [name], "clash": [bool((n[again] != n[again + 1]).any())]})

    return tokens.mapInArrow(dealt, "token string, bucket int, hash long").groupBy("bucket").applyInArrow(store, "bucket int, file string, clash boolean")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs(doc_id, text)."""
    narrow = docs.select(long_id("doc_id").alias("doc_id"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    whole_only = PreTokens(tokenizer_path).whole_only
    table = None if whole_only else piece_table(docs, tokenizer_path)

    def count(batches):
        pre, opened = _pre(tokenizer_path), {}
        for b in slices(batches, "text", 2 << 20):
            texts = b.column(1).to_pylist()
            if table is None:
                n = np.fromiter((len(pre.whole(x or "")) for x in texts), np.int64, b.num_rows)
            else:
                tokens, ends, special = [], [0], []
                for text in texts:
                    parts = pre.parts(text or "")
                    special.append(sum(isinstance(p, int) for p in parts))
                    for p in parts:
                        if not isinstance(p, int):
                            tokens += p
                    ends.append(len(tokens))
                places = dict.fromkeys(tokens)
                distinct = list(places)
                places.update(zip(distinct, range(len(distinct)), strict=True))
                codes = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                n = per_text(table.of(distinct, opened)[codes], np.array(ends)) + np.array(special, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    out = narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
