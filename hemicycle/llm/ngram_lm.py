"""LM scoring (4): an interpolated modified Kneser-Ney bigram model.

Counting. A task reduces its documents to distinct words and distinct word pairs with counts; these
go as packed sorted blocks to buckets of the hash range, where they are merged. Words become the
sorted array of their 64-bit hashes (a word's id is its place), pairs the sorted array of their ids.
Pairs are dealt out by their second word, so a word's continuation count is complete in its bucket;
words that hold more than a quarter of a bucket are dealt out by both words and their partial counts
added. Nothing of the corpus passes through the driver but the file lists, eight counts of counts and the
numbers of such frequent words, fewer than four a bucket.
Model. Flat arrays in the shared folder: word hashes, per-word counts, lower-order probability and
back-off weight, pair keys and counts. Workers memory-map them and look up a batch's distinct words
and pairs in sorted order.

Tokens are the A-Z-lower-cased words of a text and one end token; the end token also serves as the
context of a text's first word. Lower order: continuation counts, interpolated with the uniform
distribution over the V known tokens and one unknown. Contexts never seen back off with weight 1.
Discounts are estimated from counts of counts at each order; where those do not give discounts in
(0, k) (tiny corpora), 0.5, 1 and 1.5 are used.

null text: empty, scored as its end token. null doc_id: a training row. Repeated rows count again. Very long
texts are counted and scored whole. Ties do not arise. Empty training set: V and N are 0, every token is
unknown with probability 1. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import doc_words, long_id, materialise, mix64, new_folder, pack_counts, pack_sorted, partitions, per_text, read_array, slices, sum_runs, unpack_counts, unpack_sorted, write_bytes

#: No word holds a line feed.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_BLOCK = "bucket int, n long, keys binary, counts binary"
_FALLBACK = (0.5, 1.0, 1.5)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def token_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token among the distinct hashes, distinct hashes, offsets); each text ends with END."""
    codes, words, offsets = doc_words(text, lower=True)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    out = np.empty(len(codes) + len(ends), np.int64)
    mask = np.zeros(len(out), bool)
    mask[ends] = True
    out[mask], out[~mask] = len(words), codes
    return out, np.append(h, END), np.concatenate([[0], ends + 1])


def pair_places(tokens: np.ndarray, end_code: int) -> np.ndarray:
    """Each token's predecessor; the end token precedes a text's first."""
    before = np.empty_like(tokens)
    before[:1], before[1:] = end_code, tokens[:-1]
    return before


def _emit(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray):
    """Blocks of ascending keys for each bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    rows = [(int(bucket[a]), int(z - a), pack_sorted(keys[a:z]), pack_counts(counts[a:z])) for a, z in zip(at, at[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "n", "keys", "counts"])


def _merge(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    return table.column("bucket")[0].as_py(), *sum_runs(keys, counts)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    if min(n1, n2, n3) <= 0:
        return _FALLBACK
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x < k for k, x in enumerate(d, 1)) else _FALLBACK


@dataclass
class Model:
    """File names and constants of a trained model; small, and safe to ship to workers."""

    words: list = field(default_factory=list)  # (first hash, file of hashes, file of counts, length), ascending
    lower: list = field(default_factory=list)  # (first id, probabilities, back-off weights, length), ascending
    pairs: dict = field(default_factory=dict)  # bucket: (keys, counts, length)
    hot: list = field(default_factory=list)  # ids of words whose pairs are dealt out by both words
    buckets: int = 1
    n: int = 0
    v: int = 0
    d: tuple = _FALLBACK
    unknown: float = 1.0  # lower-order probability of an unknown token


class Reader:
    """A model's arrays, memory-mapped."""

    def __init__(self, model: Model):
        self.m = model
        self.first = np.array([w[0] for w in model.words], np.uint64)
        self.bases = np.concatenate([[0], np.cumsum([w[3] for w in model.words])]).astype(np.int64)
        self.hash = [read_array(w[1], "<u8") for w in model.words]
        self.count = [read_array(w[2], "<i8") for w in model.words]
        self.starts = np.array([x[0] for x in model.lower], np.int64)
        self.low = [(read_array(x[1], "<f8"), read_array(x[2], "<f8")) for x in model.lower]
        self.pair = {b: (read_array(x[0], "<u8"), read_array(x[1], "<i8")) for b, x in model.pairs.items()}
        self.hot = np.array(sorted(model.hot), np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        h = hashes[order]
        shard = np.searchsorted(self.first, h, "right") - 1
        for s in np.unique(shard[shard >= 0]).tolist():
            where = order[shard == s]
            at = np.searchsorted(self.hash[s], hashes[where])
            ok = at < len(self.hash[s])
            ok[ok] = self.hash[s][at[ok]] == hashes[where[ok]]
            out[where[ok]] = at[ok] + self.bases[s]
            counts[where[ok]] = self.count[s][at[ok]]
        return out, counts

    def lower_order(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-order probability as a token, back-off weight as a context."""
        p, gamma = np.full(len(ids), self.m.unknown), np.ones(len(ids))
        shard = np.searchsorted(self.starts, ids, "right") - 1
        for s in np.unique(shard[ids >= 0]).tolist():
            where = np.flatnonzero((shard == s) & (ids >= 0))
            at = ids[where] - self.starts[s]
            p[where], gamma[where] = self.low[s][0][at], self.low[s][1][at]
        return p, gamma

    def bucket(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = mix64(second.astype(np.uint64))
        if len(self.hot):
            warm = np.isin(second, self.hot)
            h[warm] = mix64(h[warm] ^ mix64(first[warm].astype(np.uint64) + np.uint64(1)))
        return (h % np.uint64(self.m.buckets)).astype(np.int32)

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = second.astype(np.uint64) << np.uint64(32) | first.astype(np.uint64)
        out = np.zeros(len(keys), np.int64)
        bucket = self.bucket(first, second)
        order = np.lexsort((keys, bucket))
        edge = np.searchsorted(bucket[order], np.arange(self.m.buckets + 1))
        for b, (have, count) in self.pair.items():
            where = order[edge[b] : edge[b + 1]]
            if len(where):
                at = np.searchsorted(have, keys[where])
                ok = at < len(have)
                ok[ok] = have[at[ok]] == keys[where[ok]]
                out[where[ok]] = count[at[ok]]
        return out


_held: dict[str, Reader] = {}


def _reader(model: Model) -> Reader:
    key = repr((model.words[:1], next(iter(model.pairs.items()), None), model.lower[:1]))
    if key not in _held:
        _held.clear()
        _held[key] = Reader(model)
    return _held[key]


def train(docs: DataFrame) -> Model:
    """Count docs(text) and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    folder, buckets = new_folder(spark, "ngram-lm"), partitions(spark)
    text = docs.select("text")
    name = lambda kind, b: f"{folder}/{kind}-{b:05d}-{uuid.uuid4().hex}"

    def words(batches):
        keys, counts = [], []
        for b in slices(batches, "text"):
            tokens, h, _ = token_hashes(b.column(0))
            k, c = sum_runs(h, np.bincount(tokens, minlength=len(h)))
            keys.append(k[c > 0]), counts.append(c[c > 0])
        if keys:
            k, c = sum_runs(np.concatenate(keys), np.concatenate(counts))
            yield _emit(k, c, (k // np.uint64((1 << 64) // buckets + 1)).astype(np.int32))

    def word_file(table: pa.Table) -> pa.Table:
        b, k, c = _merge(table)
        at = name("words", b)
        write_bytes(f"{at}.hash", k.astype("<u8"))
        write_bytes(f"{at}.count", c.astype("<i8"))
        return pa.table({"bucket": pa.array([b], pa.int32()), "file": [at], "n": [len(k)], "total": [int(c.sum())], "first": pa.array([int(k[0].view(np.int64))], pa.int64())})

    listed = materialise(text.mapInArrow(words, _BLOCK).groupBy("bucket").applyInArrow(word_file, "bucket int, file string, n long, total long, first long"), "lm-words")
    shards = listed.orderBy("bucket").collect()  # a row per bucket
    model = Model(buckets=buckets, n=sum(r["total"] for r in shards), v=sum(r["n"] for r in shards))
    if not model.n:
        return model
    if model.v >= 1 << 32:
        raise OverflowError("more than 2**32 distinct words; a pair's key holds two word numbers of 32 bits")

    def frequent(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.asarray(read_array(f"{r['file']}.count", "<i8")) * (4 * buckets) > model.n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["bucket"], np.int32)), pa.array(at.astype(np.int64))], names=["bucket", "place"])

    # words of more than a quarter of a bucket's share: fewer than 4 * buckets in all
    hot = [(r["bucket"], r["place"]) for r in listed.select("bucket", "file").repartition(buckets).mapInArrow(frequent, "bucket int, place long").collect()]
    base, bases = 0, {}
    for r in shards:
        model.words.append((r["first"] % (1 << 64), f"{r['file']}.hash", f"{r['file']}.count", r["n"]))
        bases[r["bucket"]] = base
        base += r["n"]
    model.hot = [bases[b] + at for b, at in hot]

    def pairs(batches):
        reader = _reader(model)
        keys, counts = [], []
        for b in slices(batches, "text"):
            tokens, h, _ = token_hashes(b.column(0))
            ids = reader.ids(h)[0][tokens].astype(np.uint64)
            end = reader.ids(h[-1:])[0].astype(np.uint64)[0]
            before = pair_places(ids, end)
            k = np.sort(ids << np.uint64(32) | before)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys.append(k[first]), counts.append(np.diff(np.append(first, len(k))))
        if keys:
            k, c = sum_runs(np.concatenate(keys), np.concatenate(counts))
            yield _emit(k, c, reader.bucket((k & np.uint64(0xFFFFFFFF)).astype(np.int64), (k >> np.uint64(32)).astype(np.int64)))

    width = -(-model.v // buckets)

    def pair_file(table: pa.Table) -> pa.Table:
        """The bucket's arrays go to files; per-word sums of them return as rows."""
        b, k, c = _merge(table)
        at = name("pairs", b)
        write_bytes(f"{at}.keys", k.astype("<u8"))
        write_bytes(f"{at}.counts", c.astype("<i8"))
        second = k >> np.uint64(32)
        w, n = sum_runs(second, np.ones(len(k), np.int64))
        first = k & np.uint64(0xFFFFFFFF)
        order = np.argsort(first, kind="stable")
        ordered, kind = first[order], np.minimum(c[order], 3)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        v = ordered[edges]
        parts = [np.add.reduceat((kind == i).astype(np.int64), edges) for i in (1, 2, 3)]
        rows = [{"range": -1, "kind": b, "file": at, "n": len(k), "ids": None, "a": _plain(np.array([(c == i).sum() for i in (1, 2, 3, 4)]))}]
        for kind_of, ids, columns in ((0, w, [n]), (1, v, parts)):
            of = (ids // np.uint64(width)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            for x, z in zip(edge, edge[1:], strict=False):
                rows.append({"range": int(of[x]), "kind": kind_of, "file": None, "n": int(z - x), "ids": pack_sorted(ids[x:z]), "a": b"".join(_sized(pack_counts(col[x:z])) for col in columns)})
        return pa.Table.from_pylist(rows, schema=_stats)

    counted = materialise(text.mapInArrow(pairs, _BLOCK).groupBy("bucket").applyInArrow(pair_file, "range int, kind int, file string, n long, ids binary, a binary"), "lm-pairs")
    n_of = np.zeros(4, np.int64)
    for r in counted.where("range = -1").collect():  # a row per bucket
        model.pairs[r["kind"]] = (f"{r['file']}.keys", f"{r['file']}.counts", r["n"])
        n_of += np.frombuffer(r["a"], np.int64)
    model.d = discounts(*n_of.tolist())

    def range_sums(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        lo = table.column("range")[0].as_py() * width
        size = min(width, model.v - lo)
        continued, kinds = np.zeros(size, np.int64), np.zeros((3, size), np.int64)
        for r in table.to_pylist():
            at = unpack_sorted(r["ids"]).astype(np.int64) - lo
            columns = [unpack_counts(x) for x in _split(r["a"])]
            if r["kind"] == 0:
                continued[at] += columns[0]
            else:
                for i in range(3):
                    kinds[i, at] += columns[i]
        return lo, continued, kinds

    def lower_counts(table: pa.Table) -> pa.Table:
        lo, continued, kinds = range_sums(table)
        at = name("lower", lo)
        write_bytes(f"{at}.continued", continued.astype("<i8"))
        write_bytes(f"{at}.kinds", kinds.astype("<i8"))
        return pa.table({"lo": pa.array([lo], pa.int64()), "size": pa.array([len(continued)], pa.int64()), "file": [at], "total": pa.array([int(continued.sum())], pa.int64()), "n": pa.array([[int((continued == i).sum()) for i in (1, 2, 3, 4)]], pa.list_(pa.int64()))})

    ranges = materialise(counted.where("range >= 0").groupBy("range").applyInArrow(lower_counts, "lo long, size long, file string, total long, n array<long>"), "lm-ranges")
    rows = ranges.orderBy("lo").collect()  # a row per range of ids
    types = sum(r["total"] for r in rows)
    low = discounts(*np.sum([r["n"] for r in rows], axis=0).tolist())
    of = np.array([0.0, *low])
    taken = sum(float(of[min(i, 3)]) * sum(r["n"][i - 1] for r in rows) for i in (1, 2))
    many = sum(r["size"] for r in rows) - sum(r["n"][0] + r["n"][1] for r in rows)
    uniform = (taken + of[3] * many) / types / (model.v + 1)
    model.unknown = uniform
    d = np.array(model.d)

    def finish(batches):
        reader = _reader(model)
        for b in batches:
            for r in b.to_pylist():
                continued = read_array(f"{r['file']}.continued", "<i8")
                kinds = read_array(f"{r['file']}.kinds", "<i8").reshape(3, -1)
                ids = np.arange(r["lo"], r["lo"] + r["size"])
                shard = np.searchsorted(reader.bases, ids, "right") - 1
                total = np.zeros(len(ids), np.int64)
                for s in np.unique(shard).tolist():
                    total[shard == s] = reader.count[s][ids[shard == s] - reader.bases[s]]
                p = (continued - of[np.minimum(continued, 3)]) / types + uniform
                gamma = (d @ kinds) / total
                at = f"{r['file']}-{uuid.uuid4().hex}"
                write_bytes(f"{at}.p", p.astype("<f8"))
                write_bytes(f"{at}.gamma", gamma.astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([r["lo"]]), pa.array([r["size"]]), pa.array([at])], names=["lo", "size", "file"])

    for r in materialise(ranges.repartition(buckets).mapInArrow(finish, "lo long, size long, file string"), "lm-lower").orderBy("lo").collect():
        model.lower.append((r["lo"], f"{r['file']}.p", f"{r['file']}.gamma", r["size"]))
    _held.clear()
    return model


_stats = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("file", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("a", pa.binary())])


def _plain(x: np.ndarray) -> bytes:
    return x.astype(np.int64).tobytes()


def _sized(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + x


def _split(x: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(x):
        n = int.from_bytes(x[at : at + 8], "little")
        out.append(x[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of docs(doc_id, text)."""

    def work(batches):
        reader = _reader(model) if model.n else None
        for b in slices(batches, "text"):
            tokens, h, offsets = token_hashes(b.column(2))
            if reader is None:
                zero = np.zeros(len(tokens))
                known, base, value = zero.astype(np.int64), zero, zero
            else:
                ids, counts = reader.ids(h)
                p, gamma = reader.lower_order(ids)
                before = pair_places(tokens, len(h) - 1)
                key, inverse = np.unique(before * len(h) + tokens, return_inverse=True)
                v, w = np.divmod(key, len(h))
                both = (ids[v] >= 0) & (ids[w] >= 0)
                c = np.zeros(len(key), np.int64)
                c[both] = reader.pair_counts(ids[v[both]], ids[w[both]])
                d = np.array([0.0, *model.d])[np.minimum(c, 3)]
                prob = np.log10((c - d) / np.maximum(counts[v], 1) + gamma[v] * p[w])
                value = prob[inverse.ravel()]
                known = (counts > 0)[tokens].astype(np.int64)
                base = np.log10((counts + 1) / (model.n + 1 * (model.v + 1)))[tokens]
            starts = offsets[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offsets)), pa.array(per_text(known, offsets)), pa.array(np.full(b.num_rows, model.n, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    narrow = docs.select(long_id("doc_id").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return narrow.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
