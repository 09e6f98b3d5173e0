"""Quality rules (10): counting rules, then a hashed n-gram log-likelihood ratio.

Words and adjacent word pairs are hashed to 2**bits buckets. Two multinomials are counted, one over
all documents and one over trusted ones (labelled good and not toxic; at most `trusted_rows` of them,
those with the smallest hash of their id, so the join key set stays bounded). A document's score is
the mean over its n-grams of log(p_trusted / p_corpus), and it is kept if it passes the base rules
and its score is at least `threshold`. Every document is scored; the two vectors are the only thing
that reaches the driver, and their size is fixed by `bits`.

null text: no words, so base_failed. null or repeated doc_ids (ties): each row is judged by its text; a label
applies to all rows of its id. Very long texts are judged whole. No trusted document: all ratios are 0, so the
base rules decide; with few of them (far fewer n-grams than 2**bits) ratios lean below 0, as both vectors are smoothed
by one. Empty table: no rows. keep_good() keeps other columns, whatever their names; elsewhere they are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import doc_words, long_id, mix64, per_text, slices

_BLANK = " \t\n\v\f\r"
_SLICES = 16
#: Text that is counted at once; a word of it takes some 150 bytes of arrays.
_SLICE_BYTES = 2 << 20


def features(codes: np.ndarray, words: pa.Array, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs; a pair stands at its second word's place, a text's first has none (-1)."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    each = h[codes]
    one = (each >> np.uint64(64 - bits)).astype(np.int64)
    two = np.full(len(codes), -1, np.int64)
    if len(codes) > 1:
        with np.errstate(over="ignore"):
            two[1:] = (mix64(each[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[1:]) >> np.uint64(64 - bits)).astype(np.int64)
        starts = offsets[:-1]
        two[starts[starts < len(codes)]] = -1
    return one, two


def repeat_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in that text."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(text[2:] == text[:-2])
        c = codes.astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(mix64(mix64(c[at] + np.uint64(1)) + c[at + 1]) + c[at + 2]) + mix64(text[at].astype(np.uint64) + np.uint64(7))
        order = np.argsort(key)
        s, p = key[order], at[order]
        equal = s[1:] == s[:-1]
        i = np.flatnonzero(equal)
        true = (text[p[i]] == text[p[i + 1]]) & (codes[p[i]] == codes[p[i + 1]]) & (codes[p[i] + 1] == codes[p[i + 1] + 1]) & (codes[p[i] + 2] == codes[p[i + 1] + 2])
        if not true.all():  # two windows with one key: compare the windows themselves
            whole = np.stack([text[at], codes[at], codes[at + 1], codes[at + 2]], 1)
            _, inverse, count = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
            hit = at[count[inverse.ravel()] > 1]
        else:
            again = np.zeros(len(p), bool)
            again[i] = again[i + 1] = True
            hit = p[again]
        covered[hit] = covered[hit + 1] = covered[hit + 2] = True
    return per_text(covered.astype(np.int64), offsets)


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, trusted_rows: int = 20_000) -> np.ndarray:
    """log(p_trusted / p_corpus) of each bucket, smoothed by one; zeros without trusted documents."""
    size, cut = 1 << bits, (1 << bits) // _SLICES
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(long_id("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    trusted = trusted.orderBy(F.xxhash64("__trusted"), "__trusted").limit(trusted_rows)
    flagged = docs.select(long_id("doc_id").alias("doc_id"), F.col("text")).join(F.broadcast(trusted), F.col("doc_id") == F.col("__trusted"), "left").select(F.col("__trusted").isNotNull().alias("good"), "text")

    def count(batches):
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in slices(batches, "text", _SLICE_BYTES):
            codes, words, offsets = doc_words(b.column(1), lower=False)
            one, two = features(codes, words, offsets, bits)
            mine = np.repeat(np.asarray(b.column(0)).astype(bool), np.diff(offsets))
            for f in (one, two):
                ok = f >= 0
                raw += np.bincount(f[ok], minlength=size)
                good += np.bincount(f[ok & mine], minlength=size)
        pack = zstandard.ZstdCompressor(level=1).compress
        if raw.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SLICES), pa.int32()), pa.array([pack(np.stack([raw[s : s + cut], good[s : s + cut]]).tobytes()) for s in range(0, size, cut)], pa.binary())], names=["slice", "counts"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, cut), np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(2, -1)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = flagged.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    both = np.zeros((2, size), np.int64)
    for r in sums.collect():  # 16 rows that hold 2 * 2**bits numbers, whatever the input
        both[:, r["slice"] * cut : (r["slice"] + 1) * cut] = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    raw, good = both
    if not good.any():
        return np.zeros(size, np.float32)
    return (np.log((good + 1) / (good.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))).astype(np.float32)


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = -0.25) -> DataFrame:
    """The rows of docs(doc_id, text) as doc_id, text_hash, the five counts, score, base_failed and kept."""
    bits = int(len(ratios)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 4 * 2**bits bytes

    def work(batches):
        ratio = shared.value
        for b in slices(batches, "text", _SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_measures(b.column(2), ratio, bits)], names=["doc_id", "text_hash", *_NAMES])

    narrow = docs.select(long_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = narrow.mapInArrow(work, f"doc_id long, text_hash long, {_FIELDS}").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def _measures(texts: pa.Array, ratio: np.ndarray, bits: int) -> list[pa.Array]:
    """The five counts and the score of each text."""
    text = pc.fill_null(texts, "")
    codes, words, offsets = doc_words(text, lower=False)
    one, two = features(codes, words, offsets, bits)
    n = np.diff(offsets)
    gain = ratio[one].astype(np.float64) + np.where(two >= 0, ratio[two], 0)
    grams = np.maximum(2 * n - 1, 1)
    chars = np.asarray(pc.utf8_length(words), np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    return [
        pa.array(n),
        pa.array(per_text(chars, offsets)),
        pc.count_substring_regex(text, "[#*$%&|<>]").cast(pa.int64()),
        pa.array(np.fromiter(map(dup_lines, text.to_pylist()), np.int64, len(text))),
        pa.array(repeat_words(codes, offsets)),
        pa.array([float(np.sum(gain[a:z])) / g for a, z, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), grams.tolist(), strict=True)], pa.float64()),
    ]


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = -0.25) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns: the pass that scores them hands them through."""
    ratios = fit(docs, labels)
    bits = int(len(ratios)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 4 * 2**bits bytes

    def work(batches):
        for b in slices(batches, "text", _SLICE_BYTES):
            n_words, _, _, _, repeated, score = (np.asarray(x) for x in _measures(b.column(b.schema.get_field_index("text")), shared.value, bits))
            yield b.filter(pa.array((n_words >= 50) & (100 * repeated <= 50 * n_words) & (score >= threshold)))

    return docs.mapInArrow(work, docs.schema)
