"""Helpers that the training-data operators share.

Everything that has to outlive one task goes to the folder named by ``spark.checkpoint.dir``,
which the driver and all executors see (hemicycle.storage). Workers reach it through ``pyarrow.fs``; where
the folder is a mounted file system its files are memory-mapped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hemicycle.storage import run_folder, written

#: One word: a run of characters that are neither space nor U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the run's folder that nothing else uses; files in it may be created by any worker. It goes with the run."""
    path = f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, local = open_fs(path)
    fs.create_dir(local, recursive=True)
    return path


#: Write a frame as Parquet in the run's folder and read it back.
materialise = written


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_bytes(path: str, *parts) -> None:
    """Names are unique to a task attempt, and only names that a finished task reports are ever read."""
    fs, local = open_fs(path)
    with fs.open_output_stream(local, compression=None, buffer_size=1 << 20) as out:
        for x in parts:
            out.write(memoryview(x).cast("B") if not isinstance(x, bytes) else x)


def read_array(path: str, dtype) -> np.ndarray:
    """A flat array file, memory-mapped where the file system is mounted and read whole elsewhere."""
    fs, local = open_fs(path)
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        if os.path.getsize(local) == 0:
            return np.zeros(0, dtype)
        return np.memmap(local, dtype=dtype, mode="r")
    with fs.open_input_file(local) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one column's data stays near most_bytes; a longer single row stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        at, n = 0, len(size)
        ends = np.cumsum(size)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def doc_words(text: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text: (code of each word, distinct words, offsets of each text's words).

    Nulls count as empty. Lower-casing covers A-Z only.
    """
    text = pa.compute.fill_null(text, "")
    if lower:
        text = pa.compute.ascii_lower(text)
    text = pa.compute.ascii_trim_whitespace(text)
    lists = pa.compute.ascii_split_whitespace(text)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    enc = lists.flatten().dictionary_encode()
    codes = np.asarray(enc.indices, dtype=np.int64)
    words = enc.dictionary
    empty = np.asarray(pa.compute.equal(words, ""), dtype=bool) if len(words) else np.zeros(0, bool)
    if empty.any():  # what splitting leaves of texts without words
        keep = ~empty[codes]
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets - offsets[0]]
    else:
        offsets = offsets - offsets[0]
    return codes, words, offsets


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; 0 for empty texts."""
    run = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as deltas, bytes grouped by significance, compressed."""
    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    data = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def sum_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of each key's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Cache(dict):
    """Bounded memo in two generations: the older half is dropped when the newer one is full."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def long_id(name: str):
    return F.col(name).cast("long")
