"""Token-ID / binary output (9): flat unsigned files with 64-bit document offsets.

Documents are range-partitioned by doc_id, so part k's documents all precede those of part k+1.
Each part's task writes its ids (uint16 where the vocabulary allows, else uint32) and its documents'
ids and lengths; the parts' totals are summed to prefix sums, and each part's 64-bit offsets (counted
from the start of the first part) are written from its base. Readers memory-map the files.

null text: encoded as empty (the end id alone). null doc_id: last. Repeated doc_ids (ties): each row is kept,
rows of one id ordered by a hash of their text. Very long texts are encoded whole, stretch by stretch.
Empty table: an empty manifest, no rows. Other columns are ignored, whatever their names.
A file is named after the task attempt that wrote it and only files in the manifest are read, so
lost executors and repeated attempts do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise, new_folder, read_array, slices, write_bytes, open_fs
from hemicycle.llm.bytelevel import Pieces

_held: dict[tuple, Pieces] = {}
_MANIFEST = "part int, ids string, docs string, dtype string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write docs(doc_id, text); the manifest: a row per part with its files, base, n_docs and n_tokens."""
    folder = folder or new_folder(docs.sparkSession, "token-bins")

    def write(batches):
        key = (tokenizer_path, end_id)
        if key not in _held:
            _held.clear()
            probe = Pieces(tokenizer_path, len)
            dtype = "<u2" if max(probe.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
            code = "H" if dtype == "<u2" else "I"
            _held[key] = Pieces(tokenizer_path, lambda ids: struct.pack(f"<{len(ids)}{code}", *ids), 600_000)
            _held[key].dtype = dtype
        pieces = _held[key]
        end, width = np.array([end_id], pieces.dtype).tobytes(), int(pieces.dtype[-1])
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, local = open_fs(name)
        ids, lengths, missing, total, out = [], [], [], 0, None
        for b in slices(batches, "text"):
            out = out or fs.open_output_stream(f"{local}.ids", buffer_size=1 << 20)
            for text in b.column(1).to_pylist():
                data = b"".join(pieces.of(text or ""))
                out.write(data)
                out.write(end)
                lengths.append(len(data) // width + 1)
            ids.append(np.asarray(pa.compute.fill_null(b.column(0), 0), np.int64))
            missing.append(np.asarray(b.column(0).is_null()))
        if out is None:
            return
        out.close()
        n = np.array(lengths, "<u8")
        write_bytes(f"{name}.docs", n, np.concatenate(ids).astype("<i8"), np.concatenate(missing).astype("<u1"))
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "ids": f"{name}.ids", "docs": f"{name}.docs", "dtype": pieces.dtype, "n_docs": len(n), "n_tokens": int(n.sum())}],
            schema=pa.schema([("part", pa.int32()), ("ids", pa.string()), ("docs", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    narrow = docs.select(long_id("doc_id").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    parts = narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _MANIFEST)
    parts = materialise(parts, "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part: few
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def offsets(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                n = read_array(r["docs"], np.uint8)[: 8 * r["n_docs"]].view("<u8")
                r["offsets"] = r["docs"][: -len("docs")] + f"{uuid.uuid4().hex}.offsets"
                write_bytes(r["offsets"], np.concatenate([[0], np.cumsum(n, dtype=np.uint64)]).astype("<u8") + np.uint64(r["base"]))
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema.append(pa.field("offsets", pa.string())))

    return materialise(spread(based).mapInArrow(offsets, f"{_MANIFEST}, base long, offsets string"), "token-manifest")


def spread(rows: DataFrame) -> DataFrame:
    """A few rows that each stand for a file, dealt out to as many tasks as the session uses."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian uint32 ids) of each document, from the files."""

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, off = read_array(r["ids"], r["dtype"]), read_array(r["offsets"], "<u8").astype(np.int64)
                docs = read_array(r["docs"], np.uint8)[8 * r["n_docs"] :]
                doc_id, null = docs[: 8 * r["n_docs"]].view("<i8"), docs[8 * r["n_docs"] :].view(bool)
                at = off - r["base"]
                for lo in range(0, r["n_docs"], 20_000):
                    hi = min(lo + 20_000, r["n_docs"])
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4")) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_id[lo:hi], mask=np.asarray(null[lo:hi])), pa.array(off[lo:hi]), pa.array(off[lo + 1 : hi + 1] - off[lo:hi]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
