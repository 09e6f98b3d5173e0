"""SentencePiece encoding and decoding (3) by a max-plus parallel scan.

The model at hand is a BPE model. Its encoding of a text is the one path through the piece lattice in
which every two neighbouring pieces re-encode to themselves, so a path's score is 0 if all its
neighbours agree and minus infinity otherwise, and the best path is found in the (max, +) algebra.
A text of more than chunk_chars characters is cut into chunks at fixed places, inside words too. A
boundary's states are the pieces that may cover or end at it; each chunk yields the matrix of best
scores from its left boundary's states to its right one's. Products of these matrices, which are
associative, give the state at every boundary, and each chunk is then traced back on its own.
Within a chunk, runs between word starts cannot influence each other (no piece holds a word start
after another character), so each distinct run is encoded once by the library and remembered; only
the runs at the boundaries, or a chunk without word start, go through the lattice.

null text: encoded as empty, no pieces, decoded to ''. Texts that hold the word-start sign itself decode
to a space instead (as the library does). Repeated rows (ties) are each encoded. Very long texts take the scan.
Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import Cache, long_id, materialise, slices

MARK = "▁"
#: Longest piece considered, in characters; checked against the model when it is loaded.
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NONE = np.float32("-inf")


class PieceModel:
    """A BPE model's pieces, as the lattice and the decoder need them."""

    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(names))]
        self.score = {p: sp.get_score(i) for i, p in enumerate(names) if not special[i]}
        self.id = {p: i for i, p in enumerate(names) if not special[i]}
        self.longest = max(map(len, self.score))
        self.free = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        byte_of = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.byte_id = {byte_of[p]: i for i, p in enumerate(names) if p in byte_of and special[i]}
        self.unknown = sp.unk_id()
        self.text = [byte_of[p] if p in byte_of and s else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, (p, s) in enumerate(zip(names, special, strict=True))]
        self.canonical = lru_cache(50_000)(lambda p: self.merge(p) == [p])
        self.agree = lru_cache(100_000)(lambda a, b: self.merge(a + b) == [a, b])
        self.runs = Cache(lambda r: np.array(sp.encode(r[1:].replace(MARK, " ")), "<u4").tobytes() if r[0] == MARK and len(r) > 1 else self.ids(self.merge(r)), most)

    def merge(self, s: str) -> list[str]:
        """BPE by its definition, for strings of a few characters."""
        parts = list(s)
        while len(parts) > 1:
            scores = [self.score.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
            i = max(range(len(scores)), key=scores.__getitem__)
            if scores[i] == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            if p in self.id:
                out.append(self.id[p])
            elif self.byte_id:
                out += [self.byte_id[bytes([b])] for b in p.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def normalise(self, text: str) -> str:
        return self.sp.normalize(text) if text else ""

    def encode(self, text: str) -> bytes:
        """Ids (little-endian uint32) of a text in one chunk."""
        if not self.free:
            return np.array(self.sp.encode(text), "<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, _RUN.findall(self.normalise(text))))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    # The lattice. Positions are characters of a window of the normalised text.

    def states(self, window: str, at: int) -> list[tuple[int, int]]:
        """Pieces [i, j) that begin before the boundary and cover or end at it."""
        found = []
        for i in range(max(0, at - self.longest), at):
            for j in range(at, min(len(window), i + self.longest) + 1):
                if j - i == 1 or ((p := window[i:j]) in self.score and self.canonical(p)):
                    found.append((i, j))
        return found

    def forward(self, window: str, entries: list[tuple[str | None, int]], stop: int, trace: bool = False):
        """at[p][(piece, start)]: which entries (a bit mask) reach that piece, which ends at p; begun before stop."""
        at: dict[int, dict[tuple[str | None, int], int]] = {}
        back: dict[tuple[int, str | None, int], tuple] = {}
        for k, (piece, p) in enumerate(entries):
            at.setdefault(p, {})[(piece, -1 - k)] = 1 << k
        for p in range(min((p for _, p in entries), default=stop), stop):
            if p not in at:
                continue
            here = at[p]
            for q in range(p + 1, min(len(window), p + self.longest) + 1):
                t = window[p:q]
                if q - p > 1 and (t not in self.score or not self.canonical(t)):
                    continue
                mask = 0
                for (before, start), m in here.items():
                    if before is None or self.agree(before, t):
                        mask |= m
                        if trace:
                            back.setdefault((q, t, p), (p, before, start))
                if mask:
                    at.setdefault(q, {})[(t, p)] = at.get(q, {}).get((t, p), 0) | mask
        return (at, back) if trace else at

    def word_starts(self, window: str, a: int, b: int) -> tuple[int, int] | None:
        """First and last place in [a, b] at which a run begins, so that nothing reaches across."""
        if not self.free:
            return None
        ok = lambda q: 0 < q < len(window) and window[q] == MARK and window[q - 1] != MARK
        first = next((q for q in range(a, b + 1) if ok(q)), None)
        return None if first is None else (first, next(q for q in range(b, a - 1, -1) if ok(q)))

    def matrix(self, window: str, a: int, b: int, first: bool, last: bool) -> tuple[int, int, bytes]:
        """Best scores from the states at a to those at b, for the chunk [a, b) of a window with context."""
        left = [(None, a)] if first else [(window[i:j], j) for i, j in self.states(window, a)]
        right = [(i, j) for i, j in self.states(window, b) if not last or j == b]
        out = np.full((len(left), len(right)), NONE, np.float32)
        cut = self.word_starts(window, a, b - 1)
        reach = None
        if cut and all(p <= cut[0] for _, p in left):
            met = self.forward(window, left, cut[0]).get(cut[0], {})
            reach = 0
            for m in met.values():
                reach |= m
            ends = self.forward(window, [(None, cut[1])], b)
        else:
            ends = self.forward(window, left, b)
        for x, (i, j) in enumerate(right):
            mask = ends.get(j, {}).get((window[i:j], i), 0)
            if reach is not None:
                mask = reach if mask else 0
            for e in range(len(left)):
                if mask >> e & 1:
                    out[e, x] = 0
            if reach is None and not first:  # a piece that spans the whole chunk
                for e, (p, _) in enumerate(left):
                    if (i, j) == (j - len(p or ""), left[e][1]) and p == window[i:j] and i < a:
                        out[e, x] = 0
        return len(left), len(right), out.tobytes()

    def trace(self, window: str, a: int, b: int, entry: int, leave: int, first: bool, last: bool) -> bytes:
        """Ids of the pieces that follow the entry state's piece up to and with the exit state's."""
        left = [(None, a)] if first else [(window[i:j], j) for i, j in self.states(window, a)]
        right = [(i, j) for i, j in self.states(window, b) if not last or j == b]
        piece, p = left[entry]
        end = right[leave]
        if piece is not None and end == (p - len(piece), p):
            return b""
        cut = self.word_starts(window, a, b - 1)
        if cut and p <= cut[0]:
            head = self._path(window, (piece, p), cut[0], None) if p < cut[0] else []
            middle = b"".join(map(self.runs.__getitem__, _RUN.findall(window[cut[0] : cut[1]])))
            return self.ids(head) + middle + self.ids(self._path(window, (None, cut[1]), b, end))
        return self.ids(self._path(window, (piece, p), b, end))

    def _path(self, window: str, entry, stop: int, end: tuple[int, int] | None) -> list[str]:
        at, back = self.forward(window, [entry], stop, trace=True)
        if end is None:
            piece, start = next(iter(at[stop]))
            node = (stop, piece, start)
        else:
            node = (end[1], window[end[0] : end[1]], end[0])
        out = []
        while node[2] >= 0:
            out.append(node[1])
            node = back[node]
        return out[::-1]


_held: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    return _held.get(path) or _held.setdefault(path, PieceModel(path))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NONE, np.float32)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state at every boundary, from prefix and suffix products."""
    ahead = [np.zeros((matrices[-1].shape[1], 1), np.float32)]
    for m in matrices[:0:-1]:
        ahead.append(max_plus(m, ahead[-1]))
    ahead.reverse()
    row, at = np.zeros((1, 1), np.float32), []
    for m, rest in zip(matrices, ahead, strict=True):
        row = max_plus(row, m)
        best = int(np.argmax(row[0] + rest[:, 0]))
        at.append(best)
        row = np.where(np.arange(row.shape[1]) == best, row, NONE)
    return at


_OUT = "doc_id long, ids binary, decoded string"


def encode(docs: DataFrame, model_path: str, chunk_chars: int = 32_768) -> DataFrame:
    """doc_id, ids (flat little-endian uint32) and the text decoded from them, for each row of docs(doc_id, text)."""
    narrow = docs.select(long_id("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    giant = F.char_length("text") > chunk_chars

    def short(batches):
        model = _model(model_path)
        for b in slices(batches, "text"):
            ids = [model.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    def cut(batches):
        model = _model(model_path)
        for b in slices(batches, "text"):
            for row in b.to_pylist():
                text, n = model.normalise(row["text"]), 0
                k = max(1, -(-len(text) // chunk_chars))
                for n in range(k):
                    lo, hi = n * chunk_chars, min(len(text), (n + 1) * chunk_chars)
                    start = max(0, lo - model.longest)
                    window, a, z = text[start : hi + model.longest], lo - start, hi - start
                    rows, cols, data = model.matrix(window, a, z, n == 0, n == k - 1)
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row["row"], "doc_id": row["doc_id"], "chunk": n, "chunks": k, "piece_text": window, "a": a, "b": z, "m": rows, "n": cols, "matrix": data}],
                        schema=_chunk_schema,
                    )

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        at = boundary_states([np.frombuffer(r["matrix"], np.float32).reshape(r["m"], r["n"]) for r in rows])
        return pa.table({"row": [r["row"] for r in rows], "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "entry": pa.array([0, *at[:-1]], pa.int32()), "leave": pa.array(at, pa.int32())})

    def back(batches):
        model = _model(model_path)
        for b in batches:
            out = [model.trace(r["piece_text"], r["a"], r["b"], r["entry"], r["leave"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("chunk"), pa.array(out, pa.binary())], names=["row", "doc_id", "chunk", "ids"])

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        ids = b"".join(r["ids"] for r in rows)
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([ids], pa.binary()), "decoded": [_model(model_path).decode(ids)]})

    whole = narrow.where(~giant).mapInArrow(short, _OUT)
    keyed = narrow.where(giant).withColumn("row", F.monotonically_increasing_id())
    chunks = materialise(keyed.mapInArrow(cut, "row long, doc_id long, chunk int, chunks int, piece_text string, a int, b int, m int, n int, matrix binary"), "piece-chunks")
    at = chunks.select("row", "chunk", "m", "n", "matrix").groupBy("row").applyInArrow(scan, "row long, chunk int, entry int, leave int")
    traced = chunks.drop("matrix", "m", "n").join(at, ["row", "chunk"]).mapInArrow(back, "row long, doc_id long, chunk int, ids binary")
    return whole.unionByName(traced.groupBy("row").applyInArrow(join, _OUT))


_chunk_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("piece_text", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("matrix", pa.binary())])


def piece_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_crc32, decoded_chars of encode()'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("decoded").alias("decoded_crc32"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
    )
