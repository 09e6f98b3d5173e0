"""WARC (7): archives, read back through an external merge of their indexes.

Writing. Payload digests are reduced to the largest page_id of each payload that occurs more than once;
that table is broadcast if it is small (its size is checked) and joined by shuffle otherwise. Each
task then writes one archive of gzip members, a record each: the full response for the chosen page,
a revisit that refers to it for the others.
Reading. Each archive is read back record by record. Its captures are sorted by URL key, timestamp and
page_id in runs of bounded size, each of which is written to a file of small blocks. Split points from
the keys of a bounded number of archives cut the key space into ranges, and a run's slice in each range
is known by its rows. For each range a task merges its slices of all runs with a loser tree that holds
one block of each run, so ranges and rows within them are the globally ordered capture history. More
runs than `fan_in` are first merged in groups, pass by pass. Captures of equal keys (ties) stand in the
order of their runs' names and places.

null html: an empty payload. null url: an empty key. null page_id: a record without target name that
revisits the others of its payload; a payload that only such rows have is all response. Rows that repeat the
chosen page are responses each. Very long pages are records like others, held one at a time. Empty table:
no archive and no rows. Other columns are ignored, whatever their names.
Archives and runs are named after the task attempt that wrote them, and only reported ones are read.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise, new_folder, open_fs, slices

_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, the time of page 0; page n was captured n seconds later
_SAMPLES = 16
#: Archives whose keys give the split points; rows of a run, and of one of its blocks.
_SAMPLED, _RUN, _BLOCK = 4096, 50_000, 512


def base32_sha1(payload):
    """A column's SHA-1 in upper-case base32: 40 bits at a time through base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_DIGITS)


def url_key(url: str) -> str:
    """A sortable key: host parts reversed, then path and query, lower-case, without scheme, port 80/443 or fragment."""
    rest = url.split("#", 1)[0].strip().lower().split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash + path or "/") if rest else ""


def loser_tree(runs: list[Iterable], key: Callable = lambda x: x) -> Iterator:
    """Merge sorted runs; ties go to the earlier run. One comparison per level and item."""
    its = [iter(r) for r in runs]
    k = len(its)
    if not k:
        return
    heads: list = [next(it, its) for it in its]  # its: a run's end
    keys = [None if h is its else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if heads[a] is its or heads[b] is its:
            return heads[b] is its and (heads[a] is not its or a < b)
        return keys[a] < keys[b] or (keys[a] == keys[b] and a < b)

    losers = [-1] * k
    winner = [0] * (2 * k)
    for node in range(2 * k - 1, 0, -1):
        if node >= k:
            winner[node] = node - k
        else:
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while heads[top] is not its:
        yield heads[top]
        heads[top] = next(its[top], its)
        keys[top] = None if heads[top] is its else key(heads[top])
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _stamp(page_id: int | None) -> str:
    from datetime import UTC, datetime, timedelta

    try:
        return (datetime.fromtimestamp(_EPOCH, UTC) + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "9999-12-31T23:59:59Z" if page_id > 0 else "0001-01-01T00:00:00Z"


def record(page_id: int | None, url: str, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block is the HTTP header alone, whose length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_stamp(page_id)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length of each gzip member, its record's header and its block."""
    at, held, data, unzip = 0, b"", [], zlib.decompressobj(31)
    used = 0
    while True:
        held = held or stream.read(step)
        if not held:
            break
        data.append(unzip.decompress(held))
        used += len(held) - len(unzip.unused_data)
        held = unzip.unused_data
        if unzip.eof:
            raw = b"".join(data)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield at, used, fields, rest[: int(fields["Content-Length"])]
            at, used, data, unzip = at + used, 0, [], zlib.decompressobj(31)
    if data:
        raise ValueError("archive ends within a record")


def _order(page_id: int | None, url: str) -> tuple:
    return url_key(url), _stamp(page_id), page_id is None, page_id or 0


def write_archives(pages: DataFrame, min_bytes: int = 0, broadcast_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html); the manifest: archive, n_records, n_bytes and a few sorted keys of each."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    flat = pages.select(long_id("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    digested = flat.withColumn("digest", base32_sha1(F.encode("html", "utf-8"))).withColumn("length", F.octet_length("html").cast("long"))
    groups = digested.where(F.col("length") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("length").alias("l")).agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"))
    repeated = materialise(groups.where("n > 1 and chosen is not null").drop("n"), "repeated")
    if repeated.count() * 64 <= broadcast_bytes:
        repeated = F.broadcast(repeated)
    joined = digested.join(repeated, (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l")), "left")
    rows = joined.select("page_id", "url", "html", "length", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen")).alias("refers_to"))

    def write(batches):
        name, out, keys, total = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, [], 0
        fs, local = open_fs(name)
        for b in slices(batches, "html"):
            out = out or fs.open_output_stream(local, compression=None, buffer_size=1 << 20)
            for r in b.to_pylist():
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                url = "".join(r["url"].splitlines())
                data = pack.compress(record(r["page_id"], url, r["html"].encode(), r["length"], r["digest"], r["refers_to"])) + pack.flush()
                out.write(data)
                total += len(data)
                keys.append(_order(r["page_id"], url))
        if out is not None:
            out.close()
            keys.sort()
            some = [pickle.dumps(keys[i * len(keys) // _SAMPLES]) for i in range(_SAMPLES)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64()), pa.array([some], pa.list_(pa.binary()))], names=["archive", "n_records", "n_bytes", "keys"])

    return materialise(rows.mapInArrow(write, "archive string, n_records long, n_bytes long, keys array<binary>"), "manifest")


_FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
_CAPTURE = pa.schema(_FIELDS)
_ENTRY = pa.schema([*_FIELDS, ("range", pa.int32()), ("place", pa.int64())])
_ENTRY_DDL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, range int, place long"
_SLICE_DDL = "range int, file string, start long, stop long"


def _key(row: tuple) -> tuple:
    """The order of captures; one without page comes last among its equals."""
    return row[0], row[1], row[2] is None, row[2] or 0


class _RunWriter:
    """A file of sorted captures in blocks of _BLOCK rows."""

    def __init__(self, path: str):
        fs, local = open_fs(path)
        self.out = fs.open_output_stream(local, compression=None, buffer_size=1 << 20)
        self.ipc = pa.ipc.new_file(self.out, _CAPTURE, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.held: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) == _BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.ipc.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE))
            self.held = []

    def close(self) -> None:
        self.flush()
        self.ipc.close()
        self.out.close()


def _run_rows(path: str, start: int, stop: int) -> Iterator[tuple]:
    """Rows [start, stop) of a run, one block in memory at a time."""
    fs, local = open_fs(path)
    with fs.open_input_file(local) as f:
        run = pa.ipc.open_file(f)
        for n in range(start // _BLOCK, -(-stop // _BLOCK)):
            block = run.get_batch(n)
            lo, hi = max(start - n * _BLOCK, 0), min(stop - n * _BLOCK, block.num_rows)
            yield from zip(*(c.to_pylist() for c in block.slice(lo, hi - lo).columns), strict=True)


def _by_range(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Slices of each range (or group and range) of rows sorted by it, in the order of file names."""
    held: list[tuple] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][0] != r["range"]:
                yield held[0][0], sorted(x[1:] for x in held)
                held = []
            held.append((r["range"], r["file"], r["start"], r["stop"]))
    if held:
        yield held[0][0], sorted(x[1:] for x in held)


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_captures(manifest: DataFrame, run_rows: int = _RUN, fan_in: int = 128) -> DataFrame:
    """The capture history: a row per record with its place in (range, place) order of URL key, time and page_id."""
    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "capture-runs")
    some = manifest.select("archive", "keys").orderBy(F.xxhash64("archive"), "archive").limit(_SAMPLED).collect()  # 16 keys of at most _SAMPLED archives
    keys = sorted(pickle.loads(k) for r in some for k in r["keys"])
    splits = [keys[i * len(keys) // tasks] for i in range(1, tasks)] if keys else []

    def runs(batches):
        def sorted_run(entries: list[tuple]) -> pa.RecordBatch:
            entries.sort(key=_key)
            name = f"{folder}/run-{uuid.uuid4().hex}"
            out = _RunWriter(name)
            for e in entries:
                out.add(e)
            out.close()
            edges = [0, *(bisect_left(entries, x, key=_key) for x in splits), len(entries)]
            cut = [(i, a, z) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if a < z]
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([name] * len(cut)), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64())], names=["range", "file", "start", "stop"])

        for b in batches:
            for r in b.to_pylist():
                fs, local = open_fs(r["archive"])
                entries, n_records = [], 0
                with fs.open_input_stream(local, compression=None) as f:
                    for at, size, head, block in read_records(f):
                        http, _, body = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        if kind == "response" and (len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{r['archive']} at {at}: payload and digest differ")
                        page = _page(head["WARC-Record-ID"])
                        entries.append((url_key(head["WARC-Target-URI"]), _stamp(page), page, n, digest, kind, _page(head.get("WARC-Refers-To")), r["archive"], at, size))
                        n_records += 1
                        if len(entries) == run_rows:
                            yield sorted_run(entries)
                            entries = []
                if entries:
                    yield sorted_run(entries)
                if n_records != r["n_records"]:
                    raise ValueError(f"{r['archive']}: {n_records} records, {r['n_records']} were written")

    def merged(slices_of: list[tuple]) -> Iterator[tuple]:
        return loser_tree([_run_rows(*s) for s in slices_of], key=_key)

    def merge_group(batches):
        for which, found in _by_range(batches):
            name, n = f"{folder}/run-{uuid.uuid4().hex}", 0
            out = _RunWriter(name)
            for row in merged(found):
                out.add(row)
                n += 1
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([which // _GROUPS], pa.int32()), pa.array([name]), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["range", "file", "start", "stop"])

    def merge(batches):
        for which, found in _by_range(batches):
            held, place = [], 0
            for row in merged(found):
                held.append((*row, which, place))
                place += 1
                if len(held) == 4 * _BLOCK:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)

    by_range = lambda df: df.repartition(tasks, "range").sortWithinPartitions("range")
    found = materialise(manifest.select("archive", "n_records").repartition(tasks).mapInArrow(runs, _SLICE_DDL), "runs")
    while True:
        many = found.groupBy("range").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if many <= fan_in:
            break
        group = F.pmod(F.xxhash64("file"), F.lit(-(-many // (fan_in // 2)))).cast("long")  # so that hardly a group has more than fan_in
        dealt = by_range(found.withColumn("range", F.col("range").cast("long") * _GROUPS + group))
        found = materialise(dealt.mapInArrow(merge_group, _SLICE_DDL), "runs")
    return by_range(found).mapInArrow(merge, _ENTRY_DDL)


#: More groups than a pass has; a range and a group make one number.
_GROUPS = 1 << 24


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ENTRY, strict=True)], schema=_ENTRY)
