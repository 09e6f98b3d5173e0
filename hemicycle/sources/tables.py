"""Reading tables by stem or extension, guards, inventories; writing, upserts, lineage and reports."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import re
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.operators.rows import first_row


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def resolve_table(spark: SparkSession, folder: str, stem: str, extensions: Sequence[str] = (".parquet", ".parquet.zst", ".pq")) -> str:
    for ext in extensions:
        if exists(spark, f"{folder}/{stem}{ext}"):
            return f"{folder}/{stem}{ext}"
    raise FileNotFoundError(f"{folder}/{stem} with any of {', '.join(extensions)}")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, CSV or TSV by extension."""
    if path.endswith((".csv", ".tsv")):
        df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A directory of shards whose schemas may differ; unreadable files are skipped."""
    return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that a glob matches, the greatest name on ties."""
    fs, p = _hadoop(spark, pattern)
    found = [(f.getModificationTime(), f.getPath().toString()) for f in fs.globStatus(p) or []]
    return max(found)[1] if found else None


def ensure_min_rows(df: DataFrame, least: int, name: str = "table") -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{name} has {n} rows, fewer than {least}")
    return df


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per kind (first word of the name): files, bytes and the years that names mention. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    years = F.transform(F.regexp_extract_all(name, F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int"))
    rows = files.select(F.lower(F.regexp_extract(name, r"^([A-Za-z]+)", 1)).alias("kind"), "length", F.array_min(years).alias("first"), F.array_max(years).alias("last"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.min("first").alias("first_year"), F.max("last").alias("last_year"))


def corpus_statistics(**tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct ids and first and last year of tables given as (frame, id, year)."""
    out = None
    for name, (df, key, year) in tables.items():
        one = df.agg(F.lit(name).alias("source"), F.countDistinct(key).alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
        out = one if out is None else out.unionByName(one)
    return out


def write_table(df: DataFrame, path: str, codec: str = "zstd", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _rename(fs, source, target) -> None:
    try:
        done = fs.rename(source, target)
    except Py4JJavaError as e:
        raise OSError(f"{source.toString()} could not be renamed: {e.java_exception.getMessage()}") from None
    if not done:
        raise OSError(f"{source.toString()} could not be renamed to {target.toString()}")


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put `new` in the place of `path`; if that fails, the old table is put back."""
    fs, p = _hadoop(spark, path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    old = make(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(p)
    if had:
        _rename(fs, p, old)
    try:
        _rename(fs, make(new), p)
    except Exception:
        if had:
            _rename(fs, old, p)
        raise
    if had:
        fs.delete(old, True)


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 600.0):
    """Only one writer of a table at a time: a lock file beside it, made by an atomic create; TimeoutError after `wait` seconds."""
    fs, p = _hadoop(spark, f"{path}.lock")
    until = time.monotonic() + wait
    while True:
        try:
            fs.create(p, False).close()
            break
        except Exception:
            if time.monotonic() > until:
                raise TimeoutError(f"{path}.lock is held by another writer") from None
            time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(p, False)


def upsert(rows: DataFrame, path: str, keys: Sequence[str], order: str | None = None, keep: str = "new") -> int:
    """Merge rows into the table at path, one row per key; returns its number of rows.

    order: the greatest value wins. Otherwise keep 'new' replaces and 'old' inserts only what is absent. The
    merged table is written beside the old one and put in its place, under a lock.
    """
    spark = rows.sparkSession
    with locked(spark, path):
        merged = rows.withColumn("__new", F.lit(1 if keep == "new" else 0))
        if exists(spark, path):
            old = spark.read.parquet(path).withColumn("__new", F.lit(0 if keep == "new" else 1))
            merged = old.unionByName(merged, allowMissingColumns=True)
        tie = F.xxhash64(*(c for c in merged.columns if c != "__new"))
        ranks = ([F.col(order).desc_nulls_last()] if order else []) + [F.col("__new").desc(), tie]
        new = f"{path}.new-{uuid.uuid4().hex}"
        first_row(merged, keys, ranks).drop("__new").write.parquet(new)
        _swap(spark, new, path)
        return spark.read.parquet(path).count()


def upsert_partitioned(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 256, keep: str = "new") -> None:
    """upsert() into a table kept in folders by a hash of the keys: only folders that the rows touch are read and rewritten."""
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("key_bucket", place)
    for r in dealt.select("key_bucket").distinct().collect():  # at most `buckets` numbers
        upsert(dealt.where(F.col("key_bucket") == r[0]).drop("key_bucket"), f"{path}/key_bucket={r[0]}", keys, keep=keep)


def append_lineage(spark: SparkSession, path: str, table: str, source_ids: DataFrame, operation: str, notes: str = "") -> None:
    """One record per source_id."""
    rows = source_ids.select(F.expr("uuid()").alias("lineage_id"), F.lit(table).alias("source_table"), F.col(source_ids.columns[0]).cast("string").alias("source_id"), F.lit(operation).alias("operation"), F.current_timestamp().alias("at"), F.sha2(F.to_json(F.struct(*source_ids.columns)), 256).alias("checksum"), F.lit(None).cast("string").alias("parent_id"), F.lit(notes).alias("notes"))
    rows.write.mode("append").parquet(path)


def export_table(df: DataFrame, path: str, at: str, codec: str = "zstd") -> None:
    """Timestamps coerced; rows whose timestamp does not parse are left out; files sorted by it."""
    parsed = df.withColumn(at, F.col(at).try_cast("timestamp")).where(F.col(at).isNotNull())
    write_table(parsed.sortWithinPartitions(at), path, codec)


def report(df: DataFrame, kind: str = "markdown", most: int = 1000, digits: int = 4) -> str:
    """A small result as a Markdown, LaTeX, CSV or JSON table; more than `most` rows are an error, none are dropped."""
    rows, names = df.limit(most + 1).collect(), df.columns
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    if kind == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False)
    cells = [[show(r[n]) for n in names] for r in rows]
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue().rstrip("\n")
    if kind == "latex":
        plain = [[re.sub(r"([&%$#_{}])", r"\\\1", x) for x in r] for r in [names, *cells]]
        body = " \\\\\n".join(" & ".join(r) for r in plain)
        return f"\\begin{{tabular}}{{{'l' * len(names)}}}\n{body} \\\\\n\\end{{tabular}}"
    flat = [[x.replace("|", "\\|").replace("\n", " ") for x in r] for r in [names, *cells]]
    return "\n".join(f"| {' | '.join(r)} |" for r in [flat[0], ["---"] * len(names), *flat[1:]])


def catalog_table(spark: SparkSession, folder: str, stem: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """A table by its stem: its Parquet export if there is one, else CSV or TSV; with a selection and a filter."""
    df = read_table(spark, resolve_table(spark, folder, stem, (".parquet", ".parquet.zst", ".pq", ".csv", ".tsv")))
    df = df.where(where) if where else df
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def unclassified(items: DataFrame, labels: DataFrame, key: str = "item_id") -> DataFrame:
    """Items without any label, with a text."""
    return items.join(labels.select(key).distinct(), key, "left_anti").where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def sibling(spark: SparkSession, path: str, extensions: Sequence[str] = (".json.zst", ".json")) -> str | None:
    """The first file with the path's stem and one of the extensions."""
    stem = re.sub(r"\.[^/]*$", "", path)
    return next((stem + e for e in extensions if exists(spark, stem + e)), None)


def write_artifact(spark: SparkSession, path: str, value) -> None:
    """A JSON value as one file, compressed by zstandard where the path ends in .zst."""
    data = json.dumps(value, ensure_ascii=False, sort_keys=True).encode()
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdCompressor().compress(data)
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def read_artifact(spark: SparkSession, path: str):
    """The value that write_artifact() wrote."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data)
    return json.loads(data)


def provenance(**facts) -> str:
    return json.dumps({"at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")} | facts, default=str, sort_keys=True)
