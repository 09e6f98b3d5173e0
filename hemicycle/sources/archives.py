"""Zipped JSON and CSV, nested documents and parquet directories, as typed tables.

Archives are read as whole files by Spark and unzipped member by member in the workers; parsing is by
from_json with explicit schemas.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.functions.clean import blank_to_null, lenient_timestamp, normalise_actor, normalise_speech_actor, object_or_list, session_key
from hemicycle.functions.text import html_to_text
from hemicycle.operators.rows import first_row

_MEMBER = "archive string, member string, content string"


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member and text of each member whose name has the suffix (any case); unreadable archives and members give none."""

    def unzip(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for m in z.namelist():
                    if m.lower().endswith(suffix.lower()) and not m.endswith("/"):
                        try:
                            text = z.read(m).decode("utf-8-sig", "replace")
                        except (zipfile.BadZipFile, OSError):
                            continue
                        if text.strip():
                            yield pd.DataFrame([{"archive": name, "member": m, "content": text}])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unzip, _MEMBER)


# Field names of the archives.
_SPEECH = "dok_id string, anforande_id string, dok_rm string, dok_datum string, talare string, parti string, anforandetext string, avsnittsrubrik string, kammaraktivitet string, rel_dok_id string, intressent_id string"


def speeches(members: DataFrame) -> DataFrame:
    """One row per member {"anforande": {...}}; blanks are null, parties normalised."""
    a = members.select(F.from_json("content", f"anforande struct<{_SPEECH.replace(' string', ': string')}>").alias("j")).select("j.anforande.*").where("anforande_id is not null")
    names = {"dok_id": "doc_id", "anforande_id": "speech_id", "dok_rm": "session", "talare": "speaker", "anforandetext": "text", "avsnittsrubrik": "heading", "kammaraktivitet": "activity", "rel_dok_id": "rel_doc_id", "intressent_id": "member_id"}
    cols = [blank_to_null(k, ("",)).alias(v) for k, v in names.items()]
    return a.select(*cols, lenient_timestamp("dok_datum").alias("date"), normalise_speech_actor("parti").alias("party"))


def reports(members: DataFrame) -> DataFrame:
    """Committee reports with the ids they refer to, as a JSON array (null if none)."""
    ref = "struct<ref_dok_id: string, referenstyp: string>"
    doc = "dokumentstatus struct<dokument: struct<dok_id: string, rm: string, beteckning: string, organ: string, datum: string, titel: string>, dokreferens: struct<referens: string>>"
    j = members.select(F.from_json("content", doc).alias("j")).select("j.dokumentstatus.dokument.*", F.col("j.dokumentstatus.dokreferens.referens").alias("refs"))
    ids = F.filter(F.transform(object_or_list("refs", ref), lambda r: F.trim(r["ref_dok_id"])), lambda x: x.isNotNull() & (x != ""))
    return j.where("dok_id is not null").select(F.col("dok_id").alias("doc_id"), F.col("rm").alias("session"), F.col("beteckning").alias("code"), "organ", lenient_timestamp("datum").alias("date"), F.col("titel").alias("title"), F.when(F.size(ids) > 0, F.to_json(ids)).alias("ref_ids"), F.size(ids).alias("ref_count"))


def signatories(members: DataFrame) -> DataFrame:
    """One row per signatory of a document; a single object counts as a list of one."""
    one = "struct<intressent_id: string, namn: string, partibet: string, roll: string, ordning: string>"
    doc = "dokumentstatus struct<dokument: struct<dok_id: string, rm: string>, dokintressent: struct<intressent: string>>"
    j = members.select(F.from_json("content", doc).alias("j")).select(F.col("j.dokumentstatus.dokument.dok_id").alias("item_id"), F.col("j.dokumentstatus.dokument.rm").alias("session"), F.explode(object_or_list("j.dokumentstatus.dokintressent.intressent", one)).alias("s"))
    out = j.select("item_id", "session", F.col("s.intressent_id").alias("member_id"), F.col("s.namn").alias("name"), F.col("s.partibet").alias("party"), F.col("s.roll").alias("role"), F.col("s.ordning").try_cast("int").alias("position"))
    keys = ["item_id", "member_id", "name", "party", "role"]
    return first_row(out, keys, [F.col("position").asc_nulls_last(), F.col("session").asc_nulls_last()])


#: The two layouts of vote files.
OLD_LAYOUT = ("rm", "beteckning", "punkt", "votering_id", "namn", "intressent_id", "parti", "valkrets", "rost", "avser", "banknummer", "kon", "fodd", "datum")
NEW_LAYOUT = ("rm", "beteckning", "votering_id", "punkt", "namn", "intressent_id", "parti", "valkrets", "rost", "avser", "banknummer", "kon", "fodd", "datum")


def vote_rows(members: DataFrame, old: Sequence[str] = OLD_LAYOUT, new: Sequence[str] = NEW_LAYOUT) -> DataFrame:
    """Vote records of CSV members: a member with a header follows its header, one without the new layout."""
    wanted = sorted(set(old))

    def parse(batches):
        for pdf in batches:
            for text in pdf["content"]:
                rows = csv.reader(io.StringIO(text.lstrip("﻿")))
                first = next(rows, None)
                if first is None:
                    continue
                head = [x.strip().lower() for x in first]
                names = head if "rm" in head else list(new)
                body = rows if "rm" in head else [first, *rows]
                out = pd.DataFrame([dict(zip(names, r, strict=False)) for r in body if r])
                if len(out):
                    yield out.reindex(columns=wanted).astype(object).where(out.reindex(columns=wanted).notna(), None)

    raw = members.select("content").mapInPandas(parse, ", ".join(f"{c} string" for c in wanted))
    clean = raw.select(*(blank_to_null(c).alias(c) for c in wanted))
    return clean.select(session_key("rm").alias("session"), F.col("beteckning").alias("code"), F.col("punkt").alias("point"), F.col("votering_id").alias("vote_id"), F.col("namn").alias("name"), F.col("intressent_id").alias("member_id"), normalise_actor("parti").alias("party"), F.col("valkrets").alias("district"), F.col("rost").alias("vote"), F.col("avser").alias("about"), lenient_timestamp("datum").alias("date"))


def bulk_documents(members: DataFrame) -> DataFrame:
    """id, title, text, date, party, doc_type by coalesce chains; HTML stands in for a text under 50 characters."""
    get = lambda *paths: F.coalesce(*(F.nullif(F.trim(F.get_json_object("content", p)), F.lit("")) for p in paths))
    base = "$.dokumentstatus.dokument."
    text, html = get(f"{base}text", "$.text"), get(f"{base}html", "$.html")
    return members.select(
        get(f"{base}dok_id", f"{base}id", "$.dok_id", "$.id").alias("item_id"), get(f"{base}titel", "$.titel", "$.title").alias("title"), F.when(F.length(F.coalesce(text, F.lit(""))) < 50, F.coalesce(html_to_text(html), text)).otherwise(text).alias("text"),
        lenient_timestamp(get(f"{base}datum", "$.datum", "$.date")).alias("date"), get(f"{base}parti", "$.parti", "$.party").alias("party"), get(f"{base}typ", "$.typ", "$.doc_type").alias("doc_type"), F.col("content").alias("json"),
    ).where("item_id is not null")
