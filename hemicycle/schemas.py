"""Explicit schemas of the canonical tables, and column resolution for inputs that drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Ordered axis from one end to the other. The canonical seven categories.
AXIS = ("far_left", "left", "centre_left", "centre", "centre_right", "right", "far_right")

LABELS = "item_id string, modality string, category string, raw_score double, weight double, matched_rules string, version string, created_at timestamp"
ITEMS = "item_id string, modality string, actor string, signatory string, date timestamp, title string, text string, metadata string"
VOTES = "session string, code string, point string, vote_id string, name string, member_id string, party string, district string, vote string, about string, date timestamp"
SPEECHES = "doc_id string, speech_id string, session string, date timestamp, speaker string, party string, text string, heading string, activity string, rel_doc_id string, member_id string"
REPORTS = "doc_id string, session string, code string, organ string, date timestamp, title string, ref_ids string, ref_count int"
SIGNATORIES = "item_id string, session string, member_id string, name string, party string, role string, position int"
LINEAGE = "lineage_id string, source_table string, source_id string, operation string, at timestamp, checksum string, parent_id string, notes string"
LINKS = "item_id string, target_id string, action_id string, action_type string, category string, days_diff long, link_source string, similarity double"


def resolve_first(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that df has."""
    return next((n for n in names if n in df.columns), None)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
