"""Cleaning, normalising and date expressions. All are plain Column expressions inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Party codes and the spellings that map to them.
PARTIES = ("S", "M", "C", "V", "MP", "KD", "L", "SD")
VOTE_ALIASES = {"s": "S", "m": "M", "c": "C", "v": "V", "mp": "MP", "kd": "KD", "fp": "L", "vpk": "V", "apk": "S", "-": None}
SPEECH_ALIASES = {"s": "S", "m": "M", "c": "C", "v": "V", "mp": "MP", "kd": "KD", "fp": "L"}
NULL_TOKENS = ("nan", "", "?", "null")
YES = ("ja", "j", "1", "yes", "y", "för", "for")
NO = ("nej", "no", "n", "0", "against", "emot")
UNKNOWN_ACTORS = ("unknown", "nyd", "")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c, tokens: Sequence[str] = NULL_TOKENS, lower: bool = False) -> Column:
    """Trimmed text; tokens that stand for nothing become null."""
    t = F.trim(col(c))
    return F.when(~(F.lower(t) if lower else t).isin(*tokens), t)


def nan_to_null(c) -> Column:
    """NaN is no number here: aggregates and orders see null."""
    return F.when(~F.isnan(col(c)), col(c))


def _lookup(c: Column, table: Mapping[str, str | None]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[c]


def normalise_actor(c, aliases: Mapping[str, str | None] = VOTE_ALIASES, valid: Sequence[str] = PARTIES, lower_first: bool = False) -> Column:
    """Aliases by exact spelling, else the upper-case code if valid, else null. lower_first: the speech variant."""
    t = F.trim(col(c))
    key = F.lower(t) if lower_first else t
    return F.when(key.isin(*aliases), _lookup(key, aliases)).when(F.upper(t).isin(*valid), F.upper(t))


def normalise_speech_actor(c) -> Column:
    return normalise_actor(c, SPEECH_ALIASES, lower_first=True)


def session_key(c) -> Column:
    return F.replace(col(c), F.lit("/"), F.lit(""))


def session_year(c) -> Column:
    return F.substring(col(c), 1, 4).try_cast("int")


def clean_doc_id(c) -> Column:
    t = F.trim(col(c))
    return F.when((t != "") & (F.lower(t) != "none"), t)


def number_or_zero(c) -> Column:
    n = col(c).try_cast("double")
    return F.coalesce(F.nanvl(n, F.lit(0.0)), F.lit(0.0))


def lenient_timestamp(c, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy")) -> Column:
    """The first format that parses, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(col(c)), F.lit(f)) for f in formats))


def metadata_date(df: DataFrame, date_col: str = "date", metadata_col: str = "metadata", keys: Sequence[str] = ("systemdatum", "datum", "date", "system_date")) -> DataFrame:
    """Dates from metadata JSON, only where no row has a date of its own."""
    none = df.agg((F.count(date_col) == 0).alias("none_dated"))
    found = F.coalesce(*(F.nullif(F.trim(F.get_json_object(metadata_col, f"$.{k}")), F.lit("")) for k in keys))
    parsed = lenient_timestamp(found).cast(df.schema[date_col].dataType)
    return df.crossJoin(F.broadcast(none)).withColumn(date_col, F.when(F.col("none_dated"), parsed).otherwise(F.col(date_col))).drop("none_dated")


def days_between(a, b, floor_first: bool = False) -> Column:
    """Whole 24-hour days between timestamps: floor(|d|), or |floor(d)|."""
    s = (F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return (F.abs(F.floor(s)) if floor_first else F.floor(F.abs(s))).cast("long")


def month_distance(a, b) -> Column:
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("long")


# The parliament's periods.
PERIODS = ((1971, 1979), (1980, 1989), (1990, 1997), (1998, 2001), (2002, 2005), (2006, 2009), (2010, 2013), (2014, 2017), (2018, 2021), (2022, 2025))


def period_bucket(year, bounds: Sequence[tuple[int, int]] = PERIODS) -> Column:
    """'from-to' of the range that holds the year, else null."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(bounds):
        out = F.when(col(year).between(lo, hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def election_years(first: int, last: int, cadence: int = 4) -> list[int]:
    return list(range(first, last + 1, cadence))


def in_run_up(year, elections: Sequence[int], window: int = 1) -> Column:
    """Year lies within `window` years up to and with an election."""
    return F.exists(F.array(*map(F.lit, elections)), lambda e: (col(year) <= e) & (col(year) >= e - window))


def in_month_run_up(month, elections: Sequence[int], election_month: int = 9, months: int = 12) -> Column:
    def near(e):
        d = (e - F.year(month)) * 12 + F.lit(election_month) - F.month(month)
        return (d >= 0) & (d <= months)

    return F.exists(F.array(*map(F.lit, elections)), near)


def time_key(c) -> Column:
    """2014, 2014.0 and '2014' are one key."""
    n = col(c).try_cast("double")
    return F.coalesce(F.round(n).cast("long").cast("string"), F.trim(col(c).cast("string")))


def vote_signal(c) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.when(t.isin(*YES), 1.0).when(t.isin(*NO), 0.0)


def code_prefix(c) -> Column:
    return F.nullif(F.upper(F.regexp_extract(col(c), "^([A-Za-z]+)", 1)), F.lit(""))


def is_actor(c, unknown: Sequence[str] = UNKNOWN_ACTORS) -> Column:
    """A known actor, whatever the case; null is unknown."""
    return F.coalesce(~F.lower(F.trim(col(c))).isin(*unknown), F.lit(False))


def axis_index(c, axis: Sequence[str]) -> Column:
    return _lookup(col(c), {a: str(i) for i, a in enumerate(axis)}).cast("int")


# Rules by prefix, the first that holds decides.
_CONFIDENCE = (
    ("existing:betankande_ref_dok_id", 0.98), ("existing:rel_dok_id", 0.95), ("existing:", 0.90), ("fallback:party_category_vote", 0.80), ("fallback:party_category", 0.75), ("fallback:party_vote", 0.70),
    ("fallback:party", 0.65), ("fallback:category_vote", 0.60), ("fallback:category", 0.55), ("fallback:vote_any", 0.45),
)
# Stratum, score and whether it is structural, by the source's full name, then by its prefix.
_STRATA_BY_NAME = (
    ("existing:rel_dok_id", "structural_high", 0.95, True), ("existing:betankande_ref_dok_id", "structural_high", 0.95, True), ("graph_direct_signatory_motion", "graph_signatory", 0.85, True),
    ("graph_direct_signatory_vote", "graph_signatory", 0.85, True), ("graph_direct_motion", "graph_direct", 0.65, False), ("graph_direct_vote", "graph_direct", 0.65, False), ("graph_rebalanced_motion", "heuristic_graph", 0.50, False),
)
_STRATA_BY_PREFIX = (("existing:", "existing_unknown", 0.70, False), ("fallback_after_stale_existing:", "heuristic_fallback", 0.40, False), ("fallback:", "heuristic_fallback", 0.35, False))


def link_confidence(c, rules: Sequence[tuple[str, float]] = _CONFIDENCE, default: float = 0.35) -> Column:
    out = F.lit(default)
    for prefix, value in reversed(rules):
        out = F.when(col(c).startswith(prefix), value).otherwise(out)
    return out


def link_stratum(c) -> Column:
    """struct(stratum, score, structural) of a link's source; an unknown or null source is the stratum unknown."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    make = lambda name, score, structural: F.struct(F.lit(name).alias("stratum"), F.lit(score).alias("score"), F.lit(structural).alias("structural"))
    rules = [(s == name, out) for name, *out in _STRATA_BY_NAME] + [(s.startswith(prefix), out) for prefix, *out in _STRATA_BY_PREFIX]
    result = make("unknown", 0.20, False)
    for holds, out in reversed(rules):
        result = F.when(holds, make(*out)).otherwise(result)
    return result


def first_signatory(signatories: str) -> Column:
    """Party of the primary signatory: position 1, else role undertecknare, else the first with a party."""
    held = F.filter(F.col(signatories), lambda x: F.trim(F.coalesce(x["party"], F.lit(""))) != "")
    rank = F.transform(held, lambda x, i: F.struct(F.when(x["position"] == 1, 0).when(F.lower(x["role"]) == "undertecknare", 1).otherwise(2).alias("rank"), i.alias("i"), F.trim(x["party"]).alias("party")))
    return F.get(F.array_sort(rank), F.lit(0))["party"]


def object_or_list(c, element: str) -> Column:
    """JSON that is either one object or a list of them, as a list."""
    text = col(c)
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), f"array<{element}>"), F.array(F.from_json(F.when(F.trim(text).startswith("{"), text), element)), F.array().cast(f"array<{element}>"))


def sorted_json(keys: Column, values: Column) -> Column:
    """A JSON object with its keys in order."""
    pairs = F.array_sort(F.arrays_zip(keys.alias("k"), values.alias("v")))
    return F.to_json(F.map_from_entries(pairs))


def group_share(value, *keys: str) -> Column:
    """Share of the group's total; 0 where the total is not positive."""
    total = F.sum(col(value)).over(Window.partitionBy(*keys))
    return F.when(total > 0, col(value) / total).otherwise(0.0)
