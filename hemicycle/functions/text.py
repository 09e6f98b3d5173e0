"""Text expressions: tokens, sentences, HTML, keyword and stance rules. Python only where Unicode tables are needed."""

from __future__ import annotations

import html as _html
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hemicycle.functions.clean import col

SENTENCE = r"(?<=[.!?])\s+"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _html.unescape(x))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalise_text(c) -> Column:
    """NFKC, dashes to '-', white space squeezed."""
    return squeeze(F.translate(nfkc(col(c)), "–—", "--"))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def without(tokens_col, stop: Sequence[str]) -> Column:
    """Tokens that are no stop words; repeats stay."""
    return F.filter(col(tokens_col), lambda t: ~t.isin(*stop))


def html_to_text(c, entities: Mapping[str, str] | None = None) -> Column:
    """Scripts, styles and tags out, entities decoded, white space squeezed.

    All entities are decoded as browsers do, also without a semicolon; or, if `entities` (as written, with
    what they stand for) are given, these alone, one after another. Then scripts go before styles, and
    white space and word ends are ASCII, as in RE2.
    """
    if entities is None:
        bare = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]+>", " ")
        return squeeze(unescape(bare))
    t = col(c)
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?isu)<{tag}(?![0-9A-Za-z_]).*?</{tag}[\t\n\f\r ]*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for written, meant in entities.items():
        t = F.replace(t, F.lit(written), F.lit(meant))
    return F.trim(F.regexp_replace(t, r"[\t\n\f\r ]+", " "))


def strip_tags(c) -> Column:
    """Cheap: only where both brackets occur."""
    t = col(c)
    return F.when(t.contains("<") & t.contains(">"), squeeze(F.regexp_replace(t, r"<[^>]+>", " "))).otherwise(t)


def sentences(c) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), SENTENCE), lambda s: F.trim(s) != "")


def chunks(c, most: int = 1500) -> Column:
    """Sentences gathered greedily into chunks of at most `most` characters; a longer sentence stands alone.

    A pass over the sentences' lengths notes where chunks start (a few numbers); chunks are then slices, so
    no text is copied on the way.
    """
    return _sliced(sentences(c), most)


def _sliced(held: Column, most: int) -> Column:
    sizes = F.transform(held, lambda s: F.length(s))
    opened = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, n: F.struct(
            F.when((a["at"] > 0) & (a["size"] + n + 1 <= most), a["size"] + n + 1).otherwise(n).alias("size"),
            (a["at"] + 1).alias("at"),
            F.when((a["at"] > 0) & (a["size"] + n + 1 <= most), a["starts"]).otherwise(F.array_append(a["starts"], a["at"])).alias("starts"),
        ),
        lambda a: a["starts"],
    )
    return F.transform(opened, lambda at, i: F.array_join(F.slice(held, at + 1, F.coalesce(F.get(opened, i + 1), F.size(held)) - at), " "))


def context_window(chunks_col, scores_col, k: int = 1) -> Column:
    """The best-scoring chunk with k chunks on either side."""
    at = F.array_position(col(scores_col), F.array_max(col(scores_col)))
    lo = F.greatest(F.lit(1), at - k).cast("int")
    return F.slice(col(chunks_col), lo, (at + k - lo + 1).cast("int"))


def keyword_hits(c, words: Sequence[str]) -> Column:
    """Distinct keywords that occur as substrings, whatever the case."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return sum((t.contains(w.lower()).cast("int") for w in words), F.lit(0))


def pattern_hits(c, patterns: Sequence[str]) -> Column:
    """Patterns that match anywhere."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return sum((t.rlike(f"(?U){p}").cast("int") for p in patterns), F.lit(0))


def stance(sentence, rhetorical: str, opponent: str, own: str) -> Column:
    """own overrides rhetorical and opponent; neutral otherwise."""
    s = F.lower(col(sentence))
    r = lambda p: s.rlike(f"(?U){p}")
    return F.when(r(own), "own").when(r(rhetorical), "rhetorical").when(r(opponent), "opponent").otherwise("neutral")


def argumentative_extract(c, rhetorical: str, opponent: str, own: str, most: int = 5000, least: int = 15) -> Column:
    """Own, then neutral, then opponent sentences, each counted with one blank, until one would overflow; the text's start if none is left."""
    clean = squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", " "))
    held = F.filter(sentences(clean), lambda s: F.length(s) > least)
    kind = lambda k: F.filter(held, lambda s: stance(s, rhetorical, opponent, own) == k)
    ordered = F.concat(kind("own"), kind("neutral"), kind("opponent"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(a, s):
        longer = F.when(a["text"] == "", s).otherwise(F.concat(a["text"], F.lit(" "), s))
        full = a["full"] | (F.length(longer) + 1 > most)
        return F.struct(F.when(full, a["text"]).otherwise(longer).alias("text"), full.alias("full"))

    out = F.aggregate(ordered, start, step, lambda a: a["text"])
    return F.when(out == "", F.substring(clean, 1, most)).otherwise(out)


def policy_sentences(c, drop: Sequence[str], keep: Sequence[str], modals: Sequence[str], least: int = 20) -> Column:
    """Sentences with a party's marker (part of the text) or a modal word between blanks, without a government marker (pattern), joined by blanks."""
    government = "(?U)" + "|".join(f"(?:{p})" for p in drop)

    def ok(s):
        t = F.trim(F.lower(s))
        wanted = reduce(or_, [*(t.contains(w) for w in keep), *(F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {w} ") for w in modals)], F.lit(False))
        return (F.length(t) >= least) & wanted & (~t.rlike(government) if drop else F.lit(True))

    return F.array_join(F.filter(sentences(c), ok), " ")


def lemma_hits(lemmas, words: Sequence[str]) -> Column:
    """Keywords that occur in the text of the lemmas, each counted once."""
    text = F.lower(F.array_join(col(lemmas), " "))
    return sum((F.coalesce(text.contains(w.lower()), F.lit(False)).cast("int") for w in dict.fromkeys(words) if w), F.lit(0))


def paragraphs(c) -> Column:
    """The non-blank paragraphs (parted by blank lines), or the non-blank lines where there is only one."""
    held = lambda pattern: F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda s: F.trim(s)), lambda s: s != "")
    parted = held(r"\n\s*\n")
    return F.when(F.size(parted) > 1, parted).otherwise(held(r"\n"))


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(False))


def _summed(parts: Sequence[tuple[Column, Mapping[str, float]]]) -> Column:
    names = list(dict.fromkeys(n for _, boosts in parts for n in boosts))
    totals = [sum((F.when(on, b[n]).otherwise(0.0) for on, b in parts if n in b), F.lit(0.0)) for n in names]
    return F.map_filter(F.create_map(*(x for n, t in zip(names, totals, strict=True) for x in (F.lit(n), t))), lambda _, v: v != 0)


def stance_boost(c, concepts: Mapping[str, tuple[Sequence[str], Sequence[str]]], one: Mapping[str, float], other: Mapping[str, float], lemmas=None) -> Column:
    """map category -> summed boosts: for each concept in the text (or in its lemmas, where given) whose words of only one side occur, that side's boosts."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    parts = []
    for concept, (a, b) in concepts.items():
        named = t.contains(concept) if lemmas is None else t.contains(concept) | F.coalesce(F.array_join(col(lemmas), " ").contains(concept), F.lit(False))
        x, y = _any(t, a), _any(t, b)
        parts += [(named & x & ~y, one), (named & y & ~x, other)]
    return _summed(parts)


def cooccurrence_boost(c, rules: Sequence[tuple[Sequence[Sequence[str]], Mapping[str, float]]]) -> Column:
    """map category -> summed boosts of the rules of which every word group has a word in the text."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return _summed([(reduce(and_, (_any(t, g) for g in groups)), boosts) for groups, boosts in rules])


def rhetoric_scores(c, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """map label -> share of all hits (3 decimals); none is 1 without hits."""
    hits = {k: keyword_hits(c, w) for k, w in lexicon.items()}
    total = sum(hits.values(), F.lit(0))
    pairs = [x for k, h in hits.items() for x in (F.lit(k), F.when(total > 0, F.round(h / total, 3)).otherwise(0.0))]
    return F.create_map(*pairs, F.lit("none"), F.when(total == 0, 1.0).otherwise(0.0))


def repair_json(c) -> Column:
    """Single quotes made double, commas before a closing bracket dropped."""
    return F.regexp_replace(F.translate(col(c), "'", '"'), r",\s*([}\]])", "$1")


def json_scores(c, keys: Sequence[str]) -> Column:
    """map key -> number from a model's answer that holds something like JSON.

    The object that names the first key, else the widest one that names the second, is repaired and
    parsed; a key may stand with blanks for underscores. What does not parse is read pair by pair.
    Null if nothing is found.
    """
    raw = col(c)
    narrow = F.regexp_extract(raw, rf'(?s)\{{[^{{}}]*"{keys[0]}"[^{{}}]*\}}', 0)
    wide = F.regexp_extract(raw, rf'(?s)\{{.*"{keys[min(1, len(keys) - 1)]}".*\}}', 0)
    text = repair_json(F.coalesce(F.nullif(narrow, F.lit("")), wide))
    obj = F.from_json(text, "map<string,string>")
    pair = lambda k: F.nullif(F.regexp_extract(text, rf'"{k}"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), F.lit(""))
    found = [F.when(obj.isNotNull(), F.coalesce(obj[k], obj[k.replace("_", " ")])).otherwise(pair(k)).try_cast("double") for k in keys]
    out = F.map_filter(F.create_map(*(x for k, v in zip(keys, found, strict=True) for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return F.when(F.size(out) > 0, out)


def margin_gate(similarities, expected: str, neighbours: Sequence[str], least: float = 0.05) -> Column:
    """The expected category's similarity exceeds each neighbour's by the margin; those not measured do not count."""
    s = col(similarities)
    return reduce(and_, (F.coalesce(s[expected] - s[n] >= least, F.lit(True)) for n in neighbours), F.lit(True))


def year_tokens(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int"))


def quality_gate(c, words: Sequence[str], patterns: Sequence[str], least: int) -> Column:
    return (keyword_hits(c, words) >= least) | (pattern_hits(c, patterns) >= 1)


def redact(c, rules: Mapping[str, str]) -> Column:
    out = col(c)
    for pattern, instead in rules.items():
        out = F.regexp_replace(out, pattern, instead)
    return out


def preview(c, n: int = 200) -> Column:
    return F.substring(col(c), 1, n)
