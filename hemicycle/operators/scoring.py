"""Rule scoring of text onto an axis, with pluggable model signals.

A definition is {category: {"keywords": [...], "regexes": [...]}}. Rules are expressions; model
signals are columns of ARRAY<DOUBLE> that adapters add beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions.text import keyword_hits, lemma_hits, pattern_hits, sentences
from hemicycle.functions.vectors import proportions

#: Our own small lexicon, for tests and examples.
LEXICON = {
    "left": {"keywords": ["public ownership", "redistribution", "solidarity"], "regexes": [r"\bnationali[sz]e"]},
    "centre": {"keywords": ["compromise", "reform", "balance"], "regexes": [r"\bmiddle ground\b"]},
    "right": {"keywords": ["tax cuts", "private enterprise", "free market"], "regexes": [r"\bderegulat"]},
}


def rule_vector(text: str, definitions: Mapping[str, Mapping[str, Sequence[str]]], regex_weight: float = 1.5) -> Column:
    """Distinct keyword hits plus weighted pattern hits per category, in the definitions' order."""
    return F.array(*((keyword_hits(text, d.get("keywords", ())) + regex_weight * pattern_hits(text, d.get("regexes", ()))).cast("double") for d in definitions.values()))


def combine(signals: Mapping[str, tuple[str, float]]) -> Column:
    """Weighted mean of the signals present, each first made a distribution; weights of absent ones are shared out."""
    parts = [F.struct(F.col(c).isNotNull().alias("on"), F.lit(w).alias("w"), proportions(c).alias("p")) for c, w in signals.values()]
    held = F.filter(F.array(*parts), lambda x: x["on"])
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["w"])
    zero = F.transform(F.get(held, F.lit(0))["p"], lambda _: F.lit(0.0))
    summed = F.aggregate(held, zero, lambda a, x: F.zip_with(a, x["p"], lambda s, p: s + p * x["w"]))
    return F.transform(summed, lambda x: F.try_divide(x, total))


def classify(items: DataFrame, text: str, definitions: Mapping[str, Mapping[str, Sequence[str]]] = LEXICON, version: str = "rules-1", extra: Mapping[str, tuple[str, float]] | None = None, rule_weight: float = 1.0) -> DataFrame:
    """One row per item and category: raw_score and weight, which sum to 1 (uniform without any hit)."""
    names = F.array(*map(F.lit, definitions))
    scored = items.withColumn("__raw", rule_vector(text, definitions))
    signals = {"rules": ("__raw", rule_weight)} | dict(extra or {})
    scored = scored.withColumn("__w", combine(signals))
    rows = scored.select("item_id", F.explode(F.arrays_zip(names.alias("category"), F.col("__raw").alias("raw_score"), F.col("__w").alias("weight"))).alias("x"))
    return rows.select("item_id", "x.*", F.lit(version).alias("version"))


# The weights of the signals by kind of text.
RULE_WEIGHTS = {"keywords": 0.70, "embedding": 0.30}
MOTION_WEIGHTS = {"keywords": 0.20, "embedding": 0.40, "zero_shot": 0.40}
SPEECH_WEIGHTS = {"transformer": 0.70, "zero_shot": 0.30}
JUDGED_SPEECH_WEIGHTS = {"judge": 0.60, "transformer": 0.25, "zero_shot": 0.15}
#: Signals that are made to sum to 1 before they are weighed; models' probabilities count as they are.
NORMALISED = ("keywords", "embedding", "zero_shot")


def share_of(v: str | Column) -> Column:
    """A vector over its sum; as it is where the sum is not positive."""
    v = F.col(v) if isinstance(v, str) else v
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v)


def overlap_vector(text: str, definitions: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """Per category the share of its keywords and of its definition that occur in the text: what a matcher without a model gives."""
    parts = {name: [*d.get("keywords", ()), *([d["definition"]] if d.get("definition") else [])] for name, d in definitions.items()}
    return F.array(*((keyword_hits(text, [w for w in ws if w]) / max(1, len(ws))).cast("double") for ws in parts.values()))


def lemma_vector(text: str, lemmas: str, definitions: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """Per category the keywords in the text of the lemmas, plus the patterns that match the text."""
    return F.array(*((lemma_hits(lemmas, d.get("keywords", ())) + pattern_hits(text, d.get("regexes", ()))).cast("double") for d in definitions.values()))


def _times(w: float) -> Callable[[Column], Column]:
    return lambda x: x * w


def mixed_weights(signals: Mapping[str, str], weights: Mapping[str, float], n: int) -> Column:
    """Weighted sum of the signals (arrays of n, an absent or null one counts 0), made to sum to 1 where it is positive."""
    zero = F.array_repeat(F.lit(0.0), n)
    out = zero
    for name, w in weights.items():
        if name in signals and w:
            v = F.coalesce(F.col(signals[name]), zero)
            out = F.zip_with(out, F.transform(share_of(v) if name in NORMALISED else v, _times(w)), lambda a, x: a + x)
    return share_of(out)


def adjusted(v: Column, categories: Sequence[str], boosts: str) -> Column:
    """A vector with the positive boosts of a map added, and made to sum to 1 again where there are any."""
    names = F.array(*map(F.lit, categories))
    add = F.transform(names, lambda k: F.greatest(F.lit(0.0), F.coalesce(F.element_at(boosts, k), F.lit(0.0))))
    return F.when(F.exists(add, lambda x: x > 0), share_of(F.zip_with(v, add, lambda a, x: a + x))).otherwise(v)


def with_supervised(v: Column, probs: str, trigger: float = 0.15, least: float = 0.5) -> Column:
    """A supervised model's classes of at least `least` in place of a vector that nowhere reaches the trigger."""
    chosen = F.transform(F.col(probs), lambda p: F.when(p >= least, p).otherwise(0.0))
    use = (F.array_max(v) < trigger) & F.coalesce(F.array_max(chosen) > 0, F.lit(False))
    return F.when(use, share_of(chosen)).otherwise(v)


def with_judge(v: Column, categories: Sequence[str], verdict: str, threshold: float = 0.30) -> Column:
    """The judge's category alone in place of a vector that nowhere reaches the threshold."""
    only = F.transform(F.array(*map(F.lit, categories)), lambda k: (k == F.col(verdict)).cast("double"))
    return F.when((F.array_max(v) < threshold) & F.col(verdict).isin(*categories), only).otherwise(v)


def score_items(items: DataFrame, definitions: Mapping[str, Mapping[str, Sequence[str]]], signals: Mapping[str, str], weights: Mapping[str, float], raw: str = "keywords", boosts: str | None = None, supervised: str | None = None, verdict: str | None = None, version: str = "1") -> DataFrame:
    """item_id, category, raw_score, weight and version, a row per item and category.

    signals: name -> column of ARRAY<DOUBLE> in the definitions' order. raw names the signal given as raw_score. Then, where
    given: boosts by rhetoric, a supervised model for weak results, and a judge's verdict for weak results.
    """
    names = list(definitions)
    v = mixed_weights(signals, weights, len(names))
    held = items.withColumn("__w", v)
    if boosts:
        held = held.withColumn("__w", adjusted(F.col("__w"), names, boosts))
    if supervised:
        held = held.withColumn("__w", with_supervised(F.col("__w"), supervised))
    if verdict:
        held = held.withColumn("__w", with_judge(F.col("__w"), names, verdict))
    raw_column = F.coalesce(F.col(signals[raw]), F.array_repeat(F.lit(0.0), len(names))) if raw in signals else F.array_repeat(F.lit(0.0), len(names))
    cells = F.arrays_zip(F.array(*map(F.lit, names)).alias("category"), raw_column.alias("raw_score"), F.col("__w").alias("weight"))
    return held.select("item_id", F.explode(cells).alias("x")).select("item_id", "x.*", F.lit(version).alias("version"))


def zero_shot(chunks: str, entailment: str, hypotheses: Sequence[str], categories: Sequence[str], against: str | None = None, against_hypotheses: Sequence[str] = (), critique: float = 0.5, least: int = 100) -> Column:
    """Per category the mean entailment over a text's chunks and the category's hypotheses.

    entailment and against: a vector per chunk over the hypotheses, whose categories are given. Chunks under `least`
    characters are left out, but the first stays if no other does. With `against` (speeches) the score is
    max(0, mean advocacy - critique * mean criticism), and no short chunk stays.
    """
    sizes = F.transform(F.col(chunks), lambda c: F.length(c))
    long_enough = lambda v: F.filter(F.transform(F.col(v), lambda x, i: F.struct(F.get(sizes, i).alias("n"), x.alias("v"))), lambda s: s["n"] >= least)

    def mean(v: str, of: Sequence[str], name: str, first: bool) -> Column:
        places = F.array(*(F.lit(i) for i, h in enumerate(of) if h == name)) if name in of else F.array().cast("array<int>")
        kept = F.transform(long_enough(v), lambda s: s["v"])
        if first:
            kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.col(v), 1, 1))
        values = F.flatten(F.transform(kept, lambda x: F.transform(places, lambda i: F.get(x, i))))
        return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)), F.lit(0.0))

    if against is None:
        return F.array(*(mean(entailment, hypotheses, c, True) for c in categories))
    return F.array(*(F.greatest(F.lit(0.0), mean(entailment, hypotheses, c, False) - critique * mean(against, against_hypotheses, c, False)) for c in categories))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with `class_weight`, n / (classes * rows of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    whole = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    share = n.crossJoin(F.broadcast(whole)).select(F.col(label).alias("__l"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("class_weight"))  # one row
    return rows.join(share, rows[label].eqNullSafe(F.col("__l"))).drop("__l")


def meta_learner(features: str, label: str, iterations: int = 50):
    """A class-balanced multinomial model over a vector column (rows of balanced()), as an untrained pyspark.ml Pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep")
    return Pipeline(stages=[index, LogisticRegression(featuresCol=features, labelCol="label_index", weightCol="class_weight", maxIter=iterations)])


def explain_tfidf(rows: DataFrame, key: str, tokens: str, k: int = 10) -> DataFrame:
    """key, rank, token, score: the k tokens with the highest tf * ln((1 + n) / (1 + df)) of each row, the smallest token on ties."""
    tf = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    scored = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.ln((1 + F.col("n")) / (1 + F.col("df"))), 9))  # one row
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "token"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select(key, "rank", "token", "score")


#: Model adapters by name: a function that loads a model, which then turns a Series of texts into a list of vectors.
ADAPTERS: dict[str, Callable[[], Callable[[pd.Series], list]]] = {}


def register_adapter(name: str, load: Callable[[], Callable[[pd.Series], list]]) -> None:
    """Make a model known by a name; a name is given once."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is there already")
    ADAPTERS[name] = load


def adapter_column(rows: DataFrame, text: str, name: str, adapter: str) -> DataFrame:
    """model_column() with a registered model."""
    if adapter not in ADAPTERS:
        raise KeyError(f"no adapter {adapter}; known: {', '.join(sorted(ADAPTERS)) or 'none'}")
    return model_column(rows, text, name, ADAPTERS[adapter])


def model_column(rows: DataFrame, text: str, name: str, load: Callable[[], Callable[[pd.Series], list]]) -> DataFrame:
    """Adds ARRAY<DOUBLE> `name` from a model that each worker loads once and feeds in batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(model(s.fillna("")), index=s.index)

    return rows.withColumn(name, run(text))


#: Feature makers by name: a function of the rows' text column that gives a map of numbers.
FEATURES: dict[str, Callable[[str], Column]] = {
    "length": lambda text: F.create_map(F.lit("chars"), F.length(F.coalesce(text, F.lit(""))).cast("double")),
    "sentences": lambda text: F.create_map(F.lit("sentences"), F.size(sentences(text)).cast("double")),
}


def register_feature(name: str, make: Callable[[str], Column]) -> None:
    """Make a feature known by a name; a name is given once."""
    if name in FEATURES:
        raise ValueError(f"feature {name} is there already")
    FEATURES[name] = make


def with_features(rows: DataFrame, text: str, names: Sequence[str], column: str = "features") -> DataFrame:
    """rows with one map of the named features, added up by key."""
    held = rows.withColumns({f"__f_{n}": FEATURES[n](text) for n in names})
    return held.withColumn(column, merge_features([f"__f_{n}" for n in names])).drop(*(f"__f_{n}" for n in names))


def merge_features(maps: Sequence[str]) -> Column:
    """Feature maps added up by key."""
    pairs = F.flatten(F.array(*(F.map_entries(m) for m in maps)))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["key"] == k), F.lit(0.0), lambda a, p: a + p["value"])
    return F.map_from_arrays(keys, F.transform(keys, total))


def text_classifier(label: str = "label", text_tokens: str = "tokens", features: int = 1 << 14):
    """TF-IDF over 1- and 2-grams with one-versus-rest logistic regression, as an untrained pyspark.ml Pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import IDF, HashingTF, NGram, StringIndexer, VectorAssembler

    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep"), NGram(n=2, inputCol=text_tokens, outputCol="pairs"), HashingTF(numFeatures=features, inputCol=text_tokens, outputCol="tf1"), HashingTF(numFeatures=features, inputCol="pairs", outputCol="tf2"), VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"), IDF(inputCol="tf", outputCol="features"), OneVsRest(classifier=LogisticRegression(maxIter=20), labelCol="label_index")])


def topic_model(k: int = 10, features: int = 1 << 12):
    """LDA topics over tokens, as an untrained pyspark.ml Pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    return Pipeline(stages=[CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=features), LDA(k=k, maxIter=10)])
