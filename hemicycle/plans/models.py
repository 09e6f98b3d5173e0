"""Queries for scorers, model signals, tests over links and profiles, and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.functions import text as T
from hemicycle.functions import vectors as V
from hemicycle.operators import scoring as M
from hemicycle.operators import stats as S
from hemicycle.plans.catalog import _GAPS, _MODAL, _PROBS, _SIGNED, _SIGNED_OUT, _YEARLY, _gaps, _modal, _probs, _query, _r, _t, _tested, _yearly

_WORDS = {"left": {"keywords": ["the", "und"], "regexes": ["[0-9]{4}"], "definition": "of the"}, "centre": {"keywords": ["que"], "regexes": ["ng "], "definition": "de la"}, "right": {"keywords": ["ion", "zz"], "regexes": []}}
_KW = """d AS (SELECT doc_id AS item_id, lower(text) AS t FROM documents), k AS (SELECT item_id, t, CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'und') AS INT) + CAST(regexp_matches(t, '[0-9]{4}') AS INT) AS a, CAST(contains(t, 'que') AS INT) + CAST(regexp_matches(t, 'ng ') AS INT) AS b, CAST(contains(t, 'ion') AS INT) + CAST(contains(t, 'zz') AS INT) AS c FROM d),
o AS (SELECT *, (CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'und') AS INT) + CAST(contains(t, 'of the') AS INT)) / 3 AS ea, (CAST(contains(t, 'que') AS INT) + CAST(contains(t, 'de la') AS INT)) / 2 AS eb, (CAST(contains(t, 'ion') AS INT) + CAST(contains(t, 'zz') AS INT)) / 2 AS ec FROM k),
n AS (SELECT *, CASE WHEN a + b + c > 0 THEN a + b + c ELSE 1 END AS ks, CASE WHEN ea + eb + ec > 0 THEN ea + eb + ec ELSE 1 END AS es FROM o)"""


def _scored(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return docs.withColumns({"kw": M.rule_vector("text", _WORDS, 1.0), "ov": M.overlap_vector("text", _WORDS)})


@_query(f"""WITH {_KW}, m AS (SELECT *, 0.7 * a / ks + 0.3 * ea / es AS wa, 0.7 * b / ks + 0.3 * eb / es AS wb, 0.7 * c / ks + 0.3 * ec / es AS wc FROM n), s AS (SELECT *, CASE WHEN wa + wb + wc > 0 THEN wa + wb + wc ELSE 1 END AS s FROM m),
p AS (SELECT *, ((item_id * 37) % 100) / 100.0 AS q FROM s), f AS (SELECT *, greatest(wa, wb, wc) / s < 0.15 AND q >= 0.5 AS sup FROM p)
SELECT item_id, category, CAST(raw AS DOUBLE) AS raw_score, round(weight, 6) AS weight FROM (SELECT item_id, 'left' AS category, a AS raw, CASE WHEN sup THEN 1 ELSE wa / s END AS weight FROM f UNION ALL SELECT item_id, 'centre', b, CASE WHEN sup THEN 0 ELSE wb / s END FROM f UNION ALL SELECT item_id, 'right', c, CASE WHEN sup THEN 0 ELSE wc / s END FROM f)""")
def motion_scores(spark, d):
    """Rules with an overlap matcher; a supervised model where they say little."""
    rows = _scored(spark, d).withColumn("sup", F.array(((F.col("item_id") * 37) % 100) / F.lit(100.0), F.lit(0.1), F.lit(0.2)))
    out = M.score_items(rows, _WORDS, {"keywords": "kw", "embedding": "ov"}, M.RULE_WEIGHTS, supervised="sup")
    return out.select("item_id", "category", "raw_score", _r("weight").alias("weight"))


@_query(f"""WITH {_KW}, z AS (SELECT *, ((item_id * 7) % 10) / 10.0 AS z1, ((item_id * 3) % 10) / 10.0 AS z2, ((item_id * 11) % 10) / 10.0 AS t1 FROM n), m AS (SELECT *, 0.7 * t1 + 0.3 * z1 / greatest(z1 + z2, 1e-300) AS wa, 0.7 * (1 - t1) + 0.3 * z2 / greatest(z1 + z2, 1e-300) AS wb, 0 AS wc FROM z),
s AS (SELECT *, wa / (wa + wb) AS x, wb / (wa + wb) AS y, CASE WHEN contains(t, 'tion') AND contains(t, 'sch') THEN 0.4 ELSE 0 END AS boost FROM m)
SELECT item_id, category, round(weight, 6) AS weight FROM (SELECT item_id, 'left' AS category, x / (1 + boost) AS weight FROM s UNION ALL SELECT item_id, 'centre', y / (1 + boost) FROM s UNION ALL SELECT item_id, 'right', boost / (1 + boost) FROM s)""")
def speech_scores(spark, d):
    """A model's and the zero-shot signal, then boosts by rhetoric."""
    tenth = lambda n: ((F.col("item_id") * n) % 10) / F.lit(10.0)
    rows = _scored(spark, d).withColumns({"zs": F.array(tenth(7), tenth(3), F.lit(0.0)), "bert": F.array(tenth(11), 1 - tenth(11), F.lit(0.0)), "boost": T.cooccurrence_boost("text", [([["tion"], ["sch"]], {"right": 0.4})])})
    out = M.score_items(rows, _WORDS, {"keywords": "kw", "zero_shot": "zs", "transformer": "bert"}, M.SPEECH_WEIGHTS, boosts="boost")
    return out.select("item_id", "category", _r("weight").alias("weight"))


@_query("""WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, ((conv_id * 7 + turn * 3) % 10) / 10.0 AS a, ((conv_id * 3 + turn) % 10) / 10.0 AS b FROM conversations), g AS (SELECT conv_id, avg(a) FILTER (n >= 100) AS la, avg(b) FILTER (n >= 100) AS lb, arg_min(a, turn) AS fa, arg_min(b, turn) AS fb FROM c GROUP BY conv_id)
SELECT conv_id, round(coalesce((la + lb) / 2, (fa + fb) / 2), 6) AS left_score, round(coalesce(lb, fb), 6) AS right_score, round(greatest(0, coalesce((la + lb) / 2, 0) - 0.5 * coalesce(lb, 0)), 6) AS left_net FROM g""")
def zero_shot_scores(spark, d):
    """Entailment per chunk (here a turn) and hypothesis, averaged by category, and net of criticism."""
    c = _t(spark, d, "conversations").withColumns({"a": ((F.col("conv_id") * 7 + F.col("turn") * 3) % 10) / F.lit(10.0), "b": ((F.col("conv_id") * 3 + F.col("turn")) % 10) / F.lit(10.0)})
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), F.array("a", "b", "b").alias("v"), F.array("b").alias("against")))).alias("x"))
    rows = rows.select("conv_id", F.col("x.text").alias("chunks"), F.col("x.v").alias("v"), F.col("x.against").alias("against"))
    both = rows.withColumns({"plain": M.zero_shot("chunks", "v", ["left", "left", "right"], ["left", "right"]), "net": M.zero_shot("chunks", "v", ["left", "left", "right"], ["left", "right"], "against", ["left"])})
    at = lambda c, i: _r(F.get(c, F.lit(i)))
    return both.select("conv_id", at("plain", 0).alias("left_score"), at("plain", 1).alias("right_score"), at("net", 0).alias("left_net"))


@_query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), f AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT token, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT doc_id, token, round(tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)), 9) AS score FROM f JOIN n USING (token)) SELECT doc_id, CAST(k AS INTEGER) AS rank, token, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) AS k FROM s) WHERE k <= 5""")
def explain_documents(spark, d):
    """The five words that tell most of each document."""
    rows = _t(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return M.explain_tfidf(rows, "doc_id", "tokens", 5).withColumn("score", _r("score"))


@_query(f"""WITH {_PROBS} SELECT round(avg(CAST(CAST(p1 > 0.5 AS INT) = t AS INT)), 6) AS accuracy, round((count(*) FILTER (t = 1 AND p1 > 0.5) / count(*) FILTER (t = 1) + count(*) FILTER (t = 0 AND p1 <= 0.5) / count(*) FILTER (t = 0)) / 2, 6) AS balanced_accuracy,
  round((2.0 * count(*) FILTER (t = 1 AND p1 > 0.5) / (count(*) FILTER (t = 1) + count(*) FILTER (p1 > 0.5)) + 2.0 * count(*) FILTER (t = 0 AND p1 <= 0.5) / (count(*) FILTER (t = 0) + count(*) FILTER (p1 <= 0.5))) / 2, 6) AS macro_f1 FROM p""")
def summary_metrics(spark, d):
    out = S.summary_metrics(S.class_metrics(_probs(spark, d).withColumn("predicted", V.argmax("p")), "t", "predicted"))
    return out.select(*(_r(c).alias(c) for c in out.columns))


@_query("""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 6) AS class_weight, n FROM n""")
def class_weights(spark, d):
    return M.balanced(_t(spark, d, "labels"), "quality").groupBy("quality").agg(_r(F.avg("class_weight")).alias("class_weight"), F.count("*").alias("n"))


def _three(rows: str, keys: str) -> str:
    """The three comparisons of rows(keys, said, moved, voted): g names the group and the comparison, d is the difference (null for a missing side)."""
    one = lambda name, other: f"SELECT concat_ws('|', {keys}, '{name}') AS g, said - {other} AS d FROM {rows}"
    return f"{one('speech_vs_motion', 'moved')} UNION ALL {one('speech_vs_vote', 'voted')} UNION ALL {one('speech_vs_combined', '(moved + voted) / 2')}"


@_query(f"""WITH l AS (SELECT n_name AS party, 'c' || (c_custkey // 200) AS category, c_custkey AS item_id, c_acctbal + c_custkey / 1e6 AS said, c_custkey * 3.7 + 0.001 AS moved FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> 'NATION_3'),
b AS (SELECT n_name AS party, c_custkey % 97 AS vote_id, arg_max(['Ja', 'nej', 'avstår'][c_custkey % 3 + 1], c_custkey) AS vote FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
f AS (SELECT l.*, CASE lower(vote) WHEN 'ja' THEN 1.0 WHEN 'nej' THEN 0.0 END AS voted FROM l LEFT JOIN b ON b.party = l.party AND b.vote_id = l.item_id % 97 AND l.item_id % 5 <> 0), x AS ({_three('f', 'party, category')}),
k AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM x WHERE d IS NOT NULL AND d <> 0), w AS (SELECT g, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM k GROUP BY g), n AS (SELECT g, count(d) AS n FROM x GROUP BY g)
SELECT split_part(g, '|', 1) AS party, split_part(g, '|', 2) AS category, split_part(g, '|', 3) AS comparison, CASE WHEN n > 0 THEN 'wilcoxon' END AS test, n, CAST(w AS DOUBLE) AS stat, round(abs(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) / sqrt(n), 6) AS effect FROM n LEFT JOIN w USING (g)""")
def linked_tests(spark, d):
    """Tests by party and category (some eight customers each) of what was said with what was moved and voted."""
    rows = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.col("c_custkey")
    links = rows.select(F.col("n_name").alias("party"), F.concat(F.lit("c"), F.floor(key / 200)).alias("category"), key.alias("item_id"), (F.col("c_acctbal") + key / 1e6).alias("said"), (key * 3.7 + 0.001).alias("moved"))
    first = rows.where("c_custkey % 5 <> 0").select(key.alias("item_id"), (key % 97).cast("string").alias("first_vote_id"))
    votes = rows.select((key % 97).cast("string").alias("vote_id"), F.col("n_name").alias("party"), F.element_at(F.array(F.lit("Ja"), F.lit("nej"), F.lit("avstår")), (key % 3 + 1).cast("int")).alias("vote"), key.alias("order"))
    out = S.linked_tests(links, first, votes, "order", ("NATION_3",))
    return out.select("party", "category", "comparison", "test", "n", "stat", _r("effect").alias("effect"))


@_query(f"""WITH {_MODAL}, y AS (SELECT s.actor AS party, s.category, s.proportion AS said, m.proportion AS moved, v.proportion AS voted FROM prof s JOIN prof m ON m.actor = s.actor AND m.category = s.category AND m.modality = 'motion' JOIN prof v ON v.actor = s.actor AND v.category = s.category AND v.modality = 'vote' WHERE s.modality = 'speech'),
pairs AS ({_three('y', 'category')}), {_SIGNED}
SELECT 'ALL_PARTIES' AS party, split_part(g, '|', 1) AS category, split_part(g, '|', 2) AS comparison, {_SIGNED_OUT} FROM w""")
def profile_tests(spark, d):
    """Tests by category across actors of what was said with what was moved and voted."""
    return _tested(S.profile_tests(_modal(spark, d).withColumnRenamed("actor", "party")), "party", "category", "comparison")


_WEIGHTED = " + ".join(f"CAST(u >= {edge!r} AS INT)" for edge in S._POISSON)


@_query(f"""WITH {_YEARLY}, d AS (SELECT actor, said, did, draw, CAST(CAST(('0x' || substr(md5('42|' || draw || '|' || year), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM y, range(1, 101) t(draw)), w AS (SELECT *, {_WEIGHTED} AS w FROM d),
s AS (SELECT actor, draw, CAST(sum(w) AS DOUBLE) AS n, sum(w * said) AS x, sum(w * did) AS y, sum(w * said * said) AS xx, sum(w * did * did) AS yy, sum(w * said * did) AS xy FROM w GROUP BY ALL), r AS (SELECT actor, CASE WHEN n * xx - x * x > 1e-12 AND n * yy - y * y > 1e-12 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS r FROM s),
e AS (SELECT actor, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r GROUP BY actor)
SELECT actor, round(corr(said, did), 5) AS pearson, round(any_value(low), 5) AS low, round(any_value(high), 5) AS high FROM y JOIN e USING (actor) GROUP BY actor""")
def correlation_interval(spark, d):
    out = S.correlation_interval(_yearly(spark, d), ["actor"], "said", "did", "year", 100)
    return out.select("actor", _r("pearson", 5).alias("pearson"), _r("low", 5).alias("low"), _r("high", 5).alias("high"))


@_query(f"""WITH {_YEARLY}, r AS (SELECT *, rank() OVER (PARTITION BY actor ORDER BY said) + (count(*) OVER (PARTITION BY actor, said) - 1) / 2.0 AS a, rank() OVER (PARTITION BY actor ORDER BY did) + (count(*) OVER (PARTITION BY actor, did) - 1) / 2.0 AS b, rank() OVER (PARTITION BY actor ORDER BY year DESC) AS c FROM y), p AS (SELECT actor, 1 AS sign, round(corr(a, b), 6) AS rho FROM r GROUP BY actor UNION ALL SELECT actor, -1, round(corr(a, c), 6) FROM r GROUP BY actor)
SELECT actor, sign, rho AS spearman FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY abs(rho) DESC, sign DESC) AS n FROM p) WHERE n = 1""")
def scale_orientation(spark, d):
    """Of a rising and a falling scale, the one that goes best with what was said."""
    y = _yearly(spark, d).withColumn("down", -F.col("year"))
    one = lambda b, sign: S.correlation(y, ["actor"], "said", b).select("actor", F.lit(sign).alias("sign"), _r("spearman").alias("spearman"))
    return S.orientation(one("did", 1).unionByName(one("down", -1)), "actor", "sign")


_SETTINGS = ((0.5, 0.5, 0.2, 0.05, 1.0), (0.3, 0.8, 0.0, 0.1, 2.0), (1.2, 0.4, 0.3, 0.0, 0.05))


@_query(f"""WITH {_GAPS}, w AS (SELECT actor, max(js_distance) FILTER (comparison = 'speech_vs_motion') AS sm, max(js_distance) FILTER (comparison = 'speech_vs_vote') AS sv, max(js_distance) FILTER (comparison = 'motion_vs_vote') AS mv FROM gaps GROUP BY actor),
p(setting, motion, vote, fill, missing, power) AS (VALUES (0, 0.5, 0.5, 0.2, 0.05, 1.0), (1, 0.3, 0.8, 0.0, 0.1, 2.0), (2, 1.0, 0.4, 0.3, 0.0, 0.1)), c AS (SELECT setting, actor, s.name, (1 - (motion * sm + (1 - motion) * sv)) * (vote * coalesce(CASE WHEN s.name = 'fair' THEN 1 - sm END, fill) + (1 - vote) * (1 - sm) / (1 - sm + mv)) * pow(1 - CASE WHEN s.name = 'fair' THEN missing ELSE sv END, power) AS score
  FROM w, p, (VALUES ('fair'), ('all')) s(name)), r AS (SELECT setting, actor, max(score) - min(score) AS range FROM c GROUP BY ALL), b AS (SELECT setting, stddev_pop(score) AS sd FROM c WHERE name = 'fair' GROUP BY setting)
SELECT CAST(setting AS INTEGER) AS setting, round(max(range) + 0.5 * avg(range) + 0.5 * greatest(0, 0.05 - any_value(sd)), 6) AS fitness FROM r JOIN b USING (setting) GROUP BY setting""")
def scenario_spread(spark, d):
    """How far the actors' uphold scores move between two scenarios, at three settings."""
    wide = _gaps(spark, d).groupBy("actor").pivot("comparison", ["speech_vs_motion", "speech_vs_vote", "motion_vs_vote"]).agg(F.max("js_distance")).collect()  # a row per actor, a fixed few
    base = [{"party": r["actor"], "sm": r["speech_vs_motion"], "sv": r["speech_vs_vote"], "voted": 1 - r["speech_vs_motion"], "not_voted": r["motion_vs_vote"]} for r in wide]
    both = {"fair": [r | {"alignment": 1 - r["sm"], "contradiction": None} for r in base], "all": [r | {"alignment": None, "contradiction": r["sv"]} for r in base]}
    return spark.createDataFrame([(i, S.scenario_spread(both, x)) for i, x in enumerate(_SETTINGS)], "setting int, fitness double").select("setting", _r("fitness").alias("fitness"))
