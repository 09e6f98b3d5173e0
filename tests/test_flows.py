"""Linking, ranking, resampling and tests against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.operators import flows as W
from hemicycle.operators import linkage as L
from hemicycle.operators import rows as R
from hemicycle.operators import stats as S

DAY = dt.datetime(2020, 1, 1)


def test_unclassified_statements_stay(spark):
    meta = spark.createDataFrame([("s1", "M"), ("s2", "S"), ("s3", None)], "speech_id string, party string")
    top = spark.createDataFrame([("s1", "right", 0.9), ("s2", "left", float("nan"))], "speech_id string, category string, weight double")
    got = {r.speech_id: (r.category, r.weight) for r in W.with_unclassified(meta, top).collect()}
    assert got == {"s1": ("right", 0.9), "s2": ("left", 0.0), "s3": ("", 0.0)}


def test_graph_motion_channel_prefers_the_signatory(spark):
    items = spark.createDataFrame([("a", "M", "right", 0.9, DAY, False), ("b", "M", "right", 0.2, DAY, False)], "item_id string, party string, category string, weight double, date timestamp, has_vote boolean")
    signed = spark.createDataFrame([("b", "p1"), ("a", "p2")], "item_id string, signatory string")
    rows = spark.createDataFrame([("s1", "M", "right", DAY, "p1"), ("s2", "M", "right", DAY, ""), ("s3", "x", "", None, None)], "speech_id string, party string, category string, date timestamp, signatory string")
    got = {r.speech_id: r for r in W.graph_links(rows, items, signed).collect()}
    assert (got["s1"].motion_candidate, got["s1"].link_source, got["s1"].vote_candidate) == ("b", "graph_direct_signatory_motion", None)
    assert got["s1"].motion_score == pytest.approx(0.4 + 0.25 + 0.2 + 0.1 + 0.05 * 0.45)
    assert (got["s2"].target_id, got["s2"].link_source) == ("a", "fallback:party_category")
    assert (got["s3"].target_id, got["s3"].link_source, got["s3"].days_diff) == ("a", "fallback:any", None)
    voted = items.withColumn("has_vote", F.lit(True))  # no item without a vote: the motion channel holds all
    assert {r.motion_candidate for r in W.graph_links(rows.where("speech_id = 's1'"), voted, signed).collect()} == {"b"}
    old = spark.createDataFrame([("s1", "a", "dok_id"), ("s2", "gone", None)], "speech_id string, target_id string, link_source string")
    kept = {r.speech_id: (r.target_id, r.link_source) for r in W.graph_links(rows, items, signed, old).collect()}
    assert kept["s1"] == ("a", "existing:dok_id") and kept["s2"] == ("a", "fallback_after_stale_existing:party_category")


def test_cascade_can_stop_after_references(spark):
    items = spark.createDataFrame([("H10", "M", "right", DAY, 1.0), ("H20", "S", "left", DAY, 1.0)], "item_id string, party string, category string, date timestamp, weight double")
    rows = spark.createDataFrame([(1, "S", ["left"], DAY, None, "h10", "h20 too"), (2, "S", ["left", "x"], DAY, None, None, None), (3, "zz", [], None, None, None, None)], "speech_id long, party string, categories array<string>, date timestamp, rel_doc_id string, doc_id string, text string")
    got = {r.speech_id: (r.item_id, r.link_source) for r in W.link_statements(rows, items).collect()}
    assert got == {1: ("H20", "text"), 2: ("H20", "nearest")}  # the own party's item counts before the first one named
    assert [r.speech_id for r in W.link_statements(rows, items, only_ids=True).collect()] == [1]


@pytest.mark.parametrize("window", [0, 3, 90])
def test_nearest_in_time_by_brute_force(spark, window):
    rng = random.Random(window)
    at = lambda: DAY + dt.timedelta(seconds=rng.choice([0, rng.randint(0, 86400 * 400), 86400 * rng.randint(0, 400)]), microseconds=rng.choice([0, 0, rng.randint(0, 999999)]))
    left = [(i, rng.choice("ab"), at()) for i in range(150)] + [(900, "a", None), (901, None, DAY)]
    right = [(rng.randint(0, 400), rng.choice("ab"), at()) for _ in range(200)] + [(1, None, DAY), (2, "a", None)]
    want, width = {}, dt.timedelta(days=window)
    for k, p, t in left:
        met = [(abs(t - u) // dt.timedelta(days=1), i) for i, q, u in right if p and p == q and t and u and abs(t - u) <= width]
        if met:
            want[k] = min(met)
    a, b = spark.createDataFrame(left, "k int, party string, at timestamp"), spark.createDataFrame(right, "item int, party string, on timestamp")
    got = L.nearest_in_time(a, b, ["party"], "k", "at", "item", "on", window).collect()
    assert {r.k: (r.days_diff, r.item) for r in got} == want and len(got) == len(want)


def test_token_overlap_by_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    left = [(i, rng.choice("ab"), rng.choices(words, k=rng.randint(0, 25))) for i in range(60)] + [(99, "a", None)]
    right = [(i, rng.choice("ab"), rng.choices(words, k=rng.randint(0, 8))) for i in range(60)]
    a, b = (spark.createDataFrame(x, "id int, p string, t array<string>") for x in (left, right))
    got = {r.k: (round(r.similarity, 9), r.i) for r in L.token_overlap(a.withColumnsRenamed({"id": "k"}), b.withColumnsRenamed({"id": "i"}), "k", "i", "t", "t", 0.6, ["p"]).collect()}
    want = {}
    for k, p, t in left:
        met = [(-len(set(t or []) & set(u)) / len(set(u)), i) for i, q, u in right if p == q and u and len(set(t or []) & set(u)) / len(set(u)) >= 0.6]
        if met:
            want[k] = (round(-min(met)[0], 9), min(met)[1])
    assert got == want


def test_semantic_best_in_packs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(70, 0, None), (71, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    got = L.semantic_best(df.withColumnRenamed("id", "k"), df.withColumnRenamed("id", "item"), ["label"], "k", "item", "v", "v", 0.2, 3, pack=7).collect()
    want = []
    for k, a, v in rows:
        met = []
        for i, b, u in rows:
            if a == b and i != k and v and u and any(v) and any(u):
                s = round(float(np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u)), 9)
                met += [(-s, i)] if s >= 0.2 else []
        want += [(k, i, n) for n, (_, i) in enumerate(sorted(met)[:3], 1)]
    assert sorted((r.k, r.item, r["rank"]) for r in got) == sorted(want)


def test_global_rank_in_buckets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {r.k: r["rank"] for r in R.global_rank(df, [F.col("v").isNull(), -F.col("v")], "k", bucket_rows=40).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}
    p = [(i, rng.random() ** 3) for i in range(300)]
    whole, cut = (S.benjamini_hochberg(spark.createDataFrame(p, "k int, p double"), "p", "k", legacy, n) for legacy, n in ((False, 10**6), (False, 20)))
    assert sorted((r.k, round(r.adjusted, 12)) for r in whole.collect()) == sorted((r.k, round(r.adjusted, 12)) for r in cut.collect())


def test_grid_agrees_with_rebalance(spark):
    rows = [(f"i{i}", "vote" if i < 10 else "motion", "a", "" if i == 9 else f"m{i}", "existing:x" if i < 6 else "fallback:any", float(i), None if i == 8 else 0.5, "S") for i in range(12)]
    df = spark.createDataFrame(rows, "item_id string, action_type string, action_id string, motion_candidate string, link_source string, score double, margin double, party string")
    for share, margin in itertools.product((0.2, 0.4, 0.9), (-1.0, 0.0)):
        flips = L.rebalance(df, share, margin).where("rebalanced").count()
        assert [r.flips for r in S.rebalance_grid(df, [share], [margin], 9.45).collect()] == [flips]
        assert [r.flips for r in S.fairness_grid(df, [share], [margin], 9.45).collect()] == [flips]


def test_bootstrap_rows_draw_apart_and_nulls_do_not_count(spark):
    rows = [(i, "a", 1.0 if i < 200 else 3.0) for i in range(400)] + [(1000 + i, "b", 10.0 if i % 2 else None) for i in range(100)] + [(2000 + i, "b", float("nan")) for i in range(9)]
    out = {r.g: r for r in S.bootstrap_means(spark.createDataFrame(rows, "id int, g string, v double"), "g", ["v"], 300, row_id="id").collect()}
    assert 1.8 < out["a"].v_low < 2.0 < out["a"].v_high < 2.2 and out["a"].v_mean == 2.0
    assert (out["b"].v_mean, out["b"].v_low, out["b"].v_high) == (10.0, 10.0, 10.0)


def test_sign_flips(spark):
    x = [0.3, -0.1, 0.5, 0.2, 0.4]
    rng = np.random.default_rng(0)
    rows = [(i, "exact", v) for i, v in enumerate(x)] + [(9, "exact", float("nan")), (10, "exact", None), (11, "exact", float("inf"))]
    rows += [(100 + i, "far", float(v)) for i, v in enumerate(rng.normal(1, 0.3, 40))] + [(200 + i, "near", (-1.0) ** i) for i in range(40)]
    got = {r.g: (r.n, r.p) for r in S.sign_flip_tests(spark.createDataFrame(rows, "id int, g string, x double"), ["g"], "x", "id", rounds=400).collect()}
    means = [abs(sum(s * v for s, v in zip(signs, x, strict=True))) for signs in itertools.product((1, -1), repeat=5)]
    assert got["exact"] == (5, sum(m >= abs(sum(x)) - 1e-12 for m in means) / 32)
    assert got["far"] == (40, 1 / 401) and got["near"] == (40, 1.0)


def test_paired_test_rules():
    rng = np.random.default_rng(5)
    normal, skewed = rng.normal(0.5, 1, 60), rng.exponential(1, 60)
    assert S.shapiro_p(np.array([S.NormalDist().inv_cdf((i - 0.375) / 60.25) for i in range(1, 61)])) > 0.9
    assert S.shapiro_p(skewed) < 0.01 < 0.05 < S.shapiro_p(normal) and math.isnan(S.shapiro_p(normal[:5]))
    t = S.paired_test(normal, np.zeros(60))
    assert t["test"] == "paired_t" and t["low"] < normal.mean() < t["high"] and t["effect"] == pytest.approx(normal.mean() / normal.std(ddof=1))
    assert t["high"] - t["low"] == pytest.approx(2 * 2.000995 * normal.std(ddof=1) / math.sqrt(60), rel=1e-4)
    assert S.paired_test(skewed, np.zeros(60))["test"] == "wilcoxon"
    w = S.paired_test(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 0, 0, 0, 0]))
    assert (w["test"], w["stat"], w["p"]) == ("wilcoxon", 0.0, 0.0625) and w["effect"] == pytest.approx(7.5 / math.sqrt(13.75) / math.sqrt(5))
    assert S.paired_test(np.ones(4), np.ones(4)) | {"low": 0, "high": 0} == {"test": "paired_t_fallback", "n": 4, "stat": None, "p": None, "effect": 0.0, "low": 0, "high": 0}
    assert S.paired_test(np.array([np.nan]), np.array([1.0]))["test"] is None


def test_searches_and_calibration(spark):
    grid = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    best, top = S.random_search(lambda x: -abs(x["a"] - 2) - x["b"], grid, 60)
    assert best == {"a": 2, "b": 0.1} and top == -0.1
    assert S.random_search(lambda x: 0, grid, 5) == S.random_search(lambda x: 0, grid, 5)
    party = {"party": "S", "sm": 0.2, "sv": 0.4, "voted": 0.6, "not_voted": 0.2, "contradiction": 0.1, "alignment": None}
    same = {"fair": [party], "all": [party]}
    assert S.scenario_spread(same, (0.5, 0.5, 0.2, 0.1, 1.0)) == pytest.approx(0.5 * 0.05)
    rows = [(i, [p, 1 - p], int((i * 7) % 10 < 10 * (1 - p))) for i, p in enumerate([0.1, 0.2, 0.2, 0.4, 0.5, 0.6, 0.8, 0.9] * 4)]
    out = S.one_vs_rest_isotonic(spark.createDataFrame(rows, "id int, p array<double>, t int"), "id", "p", "t", 2).collect()
    assert len(out) == len(rows) and all(sum(r.calibrated) == pytest.approx(1) for r in out)
    by = {rows[r.id][1][0]: r.calibrated[0] for r in out}
    assert [by[k] for k in sorted(by)] == sorted(by.values())


def test_scores_on_ties_round_as_their_sql(spark):
    """Nearness 12 / (120 + days) puts some scores halfway between two sixth decimals."""
    import duckdb

    from hemicycle.plans.catalog import _scaled_round

    df = spark.sql("SELECT days, a, b, c, v FROM VALUES (1416), (264), (648), (3720), (0), (37) AS d(days), VALUES (true), (false) AS a(a), VALUES (true), (false) AS b(b), VALUES (true), (false) AS c(c), VALUES (true), (false) AS v(v)")
    score = L.edge_score(F.col("a"), F.col("b"), F.col("c"), F.col("days"), F.when(F.col("v"), 0.35).otherwise(0.45))
    got = {tuple(r)[:5]: (r.score, r.rounded) for r in df.withColumn("score", score).withColumn("rounded", _scaled_round("score")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (days BIGINT, a BOOLEAN, b BOOLEAN, c BOOLEAN, v BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", list(map(list, got)))
    sql = "0.40 * CAST(a AS INT) + 0.25 * CAST(b AS INT) + 0.20 * CAST(c AS INT) + 0.10 / (1 + days / 120.0) + 0.05 * CASE WHEN v THEN 0.35 ELSE 0.45 END"
    assert {r[:5]: r[5:] for r in con.execute(f"SELECT *, round(s, 6) FROM (SELECT *, {sql} AS s FROM t)").fetchall()} == got
