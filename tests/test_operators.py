import datetime as dt
import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.functions import clean as C
from hemicycle.functions import text as T
from hemicycle.functions import vectors as V
from hemicycle.operators import linkage as L
from hemicycle.operators import profiles as P
from hemicycle.operators import rows as R
from hemicycle.operators import scoring
from hemicycle.operators import stats as S
from hemicycle.sources import archives as A
from hemicycle.sources import tables as TB
from hemicycle.streaming.incremental import process_new


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.range(1).select(*(F.lit(v).alias(n) for n, v in cols.items())) if names else spark.range(1)
    return df.select(expr).first()[0]


def test_top_category_ties_and_nan(spark):
    rows = [("i", "b", 0.8), ("i", "a", 0.8), ("j", "a", float("nan")), ("j", "b", 0.1)]
    got = {r.item_id: r.category for r in R.top_category(spark.createDataFrame(rows, "item_id string, category string, weight double")).collect()}
    assert got == {"i": "a", "j": "b"}


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, w string")
    assert sorted((r.v, r.w) for r in R.join_null_safe(a, b, ["k"]).collect()) == [("x", "p"), ("y", "q")]
    assert a.join(b, "k").count() == 1


def test_party_variants(spark):
    df = spark.createDataFrame([("fp",), ("FP",), ("-",), ("vpk",), (" m ",), ("zz",)], "p string")
    got = [tuple(r) for r in df.select(C.normalise_actor("p"), C.normalise_speech_actor("p")).collect()]
    assert got == [("L", "L"), (None, "L"), (None, None), ("V", None), ("M", "M"), (None, None)]


def test_days_and_votes(spark):
    a, b = dt.datetime(2020, 1, 1, 12), dt.datetime(2020, 1, 3)
    df = spark.createDataFrame([(a, b)], "a timestamp, b timestamp")
    assert tuple(df.select(C.days_between("a", "b"), C.days_between("a", "b", floor_first=True)).first()) == (1, 2)
    v = spark.createDataFrame([("Ja",), ("nej",), ("Avstår",)], "v string").select(C.vote_signal("v")).collect()
    assert [r[0] for r in v] == [1.0, 0.0, None]


def test_confidence_and_stratum(spark):
    want = {
        "existing:betankande_ref_dok_id": (0.98, "structural_high", 0.95, True), "existing:rel_dok_id": (0.95, "structural_high", 0.95, True), "existing:dok_id": (0.9, "existing_unknown", 0.7, False),
        "fallback:party_category_vote": (0.8, "heuristic_fallback", 0.35, False), "fallback:party_vote": (0.7, "heuristic_fallback", 0.35, False), "fallback:party": (0.65, "heuristic_fallback", 0.35, False), "fallback:vote_any": (0.45, "heuristic_fallback", 0.35, False),
        "fallback:any": (0.35, "heuristic_fallback", 0.35, False), "fallback_after_stale_existing:party": (0.35, "heuristic_fallback", 0.4, False), "graph_direct_signatory_vote": (0.35, "graph_signatory", 0.85, True),
        "graph_direct_motion": (0.35, "graph_direct", 0.65, False), "graph_rebalanced_motion": (0.35, "heuristic_graph", 0.5, False), None: (0.35, "unknown", 0.2, False), "x": (0.35, "unknown", 0.2, False),
    }
    rows = spark.createDataFrame([(s,) for s in want], "s string").select("s", C.link_confidence("s").alias("c"), C.link_stratum("s").alias("t")).collect()
    assert {r["s"]: (r["c"], *r["t"]) for r in rows} == want


def test_contradiction(spark):
    r = spark.createDataFrame([(0.5, 1.0), (None, None)], "j double, f double").select(V.contradiction("j", "f").alias("x")).collect()
    assert tuple(r[0]["x"]) == pytest.approx((0.5, 0.65, 0.0, 0.64)) and tuple(r[1]["x"]) == (1.0, 0.0, 0.0, 0.0)


def test_boosts_json_and_margin(spark):
    rules = {"tax": (["raise"], ["cut"]), "state": (["grow"], ["shrink"])}
    df = spark.createDataFrame([("Raise the tax, grow the state",), ("raise and cut tax",), ("raise",), (None,)], "t string")
    assert [r[0] for r in df.select(T.stance_boost("t", rules, {"left": 0.5, "mid": 0.3}, {"right": 0.5})).collect()] == [{"left": 1.0, "mid": 0.6}, {}, {}, {}]
    both = [([["raise"], ["tax", "fee"]], {"left": 1.4}), ([["cut"]], {"right": 1.0, "left": 0.1})]
    assert [r[0] for r in df.select(T.cooccurrence_boost("t", both)).collect()] == [{"left": 1.4}, {"left": 1.5, "right": 1.0}, {}, {}]
    raw = ['so: {"far_left": 10, "left": "4",} end', '{"far left": 3, "left": 5}', '{"far_left": 1, left: 2, "mid": 7.5}', "{'left': 2}", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(T.json_scores("t", ["far_left", "left", "mid"])).collect()]
    assert got == [{"far_left": 10.0, "left": 4.0}, {"far_left": 3.0, "left": 5.0}, {"far_left": 1.0, "mid": 7.5}, None, None]
    sims = spark.createDataFrame([({"a": 0.5, "b": 0.4},), ({"a": 0.5, "b": 0.48},), ({"b": 0.9},)], "m map<string,double>")
    assert [r[0] for r in sims.select(T.margin_gate("m", "a", ["b", "c"])).collect()] == [True, False, True]


def test_run_up(spark):
    df = spark.createDataFrame([(2013,), (2014,), (2015,)], "y int")
    assert [r[0] for r in df.select(C.in_run_up("y", C.election_years(2014, 2026), 1)).collect()] == [True, True, False]
    assert [r[0] for r in df.select(C.in_run_up("y", [2014], 0)).collect()] == [False, True, False]


def test_distances(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2, 0.0, 0.0, 0.0, 0.0], [0.0, 0.1, 0.2, 0.3, 0.4, 0.0, 0.0])], "a array<double>, b array<double>")
    js, cos, eu, ent, am = df.select(V.js_distance("a", "b"), V.cosine_distance("a", "b"), V.euclidean("a", "b"), V.entropy("a", base2=True), V.argmax("b")).first()
    a, b = np.array(df.first()[0]), np.array(df.first()[1])
    assert js == pytest.approx(0.798588990, abs=1e-8)
    assert cos == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert eu == pytest.approx(np.linalg.norm(a - b)) and am == 4
    assert ent == pytest.approx(-sum(x * math.log2(x) for x in a if x))


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.04), (2, 0.001), (3, 0.03)], "k int, p double")
    assert [round(r.adjusted, 6) for r in S.benjamini_hochberg(df, "p", "k").orderBy("k").collect()] == [0.04, 0.003, 0.04]
    assert [round(r.adjusted, 6) for r in S.benjamini_hochberg(df, "p", "k", legacy=True).orderBy("k").collect()] == [0.003, 0.003, 0.04]


def test_fill(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, None), ("B", 1, 5.0), ("B", 2, None)], "g string, t int, v double")
    fixed = {(r.g, r.t): r.filled for r in P.carry(df, "g", "t", "v").collect()}
    leak = {(r.g, r.t): r.filled for r in P.carry(df, "g", "t", "v", leak=True).collect()}
    assert fixed == {("A", 1): None, ("A", 2): None, ("B", 1): 5.0, ("B", 2): 5.0} and set(leak.values()) == {5.0}


def test_pathways_null_keys(spark):
    k = "party string, topic string, year int"
    said = spark.createDataFrame([(None, "t", 2020)] * 5, k)
    moved = spark.createDataFrame([(None, "t", 2020)] * 3, k)
    voted = spark.createDataFrame([(None, "t", 2020, 1)], f"{k}, vote_weight int")
    r = P.pathways(said, moved, voted).first()
    assert (r.S, r.M, r.V, r.pct_vote, r.pct_motion, r.pct_none) == (5, 3, 1, 0.2, 0.4, 0.4)


ITEMS = "item_id string, party string, category string, weight double, has_vote boolean"


def test_ladder_prefers_voted_same_party_category(spark):
    items = spark.createDataFrame([("a", "M", "right", 0.9, False), ("b", "M", "right", 0.5, True), ("c", "S", "left", 0.7, False)], ITEMS)
    rows = spark.createDataFrame([("s1", "M", "right"), ("s2", "S", "x"), ("s3", "zz", "")], "speech string, party string, category string")
    got = {r.speech: (r.target_id, r.link_source) for r in L.ladder(rows, items).collect()}
    assert got == {"s1": ("b", "fallback:party_category_vote"), "s2": ("c", "fallback:party"), "s3": ("b", "fallback:vote_any")}
    compat = {r.speech: r.link_source for r in L.ladder(rows, items, multi_key_only=True).collect()}
    assert compat["s2"] == "fallback:vote_any"


def test_ladder_partition_invariant(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(f"i{i}", str(rng.integers(3)), str(rng.integers(3)), float(rng.integers(4)), bool(rng.integers(2))) for i in range(60)], ITEMS)
    rows = spark.createDataFrame([(i, str(i % 4), str(i % 5)) for i in range(40)], "s int, party string, category string")
    assert sorted(L.ladder(rows, items).collect()) == sorted(L.ladder(rows.repartition(7), items.repartition(5)).collect())


def test_references(spark):
    rows = spark.createDataFrame([("s", None, "H1", "see so 291 and H2")], "k string, rel string, dok string, title string")
    items = spark.createDataFrame([("h1", "SO291"), ("H2", "X1")], "item_id string, code string")
    al = L.alias_table(items, ["item_id"], code="code")
    got = L.reference_candidates(rows, "k", ["rel", "dok"], ["title"], r"\bso \d+|\bH\d+", items, al).orderBy("rank", "pos").collect()
    assert [(r.item_id, r.source) for r in got] == [("h1", "dok"), ("H2", "title")]


def test_rebalance_and_grid(spark):
    rows = [(f"i{i}", "vote" if i < 8 else "motion", f"v{i}", f"m{i}" if i != 3 else None, "fallback:any" if i else "existing:x", float(i), i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "item_id string, action_type string, action_id string, motion_candidate string, link_source string, score double, margin double")
    out = L.rebalance(df, 0.5, 0.0)
    assert sorted(r.item_id for r in out.where("rebalanced").collect()) == ["i5", "i6", "i7"]
    assert out.where("action_type = 'motion'").count() == 5


def test_nearest_window(spark):
    t = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    left = spark.createDataFrame([(1, "p", t(0)), (2, "p", None)], "k int, party string, at timestamp")
    right = spark.createDataFrame([("a", "p", t(-90)), ("b", "p", t(89)), ("c", "p", t(91)), ("d", "q", t(0))], "item string, party string, on timestamp")
    got = L.nearest_in_time(left, right, ["party"], "k", "at", "item", "on").select("k", "item", "days_diff").collect()
    assert [tuple(r) for r in got] == [(1, "b", 89)]


def test_cascade(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = L.cascade(rows, "k", ("first", lambda d: d.where("k = 1")), ("rest", lambda d: d.where("k < 3")))
    assert sorted((r.k, r.link_source) for r in got.collect()) == [(1, "first"), (2, "rest")]


def test_bridge(spark):
    items = spark.createDataFrame([("m1",), ("m2",)], "item_id string")
    refs = spark.createDataFrame([("s", "c", json.dumps(["m1", "m1", "m9"])), ("s", "d", json.dumps(["m1"])), ("s", "e", None)], "session string, code string, ref_ids string")
    votes = spark.createDataFrame([("s", "c", "v2"), ("s", "c", "v1"), ("s", "c", "v1"), ("s", "d", "v3")], "session string, code string, vote_id string")
    assert [tuple(r) for r in R.bridge(items, refs, votes).collect()] == [("m1", "s", "c", 3, "v1")]


def test_text(spark):
    df = spark.createDataFrame([("A <b>x</b>. Öppna dörren! <script>no()</script>Why &amp; when?",)], "t string")
    html, toks, sents = df.select(T.html_to_text("t"), T.tokens("t"), T.sentences("t")).first()
    assert html == "A x . Öppna dörren! Why & when?" and "öppna" in toks and len(sents) == 3
    long = spark.createDataFrame([("aaaa. bbbb. cccccccccc. d.",)], "t string")
    assert long.select(T.chunks("t", 11)).first()[0] == ["aaaa. bbbb.", "cccccccccc.", "d."]
    assert spark.createDataFrame([(None,)], "t string").select(F.size(T.sentences("t")), T.keyword_hits("t", ["a"])).first() == (0, 0)


def test_classify(spark):
    items = spark.createDataFrame([("a", "we want tax cuts and a free market"), ("b", None)], "item_id string, text string")
    got = scoring.classify(items, "text").collect()
    w = {(r.item_id, r.category): r.weight for r in got}
    assert len(got) == 6 and w[("a", "right")] == 1.0 and w[("b", "left")] == pytest.approx(1 / 3)


def _zip(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives(spark, tmp_path):
    _zip(tmp_path / "a.zip", **{"1.json": json.dumps({"anforande": {"anforande_id": "s1", "parti": "fp", "dok_datum": "2020-01-02", "anforandetext": " x ", "talare": ""}}), "2.json": "{broken", "3.json": ""})
    r = A.speeches(A.zip_members(spark, str(tmp_path / "a.zip"), ".json")).collect()
    assert [(x.speech_id, x.party, x.text, x.speaker, str(x.date)) for x in r] == [("s1", "L", "x", None, "2020-01-02 00:00:00")]
    who = {"intressent_id": "1", "namn": "N", "partibet": "S", "roll": "undertecknare", "ordning": "1"}
    for k, v in (("o", who), ("l", [who, who | {"intressent_id": "2", "ordning": "2"}])):
        _zip(tmp_path / f"{k}.zip", d=json.dumps({"dokumentstatus": {"dokument": {"dok_id": k, "rm": "2020/21"}, "dokintressent": {"intressent": v}}}))
    assert A.signatories(A.zip_members(spark, str(tmp_path / "o.zip"))).count() == 1
    assert sorted(x.position for x in A.signatories(A.zip_members(spark, str(tmp_path / "l.zip"))).collect()) == [1, 2]
    row = "2002/03,AU1,5,ABC,Namn,01,m,X,Ja,sakfrågan,1,man,1950,2003-01-01"
    old, new = io.StringIO(), "2019/20,AU1,DEF,5,Namn,02,s,X,Nej,sakfrågan,1,man,1950,2020-01-01"
    old.write("﻿" + ",".join(A.OLD_LAYOUT).upper() + "\n" + row)
    _zip(tmp_path / "v.zip", old=old.getvalue(), new=new)
    got = sorted((x.session, x.point, x.vote_id, x.party, x.vote) for x in A.vote_rows(A.zip_members(spark, str(tmp_path / "v.zip"))).collect())
    assert got == [("2002/03".replace("/", ""), "5", "ABC", "M", "Ja"), ("201920", "5", "DEF", "S", "Nej")]


def test_upsert_and_stream(spark, tmp_path):
    path, s = str(tmp_path / "t"), "speech_id string, category string, score double"
    assert TB.upsert(spark.createDataFrame([("1", "a", 0.1), ("1", "b", 0.2), ("2", "a", 0.3)], s), path, ["speech_id", "category"]) == 3
    assert TB.upsert(spark.createDataFrame([("1", "a", 0.9)], s), path, ["speech_id", "category"]) == 3
    assert spark.read.parquet(path).where("speech_id = '1' and category = 'a'").first().score == 0.9
    TB.upsert(spark.createDataFrame([("1", "a", 0.5), ("3", "a", 0.5)], s), path, ["speech_id", "category"], keep="old")
    assert sorted(r.score for r in spark.read.parquet(path).where("category = 'a'").collect()) == [0.3, 0.5, 0.9]
    src = str(tmp_path / "src")
    spark.createDataFrame([("9", "z", 1.0)], s).write.parquet(src)
    for _ in range(2):
        process_new(spark, src, s, lambda d: d, path, ["speech_id", "category"], str(tmp_path / "cp"))
    assert spark.read.parquet(path).where("speech_id = '9'").count() == 1


def test_statistics(spark):
    assert S.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == (0.0, pytest.approx(0.0625))
    assert S._t_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(400)], "g string, v double").withColumn("i", F.monotonically_increasing_id())
    r = S.bootstrap_means(df, "g", ["v"], 200).first()
    assert r.v_low < r.v_mean < r.v_high and r.v_high - r.v_low < 0.8
    best, top = S.evolve(lambda x: -float(((x - 0.3) ** 2).sum()), [(0, 1), (0, 1)])
    assert top > -0.01 and np.allclose(best, 0.3, atol=0.1)


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "k int, s string")
    got = S.stratified_sample(df, "s", 20, "k")
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 18, "b": 2}
    assert sorted(got.collect()) == sorted(S.stratified_sample(df.repartition(9), "s", 20, "k").collect())
    parts = S.split(df, "s", "k", {"train": 0.5, "validation": 0.25, "test": 0.25})
    assert {(r.s, r.split): r["count"] for r in parts.groupBy("s", "split").count().collect()}[("a", "train")] == 45


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert R.bag_difference(a, a.repartition(3)).count() == 0
    assert [r.side for r in R.bag_difference(a, a.distinct()).collect()] == ["left"]
    assert R.row_digest(a).first() == R.row_digest(a.repartition(3)).first()
