"""Sources, sinks, model adapters, forecasts and small parts on fixtures."""

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hemicycle import api, schemas, storage
from hemicycle.functions import clean as C
from hemicycle.functions import vectors as V
from hemicycle.operators import forecast, scoring
from hemicycle.operators import profiles as P
from hemicycle.operators import rows as R
from hemicycle.operators import stats as S
from hemicycle.sources import archives as A
from hemicycle.sources import paged
from hemicycle.sources import tables as TB
from hemicycle.streaming import incremental


def test_tables_by_stem_and_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    TB.write_table(df, f"{tmp_path}/a.pq")
    df.write.option("header", True).csv(f"{tmp_path}/b.csv")
    df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/c.tsv")
    assert TB.resolve_table(spark, str(tmp_path), "a").endswith("a.pq")
    with pytest.raises(FileNotFoundError):
        TB.resolve_table(spark, str(tmp_path), "zz")
    assert TB.read_table(spark, f"{tmp_path}/b.csv", ["v", "none"]).columns == ["v"]
    assert sorted(r.k for r in TB.read_table(spark, f"{tmp_path}/c.tsv").collect()) == ["1", "2"]
    assert TB.catalog_table(spark, str(tmp_path), "a", ["v"], "k = 2").collect() == [("y",)]
    assert TB.catalog_table(spark, str(tmp_path), "b").count() == 2
    TB.write_table(df, f"{tmp_path}/p.parquet", partition_by=["k"])
    assert (tmp_path / "p.parquet/k=1").exists()
    assert TB.ensure_min_rows(df, 2) is df
    with pytest.raises(ValueError, match="fewer than 3"):
        TB.ensure_min_rows(df, 3)
    assert TB.unclassified(spark.createDataFrame([(1, " "), (2, "t"), (3, "t")], "item_id int, text string"), spark.createDataFrame([(3,)], "item_id int")).collect() == [(2, "t")]


def test_shards_and_inventory(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/s/one")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{tmp_path}/s/two")
    (tmp_path / "s/two/part-broken.parquet").write_bytes(b"no parquet")
    got = TB.read_shards(spark, f"{tmp_path}/s/*")
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, None), (2, "x")]
    for i, name in enumerate(("motion-2001.zip", "motion-2005-2007.zip", "Vote.csv")):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_text("x" * (i + 1))
        import os

        os.utime(tmp_path / "f" / name, (1000 + i, 1000 + i))
    got = {r.kind: (r.n_files, r.n_bytes, r.first_year, r.last_year) for r in TB.inventory(spark, f"{tmp_path}/f").collect()}
    assert got == {"motion": (2, 3, 2001, 2007), "vote": (1, 3, None, None)}
    assert TB.latest_file(spark, f"{tmp_path}/f/*").endswith("Vote.csv") and TB.latest_file(spark, f"{tmp_path}/f/*.none") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2020-01-02"), ("2", "no date"), ("3", "2019-01-01 10:00:00")], "id string, at string")
    TB.export_table(df, f"{tmp_path}/e", "at")
    assert sorted((r.id, r["at"].year) for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [("1", 2020), ("3", 2019)]
    for _ in range(2):
        TB.append_lineage(spark, f"{tmp_path}/l", "t", df.select("id"), "import", "n")
    rows = spark.read.parquet(f"{tmp_path}/l").collect()
    assert len(rows) == 6 and len({r.lineage_id for r in rows}) == 6 and len({r.checksum for r in rows}) == 3
    small = spark.createDataFrame([("a|b", 1.5), ("c_d", None)], "n string, x double").orderBy("n")
    assert TB.report(small).split("\n")[2] == "| a\\|b | 1.5000 |"
    assert TB.report(small.select(F.lit('q"x,').alias("n")).limit(1), "csv") == 'n\n"q""x,"'
    assert "c\\_d & " in TB.report(small, "latex") and json.loads(TB.report(small, "json"))[1] == {"n": "c_d", "x": None}
    with pytest.raises(ValueError):
        TB.report(small, most=1)
    assert json.loads(TB.provenance(rows=3))["rows"] == 3
    for name in ("v.json", "v.json.zst"):
        TB.write_artifact(spark, f"{tmp_path}/{name}", {"a": [1, "é"]})
        assert TB.read_artifact(spark, f"{tmp_path}/{name}") == {"a": [1, "é"]}
    assert TB.sibling(spark, f"{tmp_path}/v.pkl").endswith("v.json.zst") and TB.sibling(spark, f"{tmp_path}/w.pkl") is None


def test_upsert_by_order_lock_and_partition(spark, tmp_path):
    s, path = "k string, v double, t int", f"{tmp_path}/u"
    TB.upsert(spark.createDataFrame([("a", 1.0, 5)], s), path, ["k"])
    TB.upsert(spark.createDataFrame([("a", 2.0, 4), ("b", 3.0, None)], s), path, ["k"], order="t")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 3.0)]
    with TB.locked(spark, path), pytest.raises(TimeoutError), TB.locked(spark, path, wait=0.3):
        pass
    with pytest.raises(OSError):
        TB._swap(spark, f"{tmp_path}/absent", path)
    assert spark.read.parquet(path).count() == 2  # the old table is back
    part = f"{tmp_path}/p"
    TB.upsert_partitioned(spark.createDataFrame([(str(i), 1.0, 0) for i in range(20)], s), part, ["k"], buckets=4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "p").glob("key_bucket=*")}
    TB.upsert_partitioned(spark.createDataFrame([("3", 9.0, 0)], s), part, ["k"], buckets=4)
    assert sum(p.stat().st_mtime_ns != t for p, t in before.items()) == 1
    assert spark.read.parquet(part).where("v = 9").count() == 1 and spark.read.parquet(part).count() == 20


def test_reports_and_bulk_documents(spark, tmp_path):
    ref = {"ref_dok_id": "H1", "referenstyp": "behandlar"}
    doc = lambda refs: json.dumps({"dokumentstatus": {"dokument": {"dok_id": "b1", "rm": "2020/21", "beteckning": "AU1", "datum": "2020-02-03", "titel": "T"}, "dokreferens": {"referens": refs}}})
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("a.JSON", doc(ref))
        z.writestr("b.json", doc([ref, {"ref_dok_id": " H2 "}, {"ref_dok_id": ""}]))
        z.writestr("c.txt", "x")
    got = A.reports(A.zip_members(spark, str(tmp_path / "r.zip"), ".json")).orderBy("ref_count").collect()
    assert [(r.ref_ids, r.ref_count, r.code) for r in got] == [('["H1"]', 1, "AU1"), ('["H1","H2"]', 2, "AU1")]
    flat = {"id": "m1", "title": "T", "text": "short", "html": "<p>a much longer text that stands in the page itself</p>", "date": "2020-01-01", "party": "S"}
    wrapped = {"dokumentstatus": {"dokument": {"dok_id": "m2", "titel": "W", "text": "y" * 60, "datum": "2021-01-01", "parti": "M", "typ": "mot"}}}
    members = spark.createDataFrame([(json.dumps(x),) for x in (flat, wrapped, {"no": "id"})], "content string")
    got = {r.item_id: r for r in A.bulk_documents(members).collect()}
    assert sorted(got) == ["m1", "m2"] and got["m1"].text.startswith("a much longer") and got["m2"].party == "M" and got["m2"].doc_type == "mot"


def test_paged_source(spark, tmp_path):
    for n in (1, 2):
        found = [{"dok_id": f"p{n}{i}", "parti": "S" if i else "m"} for i in range(3)]
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"list": {"doc": found if n == 1 else found[0]}}))
    df = paged.read_pages(spark, f"file://{tmp_path}/page-{{page}}.json", 2, "list.doc")
    assert sorted((r.page, r.item_id) for r in df.collect()) == [(1, "p10"), (1, "p11"), (1, "p12"), (2, "p20")]
    assert [r.item_id for r in paged.read_pages(spark, f"file://{tmp_path}/page-{{page}}.json", 2, "list.doc", ["M"], 1).collect()] == ["p10"]
    assert paged.read_pages(spark, None).count() == 2
    with pytest.raises(OSError):
        paged.fetch(f"file://{tmp_path}/none.json", tries=2, pause=0.01)


def test_streaming_parts(spark, tmp_path):
    rows = spark.createDataFrame([("1",), ("2",)], "k string")
    assert incremental.not_yet(rows, f"{tmp_path}/none", "k").count() == 2
    rows.where("k = '1'").write.parquet(f"{tmp_path}/t")
    assert [r.k for r in incremental.not_yet(rows, f"{tmp_path}/t", "k").collect()] == ["2"]
    at = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([(at, "a", 1.0), (at + dt.timedelta(minutes=59), "a", 2.0), (at + dt.timedelta(hours=3), "b", 4.0)], "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("counts").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_schemas_and_storage(spark):
    df = spark.range(1).withColumn("x", F.lit(1))
    assert schemas.resolve_first(df, ["y", "x"]) == "x" and schemas.resolve_first(df, ["y"]) is None
    assert schemas.require_columns(df, ["x"]) is df
    with pytest.raises(ValueError, match="missing columns: y"):
        schemas.require_columns(df, ["x", "y"])
    assert storage.written(df, "t").collect() == df.collect() and storage.shared_root(spark).startswith("file:")
    assert all(hasattr(api, n) for n in api.__all__)


def test_adapters_and_features(spark):
    name = "letters-test"
    if name not in scoring.ADAPTERS:
        scoring.register_adapter(name, lambda: lambda s: [[float(x.count("a")), float(x.count("b"))] for x in s])
    with pytest.raises(ValueError):
        scoring.register_adapter(name, lambda: None)
    df = spark.createDataFrame([("i", "aab"), ("j", None)], "item_id string, text string")
    assert [r.v for r in scoring.adapter_column(df, "text", "v", name).orderBy("item_id").collect()] == [[2.0, 1.0], [0.0, 0.0]]
    with pytest.raises(KeyError):
        scoring.adapter_column(df, "text", "v", "unknown-test")
    if "vowels-test" not in scoring.FEATURES:
        scoring.register_feature("vowels-test", lambda t: F.create_map(F.lit("chars"), F.lit(10.0), F.lit("a"), F.lit(1.0)))
    got = scoring.with_features(df, "text", ["length", "vowels-test"]).orderBy("item_id").collect()
    assert [r.features for r in got] == [{"chars": 13.0, "a": 1.0}, {"chars": 10.0, "a": 1.0}] and got[0].asDict().keys() == {"item_id", "text", "features"}


def test_weak_results_and_judge(spark):
    df = spark.createDataFrame([([0.1, 0.1], [0.6, 0.6], "b"), ([0.9, 0.1], [0.6, 0.0], "a"), ([0.1, 0.05], [0.4, 0.2], "zz")], "w array<double>, s array<double>, j string")
    got = df.select(scoring.with_supervised(F.col("w"), "s").alias("x"), scoring.with_judge(F.col("w"), ["a", "b"], "j").alias("y")).collect()
    assert [r.x for r in got] == [[0.5, 0.5], [0.9, 0.1], [0.1, 0.05]] and [r.y for r in got] == [[0.0, 1.0], [0.9, 0.1], [0.1, 0.05]]


def test_models_learn(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(6)
    rows = [("a" if i % 4 else "b", [float(x) for x in rng.normal(0 if i % 4 else 2, 0.5, 3)]) for i in range(200)]
    df = scoring.balanced(spark.createDataFrame(rows, "label string, v array<double>"), "label").withColumn("f", array_to_vector("v"))
    model = scoring.meta_learner("f", "label").fit(df)
    assert model.transform(df).where("prediction = label_index").count() > 190
    docs = spark.createDataFrame([(["tax", "budget"] * 5,), (["school", "pupil"] * 5,)] * 5, "tokens array<string>")
    topics = scoring.topic_model(2).fit(docs).transform(docs).select(F.col("tokens")[0].alias("t"), vector_to_array("topicDistribution").alias("d")).collect()
    side = {t: {int(np.argmax(r.d)) for r in topics if r.t == t} for t in ("tax", "school")}
    assert len(topics) == 10 and all(len(x) == 1 for x in side.values())


def test_forecast_grid_finds_the_season(spark):
    rng = np.random.default_rng(7)
    season = np.tile([5.0, 1, 3, 2], 15)
    y = season + np.arange(60) * 0.5 + rng.normal(0, 0.05, 60)
    rows = [("s", i, float(v), float(i % 2)) for i, v in enumerate(y)]
    out = forecast.forecast_grid(spark.createDataFrame(rows, "k string, t int, y double, x double"), "k", "t", "y", orders=((1, 0), (1, 1)), seasonal=((0, 0), (0, 1)), exog=((), ("x",)), period=4, holdout=8).collect()
    assert len(out) == 8 and sum(r.best for r in out) == 1
    best = next(r for r in out if r.best)
    assert best.sd == 1 and best.rmse < 0.5 and best.rmse == min(r.rmse for r in out)
    short = forecast.forecast_grid(spark.createDataFrame(rows[:6], "k string, t int, y double, x double"), "k", "t", "y", period=4, holdout=3).collect()
    assert not any(r.best and r.rmse is None for r in short)


def test_cleaning_traps(spark):
    df = spark.createDataFrame([(float("nan"), "3"), (1.5, "0"), (None, "x")], "x double, s string")
    assert [tuple(r) for r in df.select(C.nan_to_null("x"), P.strength("s")).collect()] == [(None, 3.0), (1.5, 1.0), (None, 1.0)]
    assert [r.s for r in R.clean_strings(spark.createDataFrame([(" a ",), ("nan",), ("?",), (None,)], "s string"), "s").collect()] == ["a", None, None, None]
    w = df.select(P.recency_weight(F.lit("2020-01-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp"), half_life=1.0)).first()[0]
    assert w == pytest.approx(0.5, abs=1e-2)
    assert pd.isna(df.select(V.expected_index(F.array(F.lit(0.0), F.lit(0.0)))).first()[0])


def test_clusters_and_factors(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0.0, 0, 0, 0], [5, 5, 0, 0], [0, 0, 9, 0]])
    x = np.concatenate([c + rng.normal(0, 0.3, (6, 4)) for c in centres])
    assert S.ward(x, 3) == [0] * 6 + [1] * 6 + [2] * 6 and S.ward(x[:1], 3) == [0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<double>")
    cluster = {r.i: r.cluster for r in S.kmeans(df, "v", 3).collect()}
    assert [len({cluster[i] for i in range(a, a + 6)}) for a in (0, 6, 12)] == [1, 1, 1] and len(set(cluster.values())) == 3
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ vt[:2].T
    got = np.array([r.components for r in S.principal(df, "v", 2).orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    score = S.latent_factor(x, 12)
    u = want[:, 0] if want[12, 0] > 0 else -want[:, 0]
    assert np.allclose(score, (u - u.mean()) / u.std())
    low, high = S.latent_interval(np.repeat(x, 5, axis=1), 12, 50)
    assert (low <= high).all() and low[12] > 0


def test_supervised_classifier_learns(spark):
    words = {"a": ["tax", "cut", "market"], "b": ["school", "care", "pupil"]}
    rng = np.random.default_rng(9)
    rows = [(k, [str(w) for w in rng.choice(words[k], 6)]) for k in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows, "label string, tokens array<string>")
    model = scoring.text_classifier(features=256).fit(df)
    assert model.transform(df).where("prediction = label_index").count() == 60
