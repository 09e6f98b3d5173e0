"""Queries for cleaning, dates, filters, lookups and small projections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.functions import clean as C
from hemicycle.functions import text as T
from hemicycle.functions import vectors as V
from hemicycle.operators import profiles as P
from hemicycle.operators import rows as R
from hemicycle.operators import stats as S
from hemicycle.plans.catalog import _LABELS, _labels, _query, _r, _t
from hemicycle.sources.tables import corpus_statistics as statistics_of
from hemicycle.sources.tables import unclassified

_SPELLED = "['2014/15', '2014.0', ' 2014 ', 'x', '', '1999-03-04', '1999-03-04 05:06:07', '2001']"


def _spelled(spark, d):
    """Customers with a text that may be a year, a session, a date or none of these."""
    values = F.array(*map(F.lit, ("2014/15", "2014.0", " 2014 ", "x", "", "1999-03-04", "1999-03-04 05:06:07", "2001")))
    return _t(spark, d, "customer").select("c_custkey", F.element_at(values, (F.col("c_custkey") % 8 + 1).cast("int")).alias("t"))


@_query(f"""WITH c AS (SELECT c_custkey, {_SPELLED}[c_custkey % 8 + 1] AS t FROM customer)
SELECT c_custkey, replace(t, '/', '') AS session, TRY_CAST(substr(t, 1, 4) AS INTEGER) AS year, coalesce(TRY_CAST(t AS DOUBLE), 0) AS number,
  CASE WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN CAST(CAST(round(TRY_CAST(t AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE trim(t) END AS time_key,
  CAST(epoch(coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y'))) AS BIGINT) AS at FROM c""")
def session_fields(spark, d):
    """Sessions, years, numbers, time keys and lenient timestamps of the same texts."""
    return _spelled(spark, d).select("c_custkey", C.session_key("t").alias("session"), C.session_year("t").alias("year"), C.number_or_zero("t").alias("number"), C.time_key("t").alias("time_key"), F.unix_seconds(C.lenient_timestamp("t")).alias("at"))


@_query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS at, CAST((year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 7 AS BIGINT) AS months, CAST(epoch(o_orderdate) // 86400 - epoch(TIMESTAMP '1996-07-03') // 86400 AS BIGINT) < 0 AS before,
  ((1998 - year(o_orderdate)) * 12 + 9 - month(o_orderdate) BETWEEN 0 AND 12) OR ((1994 - year(o_orderdate)) * 12 + 9 - month(o_orderdate) BETWEEN 0 AND 12) AS run_up, year(o_orderdate) IN (1994, 1998) AS election FROM orders""")
def metadata_dates(spark, d):
    """Dates read from metadata where the table has none, month distances and run-ups by month and by year alone."""
    rows = _t(spark, d, "orders").select("o_orderkey", F.lit(None).cast("timestamp").alias("date"), F.to_json(F.struct(F.lit("").alias("systemdatum"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datum"))).alias("metadata"))
    dated = C.metadata_date(rows).withColumn("fixed", F.lit("1996-07-03").cast("timestamp"))
    signed = F.when(F.col("date") < F.col("fixed"), -C.days_between("date", "fixed")).otherwise(C.days_between("date", "fixed"))
    return dated.select("o_orderkey", F.unix_seconds("date").alias("at"), C.month_distance("date", "fixed").alias("months"), (signed < 0).alias("before"), C.in_month_run_up("date", [1994, 1998]).alias("run_up"), C.in_run_up(F.year("date"), [1994, 1998], 0).alias("election"))


_ANSWERS = "['Ja', 'NEJ', ' yes ', 'Avstår', '0', NULL, 'för', '']"


@_query(f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS p FROM lineitem GROUP BY 1), a AS (SELECT id, p, lower(trim({_ANSWERS}[p % 8 + 1])) AS t, ['left', 'right', 'none', 'centre'][p % 4 + 1] AS c, ['Unknown', 'S', NULL, 'nyd', 'M', 'X'][p % 6 + 1] AS party, ['SoU12', 'AU1', '12', 'x9y'][p % 4 + 1] AS code FROM l)
SELECT t AS answer, c AS category, party, code, CASE WHEN t IN ('ja', 'yes', 'för') THEN 1.0 WHEN t IN ('nej', '0') THEN 0.0 END AS signal, CASE c WHEN 'left' THEN 1 WHEN 'centre' THEN 3 WHEN 'right' THEN 5 END AS place,
  lower(coalesce(party, 'unknown')) NOT IN ('unknown', 'nyd') AS known, coalesce(party, 'Unknown') NOT IN ('Unknown', 'X') AS kept, nullif(upper(regexp_extract(code, '^([A-Za-z]+)', 1)), '') AS prefix, count(*) AS n FROM a GROUP BY ALL""")
def answer_fields(spark, d):
    """Vote signals, places on the axis, code prefixes, known and excluded actors of order lines."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p") % len(values) + 1).cast("int"))
    rows = _t(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_partkey").alias("p"))
    rows = rows.select("id", pick(("Ja", "NEJ", " yes ", "Avstår", "0", None, "för", "")).alias("t"), pick(("left", "right", "none", "centre")).alias("category"), pick(("Unknown", "S", None, "nyd", "M", "X")).alias("party"), pick(("SoU12", "AU1", "12", "x9y")).alias("code"))
    kept = R.without_values(rows.select("id", "party"), "party", ("Unknown", "X")).select("id", F.lit(True).alias("kept"))
    out = rows.join(kept, "id", "left").select(F.lower(F.trim("t")).alias("answer"), "category", "party", "code", C.vote_signal("t").alias("signal"), C.axis_index("category", ("far_left", "left", "centre_left", "centre", "centre_right", "right", "far_right")).alias("place"), C.is_actor("party").alias("known"), F.coalesce("kept", F.lit(False)).alias("kept"), C.code_prefix("code").alias("prefix"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@_query("""WITH s AS (SELECT l_orderkey AS item_id, CAST(l_linenumber AS INTEGER) AS position, CASE WHEN l_tax < 0.02 THEN ' ' ELSE l_returnflag END AS party, CASE WHEN l_discount > 0.05 THEN 'Undertecknare' ELSE 'x' END AS role FROM lineitem),
r AS (SELECT item_id, party, position, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN position = 1 THEN 0 WHEN lower(role) = 'undertecknare' THEN 1 ELSE 2 END, position, role, party) AS k FROM s WHERE trim(party) <> '')
SELECT item_id, party FROM r WHERE k = 1""")
def signatory_party(spark, d):
    """The party of an order's primary signatory."""
    s = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.struct(F.col("l_linenumber").cast("int").alias("position"), F.when(F.col("l_discount") > 0.05, "Undertecknare").otherwise("x").alias("role"), F.when(F.col("l_tax") < 0.02, " ").otherwise(F.col("l_returnflag")).alias("party")).alias("s"))
    return s.groupBy("item_id").agg(F.sort_array(F.collect_list("s")).alias("list")).select("item_id", C.first_signatory("list").alias("party")).where("party is not null")


@_query(f"""WITH {_LABELS} SELECT item_id, '{{' || string_agg('"' || category || '":' || CAST(CAST(weight AS BIGINT) AS VARCHAR), ',' ORDER BY category) || '}}' AS scores FROM labels GROUP BY item_id""")
def sorted_scores(spark, d):
    held = _labels(spark, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("category", F.col("weight").cast("long").alias("weight"))), asc=False).alias("x"))
    return held.select("item_id", C.sorted_json(F.col("x.category"), F.col("x.weight")).alias("scores"))


@_query("""SELECT event_id, coalesce(value, 0) AS s, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS t1, round(ln(1 + length(props)), 6) AS size, round(user_id / 365.25, 6) AS years, CAST(event_type = 'click' AS DOUBLE) AS click, CAST(event_type = 'view' AS DOUBLE) AS viewed FROM events""")
def feature_vectors(spark, d):
    """One feature array per event, taken apart again; topics are cut or filled to four."""
    e = _t(spark, d, "events").withColumns({"topics": F.array(F.get_json_object("props", "$.k").cast("double")), "size": F.length("props")})
    v = e.select("event_id", V.feature_vector(["value"], "topics", [], "size", "user_id", "event_type", ["click", "view"], 4).alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    return v.where((F.size("v") == 9) & (at(2) == 0) & (at(4) == 0)).select("event_id", at(0).alias("s"), at(1).alias("t1"), _r(at(5)).alias("size"), _r(at(6)).alias("years"), at(7).alias("click"), at(8).alias("viewed"))


@_query("""SELECT doc_id AS item_id FROM documents WHERE lower(lang) = 'de' AND contains(lower(source), 'c1')""")
def find_items(spark, d):
    """Documents by language (any case) and part of their source."""
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("actor"), F.col("source").alias("metadata"))
    return R.find_items(items, actor="DE", text="C1").select("item_id")


def _queue(spark, d):
    """Orders as items, with weights that are shares, and events as annotations."""
    od = _t(spark, d, "orders")
    items = od.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("date"))
    labels = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_quantity") / 50).alias("weight"), F.col("l_returnflag").alias("category"))
    notes = _t(spark, d, "events").select(F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "view", "annotated").otherwise("open").alias("status"))
    return items, labels, notes


_QUEUE = """i AS (SELECT o_orderkey AS item_id, o_orderdate AS date FROM orders), l AS (SELECT l_orderkey AS item_id, l_quantity / 50 AS weight, l_returnflag AS category FROM lineitem), a AS (SELECT DISTINCT event_id AS item_id FROM events WHERE event_type = 'view'),
q AS (SELECT i.item_id, date, coalesce(max(weight), 0) AS top FROM i LEFT JOIN l USING (item_id) GROUP BY ALL HAVING coalesce(max(weight), 0) < 0.4), n AS (SELECT * FROM q WHERE item_id NOT IN (SELECT item_id FROM a))"""


@_query(f"WITH {_QUEUE} SELECT item_id, round(top, 6) AS top_weight FROM n")
def label_queue(spark, d):
    items, labels, notes = _queue(spark, d)
    return R.needs_label(items, labels, notes.where("status = 'annotated'"), 0.4).select("item_id", _r("top_weight").alias("top_weight"))


@_query(f"WITH {_QUEUE} SELECT item_id FROM n ORDER BY date DESC, item_id LIMIT 1")
def next_label(spark, d):
    items, labels, notes = _queue(spark, d)
    return R.next_to_label(items, labels, notes.where("status = 'annotated'"), 0.4).select("item_id")


@_query(f"WITH {_QUEUE} SELECT (SELECT count(*) FROM n) AS low_confidence, (SELECT count(*) FROM a) AS labelled")
def label_progress(spark, d):
    return R.progress(*_queue(spark, d), 0.4)


@_query("SELECT l_orderkey AS item_id, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS categories FROM lineitem WHERE l_quantity / 50 >= 0.6 GROUP BY 1")
def label_sets(spark, d):
    return R.label_sets(_queue(spark, d)[1], 0.6).select("item_id", F.array_join("categories", "|").alias("categories"))


@_query("SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN length(props) > 9 THEN 1 ELSE 0 END) AS BIGINT) AS n_long FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70) GROUP BY 1")
def frequent_users(spark, d):
    """Users with at least 70 events, and how many of these have props of more than nine characters."""
    held = R.with_min_rows(_t(spark, d, "events"), "user_id", 70)
    counted = held.groupBy("user_id").agg(F.count("*").alias("n"))
    return R.left_fill(counted, R.with_text(held, "props", 9).groupBy("user_id").agg(F.count("*").alias("n_long")), "user_id", n_long=0)


@_query("""WITH v AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), l AS (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)
SELECT c_custkey, n AS vote_count, o_orderkey AS last_order FROM v JOIN l ON o_custkey = c_custkey WHERE n > 0""")
def customers_with_orders(spark, d):
    """Customers that have orders, with their number and the last one by an n:1 lookup."""
    od = _t(spark, d, "orders")
    n = od.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("string").alias("vote_count"))
    held = R.with_votes(_t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left"))
    return R.lookup(held, od.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), "o_orderdate"), "c_custkey", "o_orderdate", "last_order").select("c_custkey", F.col("vote_count").cast("long").alias("vote_count"), "last_order")


@_query("""WITH s AS (SELECT c_mktsegment AS actor, avg(c_acctbal) AS score FROM customer GROUP BY 1), k AS (SELECT DISTINCT c_mktsegment AS actor, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT actor, CAST(year AS INTEGER) AS year, round(score, 6) AS score FROM k LEFT JOIN s USING (actor)""")
def static_scores(spark, d):
    """A score per segment repeated over the segment's years."""
    cu = _t(spark, d, "customer")
    scores = cu.groupBy(F.col("c_mktsegment").alias("actor")).agg(F.avg("c_acctbal").alias("score"))
    keys = _t(spark, d, "orders").join(cu, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("actor"), F.year("o_orderdate").alias("year"))
    return R.expand_static(scores, keys, "actor").select("actor", "year", _r("score").alias("score"))


@_query("SELECT p_brand, p_partkey, round(p_retailprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_retailprice >= 950) WHERE k <= 4")
def top_parts(spark, d):
    return R.top_per_class(_t(spark, d, "part"), 4, "p_brand", "p_retailprice", "p_partkey", 950.0).select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("price"))


@_query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def top_suppliers(spark, d):
    """The 20 suppliers with the most orders."""
    n = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return R.top_global(n, 20, "n", "l_suppkey")


@_query("""WITH v AS (SELECT n_name AS name, round(avg(c_acctbal), 6) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT (SELECT string_agg(name, '|' ORDER BY v DESC, name) FROM (SELECT * FROM v ORDER BY v DESC, name LIMIT 3)) AS top, (SELECT name FROM v ORDER BY v DESC, name LIMIT 1) AS highest, (SELECT name FROM v ORDER BY v, name LIMIT 1) AS lowest""")
def nation_digest(spark, d):
    v = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    return R.digest(v, "name", "v").withColumn("top", F.array_join("top", "|"))


@_query("""SELECT doc_id, source AS speaker, lang AS party, quality AS truth, toxic AS pred, round(greatest(quality * 0.6, 0.4 - 0.1 * toxic), 6) AS top_prob, replace(substr(text, 1, 240), chr(10), ' ') AS snippet FROM (SELECT * FROM documents WHERE lower(lang) = 'en' ORDER BY doc_id LIMIT 100) LEFT JOIN labels USING (doc_id)""")
def statement_lookup(spark, d):
    """The first hundred English documents with truth, prediction and a preview."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("speaker"), F.col("lang").alias("party"), "text")
    known = _t(spark, d, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"), (F.col("quality") * 0.6).alias("p0"), (0.4 - 0.1 * F.col("toxic")).alias("p1"))
    return R.lookup_statements(docs, known, "doc_id", ["p0", "p1"], party="EN").withColumn("top_prob", _r("top_prob"))


@_query("""SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS kind_click, CAST(event_type = 'view' AS DOUBLE) AS kind_view, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0.0 AS absent FROM events""")
def encoded_events(spark, d):
    """One-hot types and numbers from JSON."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.translate("props", '"', "'")).alias("props"))
    return R.json_columns(R.one_hot(e, "event_type", ["click", "view"], "kind"), "props", ["k", "absent"]).drop("props").select("event_id", "kind_click", "kind_view", "k", "absent")


@_query("""SELECT o_orderkey AS item_id, o_orderstatus AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS text, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE c_mktsegment END AS party, CAST(NULL AS VARCHAR) AS doc_type,
  '{' || CASE WHEN o_orderkey % 2 = 0 THEN '"body":"' || o_orderpriority || '",' ELSE '' END || '"datum":"' || strftime(o_orderdate, '%Y-%m-%d') || '","key":"' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '","parti":"P' ELSE '' END || '","rubrik":"' || o_orderstatus || '"}' AS metadata FROM orders JOIN customer ON c_custkey = o_custkey""")
def normalised_raw(spark, d):
    """Raw JSON as normalised rows, parties filled in from another table."""
    od = _t(spark, d, "orders")
    even, third = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    raw = od.select(F.col("o_orderkey").cast("string").alias("item_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("rubrik"), F.when(even, F.col("o_orderpriority")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datum"), F.when(third, "P").alias("parti"), F.col("o_orderkey").alias("key"))).alias("json"))
    other = od.join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("c_mktsegment").alias("party"))
    return R.backfill(R.normalise_raw(raw), other, "item_id", ["party"]).withColumn("item_id", F.col("item_id").cast("long")).select("item_id", "title", "text", "date", "party", "doc_type", "metadata")


@_query("""SELECT 'orders' AS source, count(DISTINCT o_orderkey) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders UNION ALL SELECT 'events', count(DISTINCT event_id), CAST(min(year(ts)) AS INTEGER), CAST(max(year(ts)) AS INTEGER) FROM events""")
def corpus_statistics(spark, d):
    return statistics_of(orders=(_t(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_orderkey", "y"), events=(_t(spark, d, "events").withColumn("y", F.year("ts")), "event_id", "y"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND trim(text) <> ''")
def unclassified_documents(spark, d):
    return unclassified(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id")


# Aggregates over time


@_query("""WITH a AS (SELECT c_mktsegment AS party, 'speech' AS modality, year(o_orderdate) AS year, o_totalprice AS i FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT n_name, 'motion', year(l_shipdate), l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT party, modality, CAST(year AS INTEGER) AS year, round(avg(i), 4) AS mean_index FROM a GROUP BY ALL""")
def index_drift(spark, d):
    said = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("party"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("index"))
    moved = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("party"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("index"))
    return P.drift({"speech": said, "motion": moved}).withColumn("mean_index", _r("mean_index", 4))


@_query(f"""WITH {_LABELS}, w AS (SELECT actor, category, weight * exp(-ln(2) / (500 / 365.25) * greatest(abs(floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(date)) / 86400000000.0)) / 365.25, 0)) * coalesce(nullif(CAST(item_id % 3 AS DOUBLE), 0), 1) AS w FROM labels), s AS (SELECT actor, category, sum(w) AS v FROM w GROUP BY ALL)
SELECT actor, category, round(v / sum(v) OVER (PARTITION BY actor), 6) AS proportion FROM s""")
def half_life_profile(spark, d):
    """Weights that halve every 500 days before a given day, times a strength (0 counts as 1)."""
    rows = _labels(spark, d).withColumn("strength", (F.col("item_id") % 3).cast("string"))
    return P.half_life_profile(rows, ["actor"], "date", 500.0, F.lit("2002-01-01").cast("timestamp"), "strength").select("actor", "category", _r("proportion").alias("proportion"))


@_query("""WITH p AS (SELECT c_mktsegment AS party, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS topic, count(*) AS S, count(*) FILTER (o_orderstatus = 'F') AS M, 0 AS V, avg(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END) AS i FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT party, year, sum(i * S) / sum(S) FILTER (i IS NOT NULL) AS s, CASE WHEN sum(M) FILTER (i IS NOT NULL) > 0 THEN sum(i * M) / sum(M) FILTER (i IS NOT NULL) END AS m FROM p GROUP BY ALL)
SELECT party, year, round(s, 4) AS speech_index, round(m, 4) AS motion_index, CAST(NULL AS DOUBLE) AS vote_index, round(m, 4) AS action_index FROM m""")
def index_by_year(spark, d):
    """Weighted mean index; a topic without an index (NaN) counts in neither sum."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.avg(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")))
    p = rows.groupBy(F.col("c_mktsegment").alias("party"), F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("S"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("M"), F.lit(0).alias("V"), F.coalesce(price, F.lit(float("nan"))).alias("i"))
    return P.index_by_year(p, "i").select("party", "year", *(_r(c, 4).alias(c) for c in ("speech_index", "motion_index", "vote_index", "action_index")))


@_query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS n_keys FROM orders GROUP BY 1""")
def yearly_statistics(spark, d):
    out = P.yearly_statistics(_t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_totalprice", "o_custkey")
    return out.select("year", _r("median", 4).alias("median"), _r("mean", 4).alias("mean"), "n_keys")


@_query(f"""WITH {_LABELS}, p AS (SELECT *, CASE WHEN year BETWEEN 1994 AND 1997 THEN '1994-1997' WHEN year BETWEEN 1998 AND 2001 THEN '1998-2001' END AS period FROM labels), s AS (SELECT actor, period, category, sum(weight) AS v FROM p WHERE period IS NOT NULL GROUP BY ALL)
SELECT actor, period, category, round(v / sum(v) OVER (PARTITION BY actor, period), 6) AS proportion FROM s""")
def period_profile(spark, d):
    rows = _labels(spark, d).withColumn("period", C.period_bucket("year", [(1994, 1997), (1998, 2001)]))
    return P.period_profile(rows, "actor", "period").select("actor", "period", "category", _r("proportion").alias("proportion"))


@_query("""WITH t AS (SELECT c_mktsegment AS party, year(o_orderdate) AS year, o_orderpriority AS topic, avg(CAST(o_orderstatus = 'F' AS INT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL), c AS (SELECT c_mktsegment AS party, avg(c_acctbal) / 10000 AS consistency FROM customer GROUP BY 1)
SELECT party, CAST(year AS INTEGER) AS year, round(avg(v), 6) AS share, round(any_value(consistency) * avg(v), 6) AS metric FROM t LEFT JOIN c USING (party) GROUP BY party, year""")
def consistency_by_year(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.when(F.col("c_mktsegment") == "BUILDING", "NyD").otherwise(F.col("c_mktsegment"))
    topics = rows.groupBy(party.alias("party"), F.year("o_orderdate").cast("string").alias("year"), "o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    scores = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("party")).agg((F.avg("c_acctbal") / 10000).alias("consistency"))
    return P.consistency_by_year(scores, topics, "share").select("party", "year", _r("share").alias("share"), _r("metric").alias("metric"))


@_query("""WITH w AS (SELECT c_mktsegment AS party, year(o_orderdate) AS year, avg(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1996, 1999) GROUP BY ALL), k AS (SELECT DISTINCT c_mktsegment AS party, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey), j AS (SELECT k.party, k.year, w FROM k LEFT JOIN w USING (party, year))
SELECT party, CAST(year AS INTEGER) AS year, round(coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY party ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(w IGNORE NULLS) OVER (PARTITION BY party ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS score, w IS NULL AS imputed FROM j""")
def benchmark_years(spark, d):
    """Two waves of a benchmark, filled over all years."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("party"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("score"))
    return P.fill_benchmark(rows, rows.where("year in (1996, 1999)")).withColumn("score", _r("score", 4))


@_query(f"""WITH {_LABELS}, p AS (SELECT item_id, CAST(right(category, 1) AS DOUBLE) AS place, weight FROM labels), v AS (SELECT item_id, place, sum(weight) AS w FROM p GROUP BY ALL)
SELECT item_id, round(sum((place - 1) * w) FILTER (place BETWEEN 1 AND 5) / sum(w) FILTER (place BETWEEN 1 AND 5), 6) AS expected FROM v GROUP BY item_id""")
def expected_index(spark, d):
    """The expected place on a five-step axis of each order's weights."""
    cells = _labels(spark, d).groupBy("item_id").agg(*(F.sum(F.when(F.col("category").endswith(str(i)), F.col("weight")).otherwise(0.0)).alias(f"c{i}") for i in range(1, 6)))
    return cells.select("item_id", _r(V.expected_index(F.array(*(f"c{i}" for i in range(1, 6))))).alias("expected"))


# Text


@_query("""SELECT doc_id, substr(text, 1, 40) AS preview, CAST(len(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda t: t NOT IN ('the', 'der', 'la', 'que'))) AS INTEGER) AS n_tokens,
  trim(regexp_replace(replace(replace(text, '–', '-'), '—', '-'), '\\s+', ' ', 'g'), ' ') = text AS plain,
  (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'que') AS INT) >= 2) OR regexp_matches(lower(text), '[0-9]{4}') AS passes FROM documents""")
def text_measures(spark, d):
    """Previews, tokens without stop words, whether normalising changes a text, and the keyword gate."""
    docs = _t(spark, d, "documents").withColumn("t", T.tokens("text"))
    return docs.select("doc_id", T.preview("text", 40).alias("preview"), F.size(T.without("t", ["the", "der", "la", "que"])).alias("n_tokens"), (T.normalise_text("text") == F.col("text")).alias("plain"), T.quality_gate("text", ["the", "und", "que"], ["[0-9]{4}"], 2).alias("passes"))


@_query(r"""WITH s AS (SELECT conv_id, turn, unnest(v) AS s, generate_subscripts(v, 1) AS place FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS v FROM conversations)), k AS (SELECT *, trim(lower(s), ' ') AS t FROM s)
SELECT conv_id, turn, coalesce(string_agg(s, ' ' ORDER BY place) FILTER (length(t) >= 20 AND NOT regexp_matches(t, 'zz|the (is|of)') AND (contains(t, 'tion') OR contains(t, 'ung') OR contains(' ' || t || ' ', ' and ') OR contains(' ' || t || ' ', ' le '))), '') AS kept FROM k GROUP BY conv_id, turn""")
def policy_extract(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.policy_sentences("text", ["zz", "the (is|of)"], ["tion", "ung"], ["and", "le"]).alias("kept"))


@_query(r"""SELECT conv_id, turn, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n_lines,
  CAST(CAST(contains(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'), ' '), 'the of') AS INT) + CAST(contains(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'), ' '), 'de la') AS INT) AS INTEGER) AS lemma_hits FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '\n\s*\n')""")
def paragraph_counts(spark, d):
    """Lines as paragraphs, and phrases found in the text of the lemmas (here the tokens)."""
    rows = _t(spark, d, "conversations").where(~F.coalesce("text", F.lit("")).rlike(r"\n\s*\n")).withColumn("lemmas", T.tokens("text"))
    return rows.select("conv_id", "turn", F.size(T.paragraphs("text")).alias("n_lines"), T.lemma_hits("lemmas", ["the of", "de la"]).alias("lemma_hits"))


@_query("""WITH f AS (SELECT o_orderstatus AS cls, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events) AND length(o_orderpriority) > 6) SELECT cls, o_orderkey FROM f WHERE k <= 25""")
def class_examples(spark, d):
    """25 orders of each status in hash order, without those that are labelled already."""
    od = _t(spark, d, "orders").withColumn("cls", F.col("o_orderstatus"))
    done = _t(spark, d, "events").select(F.col("event_id").alias("o_orderkey"))
    return S.examples_per_class(od, "cls", 25, "o_orderkey", exclude=done, text="o_orderpriority", longer_than=6).select("cls", "o_orderkey")


@_query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def random_orders(spark, d):
    return S.sample_rows(_t(spark, d, "orders"), 500, "o_orderkey").select("o_orderkey")


@_query("""WITH c AS (SELECT o_orderstatus AS s, count(*) AS size FROM orders GROUP BY 1), q AS (SELECT s, size, greatest(1, CAST(floor(size * 100 / (SELECT sum(size) FROM c)) AS BIGINT)) AS q FROM c),
t AS (SELECT s, CASE WHEN row_number() OVER (ORDER BY size DESC, s) = 1 THEN greatest(1, q + 100 - CAST((SELECT sum(q) FROM q) AS BIGINT)) ELSE q END AS quota FROM q), h AS (SELECT *, ntile(2) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS half FROM orders)
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS n FROM h WHERE half = 1) JOIN t ON s = o_orderstatus WHERE n <= quota""")
def upper_half_sample(spark, d):
    """A stratified sample of the dearer half of each status."""
    return S.stratified_sample(_t(spark, d, "orders"), "o_orderstatus", 100, "o_orderkey", top_half_of="o_totalprice").select("o_orderkey", "o_orderstatus")


