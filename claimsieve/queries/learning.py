"""Learning over the test tables: claims are labelled by what they cost, so that there is something to learn."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import features as X
from claimsieve.operators import learning as M
from claimsieve.queries.common import R6, event_claims, r6
from claimsieve.queries.risk import anomaly, future, ranking_sql
from claimsieve.sources import views as V


def _matrix(spark, d):
    c = event_claims(spark, d).withColumns({"billed_amount": F.col("service_minutes"), "modifier": F.lit(None).cast("string"), "member_id": F.col("claim_id") % 500})
    return X.claim_features(c, V.providers(spark, d), V.members(spark, d)), c


def _labels(c):
    return c.select("claim_id", (F.col("paid_amount") > 40).cast("int").alias("is_suspicious"))


def m01(spark, d):
    m, c = _matrix(spark, d)
    return M.with_target(m, _labels(c).where("claim_id % 2 = 0")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


M01 = "SELECT CASE WHEN event_id % 2 = 0 AND round(value * 100) / 100 > 40 THEN 1 ELSE 0 END AS label, count(*) AS n FROM events GROUP BY 1"


def m02(spark, d):
    m, c = _matrix(spark, d)
    rows = M.grouped_folds(M.with_target(m, _labels(c)))
    M.audit_folds(rows)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("provider_id").alias("providers"), F.sum("label").alias("positives"))


def m04(spark, d):
    """Isotonic calibration of a score with few values: the calibrated probability of each value."""
    rows = V.claims(spark, d).select((F.col("service_minutes") / 50).alias("ml_probability"), (F.col("order_id") * 7 % 53 < F.col("service_minutes")).cast("int").alias("label"))
    out = M.calibrated(rows, M.fit_isotonic(rows))
    return out.groupBy("ml_probability").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("calibrated_probability")).alias("calibrated"))


# The least of the means of what follows, over the greatest of where they begin: the isotonic value of each score.
M04 = f"""{V.with_views('claims')}, s AS (SELECT service_minutes / 50 AS p, count(*) AS n, sum(CASE WHEN order_id * 7 % 53 < service_minutes THEN 1 ELSE 0 END) AS y FROM claims GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY p) AS cn, sum(y) OVER (ORDER BY p) AS cy FROM s),
 w AS (SELECT a.p AS lo, b.p AS hi, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.p <= b.p), f AS (SELECT s.p, s.n, lo, min(m) AS v FROM s JOIN w ON lo <= s.p AND s.p <= hi GROUP BY 1, 2, 3) SELECT p AS ml_probability, n, {R6('max(v)')} AS calibrated FROM f GROUP BY 1, 2"""


def m03(spark, d):
    """Out-of-fold, calibrated scores of all claims: rows and bounds by fold."""
    m, c = _matrix(spark, d)
    s = M.claim_scores(m, _labels(c), k=3, rounds=3, depth=3)
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.min("calibrated_probability")).alias("least"), r6(F.max("calibrated_probability")).alias("most"), F.sum("ml_prediction").alias("predicted"))


def m08(spark, d):
    f = X.provider_features(V.claims(spark, d))
    return M.provider_anomaly(f, trees=50).select("provider_id", r6("anomaly_score").alias("anomaly_score"), r6("anomaly_percentile").alias("anomaly_percentile"), "anomaly_flag")


def _future(spark, d):
    c = event_claims(spark, d)
    labels = c.select("claim_id", (F.col("paid_amount") > 30).cast("int").alias("is_suspicious"))
    bad = c.where("provider_id % 3 = 0").select("provider_id").distinct()
    return c, labels, bad


def m09(spark, d):
    return M.future_targets(*_future(spark, d), ["2024-01-10", "2024-01-20"], (3, 5)).withColumn("target", F.col("target").cast("int"))


M09 = """WITH c AS (SELECT user_id AS provider_id, CAST(ts AS DATE) AS day, round(value * 100) / 100 > 30 AS sus FROM events), g AS (SELECT CAST(s AS DATE) AS snapshot, h AS horizon FROM (VALUES ('2024-01-10'), ('2024-01-20')) a(s) CROSS JOIN (VALUES (3), (5)) b(h)), p AS (SELECT DISTINCT provider_id FROM c)
 SELECT provider_id, snapshot, horizon, CASE WHEN provider_id % 3 <> 0 THEN 0 WHEN EXISTS (SELECT 1 FROM c WHERE c.provider_id = p.provider_id AND sus AND day > snapshot AND day - snapshot <= horizon) THEN 1 END AS target FROM p CROSS JOIN g"""


def m10(spark, d):
    panel = M.snapshot_panel(event_claims(spark, d).withColumn("billed_amount", F.col("service_minutes")), ["2024-01-10", "2024-01-20"])
    return panel.select("snapshot", "provider_id", "total_claims", "active_days", r6("median_paid").alias("median_paid"))


M10 = f"""WITH e AS (SELECT user_id AS provider_id, CAST(ts AS DATE) AS day, round(value * 100) / 100 AS paid FROM events), s AS (SELECT DATE '2024-01-10' AS snapshot UNION ALL SELECT DATE '2024-01-20')
 SELECT snapshot, provider_id, CAST(count(*) AS DOUBLE) AS total_claims, CAST(count(DISTINCT day) AS DOUBLE) AS active_days, {R6('median(paid)')} AS median_paid FROM e JOIN s ON day <= snapshot GROUP BY 1, 2"""


def m14(spark, d):
    """Baselines: claims by amount and by a hash."""
    from claimsieve.operators.evaluation import random_scores, ranking_metrics

    c = event_claims(spark, d).select(F.col("claim_id").alias("id"), F.col("paid_amount").alias("score"), (F.col("provider_id") % 5 == 0).cast("int").alias("label"))
    a = ranking_metrics(c, (50,)).withColumn("ranker", F.lit("amount"))
    return a.unionByName(ranking_metrics(random_scores(c), (50,)).withColumn("ranker", F.lit("random"))).withColumn("value", r6("value"))


def m06(spark, d):
    """Attributions of one model over all claims: the parts sum to the margin, and the reasons that come first."""
    m, c = _matrix(spark, d)
    rows = M.with_target(m, _labels(c))
    names = ["paid_amount", "service_minutes", "member_total_claims", "dist_member_provider_miles"]
    model = M._model(tuple(names), (), 3, 3, 42).fit(M.weighted(rows))
    out = M.attributions(model, rows, names)
    return out.groupBy("reason_1").agg(F.count(F.lit(1)).alias("n"), F.max((F.abs(F.col("base") + F.col("contribution") - F.col("margin")) > 1e-9).cast("int")).alias("unreconciled"))


def m11(spark, d):
    c = V.claims(spark, d)
    labels = c.select("claim_id", (F.col("service_minutes") >= 49).cast("int").alias("is_suspicious"))
    bad = c.where("provider_id % 4 = 0").select("provider_id").distinct()
    return M.future_risk(c, labels, bad, n=3, rounds=3).select("provider_id", *(r6(f"risk_{h}d").alias(f"risk_{h}d") for h in (30, 60, 90)))


def m12(spark, d):
    """Metrics with each group of columns left out, on the same folds."""
    m, c = _matrix(spark, d)
    rows = M.grouped_folds(M.with_target(m, _labels(c)), 2)
    return M.ablation(rows, {"amounts": ("paid_amount", "billed_amount")}, ("paid_amount", "billed_amount", "member_total_claims"), k=2, rounds=2).select("experiment", "metric", r6("value").alias("value"))


def m07(spark, d):
    """The claim table of seventeen columns: rows and what the parts of it hold, by fold."""
    m, c = _matrix(spark, d)
    t, _ = M.claim_ml_table(m, _labels(c), k=3, rounds=3, depth=3)
    assert len(t.columns) == 17
    return t.groupBy("oof_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("ml_prediction").alias("predicted"), F.countDistinct("top_feature_1").alias("first_reasons"), F.sum((F.col("ml_risk_score") != F.col("ml_probability")).cast("int")).alias("differ"), r6(F.max("top_feature_1_shap")).alias("most"))


def m14b(spark, d):
    """Claims ranked by their amount alone."""
    from claimsieve.operators.evaluation import ranking_metrics

    c = event_claims(spark, d).select(F.col("claim_id").alias("id"), F.col("paid_amount").alias("score"), (F.col("provider_id") % 5 == 0).cast("int").alias("label"))
    return ranking_metrics(c, (10, 50)).withColumn("value", r6("value"))


M14B = "WITH " + ranking_sql("SELECT event_id AS id, round(value * 100) / 100 AS score, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS label FROM events", (10, 50))[2:]


def _entity_labels(spark, d, every=9):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.lit("provider").alias("entity_type"), F.col("s_suppkey").alias("entity_id"), (F.col("s_suppkey") % every == 0).cast("int").alias("is_suspicious"))


def m15(spark, d):
    """Anomaly scores of providers against known ones."""
    a = anomaly(spark, d).select("provider_id", F.col("anomaly_percentile").alias("anomaly_score"), F.col("anomaly_flag").cast("int").alias("anomaly_flag"))
    return M.evaluate_anomaly(a, _entity_labels(spark, d)).withColumn("value", r6("value"))


_ANOMALY = "an AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey % 101 AS DOUBLE) AS score, CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN s_suppkey % 101 >= 95 THEN 1 ELSE 0 END AS flag FROM supplier)"
_COUNTED = f"""SELECT count(*) AS n_providers, sum(label) AS n_suspicious, sum(flag) AS n_flagged, sum(flag * label) AS tp FROM an"""
M15 = f"""WITH {_ANOMALY}, cnt AS ({_COUNTED}), long AS (SELECT unnest([struct_pack(metric := 'n_providers', value := n_providers::DOUBLE), struct_pack(metric := 'n_suspicious', value := n_suspicious::DOUBLE), struct_pack(metric := 'n_flagged', value := n_flagged::DOUBLE), struct_pack(metric := 'n_true_positive_flagged', value := tp::DOUBLE),
  struct_pack(metric := 'n_false_positive_flagged', value := (n_flagged - tp)::DOUBLE), struct_pack(metric := 'flag_precision', value := {R6('coalesce(tp / nullif(n_flagged, 0), 0)')}), struct_pack(metric := 'flag_recall', value := {R6('coalesce(tp / nullif(n_suspicious, 0), 0)')})]) AS m FROM cnt)""" + ranking_sql("SELECT id, score, label FROM an", (5, 10, 25, 50)) + " UNION ALL SELECT m.metric, m.value FROM long"


def m15b(spark, d):
    """Forward risk of providers against known ones, by horizon; providers without a value take no part."""
    return M.evaluate_future(future(spark, d), _entity_labels(spark, d, 4), ks=(5, 25)).withColumn("value", r6("value"))


M15B = " UNION ALL ".join(
    f"SELECT {h} AS horizon, metric, value FROM (WITH " + ranking_sql(f"SELECT CAST(s_suppkey AS VARCHAR) AS id, {v} AS score, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS label FROM supplier WHERE s_suppkey % 3 <> 0{more}", (5, 25))[2:] + ")"
    for h, v, more in ((30, "(s_suppkey % 10) / 10", ""), (60, "(s_suppkey % 7) / 7", " AND s_suppkey % 2 = 0"), (90, "(s_suppkey % 5) / 5", ""))
)


def m16(spark, d):
    """All learning over claims made from events: what the evaluation holds."""
    c = event_claims(spark, d).withColumns({"billed_amount": F.col("service_minutes"), "modifier": F.lit(None).cast("string"), "member_id": F.col("claim_id") % 500})
    known = spark.read.parquet(f"{d}/events.parquet").select(F.lit("provider").alias("entity_type"), F.col("user_id").alias("entity_id"), (F.col("user_id") % 7 == 0).cast("int").alias("is_suspicious")).distinct()
    out = M.run_learning(c, V.providers(spark, d), V.members(spark, d), _labels(c), known, k=2, rounds=2, trees=20, snapshots=2)
    return out["evaluation"].select("part", "metric", r6("value").alias("value"))


ENTRIES = {
    "m04_calibration": (m04, M04),
    "m01_target": (m01, M01), "m02_grouped_folds": (m02, None), "m03_claim_scores": (m03, None), "m08_provider_anomaly": (m08, None), "m09_future_targets": (m09, M09), "m10_snapshot_panel": (m10, M10), "m14_baselines": (m14, None), "m06_attributions": (m06, None), "m11_future_risk": (m11, None), "m12_ablation": (m12, None), "m07_claim_table": (m07, None), "m14_amount": (m14b, M14B), "m15_anomaly_evaluation": (m15, M15), "m15_future_evaluation": (m15b, M15B), "m16_learning_run": (m16, None)}
