"""Risk fusion over signals made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.operators import evaluation as Ev
from claimsieve.operators import risk as U
from claimsieve.plans.storage import materialize
from claimsieve.queries.common import R2, R6, r2, r6
from claimsieve.sources import views as V


def alerts(spark, d):
    """An alert for each claim with a return flag other than N."""
    c = V.claims(spark, d).where("modifier <> 'N'")
    sev = F.when(F.col("service_minutes") >= 45, "CRITICAL").when(F.col("service_minutes") >= 30, "HIGH").when(F.col("service_minutes") >= 15, "MEDIUM").otherwise("LOW")
    return c.select(
        F.concat(F.lit("A-"), "claim_id").alias("alert_id"), F.format_string("R%02d", (F.col("order_id") % 10 + 1).cast("int")).alias("rule_id"), F.lit("provider").alias("entity_type"), F.col("provider_id").cast("string").alias("entity_id"), F.array("claim_id").alias("claim_ids"), sev.alias("severity"),
        F.col("paid_amount").alias("est_dollars"), F.array(F.struct(F.concat(F.lit("Claim "), "claim_id").alias("plain_text"))).alias("evidence"), F.create_map(F.lit("service_date"), F.col("service_date").cast("string")).alias("metadata"),
    )


ALERTS = """alerts AS (SELECT 'A-' || claim_id AS alert_id, 'R' || lpad(CAST(order_id % 10 + 1 AS VARCHAR), 2, '0') AS rule_id, provider_id, claim_id, CASE WHEN service_minutes >= 45 THEN 'CRITICAL' WHEN service_minutes >= 30 THEN 'HIGH' WHEN service_minutes >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity, paid_amount AS est_dollars
 FROM claims WHERE modifier <> 'N')"""


def claim_ml(spark, d):
    return V.claims(spark, d).select("claim_id", "provider_id", (F.col("service_minutes") / 50).alias("ml_probability"), (F.col("service_minutes") / 60).alias("calibrated_probability"))


def anomaly(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("provider_id"), (F.col("s_suppkey") % 101).cast("double").alias("anomaly_percentile"), (F.col("s_suppkey") % 101 >= 95).alias("anomaly_flag"), ((F.col("s_suppkey") % 101) / 200 - 0.2).alias("anomaly_score"))


def future(spark, d):
    x = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 3 <> 0").select(x.alias("provider_id"), ((x % 10) / 10).alias("risk_30d"), F.when(x % 2 == 0, (x % 7) / 7).alias("risk_60d"), ((x % 5) / 5).alias("risk_90d"))


def networks(spark, d):
    """Communities of several sizes: one of all providers with a digit, others of a few, some providers in none."""
    k = F.col("s_suppkey")
    group = F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 1, F.floor(k / 12) + 1)
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(k, group.cast("string").alias("community")).where("community is not null")
    n = rows.groupBy("community").agg(F.collect_list(F.concat(F.lit("provider:"), F.col("s_suppkey").cast("string"))).alias("providers"), F.count(F.lit(1)).alias("size"), F.min("s_suppkey").alias("m"))
    return n.select("community", "providers", "size", F.concat(F.lit("provider:"), F.col("m").cast("string")).alias("hub"), (F.col("m") % 3 * 0.9).alias("hard_links"), (F.col("m") % 8).cast("double").alias("referrals"), ((F.col("m") % 10) / 10).alias("hub_centrality"))


def times(spark, d):
    """Temporal and historical figures of suppliers."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("provider_id"), ((k % 50) / 10).alias("burst_cv"), ((k % 40) / 20 - 0.5).alias("historical_score"))


def signals(spark, d):
    t = times(spark, d).where("provider_id % 7 <> 0")  # some providers have none
    return {"rules": U.rule_signal(alerts(spark, d)), "ml": U.ml_signal(claim_ml(spark, d)), "anomaly": U.anomaly_signal(anomaly(spark, d)), "future": U.future_signal(future(spark, d)), "network": U.network_signal(networks(spark, d)), "temporal": U.temporal_signal(t), "historical": U.historical_signal(t)}


def u01(spark, d):
    return U.rule_signal(alerts(spark, d)).select("provider_id", "alert_count", "high_count", "distinct_rules", F.size("claim_ids").alias("n_claims"), r2("exposure").alias("exposure"), r6("rules_signal").alias("rules_signal"))


_RULES = """rs AS (SELECT CAST(provider_id AS VARCHAR) AS provider_id, count(*) AS alert_count, CAST(sum(CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END) AS BIGINT) AS high_count, count(DISTINCT rule_id) AS distinct_rules, list_sort(list(DISTINCT rule_id)) AS rule_list, CAST(count(DISTINCT claim_id) AS INTEGER) AS n_claims, sum(est_dollars) AS exposure,
 least(1, 0.3 * least(count(*) / 10, 1) + 0.25 * avg(CASE severity WHEN 'LOW' THEN 0.25 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.75 ELSE 1.0 END) + 0.2 * avg(CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1.0 ELSE 0.0 END) + 0.15 * least(count(DISTINCT rule_id) / 5, 1) + 0.1 * least(ln(1 + sum(est_dollars)) / ln(50001), 1)) AS rules_signal FROM alerts GROUP BY 1)"""
U01 = f"{V.with_views('claims')}, {ALERTS}, {_RULES} SELECT provider_id, alert_count, high_count, distinct_rules, n_claims, {R2('exposure')} AS exposure, {R6('rules_signal')} AS rules_signal FROM rs"


def u02(spark, d):
    return U.ml_signal(claim_ml(spark, d)).select("provider_id", "ml_claims", "ml_high_claims", r6("ml_signal").alias("ml_signal"))


_ML = "ms AS (SELECT CAST(provider_id AS VARCHAR) AS provider_id, count(*) AS ml_claims, CAST(sum(CASE WHEN service_minutes / 60 >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS ml_high_claims, 0.6 * avg(CASE WHEN service_minutes / 60 >= 0.5 THEN 1.0 ELSE 0.0 END) + 0.4 * avg(service_minutes / 60) AS ml_signal, avg(CASE WHEN service_minutes / 60 >= 0.5 THEN 1.0 ELSE 0.0 END) AS ml_share, avg(service_minutes / 60) AS ml_mean FROM claims GROUP BY 1)"
U02 = f"{V.with_views('claims')}, {_ML} SELECT provider_id, ml_claims, ml_high_claims, {R6('ml_signal')} AS ml_signal FROM ms"


def u03(spark, d):
    return U.anomaly_signal(anomaly(spark, d)).withColumns({"anomaly_signal": r6("anomaly_signal"), "anomaly_score": r6("anomaly_score")})


_AN = "an AS (SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, least(1, (s_suppkey % 101) / 100) AS anomaly_signal, CAST(s_suppkey % 101 >= 95 AS INTEGER) AS anomaly_flag, CAST(s_suppkey % 101 AS DOUBLE) AS anomaly_percentile, (s_suppkey % 101) / 200 - 0.2 AS anomaly_score FROM supplier)"
U03 = f"WITH {_AN} SELECT provider_id, {R6('anomaly_signal')} AS anomaly_signal, anomaly_flag, anomaly_percentile, {R6('anomaly_score')} AS anomaly_score FROM an"


def u04(spark, d):
    return U.future_signal(future(spark, d)).select("provider_id", r6("future_signal").alias("future_signal"))


_FU = "fu AS (SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 * (s_suppkey % 10) / 10 + 0.3 * (s_suppkey % 7) / 7 + 0.2 * (s_suppkey % 5) / 5 ELSE (0.5 * (s_suppkey % 10) / 10 + 0.2 * (s_suppkey % 5) / 5) / 0.7 END AS future_signal FROM supplier WHERE s_suppkey % 3 <> 0)"
U04 = f"WITH {_FU} SELECT provider_id, {R6('future_signal')} AS future_signal FROM fu"


def u05(spark, d):
    """The network signal of communities of several sizes."""
    return U.network_signal(networks(spark, d)).select("provider_id", "community_id", "is_hub", r6("network_signal").alias("network_signal"), r6("hard_link_score").alias("hard_link_score"), "community_size", r6("hub_centrality").alias("hub_centrality"))


_NT = """nc AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN s_suppkey // 12 + 1 END AS c FROM supplier WHERE s_suppkey % 4 < 2), nz AS (SELECT c, count(*) AS size, min(k) AS m FROM nc GROUP BY 1),
 nt AS (SELECT CAST(k AS VARCHAR) AS provider_id, CAST(c AS VARCHAR) AS community_id, size AS community_size, k = m AS is_hub, least(m % 3 * 0.9 / size, 1) AS hard_link_score, (m % 10) / 10 * CASE WHEN k = m THEN 1 ELSE 0.5 END AS hub_centrality,
  least(0.35 * least(m % 3 * 0.9 / size, 1) + 0.25 * least((m % 8) / (5 * size), 1) + 0.2 * (m % 10) / 10 + 0.2 * least(size / 15, 1), 1) AS network_signal FROM nc JOIN nz USING (c))"""
U05 = f"WITH {_NT} SELECT provider_id, community_id, is_hub, {R6('network_signal')} AS network_signal, {R6('hard_link_score')} AS hard_link_score, community_size, {R6('hub_centrality')} AS hub_centrality FROM nt"


def u06(spark, d):
    """Temporal and historical signals made from all suppliers' numbers."""
    t = times(spark, d)
    return U.temporal_signal(t).join(U.historical_signal(t), "provider_id").select("provider_id", r6("temporal_signal").alias("temporal_signal"), r6("historical_signal").alias("historical_signal"))


U06 = f"SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, {R6('least((s_suppkey % 50) / 10 / 3, 1)')} AS temporal_signal, {R6('least(greatest((s_suppkey % 40) / 20 - 0.5, 0), 1)')} AS historical_signal FROM supplier"
_TM = "tm AS (SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, least((s_suppkey % 50) / 10 / 3, 1) AS temporal_signal, least(greatest((s_suppkey % 40) / 20 - 0.5, 0), 1) AS historical_signal FROM supplier WHERE s_suppkey % 7 <> 0)"


def fused(spark, d):
    return U.fuse(signals(spark, d))


def u08(spark, d):
    out = fused(spark, d)
    total = sum(F.col(f"{f}_contribution") for f in U.FAMILIES)
    return out.select("provider_id", r6("available_weight").alias("available_weight"), F.col("risk_score").alias("score"), (F.abs(total - F.col("risk_score")) < 1e-6).alias("reconciled"))


def u13(spark, d):
    """The whole score table but for nested columns."""
    return fused(spark, d).select("provider_id", "risk_score", *(f"{f}_contribution" for f in U.FAMILIES), "evidence_strength", "confidence", "active_families", "risk_tier", "evidence_tier", "confidence_tier", F.array_join("reasons", "; ").alias("reasons"))


def u14(spark, d):
    rows = materialize(fused(spark, d).select("provider_id", "risk_score"), "scores").select(F.col("provider_id").alias("id"), F.col("risk_score").alias("score"), (F.col("provider_id").cast("int") % 9 == 0).cast("int").alias("label"))
    return Ev.ranking_metrics(rows, (10, 25, 2000)).withColumn("value", r6("value"))


def m13(spark, d):
    """Ranking metrics of document length against the toxic label, whole tables."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))
    return Ev.ranking_metrics(rows, (10, 50)).withColumn("value", r6("value"))


M13 = f"""WITH x AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents JOIN labels USING (doc_id)), t AS (SELECT count(*) AS n, sum(label) AS p FROM x),
 r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM x), g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM x GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM g),
 k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS o FROM x), h AS (SELECT 10 AS kk, sum(label) AS hits FROM k WHERE o <= 10 UNION ALL SELECT 50, sum(label) FROM k WHERE o <= 50)
 SELECT 'roc_auc' AS metric, {R6('(SELECT sum(ar) FROM r WHERE label = 1) - p * (p + 1) / 2').replace('* 1e6) / 1e6', '/ (p * (n - p)) * 1e6) / 1e6')} AS value FROM t UNION ALL SELECT 'average_precision', {R6('(SELECT sum(pos * prec) FROM c) / p')} FROM t UNION ALL SELECT 'base_rate', {R6('p / n')} FROM t
 UNION ALL SELECT 'precision_at_' || kk, {R6('hits / least(kk, n)')} FROM h CROSS JOIN t UNION ALL SELECT 'recall_at_' || kk, {R6('hits / p')} FROM h CROSS JOIN t UNION ALL SELECT 'lift_at_' || kk, {R6('hits / least(kk, n) / (p / n)')} FROM h CROSS JOIN t"""


def _probabilities(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet")
    return e.select((F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def m05(spark, d):
    return Ev.reliability(_probabilities(spark, d)).select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


M05 = f"WITH x AS (SELECT l_quantity / 50 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {R6('avg(p)')} AS mean_p, {R6('avg(y)')} AS rate FROM x GROUP BY 1"


def m05b(spark, d):
    return Ev.calibration_metrics(_probabilities(spark, d)).select(r6("ece").alias("ece"), r6("mce").alias("mce"), r6("brier").alias("brier"), r6("log_loss").alias("log_loss"))


M05B = f"""WITH x AS (SELECT l_quantity / 50 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM x GROUP BY 1)
 SELECT (SELECT {R6('sum(gap * n) / sum(n)')} FROM b) AS ece, (SELECT {R6('max(gap)')} FROM b) AS mce, {R6('avg((p - y) * (p - y))')} AS brier, {R6('avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END)')} AS log_loss FROM x"""


def _truth(spark, d):
    c = V.claims(spark, d)
    return c.select(F.format_string("R%02d", (F.col("order_id") % 10 + 1).cast("int")).alias("rule_id"), "claim_id", (F.col("service_minutes") >= 40).alias("is_fraud"))


def v02(spark, d):
    return Ev.claim_quality(alerts(spark, d), _truth(spark, d)).select("rule_id", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


V02 = f"""{V.with_views('claims')}, x AS (SELECT 'R' || lpad(CAST(order_id % 10 + 1 AS VARCHAR), 2, '0') AS rule_id, modifier <> 'N' AS g, service_minutes >= 40 AS b FROM claims), s AS (SELECT rule_id, count(*) FILTER (WHERE g AND b) AS tp, count(*) FILTER (WHERE g AND NOT b) AS fp, count(*) FILTER (WHERE NOT g AND b) AS fn FROM x GROUP BY 1)
 SELECT rule_id, tp, fp, fn, {R6('tp / (tp + fp)')} AS precision, {R6('tp / (tp + fn)')} AS recall, {R6('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))')} AS f1 FROM s"""


def v02b(spark, d):
    return Ev.severity_distribution(alerts(spark, d)).select("rule_id", "severity", "n", r2("dollars").alias("dollars"))


V02B = f"{V.with_views('claims')}, {ALERTS} SELECT rule_id, severity, count(*) AS n, {R2('sum(est_dollars)')} AS dollars FROM alerts GROUP BY 1, 2"


def v01(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").groupBy((F.col("s_suppkey") % 10).alias("k")).agg(F.array_join(F.sort_array(F.collect_list(F.col("s_suppkey").cast("string"))), ",").alias("provider_ids"))
    scen = s.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("scenario_id"), "provider_ids", F.format_string("R%02d,R10", (F.col("k") + 1).cast("int")).alias("expected_rules"))
    out = Ev.rule_quality(alerts(spark, d).where("severity = 'CRITICAL'"), scen, None)
    return out.select("rule_id", "alerts", "entities", "tp", "fp", "expected", "scenarios", "scenarios_found", r2("exposure").alias("exposure"), r6("precision").alias("precision"), r6("recall").alias("recall"))


V01 = f"""{V.with_views('claims')}, {ALERTS}, want AS (SELECT DISTINCT 'S' || (s_suppkey % 10) AS sc, r AS rule_id, s_suppkey AS p FROM supplier CROSS JOIN LATERAL (SELECT unnest(['R' || lpad(CAST(s_suppkey % 10 + 1 AS VARCHAR), 2, '0'), 'R10']) AS r)),
 got AS (SELECT rule_id, provider_id AS p, count(*) AS n, sum(est_dollars) AS e FROM alerts WHERE severity = 'CRITICAL' GROUP BY 1, 2), ex AS (SELECT rule_id, count(DISTINCT p) AS expected, count(DISTINCT sc) AS scenarios FROM want GROUP BY 1),
 h AS (SELECT got.*, EXISTS (SELECT 1 FROM want w WHERE w.rule_id = got.rule_id AND w.p = got.p) AS hit FROM got), s AS (SELECT rule_id, CAST(sum(n) AS BIGINT) AS alerts, count(*) AS entities, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS tp, sum(e) AS exposure FROM h GROUP BY 1),
 f AS (SELECT got.rule_id, count(DISTINCT sc) AS scenarios_found FROM got JOIN want w ON w.rule_id = got.rule_id AND w.p = got.p GROUP BY 1)
 SELECT rule_id, coalesce(alerts, 0) AS alerts, coalesce(entities, 0) AS entities, coalesce(tp, 0) AS tp, coalesce(entities - tp, 0) AS fp, coalesce(expected, 0) AS expected, coalesce(scenarios, 0) AS scenarios, coalesce(scenarios_found, 0) AS scenarios_found, {R2('coalesce(exposure, 0)')} AS exposure, {R6('coalesce(tp / entities, 0)')} AS precision, {R6('coalesce(tp / expected, 0)')} AS recall
 FROM s FULL JOIN ex USING (rule_id) LEFT JOIN f USING (rule_id)"""


def v03(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rings = s.where("s_suppkey % 4 = 0").select((F.col("s_suppkey") % 12).cast("string").alias("ring_id"), F.col("s_suppkey").cast("string").alias("provider"))
    m = s.select(F.col("s_suppkey").cast("string").alias("provider"), (F.col("s_suppkey") % 9).cast("string").alias("community"))
    return Ev.ring_recovery(rings, m).withColumn("recovery", r6("recovery"))


V03 = f"""WITH ring AS (SELECT CAST(s_suppkey % 12 AS VARCHAR) AS ring_id, s_suppkey AS p FROM supplier WHERE s_suppkey % 4 = 0), m AS (SELECT s_suppkey AS p, CAST(s_suppkey % 9 AS VARCHAR) AS community FROM supplier), z AS (SELECT community, count(*) AS community_size FROM m GROUP BY 1), t AS (SELECT ring_id, count(*) AS ring_size FROM ring GROUP BY 1),
 o AS (SELECT ring_id, community, count(*) AS overlap, count(*) OVER (PARTITION BY ring_id) AS n_communities, row_number() OVER (PARTITION BY ring_id ORDER BY count(*) DESC, community) AS k FROM ring JOIN m USING (p) GROUP BY 1, 2)
 SELECT ring_id, ring_size, community, overlap, community_size, n_communities, {R6('overlap / ring_size')} AS recovery, n_communities = 1 AND overlap = ring_size AS one_community, community_size - overlap AS false_members FROM t JOIN o USING (ring_id) JOIN z USING (community) WHERE k = 1"""

# The score table as its definition has it: weights go to the families that are there, contributions sum to the score.
_F = ("rules", "ml", "anomaly", "network", "temporal", "future", "historical")
_W = {"rules": 0.25, "ml": 0.25, "anomaly": 0.15, "network": 0.2, "temporal": 0.05, "future": 0.1, "historical": 0.0}
_CLIP = "least(greatest({}, 0.0), 1.0)"
# As the operators add: decimals, so that the sum does not depend on the order of rows.
_RULES_EXACT = _RULES.replace("sum(est_dollars)", "CAST(sum(CAST(est_dollars AS DECIMAL(24, 6))) AS DOUBLE)")
_ML_EXACT = _ML.replace("avg(service_minutes / 60)", "CAST(sum(CAST(service_minutes / 60 AS DECIMAL(24, 12))) AS DOUBLE) / count(*)")


def _places(x: str, n: int) -> str:
    """Rounded as ``columns.places`` does: halves up."""
    return f"floor(({x}) * 1e{n} + (0.5 + 1e-7::DOUBLE)) / 1e{n}"


def _tiers(x: str, cuts: tuple[float, ...], names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {c} THEN '{n}'" for c, n in reversed(list(zip(cuts, names[1:])))) + f" ELSE '{names[0]}' END"


FUTURE_COLUMNS = "fc AS (SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, (s_suppkey % 10) / 10 AS risk_30d, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7) / 7 END AS risk_60d, (s_suppkey % 5) / 5 AS risk_90d FROM supplier WHERE s_suppkey % 3 <> 0)"
_PARTS = ", ".join(f"CASE WHEN {f}_signal IS NULL THEN 0.0 ELSE {_CLIP.format(f + '_signal')} * {_W[f]} / aw END AS part_{f}" for f in _F)
_ROUNDED = ", ".join(f"{_places(f'part_{f}', 4)} AS raw_{f}" for f in _F)
_MOST = "greatest(" + ", ".join(f"raw_{f}" for f in _F) + ")"
_WHICH = "CASE " + " ".join(f"WHEN raw_{f} = {_MOST} THEN '{f}'" for f in _F) + " END"
_GIVEN = ", ".join(f"round(raw_{f} + CASE WHEN {_WHICH} = '{f}' THEN rest ELSE 0.0 END, 4) AS {f}_contribution" for f in _F)
_PRESENT = " + ".join(f"CASE WHEN {f}_signal IS NULL THEN 0 ELSE 1 END" for f in _F)
_ACTIVE = " + ".join(f"CASE WHEN coalesce({f}_signal, 0) >= 0.2 THEN 1 ELSE 0 END" for f in _F if f != "historical")
_TOTAL = " + ".join(f"coalesce({f}_signal, 0)" for f in _F)
_SPREAD = " + ".join(f"CASE WHEN {f}_signal IS NULL THEN 0.0 ELSE ({f}_signal - mean) * ({f}_signal - mean) END" for f in _F)
# Texts by the conditions of each family, in this order where contributions are equal.
_SAID = {
    "rules": "CASE WHEN high_count >= 2 THEN 'Multiple high-severity billing rule alerts (' || high_count || ' alerts, $' || format('{:,.0f}', exposure) || ' est. exposure)' WHEN distinct_rules >= 2 THEN 'Triggered multiple detection rules (' || array_to_string(rule_list[1:3], ', ') || ')' WHEN alert_count > 0 THEN 'Billing anomalies detected (' || alert_count || ' alert(s), $' || format('{:,.0f}', exposure) || ' est. exposure)' END",
    "ml": "CASE WHEN ml_share >= 0.25 AND ml_high_claims >= 3 THEN 'High concentration of suspicious claims (' || format('{:,.1f}', 100 * ml_share) || '% rate, ' || ml_high_claims || ' flagged claims)' ELSE 'Elevated claim-level ML risk score (mean calibrated probability: ' || format('{:,.2f}', ml_mean) || ')' END",
    "network": "CASE WHEN hard_link_score >= 0.5 THEN 'Hard identity links with affiliated entities (shared bank/TIN/owner overlap)' WHEN is_hub THEN 'Central hub provider in multi-provider network (Community #' || community_id || ', ' || community_size || ' providers)' WHEN community_size >= 2 THEN 'Connected to elevated-risk provider community (Community #' || community_id || ', ' || community_size || ' providers)' END",
    "anomaly": "CASE WHEN anomaly_percentile >= 90 OR anomaly_flag = 1 THEN 'Statistically anomalous macro billing behavior (' || format('{:,.0f}', anomaly_percentile) || 'th percentile among peer providers)' ELSE 'Elevated behavioral anomaly profile compared to peer specialty baseline' END",
    "future": "'Elevated near-term forward risk forecast (' || format('{:,.2f}', coalesce(risk_30d, 0.0)) || ' 30-day forecast probability)'",
    "temporal": "'Billing volume surge / velocity spike exceeding historical baseline'",
}
_ITEMS = ", ".join(f"CASE WHEN {f}_contribution > {0.01 if f == 'temporal' else 0.02} AND ({t}) IS NOT NULL THEN struct_pack(c := -{f}_contribution, i := {i}, t := {t}) END" for i, (f, t) in enumerate(_SAID.items()))
_STRENGTH = """least(0.2 * least(active_families / 3, 1) + 0.3 * (0.4 * least(coalesce(distinct_rules, 0) / 3, 1) + 0.35 * least(coalesce(high_count, 0) / 3, 1) + 0.25 * least(ln(1 + greatest(coalesce(exposure, 0), 0)) / ln(50001), 1)) + 0.25 * least(coalesce(union_claims, 0) / 15, 1)
   + 0.25 * least(0.6 * coalesce(hard_link_score, 0) + 0.4 * least(coalesce(community_size, 0) / 10, 1), 1), 1.0)"""
_SURE = "least(0.6 * aw + 0.25 * CASE WHEN present >= 2 THEN greatest(0.0, 1 - 2 * std) ELSE 0.5 END + 0.15 * CASE WHEN coalesce(ml_high_claims, 0) + coalesce(n_claims, 0) > 0 THEN least((coalesce(ml_high_claims, 0) + coalesce(n_claims, 0)) / 50, 1) ELSE 0.4 END, 1.0)"
SCORES = f"""{V.with_views('claims')}, {ALERTS}, {_RULES_EXACT}, {_ML_EXACT}, {_AN}, {_FU}, {_NT}, {_TM}, {FUTURE_COLUMNS},
 both_claims AS (SELECT provider_id, count(*) AS union_claims FROM (SELECT CAST(provider_id AS VARCHAR) AS provider_id, claim_id FROM alerts UNION SELECT CAST(provider_id AS VARCHAR), claim_id FROM claims WHERE service_minutes / 60 >= 0.5) GROUP BY 1),
 g00 AS (SELECT * FROM rs FULL JOIN ms USING (provider_id) FULL JOIN an USING (provider_id) FULL JOIN fu USING (provider_id) FULL JOIN nt USING (provider_id) FULL JOIN tm USING (provider_id) FULL JOIN fc USING (provider_id) LEFT JOIN both_claims USING (provider_id)),
 gn AS (SELECT * REPLACE (coalesce(network_signal, 0.0) AS network_signal) FROM g00),
 g0 AS (SELECT *, {" + ".join(f"CASE WHEN {f}_signal IS NULL THEN 0.0 ELSE {_W[f]} END" for f in _F)} AS aw, {_PRESENT} AS present FROM gn),
 g1 AS (SELECT *, {_PARTS}, ({_TOTAL}) / present AS mean FROM g0), g2 AS (SELECT *, {_ROUNDED}, {_places(f"least({' + '.join(f'part_{f}' for f in _F)}, 1.0)", 4)} AS risk_score, sqrt(({_SPREAD}) / present) AS std, {_ACTIVE} AS active_families FROM g1),
 g3 AS (SELECT *, round(risk_score - ({" + ".join(f"raw_{f}" for f in _F)}), 4) AS rest FROM g2),
 g4 AS (SELECT *, {_GIVEN}, {_places(_STRENGTH, 4)} AS evidence_strength, {_places(_SURE, 4)} AS confidence FROM g3),
 g5 AS (SELECT *, [x.t for x in list_sort([x for x in [{_ITEMS}] if x IS NOT NULL])[1:4]] AS drivers FROM g4),
 scores AS (SELECT *, {_tiers('risk_score', (0.25, 0.5, 0.75), ('LOW', 'MODERATE', 'HIGH', 'CRITICAL'))} AS risk_tier, {_tiers('evidence_strength', (0.25, 0.5, 0.75), ('LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'))} AS evidence_tier, {_tiers('confidence', (0.4, 0.7), ('LOW', 'MEDIUM', 'HIGH'))} AS confidence_tier,
  CASE WHEN len(drivers) > 0 THEN array_to_string(drivers, '; ') ELSE 'Baseline risk profile with no elevated indicators' END AS reasons FROM g5)"""
U08 = f"{SCORES} SELECT provider_id, {R6('aw')} AS available_weight, risk_score AS score, true AS reconciled FROM scores"
U13 = f"""{SCORES} SELECT provider_id, risk_score, {", ".join(f"{f}_contribution" for f in _F)}, evidence_strength, confidence, active_families, risk_tier, evidence_tier, confidence_tier, reasons FROM scores"""


def ranking_sql(rows: str, ks: tuple[int, ...]) -> str:
    """Ranking metrics of ``rows``, a query of (id, score, label), to put behind other CTEs (starts with a comma)."""
    tops = " UNION ALL ".join(f"SELECT {k} AS kk, sum(label) AS hits FROM k WHERE o <= {k}" for k in ks)
    return f""", x AS ({rows}), t AS (SELECT count(*) AS n, sum(label) AS p FROM x), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM x),
 gs AS (SELECT score, count(*) AS n, sum(label) AS pos FROM x GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM gs), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS o FROM x), h AS ({tops})
 SELECT 'roc_auc' AS metric, round(((SELECT sum(ar) FROM r WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)) * 1e6) / 1e6 AS value FROM t UNION ALL SELECT 'average_precision', {R6('(SELECT sum(pos * prec) FROM c) / p')} FROM t UNION ALL SELECT 'base_rate', {R6('p / n')} FROM t
 UNION ALL SELECT 'precision_at_' || kk, {R6('hits / least(kk, n)')} FROM h CROSS JOIN t UNION ALL SELECT 'recall_at_' || kk, {R6('hits / p')} FROM h CROSS JOIN t UNION ALL SELECT 'lift_at_' || kk, {R6('hits / least(kk, n) / (p / n)')} FROM h CROSS JOIN t"""


U14 = SCORES + ranking_sql("SELECT provider_id AS id, risk_score AS score, CASE WHEN CAST(provider_id AS INTEGER) % 9 = 0 THEN 1 ELSE 0 END AS label FROM scores", (10, 25, 2000))
ENTRIES = {
    "u01_rule_signal": (u01, U01), "u02_ml_signal": (u02, U02), "u03_anomaly_signal": (u03, U03), "u04_future_signal": (u04, U04), "u05_network_signal": (u05, U05), "u06_time_and_record": (u06, U06), "u08_fused_score": (u08, U08), "u13_score_table": (u13, U13), "u14_prioritisation": (u14, U14),
    "m13_ranking_metrics": (m13, M13), "m05_reliability": (m05, M05), "m05_calibration": (m05b, M05B), "v01_rule_quality": (v01, V01), "v02_claim_quality": (v02, V02), "v02_severities": (v02b, V02B), "v03_ring_recovery": (v03, V03),
}
