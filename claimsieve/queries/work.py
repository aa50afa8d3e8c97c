"""Cases, the work queue, investigator queries and table handling over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimsieve.functions import columns as C
from claimsieve.functions.columns import PROHIBITED
from claimsieve.operators import cases as K
from claimsieve.operators import evaluation as Ev
from claimsieve.operators import investigate as Q
from claimsieve.plans.storage import materialize, new_path
from claimsieve.queries.common import R2, R6, r2, r6
from claimsieve.queries.risk import ALERTS, SCORES, V02, V02B, _places, alerts, fused
from claimsieve.sources import publish as P
from claimsieve.sources import tables as T
from claimsieve.sources import views as V
from claimsieve.sources.config import CaseConfig, QueueConfig


def _scores(spark, d):
    return materialize(fused(spark, d), "scores")


def _cases(spark, d):
    return materialize(K.build_cases(_scores(spark, d), CaseConfig(all_providers=True)), "cases")


#: Claims and alerts of a case. Queries of the queue and of figures read none of them, so they are not written again and again.
_LISTS = ("claim_ids", "ml_claim_ids", "alert_ids", "case_claims", "case_alerts")


def _figures(spark, d):
    """The cases without their lists; ``claim_count`` and ``alert_count`` stay."""
    return materialize(K.build_cases(_scores(spark, d), CaseConfig(all_providers=True)).drop(*_LISTS), "cases")


def _queued(cases):
    return materialize(K.build_queue(cases).drop(*_LISTS), "queue")


def _queue(spark, d):
    return _queued(_figures(spark, d))


def k01(spark, d):
    """Eligibility and case build."""
    return K.build_cases(_scores(spark, d), CaseConfig(min_risk=0.3, min_evidence=0.7)).select("case_id", "provider_id", "risk_score", "priority", "status", F.array_join("families", ",").alias("families"), "title", "summary", "claim_count", r2("estimated_exposure").alias("estimated_exposure"), F.array_join("recommendations", "; ").alias("recommendations"))


_THERE = {"rules": "rules_signal > 0 OR alert_count > 0", "ml": "ml_signal > 0 OR ml_high_claims > 0", "anomaly": "anomaly_signal > 0 OR anomaly_flag > 0", "network": "network_signal > 0 OR community_id IS NOT NULL", "future_risk": "future_signal > 0", "temporal": "temporal_signal > 0"}
_FAMILIES = "[x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _THERE.items()) + "] if x IS NOT NULL]"
_ADVICE = ", ".join(f"CASE WHEN list_contains(rule_list, '{r}') THEN '{t}' END" for r, t in K.ADVICE.items())
_SAID = f"""[x for x in [{_ADVICE}, CASE WHEN ml_high_claims > 0 THEN 'Conduct detailed clinical audit on the ' || ml_high_claims || ' high-risk claims flagged by claim ML.' END,
 CASE WHEN anomaly_flag = 1 THEN 'Examine provider''s billing composition and procedure diversity compared to peer specialty baseline.' END, CASE WHEN risk_30d >= 0.3 THEN 'Institute prospective pre-payment claim review and enhanced monitoring on upcoming submissions.' END,
 CASE WHEN community_id IS NOT NULL THEN 'Review affiliated providers in Community #' || community_id || ' to evaluate potential coordinated ring activity.' END] if x IS NOT NULL]"""
_CASE = f"""'CASE-' || lpad(CAST(case_rank AS VARCHAR), 6, '0') AS case_id, {_FAMILIES} AS families, CASE risk_tier WHEN 'MODERATE' THEN 'MEDIUM' ELSE risk_tier END AS priority, coalesce(exposure, 0) AS estimated_exposure, CAST(coalesce(union_claims, 0) AS INTEGER) AS claim_count"""
_RANK = "row_number() OVER (ORDER BY risk_score DESC, evidence_strength DESC, provider_id) AS case_rank"
_TOPIC = """CASE WHEN list_contains(families, 'network') AND list_contains(families, 'rules') THEN 'Multi-Signal Network & Billing Anomaly' WHEN list_contains(families, 'rules') AND len(families) > 1 THEN 'Consolidated Billing Anomalies'
 WHEN list_contains(families, 'ml') AND list_contains(families, 'anomaly') THEN 'Elevated Claim Risk & Behavioral Outlier' WHEN list_contains(families, 'anomaly') THEN 'Macro Behavioral Billing Anomaly' WHEN list_contains(families, 'network') THEN 'Affiliated Entity Network Anomaly' ELSE 'Prioritized Provider Billing Review' END"""
_SUMMARY = """'Provider ' || provider_id || ' was prioritized for human investigation based on consolidated signals across ' || array_to_string(families, ', ') || '. The unified risk engine assigned a risk score of ' || format('{:.3f}', risk_score) || ' (' || risk_tier || ' tier) with ' || format('{:.3f}', evidence_strength) || ' evidence strength (' || evidence_tier || ') and '
 || format('{:.3f}', confidence) || ' confidence (' || confidence_tier || '). ' || CASE WHEN estimated_exposure > 0 THEN 'Estimated financial exposure identified from supporting evidence is $' || format('{:,.2f}', estimated_exposure) || '.' ELSE 'Direct rule-calculated financial exposure is currently unquantified.' END
 || CASE WHEN coalesce(alert_count, 0) > 0 OR claim_count > 0 THEN ' Investigation package includes ' || coalesce(alert_count, 0) || ' rule alert(s) and ' || claim_count || ' suspicious claim transaction(s).' ELSE '' END || ' Primary investigation drivers: ' || array_to_string([rtrim(x, '.') for x in CASE WHEN len(drivers) > 0 THEN drivers[1:3] ELSE [reasons] END], '; ') || '.'"""
K01 = f"""{SCORES}, o AS (SELECT *, {_RANK} FROM scores WHERE risk_tier <> 'LOW' AND (risk_score >= 0.3 OR evidence_strength >= 0.7)), cases AS (SELECT *, {_CASE}, {_SAID} AS advice FROM o)
 SELECT case_id, provider_id, risk_score, priority, 'NEW' AS status, array_to_string(families, ',') AS families, 'Provider ' || provider_id || ' — ' || {_TOPIC} AS title, {_SUMMARY} AS summary, claim_count, {R2('estimated_exposure')} AS estimated_exposure,
 CASE WHEN len(advice) > 0 THEN array_to_string(advice[1:6], '; ') ELSE 'Review supporting claim documentation and provider billing history.' END AS recommendations FROM cases"""
#: A case for each provider.
CASES = f"{SCORES}, o AS (SELECT *, {_RANK} FROM scores), cases AS (SELECT *, {_CASE} FROM o)"
_QW = {"risk": 0.35, "evidence": 0.20, "exposure": 0.15, "network": 0.10, "anomaly": 0.05, "future": 0.10, "behaviour": 0.05}
_QTOTAL = " + ".join(f"coalesce(q_{k}, 0.0) * {w}" for k, w in _QW.items())
_QWEIGHT = " + ".join(f"CASE WHEN q_{k} IS NULL THEN 0.0 ELSE {w} END" for k, w in _QW.items())
# Signals from the figures of the case; those of network and behaviour are NULL where it has none.
_QITEMS = """CASE WHEN risk_score >= 0.4 THEN struct_pack(w := -0.95, i := 0, t := 'High unified risk prioritization score (' || format('{:.3f}', risk_score) || ')') WHEN risk_score >= 0.25 THEN struct_pack(w := -0.75, i := 1, t := 'Elevated unified risk prioritization score (' || format('{:.3f}', risk_score) || ')') END,
 CASE WHEN evidence_strength >= 0.7 THEN struct_pack(w := -0.9, i := 2, t := 'High supporting evidence strength (' || format('{:.3f}', evidence_strength) || ')') WHEN evidence_strength >= 0.5 THEN struct_pack(w := -0.7, i := 3, t := 'Substantial corroborating evidence strength (' || format('{:.3f}', evidence_strength) || ')') END,
 CASE WHEN estimated_exposure >= 50000 THEN struct_pack(w := -0.85, i := 4, t := 'High estimated financial exposure ($' || format('{:,.2f}', estimated_exposure) || ')') WHEN estimated_exposure >= 5000 THEN struct_pack(w := -0.65, i := 5, t := 'Identified financial exposure ($' || format('{:,.2f}', estimated_exposure) || ')') END,
 CASE WHEN community_id IS NOT NULL THEN struct_pack(w := -0.8, i := 6, t := 'Affiliated with network community #' || community_id) END, CASE WHEN anomaly_flag = 1 OR q_anomaly >= 0.6 THEN struct_pack(w := -0.75, i := 7, t := 'Statistical behavioral billing anomaly flagged') END,
 CASE WHEN q_future >= 0.05 THEN struct_pack(w := -0.7, i := 8, t := 'Elevated future risk trajectory (' || format('{:.3f}', q_future) || ')') END,
 CASE WHEN ml_high_claims >= 20 THEN struct_pack(w := -0.82, i := 9, t := 'Concentrated high-risk claim transactions (' || ml_high_claims || ' claims)') WHEN ml_high_claims > 0 THEN struct_pack(w := -0.6, i := 10, t := 'Contains ' || ml_high_claims || ' flagged high-risk claim(s)') END,
 CASE WHEN distinct_rules >= 3 THEN struct_pack(w := -0.78, i := 11, t := 'Triggered multiple independent detection rules (' || distinct_rules || ' rules, ' || alert_count || ' alerts)') WHEN alert_count >= 5 THEN struct_pack(w := -0.65, i := 12, t := 'Multiple detection rule alerts (' || alert_count || ' alerts)') END"""
QUEUE = f"""{CASES}, lim AS (SELECT min(ln(1 + greatest(estimated_exposure, 0))) AS lo, max(ln(1 + greatest(estimated_exposure, 0))) AS hi FROM cases),
 q0 AS (SELECT cases.*, risk_score AS q_risk, evidence_strength AS q_evidence, CASE WHEN hi > lo THEN (ln(1 + greatest(estimated_exposure, 0)) - lo) / (hi - lo) ELSE least(ln(1 + greatest(estimated_exposure, 0)) / ln(100001), 1) END AS q_exposure, CASE WHEN community_id IS NOT NULL THEN 0.3 END::DOUBLE AS q_network,
  CASE WHEN coalesce(anomaly_flag, 0) = 1 THEN 0.6 + 0.4 * least(greatest(coalesce(anomaly_score, 0), 0) / 0.35, 1) WHEN coalesce(anomaly_score, 0) > 0 THEN least(0.5, 0.5 * anomaly_score / 0.35) ELSE greatest(0, least(0.2, (coalesce(anomaly_score, 0) + 0.1) / 0.2 * 0.2)) END::DOUBLE AS q_anomaly,
  greatest(coalesce(risk_30d, 0), coalesce(risk_60d, 0), coalesce(risk_90d, 0)) AS q_future, CASE WHEN claim_count > 0 OR alert_count > 0 THEN 0.35 * CASE WHEN claim_count > 0 THEN least(coalesce(ml_high_claims, 0) / claim_count, 1) ELSE 0 END + 0.25 * least(coalesce(alert_count, 0) / 10, 1)
   + 0.2 * CASE WHEN alert_count > 0 THEN least(high_count / alert_count, 1) ELSE 0 END + 0.2 * least(coalesce(distinct_rules, 0) / 5, 1) END AS q_behaviour FROM cases CROSS JOIN lim),
 q1 AS (SELECT *, {_places(f"({_QTOTAL}) / ({_QWEIGHT})", 9)} AS priority_score, [x.t for x in list_sort([x for x in [{_QITEMS}] if x IS NOT NULL])[1:5]] AS why FROM q0),
 q2 AS (SELECT *, CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') ELSE 'Prioritized for investigation based on consolidated risk signals' END AS queue_reasons, CASE WHEN priority_score >= 0.8 THEN 'CRITICAL' WHEN priority_score >= 0.6 THEN 'HIGH' WHEN priority_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS priority_tier,
  CAST(row_number() OVER (ORDER BY priority_score DESC, risk_score DESC, evidence_strength DESC, estimated_exposure DESC, case_id) AS INTEGER) AS queue_rank FROM q1),
 queue AS (SELECT *, 'SIU-' || lpad(CAST(queue_rank AS VARCHAR), 6, '0') AS queue_id, CASE WHEN queue_rank <= 20 THEN 'QUEUED' ELSE 'DEFERRED' END AS queue_status FROM q2)"""
K05 = f"{QUEUE} SELECT case_id, provider_id, " + ", ".join(f"{R6('q_' + k)} AS q_{k}" for k in _QW) + f", {R6('priority_score')} AS priority_score, priority_tier, queue_reasons AS reasons FROM queue"
K06 = f"{QUEUE} SELECT queue_id, case_id, queue_rank, queue_status, priority_tier, {R6('priority_score')} AS priority_score FROM queue"
_MEANS = f"count(*) AS n, {R6('avg(risk_score)')} AS mean_risk, {R2('sum(estimated_exposure)')} AS exposure"
K08 = f"{QUEUE} SELECT queue_status AS strategy, {_MEANS} FROM queue GROUP BY 1" + "".join(f" UNION ALL SELECT '{n}', {_MEANS} FROM (SELECT * FROM queue ORDER BY {o} DESC, case_id LIMIT 20)" for n, o in (("top_priority", "priority_score"), ("top_risk", "risk_score"), ("top_exposure", "estimated_exposure")))


def k03(spark, d):
    """Every row of the ledger."""
    return K.case_evidence(_cases(spark, d), alerts(spark, d)).select("case_id", "kind", "source", "claim_id", "rule_id", "description", "severity", r2("amount").alias("amount"))


_CASE_CLAIMS = "cc AS (SELECT CAST(provider_id AS VARCHAR) AS provider_id, claim_id FROM alerts UNION SELECT CAST(provider_id AS VARCHAR), claim_id FROM claims WHERE service_minutes / 60 >= 0.5)"
K03 = f"""{CASES}, {_CASE_CLAIMS}, f AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY claim_id) AS n FROM cc)
 SELECT case_id, 'RULE' AS kind, alert_id AS source, claim_id, rule_id, 'Detection rule ' || rule_id || ' alert (' || severity || ')' AS description, severity, {R2('est_dollars')} AS amount FROM alerts a JOIN cases c ON c.provider_id = CAST(a.provider_id AS VARCHAR)
 UNION ALL SELECT case_id, 'ML', claim_id, claim_id, NULL, 'Suspicious claim transaction flagged by claim-level ML model', CASE WHEN risk_tier IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END, 0.0 FROM f JOIN cases USING (provider_id) WHERE n <= 10
 UNION ALL SELECT case_id, 'ANOMALY', 'ISOLATION_FOREST', NULL, NULL, 'Behavioral anomaly decision score ' || format('{{:.3f}}', anomaly_score), CASE WHEN anomaly_flag = 1 THEN 'HIGH' ELSE 'MEDIUM' END, 0.0 FROM cases WHERE anomaly_flag = 1 OR anomaly_signal >= 0.7
 UNION ALL SELECT case_id, 'NETWORK', 'COMM-' || community_id, NULL, NULL, 'Member of affiliated provider network (Community #' || community_id || ')', 'MEDIUM', 0.0 FROM cases WHERE community_id IS NOT NULL"""


def k05(spark, d):
    q = K.priority(K.queue_signals(_figures(spark, d)))
    return q.select("case_id", "provider_id", *(r6(f"q_{k}").alias(f"q_{k}") for k in QueueConfig().weights), r6("priority_score").alias("priority_score"), "priority_tier", F.array_join("queue_reasons", "; ").alias("reasons"))


def k06(spark, d):
    return _queue(spark, d).select("queue_id", "case_id", "queue_rank", "queue_status", "priority_tier", r6("priority_score").alias("priority_score"))


def k07(spark, d):
    """Each alert lists up to three claims of its provider and order, so that alerts and claims differ in number."""
    c = V.claims(spark, d).where("modifier <> 'N'").groupBy("provider_id", (F.col("order_id") % 40).alias("k")).agg(F.array_sort(F.collect_list("claim_id")).alias("all"), F.sum("paid_amount").alias("est_dollars"))
    a = c.select(F.lit("provider").alias("entity_type"), F.col("provider_id").cast("string").alias("entity_id"), F.slice("all", 1, 3).alias("claim_ids"), r2("est_dollars").alias("est_dollars")).where(F.col("entity_id").cast("int") % 5 != 0)
    out = K.integrated_cases(_scores(spark, d).where("provider_id % 11 <> 0"), a, V.claims(spark, d))
    return out.select("case_id", "risk", "priority", "evidence_strength", "n_alerts", "claims_count", "exposure_low", "exposure_high", "members_affected", "effort_hours", "value_per_hour", r6("queue_priority").alias("queue_priority"), "slot")


K07 = f"""{SCORES}, ka AS (SELECT provider_id, order_id % 40 AS k, round(sum(paid_amount) * 100) / 100 AS e, list_sort(list(claim_id))[1:3] AS l FROM claims WHERE modifier <> 'N' AND provider_id % 5 <> 0 GROUP BY 1, 2), kp AS (SELECT CAST(provider_id AS VARCHAR) AS provider_id, count(*) AS n, sum(e) AS e FROM ka GROUP BY 1),
 kl AS (SELECT DISTINCT CAST(provider_id AS VARCHAR) AS provider_id, unnest(l) AS claim_id FROM ka), km AS (SELECT kl.provider_id, count(DISTINCT kl.claim_id) AS k, count(DISTINCT member_id) AS m FROM kl JOIN claims USING (claim_id) GROUP BY 1),
 x AS (SELECT provider_id, CAST(round(CAST(CAST(100 * risk_score AS VARCHAR) AS DECIMAL(24, 15)), 1) AS DOUBLE) AS risk, CAST(round(CAST(CAST(evidence_strength AS VARCHAR) AS DECIMAL(24, 15)), 3) AS DOUBLE) AS ev, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(k, 0) AS k, coalesce(m, 1) AS m FROM scores LEFT JOIN kp USING (provider_id) LEFT JOIN km USING (provider_id) WHERE CAST(provider_id AS INTEGER) % 11 <> 0),
 y AS (SELECT *, round(0.8 * e, 2) AS lo, round(greatest(1.2 * e, 500), 2) AS hi, round(least(2 + 0.1 * k, 8), 1) AS h, CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM x WHERE risk >= 1 OR n > 0)
 SELECT 'CASE-PRV-' || provider_id AS case_id, risk, tier AS priority, ev AS evidence_strength, n AS n_alerts, k AS claims_count, lo AS exposure_low, hi AS exposure_high, m AS members_affected, h AS effort_hours, round(hi / greatest(h, 1), 2) AS value_per_hour,
 {R6("100 * (0.3 * least(risk / 100, 1) + 0.25 * least(hi / 50000, 1) + 0.15 * least(m / 10, 1) + 0.1 * CASE tier WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END + 0.2 * ev)")} AS queue_priority, CAST(row_number() OVER (ORDER BY risk DESC, provider_id) AS INTEGER) AS slot FROM y"""


def _told(spark, d):
    """Alerts with whole evidence: texts by rule and severity, LOW ones without an amount, R01 without fields, R04 with a note."""
    low, rule = F.col("severity") == "LOW", F.col("rule_id")
    e = F.struct(
        F.concat(F.lit("E-"), "alert_id").alias("evidence_id"), rule.alias("rule_id"), F.col("claim_ids").alias("claim_ids"), F.when(rule == "R01", F.array().cast("array<string>")).otherwise(F.array(F.lit("provider_id"), F.lit("service_date"))).alias("fields_matched"),
        F.concat(F.lit("Found by "), rule, F.lit(", "), F.lower("severity")).alias("plain_text"), F.when(low, 0.0).otherwise(F.col("est_dollars") / 2).alias("est_overpay"), F.col("severity").alias("severity"), F.when(rule == "R04", "Never opens a case alone.").otherwise("").alias("fp_notes"),
    )
    return alerts(spark, d).withColumn("evidence", F.array(e))


def _fixture(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    hubs = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("hub_provider_id"), F.concat(F.lit("NET-"), "s_suppkey").alias("network_id"), (F.col("s_suppkey") % 10 / 10).alias("hard_link_score"))
    names = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    return K.fixture_cases(_told(spark, d), V.claims(spark, d), hubs, names)


def k07b(spark, d):
    out = _fixture(spark, d)
    texts = [F.array_join(c, "; ").alias(c) for c in ("why_flagged", "top_reasons", "benign_explanations")]
    return out.select("case_id", "entity_id", "entity_name", "worst", "rules", "claims", "members_affected", "score", "priority", r2("dollars").alias("dollars"), r2("exposure_low").alias("exposure_low"), r2("exposure_high").alias("exposure_high"), "network_id", "network_risk", "anomaly_risk", *texts)


_RULE_SQL = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.RULE_NAMES.items()) + " END"
FIXTURE = f"""{V.with_views('claims')}, {ALERTS}, a AS (SELECT CAST(provider_id AS VARCHAR) AS entity_id, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst, count(DISTINCT rule_id) AS rules, count(DISTINCT claim_id) AS claims, sum(est_dollars) AS d,
  string_agg(DISTINCT 'Triggered ' || rule_id || ' (' || {_RULE_SQL} || ')', '; ' ORDER BY 'Triggered ' || rule_id || ' (' || {_RULE_SQL} || ')') AS why_flagged, CASE WHEN count(*) FILTER (WHERE rule_id = 'R04') > 0 THEN 'Never opens a case alone.' ELSE '' END AS benign FROM alerts GROUP BY 1),
 m AS (SELECT CAST(alerts.provider_id AS VARCHAR) AS entity_id, count(DISTINCT member_id) AS members_affected FROM alerts JOIN claims USING (claim_id) GROUP BY 1), t0 AS (SELECT CAST(provider_id AS VARCHAR) AS entity_id, 'Found by ' || rule_id || ', ' || lower(severity) AS text, min(alert_id) AS place FROM alerts GROUP BY 1, 2),
 t1 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY place) AS n FROM t0), t AS (SELECT entity_id, string_agg(text, '; ' ORDER BY n) AS top_reasons FROM t1 WHERE n <= 4 GROUP BY 1),
 f AS (SELECT *, 'CASE-PRO-' || entity_id AS case_id, CAST(least(CASE worst WHEN 4 THEN 35 WHEN 3 THEN 25 WHEN 2 THEN 15 ELSE 8 END + least(12 * rules, 35) + least(1.5 * claims, 20), 99) AS DOUBLE) AS score, round(0.8 * d, 2) AS lo, round(greatest(1.2 * d, 500), 2) AS hi FROM a JOIN m USING (entity_id) JOIN t USING (entity_id))"""
K07B = f"""{FIXTURE} SELECT case_id, entity_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 'Provider ' || entity_id END AS entity_name, worst, rules, claims, members_affected, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
 {R2('d')} AS dollars, {R2('lo')} AS exposure_low, {R2('hi')} AS exposure_high, CASE WHEN s_suppkey % 3 = 0 THEN 'NET-' || s_suppkey END AS network_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 10 / 10 ELSE 0.0 END AS network_risk, CAST(least(0.25 * rules, 1) AS DOUBLE) AS anomaly_risk, why_flagged, top_reasons, benign AS benign_explanations FROM f JOIN supplier ON s_suppkey = CAST(entity_id AS BIGINT)"""


def k07c(spark, d):
    out = K.fixture_evidence(_told(spark, d))
    return out.select("evidence_id", "case_id", "rule_name", "claim_id", "field_name", "plain_text", r2("est_overpay").alias("est_overpay"), "severity", "source_artifact", "fp_notes")


K07C = f"""{V.with_views('claims')}, {ALERTS} SELECT 'E-' || alert_id AS evidence_id, 'CASE-PRO-' || provider_id AS case_id, {_RULE_SQL} AS rule_name, claim_id, CASE WHEN rule_id = 'R01' THEN 'multiple' ELSE 'provider_id, service_date' END AS field_name, 'Found by ' || rule_id || ', ' || lower(severity) AS plain_text,
 {R2("CASE WHEN severity <> 'LOW' AND est_dollars > 0 THEN est_dollars / 2 ELSE est_dollars END")} AS est_overpay, severity, 'rule_engine/' || lower(rule_id) AS source_artifact, CASE WHEN rule_id = 'R04' THEN 'Never opens a case alone.' END AS fp_notes FROM alerts"""


def k07d(spark, d):
    return K.fixture_queue(materialize(_fixture(spark, d), "fixture")).select("case_id", F.col("queue_rank").cast("int").alias("queue_rank"), "score", r2("effort_hours").alias("effort_hours"), r2("ev_per_hour").alias("ev_per_hour"), F.col("slot").cast("int").alias("slot"))


K07D = f"""{FIXTURE}, h AS (SELECT *, round(least(2 + 0.1 * claims, 8), 1) AS hours, CAST(row_number() OVER (ORDER BY score DESC, entity_id) AS INTEGER) AS r FROM f)
 SELECT case_id, r AS queue_rank, score, {R2('hours')} AS effort_hours, {R2('round(hi / greatest(hours, 1), 2)')} AS ev_per_hour, r AS slot FROM h"""


def k08(spark, d):
    return K.queue_evaluation(_queue(spark, d)).select("strategy", "n", r6("mean_risk").alias("mean_risk"), r2("exposure").alias("exposure"))


def k08b(spark, d):
    cs = _figures(spark, d)
    return K.queue_report(cs, _queued(cs)).select("section", "metric", r6("value").alias("value"))


_TOP = {"average_risk": "avg(risk_score)", "average_exposure": "avg(estimated_exposure)", "total_exposure": "sum(estimated_exposure)", "average_evidence": "avg(evidence_strength)", "average_priority": "avg(priority_score)"}
_TOP_ORDERS = {"by_priority": "queue_rank", "by_risk": "risk_score DESC, evidence_strength DESC, estimated_exposure DESC, case_id", "by_exposure": "estimated_exposure DESC, risk_score DESC, evidence_strength DESC, case_id"}
_REPORT = [
    *((x, "count", k) for k, x in {"total_cases": "count(*)", "eligible_cases": "count(*)", "excluded_cases": "max(0)", "capacity": "max(20)", "selected": "count(*) FILTER (WHERE queue_rank <= 20)", "deferred": "count(*) FILTER (WHERE queue_rank > 20)"}.items()),
    ("avg(priority_score)", "score", "average_priority"), ("median(priority_score)", "score", "median_priority"),
    *((f"coalesce(avg({c}) FILTER (WHERE queue_rank {o} 20), 0)", part, f"average_{k}") for part, c in (("risk", "risk_score"), ("exposure", "estimated_exposure")) for k, o in (("selected", "<="), ("deferred", ">"))),
    *((f"count(*) FILTER (WHERE coalesce(q_{k}, 0) = 0)", "missing", f"{k}_missing") for k in ("network", "anomaly", "future", "behaviour")), ("count(*) FILTER (WHERE coalesce(estimated_exposure, 0) = 0)", "missing", "exposure_zero"),
]
K08B = f"{QUEUE} SELECT 'tier' AS section, priority_tier AS metric, CAST(count(*) AS DOUBLE) AS value FROM queue GROUP BY 1, 2" + "".join(f" UNION ALL SELECT '{a}', '{b}', {R6(x)} FROM queue" for x, a, b in _REPORT) + "".join(f" UNION ALL SELECT '{n}', '{k}', {R6(x)} FROM (SELECT * FROM queue ORDER BY {o} LIMIT 20)" for n, o in _TOP_ORDERS.items() for k, x in _TOP.items())


def k09(spark, d):
    """Decisions on claims taken as cases: the latest decides."""
    c = V.claims(spark, d).select(F.col("claim_id").alias("case_id"), F.lit("NEW").alias("status"), "service_date", "service_minutes", "order_id")
    one = c.where("order_id % 2 = 0").select("case_id", F.lit("accept").alias("decision"), F.col("service_date").alias("decided_at"))
    two = c.where("order_id % 3 = 0").select("case_id", F.when(F.col("service_minutes") >= 25, "escalate").otherwise("reject").alias("decision"), F.date_add("service_date", 1).alias("decided_at"))
    return K.apply_decisions(c, one.unionByName(two))[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


K09 = f"{V.with_views('claims')} SELECT CASE WHEN order_id % 3 = 0 THEN CASE WHEN service_minutes >= 25 THEN 'ESCALATED' ELSE 'CLOSED' END WHEN order_id % 2 = 0 THEN 'IN_REVIEW' ELSE 'NEW' END AS status, count(*) AS n FROM claims GROUP BY 1"


def q01(spark, d):
    cs = _figures(spark, d)
    out = Q.summary(V.claims(spark, d), alerts(spark, d), cs, K.build_queue(cs))
    return out.select("claims", "providers", "members", r2("paid").alias("paid"), "alerts", "alerted_entities", "cases", "queued")


Q01 = f"{V.with_views('claims')} SELECT count(*) AS claims, count(DISTINCT provider_id) AS providers, count(DISTINCT member_id) AS members, {R2('sum(paid_amount)')} AS paid, count(*) FILTER (WHERE modifier <> 'N') AS alerts, count(DISTINCT CASE WHEN modifier <> 'N' THEN provider_id END) AS alerted_entities, (SELECT count(*) FROM supplier) AS cases, least(20, (SELECT count(*) FROM supplier)) AS queued FROM claims"


def q02(spark, d):
    """The whole queue by value for the hour, with what does not fit deferred."""
    q = _queue(spark, d).withColumn("effort_hours", F.least((20 + F.col("claim_count") % 37) / 10, F.lit(8.0)))  # whole tenths
    q = q.withColumn("value_per_hour", r2(F.col("exposure_high") / F.col("effort_hours")))
    return Q.queue_page(q, "value", capacity_hours=40.0, limit=None).select("case_id", "queue_rank", "queue_status", "capacity_rank", "slot", r6("hours_used").alias("hours_used"))


def q02b(spark, d):
    """The second page of what is deferred."""
    q = _queue(spark, d).withColumn("effort_hours", F.lit(2.5))
    return Q.queue_page(q, capacity_hours=10.0, status="deferred", limit=50, offset=5).select("case_id", "slot", "capacity_rank")


def q04(spark, d):
    cs = _cases(spark, d)
    return Q.evidence_ledger(K.case_evidence(cs, alerts(spark, d)), cs).select("case_id", "kind", "source", "rule_id", r2("amount").alias("amount"))


def q05(spark, d):
    return Q.timeline(1, V.claims(spark, d), alerts(spark, d)).select("date", "kind", "n", r2("amount").alias("amount"))


Q05 = f"""{V.with_views('claims')}, {ALERTS}, t AS (SELECT service_date AS date, 'claims' AS kind, count(*) AS n, sum(paid_amount) AS amount FROM claims WHERE provider_id = 1 GROUP BY 1 ORDER BY 1 DESC LIMIT 20)
 SELECT date, kind, n, {R2('amount')} AS amount FROM t UNION ALL SELECT service_date, 'alert', 1, {R2('est_dollars')} FROM alerts JOIN claims USING (claim_id) WHERE alerts.provider_id = 1"""


def q09(spark, d):
    return Q.claims_page(V.claims(spark, d), provider_id=3, limit=40, offset=5).select("claim_id", "service_date", "paid_amount")


Q09 = f"{V.with_views('claims')} SELECT claim_id, service_date, paid_amount FROM claims WHERE provider_id = 3 ORDER BY service_date DESC, claim_id LIMIT 40 OFFSET 5"


def q10(spark, d):
    return Q.providers_page(V.providers(spark, d), county="nation_15", limit=1000).select("provider_id", "county", "specialty")


Q10 = f"{V.with_views('providers')} SELECT provider_id, county, specialty FROM providers WHERE lower(county) = 'nation_15' ORDER BY 1 LIMIT 1000"


def q11(spark, d):
    return Q.risk_info(fused(spark, d)).select("provider_id", "risk_score", "risk_tier")


def q12(spark, d):
    from claimsieve.operators.evaluation import claim_quality
    from claimsieve.queries.risk import _truth

    per = claim_quality(alerts(spark, d), _truth(spark, d))
    return per.agg(F.count(F.lit(1)).alias("rules"), r6(F.avg("f1")).alias("mean_f1"), F.sum("fn").alias("missed"))


def _breakdown(spark, d):
    """Rings by nation; those of the first twenty nations have a scenario."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rings = s.select(F.col("s_nationkey").cast("string").alias("ring_id"), F.col("s_suppkey").cast("string").alias("provider")).where("s_suppkey % 3 <> 1")
    groups = s.where("s_suppkey % 3 <> 0 or s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("provider"), (F.col("s_suppkey") % 9).cast("string").alias("community"))
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 20")
    kinds = F.when(F.col("n_nationkey") % 3 == 0, "shared_identity").when(F.col("n_nationkey") % 3 == 1, "referral_ring").otherwise("burst")
    return Ev.scenario_breakdown(rings, groups, n.select(F.col("n_nationkey").cast("string").alias("ring_id"), F.format_string("S%03d", "n_nationkey").alias("scenario_id"), kinds.alias("scenario_type"), F.when(F.col("n_nationkey") % 3 == 1, "R07").otherwise("R06,R09").alias("expected_rules")))


def q12b(spark, d):
    return _breakdown(spark, d).withColumn("recovery", r6("recovery"))


_SCENARIOS = """ring AS (SELECT s_nationkey AS k, s_suppkey AS p FROM supplier WHERE s_suppkey % 3 <> 1), grp AS (SELECT s_suppkey AS p, CAST(s_suppkey % 9 AS VARCHAR) AS g FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0),
 size AS (SELECT k, count(*) AS n FROM ring GROUP BY 1), best AS (SELECT k, max(c) AS c FROM (SELECT k, g, count(*) AS c FROM ring JOIN grp USING (p) GROUP BY 1, 2) GROUP BY 1),
 sc AS (SELECT k, n, coalesce(c, 0) AS c, coalesce(c, 0) / n AS recovery, CASE WHEN k >= 20 THEN 'collusion' WHEN k % 3 = 0 THEN 'shared_identity' WHEN k % 3 = 1 THEN 'referral_ring' ELSE 'burst' END AS kind FROM size LEFT JOIN best USING (k))"""
Q12B = f"""WITH {_SCENARIOS} SELECT CASE WHEN k >= 20 THEN CAST(k AS VARCHAR) ELSE 'S' || lpad(CAST(k AS VARCHAR), 3, '0') END AS scenario_id, kind AS scenario_type, CASE kind WHEN 'collusion' THEN 'Collusion' WHEN 'burst' THEN 'Burst' WHEN 'referral_ring' THEN 'Referral Ring' ELSE 'Shared Identity' END || ' planted collusion ring (' || k || ')' AS description,
 CAST(k AS VARCHAR) AS ring_id, CASE WHEN k >= 20 THEN 'R06,R07,R08,R09,R10' WHEN k % 3 = 1 THEN 'R07' ELSE 'R06,R09' END AS expected_rules, c > 0 AS detected, {R6('recovery')} AS recovery, n AS providers_count, c AS providers_detected FROM sc"""


def q12c(spark, d):
    """The summary in one row: claims of 40 minutes or more and every third provider are labelled."""
    listed = alerts(spark, d).where("severity = 'CRITICAL'").select("entity_type", "entity_id", F.explode("claim_ids").alias("claim_id"))
    c, s = V.claims(spark, d), spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("provider_id"))
    out = Ev.evaluation_summary(listed, c, s, c.where("service_minutes >= 40"), s.where("provider_id % 3 = 0"), _breakdown(spark, d))
    return out.select(*(r6(k).alias(k) if t == "double" else k for k, t in out.dtypes))


def _quality_sql(prefix: str, found: str, bad: str) -> str:
    return f"""{prefix}_q AS (SELECT count(*) FILTER (WHERE g AND b) AS tp, count(*) FILTER (WHERE g AND NOT b) AS fp, count(*) FILTER (WHERE b AND NOT g) AS fn FROM (SELECT coalesce(g, false) AS g, coalesce(b, false) AS b FROM (SELECT DISTINCT x, true AS g FROM ({found})) FULL JOIN (SELECT DISTINCT x, true AS b FROM ({bad})) USING (x)))"""


def _measures_sql(p: str) -> str:
    q = f"{p}_q"
    return f"{q}.tp AS {p}_tp, {q}.fp AS {p}_fp, {q}.fn AS {p}_fn, {R6(f'coalesce({q}.tp / nullif({q}.tp + {q}.fp, 0), 0)')} AS {p}_precision, {R6(f'coalesce({q}.tp / nullif({q}.tp + {q}.fn, 0), 0)')} AS {p}_recall, {R6(f'coalesce(2 * {q}.tp / nullif(2 * {q}.tp + {q}.fp + {q}.fn, 0), 0)')} AS {p}_f1"


_CRITICAL = "FROM alerts WHERE severity = 'CRITICAL'"
Q12C = f"""{V.with_views('claims')}, {ALERTS}, {_SCENARIOS}, {_quality_sql('claim', f'SELECT claim_id AS x {_CRITICAL}', 'SELECT claim_id AS x FROM claims WHERE service_minutes >= 40')}, {_quality_sql('provider', f'SELECT provider_id AS x {_CRITICAL}', 'SELECT s_suppkey AS x FROM supplier WHERE s_suppkey % 3 = 0')},
 rs AS (SELECT count(*) AS total_scenarios, count(*) FILTER (WHERE c > 0) AS detected_scenarios, {R6('avg(recovery)')} AS mean_recovery, {R6('count(*) FILTER (WHERE c > 0) / count(*)')} AS scenario_recall FROM sc)
 SELECT (SELECT count(*) FROM claims) AS total_claims, (SELECT count(*) FROM supplier) AS total_providers, {_measures_sql('claim')}, {_measures_sql('provider')}, rs.* FROM claim_q, provider_q, rs"""


def s04(spark, d):
    """A report of severities, written as JSON lines and read again."""
    path = new_path(spark, "report")
    T.write_report(Ev.severity_distribution(alerts(spark, d)), path)
    return spark.read.schema("rule_id string, severity string, n long, dollars double").json(path).withColumn("dollars", r2("dollars"))


def q13(spark, d):
    cs = _cases(spark, d)
    p = Q.evidence_packets(cs, K.case_evidence(cs, alerts(spark, d)))
    return p.select("case_id", F.size("claim_ids").alias("n_claims"), F.array_join("rule_ids", ",").alias("rules"), r2("facts.exposure_high").alias("exposure_high"))


def q14(spark, d):
    """An audit of a made text for each case; every seventh names a rule and an amount too many."""
    cs = _cases(spark, d)
    packets = Q.evidence_packets(cs, K.case_evidence(cs, alerts(spark, d)))
    wrong = F.col("case_id").rlike("7$")
    said = F.element_at(F.array(*map(F.lit, PROHIBITED)), (F.substring("case_id", -2, 1).cast("int") % len(PROHIBITED) + 1))
    briefs = cs.select("case_id", F.when(wrong, F.concat(F.lit("Pattern of CLM999; $99,999,999.00 at risk: "), F.initcap(said), F.lit("."))).otherwise(F.lit("Rule R01 found claims worth $10.00.")).alias("text"))
    return Q.audit_narratives(briefs, packets).groupBy("passes", "prohibited").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("unknown_claims")).alias("unknown"), F.sum(F.size("excess_dollars")).alias("excess"))


Q14 = "WITH c AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) SELECT r % 10 <> 7 AS passes, r % 10 = 7 AS prohibited, count(*) AS n, CAST(sum(CASE WHEN r % 10 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS unknown, CAST(sum(CASE WHEN r % 10 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS excess FROM c GROUP BY 1, 2"


def q03(spark, d):
    """Detail of the first case: what each part holds. Places are found among all; claims and alerts are written of this case only."""
    cs = materialize(K.build_cases(_scores(spark, d), CaseConfig(all_providers=True)).where("case_id = 'CASE-000001'"), "case")
    parts = Q.case_detail("CASE-000001", cs, K.case_evidence(cs, alerts(spark, d)), alerts(spark, d), V.claims(spark, d))
    key = {"case": "case_id", "evidence": "source", "alerts": "alert_id", "claims": "claim_id"}
    return reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(name).alias("part"), F.col(key[name]).alias("id")) for name, df in sorted(parts.items())))


Q03 = f"""{CASES}, {_CASE_CLAIMS}, one AS (SELECT * FROM cases WHERE case_rank = 1), own AS (SELECT alerts.* FROM alerts JOIN one ON CAST(alerts.provider_id AS VARCHAR) = one.provider_id), mine AS (SELECT claim_id FROM cc JOIN one USING (provider_id))
 SELECT 'case' AS part, case_id AS id FROM one UNION ALL SELECT 'alerts', alert_id FROM own UNION ALL (SELECT 'claims', claim_id FROM mine JOIN claims USING (claim_id) ORDER BY service_date DESC, claim_id LIMIT 50) UNION ALL SELECT 'evidence', alert_id FROM own UNION ALL SELECT 'evidence', claim_id FROM (SELECT claim_id FROM mine ORDER BY 1 LIMIT 10)
 UNION ALL SELECT 'evidence', 'ISOLATION_FOREST' FROM one WHERE anomaly_flag = 1 OR anomaly_signal >= 0.7 UNION ALL SELECT 'evidence', 'COMM-' || community_id FROM one WHERE community_id IS NOT NULL"""
Q02 = f"""{QUEUE.replace('WITH ', 'WITH RECURSIVE ', 1)}, e0 AS (SELECT case_id, queue_rank, risk_score, least(2 + 0.1 * (claim_count % 37), 8.0) AS h, {R2('greatest(1.2 * estimated_exposure, 500) / least(2 + 0.1 * (claim_count % 37), 8.0)')} AS v FROM queue), e AS (SELECT *, row_number() OVER (ORDER BY v DESC, risk_score DESC, case_id) AS r FROM e0),
 t AS (SELECT r, CASE WHEN h <= 40 THEN h ELSE 0.0 END AS used, h <= 40 AS sel FROM e WHERE r = 1 UNION ALL SELECT e.r, CASE WHEN t.used + e.h <= 40 THEN t.used + e.h ELSE t.used END, t.used + e.h <= 40 FROM t JOIN e ON e.r = t.r + 1),
 z AS (SELECT *, CASE WHEN sel THEN sum(CASE WHEN sel THEN 1 ELSE 0 END) OVER (ORDER BY r) ELSE 0 END AS cr FROM t JOIN e USING (r)) SELECT case_id, queue_rank, CASE WHEN sel THEN 'QUEUED' ELSE 'DEFERRED' END AS queue_status, CAST(cr AS INTEGER) AS capacity_rank, CAST(CASE WHEN sel THEN cr ELSE 999 END AS INTEGER) AS slot, CASE WHEN sel THEN {R6('used')} END AS hours_used FROM z"""
Q02B = f"{QUEUE} SELECT case_id, 999 AS slot, 0 AS capacity_rank FROM queue WHERE queue_rank > 4 ORDER BY queue_rank LIMIT 50 OFFSET 5"
Q04 = K03.replace("SELECT case_id, 'RULE' AS kind", "SELECT case_id, kind, source, rule_id, CASE WHEN rule_id IN ('R06', 'R08', 'R09') AND amount = 0 THEN NULL ELSE amount END AS amount FROM (SELECT case_id, c.provider_id AS p, claim_id AS txt, 'RULE' AS kind", 1).replace("UNION ALL SELECT case_id, '", "UNION ALL SELECT case_id, provider_id, NULL, '") + ") WHERE coalesce(rule_id, '') <> 'R09' OR contains('Claim ' || txt, p)"
Q11 = f"{SCORES} SELECT provider_id, risk_score, risk_tier FROM scores ORDER BY risk_score DESC, provider_id LIMIT 50"
Q12 = f"SELECT count(*) AS rules, {R6('avg(f1)')} AS mean_f1, CAST(sum(fn) AS BIGINT) AS missed FROM ({V02})"
Q13 = f"""{CASES}, l AS (SELECT CAST(provider_id AS VARCHAR) AS provider_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM alerts GROUP BY 1)
 SELECT case_id, claim_count AS n_claims, coalesce(rules, '') AS rules, {R2('greatest(1.2 * estimated_exposure, 500)')} AS exposure_high FROM cases LEFT JOIN l USING (provider_id)"""


def q06(spark, d):
    """Referral edges of a provider, the strongest fifteen."""
    r = V.referrals(spark, d)
    name = lambda c: F.concat(F.lit("provider:"), F.col(c).cast("string"))
    edges = r.groupBy(name("referring_provider_id").alias("src"), name("target_provider_id").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("edge_type", F.lit("refers_to"))
    members = edges.select(F.col("src").alias("provider"), F.lit("c").alias("community")).distinct()
    hubs = spark.range(1).select(F.lit("c").alias("community"), F.lit("provider:0").alias("hub"))
    return Q.ego_network("provider:1", edges, hubs, members)


Q06 = f"""{V.with_views('referrals')}, e AS (SELECT 'provider:' || referring_provider_id AS src, 'provider:' || target_provider_id AS dst, 'refers_to' AS edge_type, count(*)::DOUBLE AS weight FROM referrals GROUP BY 1, 2),
 t AS (SELECT * FROM e WHERE src = 'provider:1' OR dst = 'provider:1' ORDER BY weight DESC, src, dst LIMIT 15) SELECT * FROM t UNION ALL SELECT 'provider:1', 'provider:0', 'hub', 1.0"""


def q07(spark, d):
    audit = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("decided_at"))
    return Q.audit_page(audit, 100, 10)


Q07 = "SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS decided_at FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 100 OFFSET 10"


def q08(spark, d):
    n = spark.read.parquet(f"{d}/supplier.parquet").select(F.format_string("NET-%04d", F.col("s_suppkey").cast("int")).alias("network_id"), F.col("s_acctbal").alias("total_paid"), (F.col("s_suppkey") % 3).alias("hard_links"))
    return Q.networks_page(n, hard_only=True, limit=30)


Q08 = "SELECT 'NET-' || lpad(CAST(s_suppkey AS VARCHAR), greatest(4, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0') AS network_id, s_acctbal AS total_paid, s_suppkey % 3 AS hard_links FROM supplier WHERE s_suppkey % 3 > 0 ORDER BY s_acctbal DESC, network_id LIMIT 30"


def s06(spark, d):
    """Rows of lineitem against a contract, by failed checks."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    checked = T.check_contract(rows, {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.08, "flag": F.col("l_returnflag").rlike("^(A|N)$")}, ["l_orderkey", "l_linenumber"])
    return checked.groupBy(F.array_join("failed", ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


S06 = """WITH c AS (SELECT concat_ws(',', CASE WHEN l_quantity <= 45 THEN NULL ELSE 'quantity' END, CASE WHEN l_discount < 0.08 THEN NULL ELSE 'discount' END, CASE WHEN l_returnflag IN ('A', 'N') THEN NULL ELSE 'flag' END,
 CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'duplicate_key' END) AS failed FROM lineitem) SELECT failed, count(*) AS n FROM c GROUP BY 1"""


def s07(spark, d):
    """The latest order of each customer, the larger total among equal days."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("load_ts"), "o_orderkey", "o_orderdate")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    return T.latest_by_key(old, new, ["o_custkey"]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


S07 = "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def s08(spark, d):
    """Latest orders as a published set: older orders first, later ones merged by customer, then two versions that fail and change nothing."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("load_ts"), "o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("double").alias("price"))
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("load_ts")))
    old, new = (o.where(part).withColumn("_n", newest).where("_n = 1").drop("_n") for part in ("day < '1996-01-01'", "day >= '1996-01-01'"))
    root = new_path(spark, "published")
    more = {"checks": {"latest": {"price": F.col("price") >= 0}}, "keys": {"latest": ["o_custkey"]}, "merge": {"latest": "load_ts"}}
    for version, tables in (("first", {"latest": old}), ("second", {"latest": new}), ("negative", {"latest": new.withColumn("price", -F.col("price"))}), ("empty", {"latest": new.limit(0)}), ("second", {"latest": old})):
        try:
            P.publish(spark, root, version, tables, **more)
        except T.ContractError:
            pass
    rows = P.manifest(spark, root)["tables"]["latest"]["rows"]
    return P.published(spark, root)["latest"].select("o_custkey", "o_orderkey", "day", F.lit(P.manifest(spark, root)["version"]).alias("version"), F.lit(rows).cast("long").alias("n_rows"))


S08 = f"SELECT *, 'second' AS version, count(*) OVER () AS n_rows FROM ({S07})"


def k02(spark, d):
    """Peers of each case in communities made from the last digits of providers; the smallest provider is the hub."""
    p = V.providers(spark, d).select(F.concat(F.lit("provider:"), F.col("provider_id").cast("string")).alias("provider"), (F.col("provider_id") % 13).cast("string").alias("community"), "provider_id")
    hubs = p.groupBy("community").agg(F.min_by("provider", "provider_id").alias("hub")).withColumn("main_kind", F.when(F.col("community") % 2 == 0, "shared_bank_hash"))
    cs = K.with_peers(_cases(spark, d), p.drop("provider_id"), hubs)
    return cs.select("case_id", "peers", r6("peer_strength").alias("peer_strength"), F.array_join(F.transform("network_relationships", lambda x: F.concat_ws("=", x["peer"], x["relationship"], F.format_number(x["strength"], 2))), ",").alias("relationships"))


K02 = f"""{CASES}, m AS (SELECT 'provider:' || s_suppkey AS p, s_suppkey % 13 AS c, s_suppkey AS k FROM supplier), h AS (SELECT c, arg_min(p, k) AS hub FROM m GROUP BY 1),
 r AS (SELECT case_id, o.p AS peer, o.p = hub AS is_hub, m.c AS c FROM cases JOIN m ON m.p = 'provider:' || provider_id JOIN m o ON o.c = m.c AND o.p <> m.p JOIN h ON h.c = m.c), f AS (SELECT *, CASE WHEN is_hub THEN 0.85 ELSE 0.5 END AS strength, CASE WHEN is_hub THEN 'hub_link' WHEN c % 2 = 0 THEN 'shared_bank_hash' ELSE 'connected_community' END AS kind, row_number() OVER (PARTITION BY case_id ORDER BY peer) AS n FROM r),
 l AS (SELECT case_id, CAST(count(*) AS INTEGER) AS peers, CAST(avg(strength) AS DOUBLE) AS s, string_agg(peer || '=' || kind || '=' || printf('%.2f', strength), ',' ORDER BY peer) AS relationships FROM f WHERE n <= 5 GROUP BY 1)
 SELECT case_id, coalesce(peers, 0) AS peers, {R6('coalesce(s, 0)')} AS peer_strength, coalesce(relationships, '') AS relationships FROM cases LEFT JOIN l USING (case_id)"""


def s01(spark, d):
    """Orders written as CSV under other names, read back by a declared schema: a day that is none is NULL."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    path = new_path(spark, "csv")
    day = F.when(F.col("o_orderkey") % 10 == 0, "no day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("patient_id"), day.alias("service_from"), F.col("o_totalprice").alias("paid")).write.option("header", True).csv(f"{path}/claims.csv")
    schema = StructType.fromDDL("claim_id long, patient_id long, service_from string, paid double")
    t = T.canonical(T.read_csv_tables(spark, path, {"claims": schema})["claims"], {"modifier": "string"})
    t = t.withColumn("service_date", F.to_date(F.try_to_timestamp("service_date")))
    return t.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("member_id").alias("members"), r2(F.sum("paid_amount")).alias("paid"), F.count("modifier").alias("modifiers"))


S01 = f"SELECT CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS service_date, count(*) AS n, count(DISTINCT o_custkey) AS members, {R2('sum(o_totalprice)')} AS paid, CAST(0 AS BIGINT) AS modifiers FROM orders GROUP BY 1"


def s03(spark, d):
    """Alerts written as Parquet and CSV, read back from the one that is asked for or else the other."""
    path = new_path(spark, "alerts-both")
    T.write_both(alerts(spark, d), f"{path}/alerts")
    T.flat(T.read_either(spark, f"{path}/alerts.parquet")).write.option("header", True).option("compression", "gzip").csv(f"{path}/only.csv")
    nested = T.read_either(spark, f"{path}/alerts.parquet").select("alert_id", F.lit("parquet").alias("form"), F.col("claim_ids")[0].alias("claim_id"))
    text = T.read_either(spark, f"{path}/only.parquet").select("alert_id", F.lit("csv").alias("form"), F.from_json("claim_ids", "array<string>")[0].alias("claim_id"))
    return nested.unionByName(text)


S03 = f"{V.with_views('claims')}, {ALERTS} SELECT alert_id, f AS form, claim_id FROM alerts CROSS JOIN (VALUES ('parquet'), ('csv')) t(f)"


def s11(spark, d):
    """Breaks of output contracts among made-up bad rows: by table and check."""
    a = alerts(spark, d).withColumns({"severity": F.when(F.col("est_dollars") < 20000, F.col("severity")).otherwise("SEVERE"), "evidence": F.when(F.col("rule_id") != "R10", F.col("evidence")).otherwise(F.slice("evidence", 1, 0))})
    cs = _cases(spark, d)
    e = K.case_evidence(cs, alerts(spark, d)).withColumn("source", F.when(F.col("amount") < 30000, F.col("source")))
    q = _queued(cs).withColumn("queue_reasons", F.when(F.col("queue_rank") % 4 == 0, F.array(F.lit("Not guilty as yet"))).otherwise(F.col("queue_reasons")))
    parts = [T.check_contract(df, T.contract(name)).select(F.lit(name).alias("table"), F.explode("failed").alias("check")) for name, df in (("alerts", a), ("case_evidence", e), ("queue", q))]
    return reduce(lambda x, y: x.unionByName(y), parts).groupBy("table", "check").agg(F.count(F.lit(1)).alias("n"))


S11 = f"""{CASES}, b AS (SELECT 'alerts' AS "table", 'severity' AS "check" FROM alerts WHERE est_dollars >= 20000 UNION ALL SELECT 'alerts', 'evidence' FROM alerts WHERE rule_id = 'R10' UNION ALL SELECT 'case_evidence', 'source' FROM alerts WHERE est_dollars >= 30000
 UNION ALL SELECT 'queue', 'wording' FROM cases WHERE case_rank % 4 = 0) SELECT "table", "check", count(*) AS n FROM b GROUP BY 1, 2"""


def f14(spark, d):
    """Values that are no numbers count as 0, and others are clipped to [0, 1]."""
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).when(F.col("event_id") % 5 == 2, F.lit(None)).otherwise(F.col("value") / 50 - 0.5)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", r6(C.clip01(x)).alias("clipped"))


F14 = f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 0.0 ELSE {R6('least(greatest(value / 50 - 0.5, 0), 1)')} END AS clipped FROM events"


ENTRIES = {
    "k01_cases": (k01, K01), "k02_peers": (k02, K02), "s01_csv_tables": (s01, S01), "s03_both_forms": (s03, S03), "s11_output_contracts": (s11, S11), "f14_clipped": (f14, F14), "k03_case_evidence": (k03, K03), "k05_priority": (k05, K05), "k06_queue": (k06, K06), "k07_integrated_cases": (k07, K07), "k07_fixture_cases": (k07b, K07B), "k07_fixture_evidence": (k07c, K07C), "k07_fixture_queue": (k07d, K07D), "k08_queue_report": (k08b, K08B), "k08_queue_evaluation": (k08, K08), "k09_decisions": (k09, K09),
    "q01_summary": (q01, Q01), "q02_queue_hours": (q02, Q02), "q02_deferred_page": (q02b, Q02B), "q04_evidence_ledger": (q04, Q04), "q05_timeline": (q05, Q05), "q03_case_detail": (q03, Q03), "q06_ego_network": (q06, Q06), "q07_audit": (q07, Q07), "q08_networks": (q08, Q08), "q09_claims_page": (q09, Q09), "q10_providers_page": (q10, Q10), "q11_risk_info": (q11, Q11), "q12_evaluation": (q12, Q12), "q12_scenarios": (q12b, Q12B), "q12_summary": (q12c, Q12C), "q13_packets": (q13, Q13), "q14_narrative_audit": (q14, Q14),
    "s04_report": (s04, V02B), "s06_contract": (s06, S06), "s07_latest_by_key": (s07, S07), "s08_published": (s08, S08),
}
