"""Detection quality against labelled data, and ranking metrics that no single task computes alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.operators.windows import cumulative


def rule_quality(alerts: DataFrame, scenarios: DataFrame, entity_labels: DataFrame) -> DataFrame:
    """By rule: alerts, entities, true and false positives against the scenarios that expect the rule, precision, recall, exposure.

    ``scenarios``: scenario_id, provider_ids and expected_rules as comma-separated text.
    """
    want = scenarios.select("scenario_id", F.explode(F.split("expected_rules", ",")).alias("rule_id"), F.split("provider_ids", ",").alias("ids")).select("scenario_id", F.trim("rule_id").alias("rule_id"), F.explode("ids").alias("entity_id")).withColumn("entity_id", F.trim("entity_id"))
    got = alerts.groupBy("rule_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum("est_dollars").alias("dollars"))
    expected = want.groupBy("rule_id").agg(F.countDistinct("entity_id").alias("expected"), F.countDistinct("scenario_id").alias("scenarios"))
    hit = got.join(want.select("rule_id", "entity_id").distinct().withColumn("hit", F.lit(1)), ["rule_id", "entity_id"], "left")
    per = hit.groupBy("rule_id").agg(F.sum("n").alias("alerts"), F.count(F.lit(1)).alias("entities"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"), F.sum("dollars").alias("exposure"))
    seen = got.join(want, ["rule_id", "entity_id"]).groupBy("rule_id").agg(F.countDistinct("scenario_id").alias("scenarios_found"))
    out = per.join(expected, "rule_id", "full").join(seen, "rule_id", "left").fillna(0)
    return out.withColumns({"fp": F.col("entities") - F.col("tp"), "precision": F.when(F.col("entities") > 0, F.col("tp") / F.col("entities")).otherwise(0.0), "recall": F.when(F.col("expected") > 0, F.col("tp") / F.col("expected")).otherwise(0.0)})


def claim_quality(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """By rule, over claims (truth: claim_id, rule_id, is_fraud): true and false positives, misses, precision, recall and F1.

    ``alerts`` lists claims (``claim_ids``) or has one a row, as ``rules.alert_claims`` gives them at any size.
    """
    got = alerts.select("rule_id", "claim_id" if "claim_id" in alerts.columns else F.explode("claim_ids").alias("claim_id")).distinct().withColumn("got", F.lit(1))
    bad = truth.where("is_fraud").select("rule_id", F.col("claim_id").cast("string").alias("claim_id")).distinct().withColumn("bad", F.lit(1))
    both = got.join(bad, ["rule_id", "claim_id"], "full")
    g, b = F.coalesce("got", F.lit(0)), F.coalesce("bad", F.lit(0))
    out = both.groupBy("rule_id").agg(F.sum(g * b).alias("tp"), F.sum(g * (1 - b)).alias("fp"), F.sum((1 - g) * b).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("est_dollars").alias("dollars"))


def ring_recovery(rings: DataFrame, membership: DataFrame) -> DataFrame:
    """For each ring (ring_id, provider): the community that holds most of it, its share, and members that are not of the ring."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))
    total = rings.groupBy("ring_id").agg(F.count(F.lit(1)).alias("ring_size"))
    overlap = rings.join(membership, "provider").groupBy("ring_id", "community").agg(F.count(F.lit(1)).alias("overlap"))
    spread = overlap.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n_communities"))
    w = Window.partitionBy("ring_id").orderBy(F.desc("overlap"), "community")
    best = overlap.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = total.join(best, "ring_id", "left").join(sizes, "community", "left").join(spread, "ring_id", "left").fillna(0, ["overlap", "community_size", "n_communities"])
    return out.withColumns({"recovery": F.col("overlap") / F.col("ring_size"), "one_community": (F.col("n_communities") == 1) & (F.col("overlap") == F.col("ring_size")), "false_members": F.col("community_size") - F.col("overlap")})


def scenario_breakdown(rings: DataFrame, membership: DataFrame, scenarios: DataFrame) -> DataFrame:
    """For each ring its scenario, the rules expected of it, and how many of its providers one community holds.

    ``scenarios``: ring_id, scenario_id, scenario_type and expected_rules as comma-separated text. A ring without a scenario goes
    by its own id and expects the rules of relations and timing.
    """
    found = ring_recovery(rings, membership).join(scenarios, "ring_id", "left")
    kind = F.coalesce("scenario_type", F.lit("collusion"))
    told = F.concat(F.initcap(F.translate(kind, "_", " ")), F.lit(" planted collusion ring ("), F.col("ring_id"), F.lit(")"))
    return found.select(
        F.coalesce("scenario_id", "ring_id").alias("scenario_id"), kind.alias("scenario_type"), told.alias("description"), "ring_id", F.coalesce("expected_rules", F.lit(",".join(RING_RULES))).alias("expected_rules"), (F.col("overlap") > 0).alias("detected"),
        F.col("recovery").alias("recovery"), F.col("ring_size").alias("providers_count"), F.col("overlap").alias("providers_detected"),
    )


#: Rules that a planted ring is expected to set off where its scenario names none.
RING_RULES = ("R06", "R07", "R08", "R09", "R10")


def _quality(got: DataFrame, bad: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row: true and false positives, misses, precision, recall and F1 of distinct ``key`` found against those labelled."""
    both = got.select(key).distinct().withColumn("got", F.lit(1)).join(bad.select(key).distinct().withColumn("bad", F.lit(1)), key, "full")
    g, b = F.coalesce("got", F.lit(0)), F.coalesce("bad", F.lit(0))
    n = both.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in {"tp": g * b, "fp": g * (1 - b), "fn": (1 - g) * b}.items()))
    share = lambda a, c: F.when(c > 0, a / c).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    measures = {"tp": tp, "fp": fp, "fn": fn, "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    return n.select(*(x.alias(f"{prefix}_{k}") for k, x in measures.items()))


def evaluation_summary(listed: DataFrame, claims: DataFrame, providers: DataFrame, bad_claims: DataFrame, bad_providers: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One row, all of it counted: what was evaluated, quality over claims and over providers, scenarios found and mean recovery.

    ``listed``: alerts with one claim a row (``rules.alert_claims``). ``bad_claims`` and ``bad_providers``: labelled ids.
    """
    of_claims = _quality(listed.select(F.col("claim_id").cast("string").alias("claim_id")).dropna(), bad_claims.select(F.col("claim_id").cast("string").alias("claim_id")), "claim_id", "claim")
    alerted = listed.where("entity_type = 'provider'").select(F.col("entity_id").alias("provider_id"))
    of_providers = _quality(alerted, bad_providers.select(F.col("provider_id").cast("string").alias("provider_id")), "provider_id", "provider")
    rings = breakdown.agg(F.count(F.lit(1)).alias("total_scenarios"), F.coalesce(F.sum(F.col("detected").cast("int")), F.lit(0)).alias("detected_scenarios"), F.coalesce(F.avg("recovery"), F.lit(0.0)).alias("mean_recovery"))
    rings = rings.withColumn("scenario_recall", F.col("detected_scenarios") / F.greatest("total_scenarios", F.lit(1)))
    sizes = claims.agg(F.count(F.lit(1)).alias("total_claims")).join(F.broadcast(providers.agg(F.count(F.lit(1)).alias("total_providers"))))
    return reduce(lambda a, b: a.join(F.broadcast(b)), (of_claims, of_providers, rings), sizes)  # single rows


def ranking_metrics(scored: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """ROC-AUC (ties by mean rank), average precision, base rate, and precision, recall and lift of the top k (of all rows, if fewer).

    ``scored``: id, score, label (0 or 1). Rows are counted by distinct score and the counts are ranked, so no task sorts
    all rows; the top k is a limit.
    """
    rows = scored.where("score is not null and label is not null")
    by = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    below, totals = cumulative(by, "score", "n")
    pos_total = by.agg(F.sum("pos").alias("P"))
    ranks = below.agg(F.sum(F.col("pos") * (F.col("_below") + (F.col("n") + 1) / 2)).alias("rank_sum"))
    above, _ = cumulative(by.select("score", "n", "pos"), "score", "n", ascending=False)
    better, _ = cumulative(by.select("score", "pos"), "score", "pos", ascending=False)
    ap = above.withColumnRenamed("_below", "n_above").join(better.select("score", F.col("_below").alias("pos_above")), "score")
    ap = ap.agg(F.sum(F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))).alias("ap_sum"))
    one = ranks.join(F.broadcast(pos_total)).join(F.broadcast(totals)).join(F.broadcast(ap))
    n, p = F.col("_all"), F.col("P")
    base = [
        one.select(F.lit("roc_auc").alias("metric"), F.when((p > 0) & (p < n), (F.col("rank_sum") - p * (p + 1) / 2) / (p * (n - p))).alias("value")),
        one.select(F.lit("average_precision").alias("metric"), F.when(p > 0, F.col("ap_sum") / p).alias("value")),
        one.select(F.lit("base_rate").alias("metric"), (p / n).alias("value")),
    ]
    top = rows.orderBy(F.desc("score"), "id").limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    for k in ks:
        hit = top.where(F.col("r") <= k).agg(F.sum("label").alias("h"), F.count(F.lit(1)).alias("m")).join(F.broadcast(pos_total)).join(F.broadcast(totals))
        base += [hit.select(F.lit(f"precision_at_{k}").alias("metric"), (F.col("h") / F.col("m")).alias("value")), hit.select(F.lit(f"recall_at_{k}").alias("metric"), F.when(p > 0, F.col("h") / p).otherwise(0.0).alias("value")), hit.select(F.lit(f"lift_at_{k}").alias("metric"), F.when(p > 0, F.col("h") / F.col("m") / (p / n)).alias("value"))]
    return reduce(lambda a, b: a.unionByName(b), base)


def random_scores(rows: DataFrame, seed: int = 42) -> DataFrame:
    """A baseline that ranks by a hash of the id."""
    return rows.withColumn("score", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of probability: rows, mean probability and share of label 1; the last bin is closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.where("p is not null and label is not null").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("rate"))


def calibration_metrics(scored: DataFrame, bins: int = 10) -> DataFrame:
    """ECE, MCE, Brier score and log loss in one row."""
    gaps = reliability(scored, bins).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate"))).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = scored.where("p is not null and label is not null").agg(F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
    return gaps.join(F.broadcast(loss))
