"""Rules on tiny tables: hits, exclusions, limits, NULL keys, empty and missing input."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.functions import columns as C
from claimsieve.operators import evaluation as Ev
from claimsieve.operators import graph as N
from claimsieve.operators import identity as E
from claimsieve.operators import learning as M
from claimsieve.operators import risk as U
from claimsieve.operators import rules as R
from claimsieve.operators import windows as W
from claimsieve.plans.components import connected_components
from claimsieve.plans.storage import materialize
from claimsieve.sources import tables as T
from claimsieve.sources.config import QueueConfig, RiskConfig, RuleConfig

D = dt.date
CLAIM = "claim_id string, member_id string, provider_id string, procedure_code string, service_date date, billed_amount double, status string, modifier string"


def claims(spark, rows):
    return {"claims": spark.createDataFrame(rows, CLAIM)}


def test_duplicates(spark):
    row = lambda i, day=D(2024, 1, 1), amount=10.0, status="paid", mod=None, m="m": (i, m, "p", "99213", day, amount, status, mod)
    t = claims(spark, [row("a"), row("b"), row("c", status="VOID"), row("d", mod="50,LT"), row("e", amount=11.0), row("f", m=None), row("g", m=None), row("h", D(2024, 1, 2)), row("i", D(2024, 1, 3), None), row("j", D(2024, 1, 4), None), row("k", None)])
    assert [(r.claim_id_a, r.claim_id_b, r.est_dollars) for r in R.exact_duplicates(t).collect()] == [("a", "b", 10.0)]
    assert sorted((r.claim_id_a, r.claim_id_b) for r in R.near_duplicates(t).collect()) == [("a", "h"), ("b", "h"), ("i", "j")]
    assert R.exact_duplicates(claims(spark, [])).count() == 0


def test_alert_ids_are_stable(spark):
    t = claims(spark, [("a", "m", "p", "1", D(2024, 1, 1), 5.0, None, None), ("b", "m", "p", "1", D(2024, 1, 1), 5.0, None, None)])
    first, status = R.run_rules(spark, t)
    again, _ = R.run_rules(spark, t)
    assert [r.alert_id for r in first.collect()] == [r.alert_id for r in again.collect()]
    kinds = {r.rule: r.status for r in status.collect()}
    assert kinds["R01a"] == "ok" and kinds["R03"] == "skipped" and "failed" not in kinds.values()
    checked = T.check_contract(first, T.contract("alerts"), ["alert_id"])
    assert T.split_valid(checked, strict=True)[1].count() == 0


def test_burst_is_strictly_over(spark):
    weeks = [D(2024, 1, 1) + dt.timedelta(7 * i) for i in range(17)]
    for last, hits in ((15000.0, 0), (15100.0, 1)):
        rows = [(f"c{i}", "m", "p", w, 5000.0 if i < 16 else last) for i, w in enumerate(weeks)]
        t = {"claims": spark.createDataFrame(rows, "claim_id string, member_id string, provider_id string, service_date date, paid_amount double")}
        found = R.weekly_bursts(t).collect()
        assert len(found) == hits
        assert not hits or (found[0].severity == "LOW" and found[0].est_dollars == 10100.0)


def test_phantom(spark):
    t = claims(spark, [("a", "m", "p", "A0428", D(2024, 1, 5), 1.0, None, None), ("b", "m", "p", "99213", D(2024, 1, 7), 1.0, None, None), ("c", "n", "p", "A0428", D(2024, 1, 5), 1.0, None, None), ("d", "n", "p", "99213", D(2024, 1, 6), 1.0, None, None)])
    t["members"] = spark.createDataFrame([("m", D(2024, 1, 5), None), ("n", None, D(2024, 1, 5))], "member_id string, death_date date, enrollment_end date")
    assert [r.claim_id for r in R.after_death(t).collect()] == ["b"]
    assert [r.claim_id for r in R.after_enrollment(t).collect()] == ["d"]
    assert [r.claim_id for r in R.orphan_ambulance(t).collect()] == ["a"]


def test_scalars(spark):
    one = spark.range(1)
    lit = C.F.lit
    get = lambda c: one.select(c.alias("x")).first()[0]
    assert get(C.haversine_miles(lit(40.0), lit(-75.0), lit(40.0), lit(-75.0))) == 0
    assert get(C.haversine_miles(lit(91.0), lit(0.0), lit(0.0), lit(0.0))) is None and get(C.required_mph(lit(5.0), lit(0.0))) is None
    assert get(C.haversine_miles(lit(40.7128), lit(-74.006), lit(34.0522), lit(-118.2437))) == pytest.approx(2445.6, abs=1)
    assert get(C.em_level(lit("99214"))) == 4 and get(C.em_level(lit("A9921"))) is None and get(C.em_level_behaviour(lit("CPT99214"))) == 4
    assert get(C.normal_address(lit("12 North Main Street, Suite 4."))) == "12 n main st ste 4" and get(C.normal_address(lit("  "))) is None
    assert get(C.normal_name(lit("Acme Care, L.L.C. Inc."), True)) is not None
    assert get(C.token_set_ratio(lit("acme care"), lit("care acme group"))) == 100.0
    assert get(C.has_modifier(lit(None).cast("string"), ["A"])) is False and get(C.list_of(lit('["a", "b"]'))) == ["a", "b"] and get(C.list_of(lit("a, b"))) == ["a", "b"]
    assert get(C.clip01(lit(float("nan")))) == 0 and get(C.risk_tier(lit(0.5))) == "HIGH" and get(C.queue_tier(lit(0.8))) == "CRITICAL"


def test_config():
    with pytest.raises(ValueError):
        RiskConfig(weights={"rules": 0.5})
    with pytest.raises(ValueError):
        QueueConfig(weights={"risk": 0.9})


def test_contract(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "id int, x int")
    checked = T.check_contract(df, {"x": C.F.col("x") > 5}, ["id"])
    assert sorted(r.failed for r in checked.collect()) == [["duplicate_key"], ["x"], ["x", "duplicate_key"]]
    with pytest.raises(T.ContractError):
        T.split_valid(checked, strict=True)
    with pytest.raises(T.ContractError):
        T.require_outputs("real", {"alerts": df.limit(0)})
    T.require_outputs("fixture", {"alerts": None})


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3), (2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_identity(spark):
    p = spark.createDataFrame([(f"p{i}", "1 Main Street", None, f"b{i}", f"Owner {chr(65 + i)}{i}{i}") for i in range(6)] + [("p7", "9 Elm", "2", "b1", "Smith Holdings LLC"), ("p8", "9 Elm", "2", "b9", "Smith Holding LLC")], "provider_id string, address string, suite string, bank_hash string, owner_name string")
    links = E.identity_links(p).collect()
    mob = [r for r in links if r.basis == "address_no_suite"]
    assert len(mob) == 5 and sum(r.links for r in mob) == 15 and all(r.confidence <= 0.4 and r.detail.startswith("[MOB]") for r in mob)
    assert [(r.provider_a, r.provider_b) for r in links if r.basis == "bank_hash"] == [("p1", "p7")]
    assert ("p7", "p8") in {(r.provider_a, r.provider_b) for r in links if r.basis == "address_suite"}
    assert ("p7", "p8") in {(r.provider_a, r.provider_b) for r in links if r.basis in ("owner_fuzzy", "owner_exact")}


def test_communities_and_betweenness(spark):
    clique = lambda a: [(f"{a}{i}", f"{a}{j}", 10.0) for i in range(4) for j in range(i + 1, 4)]
    p = spark.createDataFrame(clique("x") + clique("y") + [("x0", "y0", 1.0)], "u string, v string, weight double")
    got = {}
    for r in N.communities(N.of_pairs(p)).collect():
        got.setdefault(r.community, set()).add(r.provider)
    assert sorted(map(sorted, got.values())) == [["x0", "x1", "x2", "x3"], ["y0", "y1", "y2", "y3"]]
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "u string, v string, weight double")
    assert {r.provider: r.betweenness for r in N.betweenness_centrality(path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_fusion(spark):
    a = spark.createDataFrame([("p1", 80.0, True), ("p2", None, False)], "provider_id string, anomaly_percentile double, anomaly_flag boolean")
    f = spark.createDataFrame([("p1", 0.5, None, 0.1), ("p3", None, None, None)], "provider_id string, risk_30d double, risk_60d double, risk_90d double")
    out = {r.provider_id: r for r in U.fuse({"anomaly": U.anomaly_signal(a), "future": U.future_signal(f)}).collect()}
    for r in out.values():
        assert 0 <= r.risk_score <= 1 and 0 <= r.confidence <= 1
        assert sum(r[f"{x}_contribution"] for x in U.FAMILIES) == pytest.approx(r.risk_score, abs=1e-9)
    assert out["p1"].risk_score == pytest.approx((0.15 * 0.8 + 0.1 * (0.25 + 0.02) / 0.7) / 0.25, abs=1e-4)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)], "id int, score double, label int")
    got = {r.metric: r.value for r in Ev.ranking_metrics(rows, (2,)).collect()}
    assert got["roc_auc"] == pytest.approx(0.875) and got["average_precision"] == pytest.approx((1 + 2 / 3) / 2) and got["precision_at_2"] == 0.5


def test_greedy_goes_on(spark):
    q = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0), ("c", 3, 4.0)], "case_id string, queue_rank int, effort_hours double")
    assert {r.case_id for r in W.greedy_capacity(q, 9.0).where("selected").collect()} == {"a", "c"}


def test_folds_and_attributions(spark):
    rows = spark.createDataFrame([(i, f"p{i % 20}", float(i % 7), float(i % 3), int(i % 7 > 4)) for i in range(400)], "claim_id int, provider_id string, a double, b double, label int")
    folds = M.grouped_folds(rows, 4)
    M.audit_folds(folds)
    assert folds.count() == 400 and folds.select("fold").distinct().count() == 4
    model = M._model(("a", "b"), (), 3, 3, 1).fit(M.weighted(rows))
    for r in M.attributions(model, rows.limit(20), ["a", "b"], 2).collect():
        assert r.base + r.contribution == pytest.approx(r.margin, abs=1e-9)


def test_no_future_in_panels(spark):
    c = spark.createDataFrame([("p", D(2024, 1, d), 1.0) for d in (1, 2, 9)], "provider_id string, service_date date, paid_amount double")
    got = {r.service_date.day: (r.claims_7d, r.claims_30d) for r in W.dense_panel(c).collect()}
    assert got[1] == (1, 1) and got[2] == (2, 2) and got[8] == (1, 2) and got[9] == (1, 3) and len(got) == 9
    assert RuleConfig().day_minutes == 960


def test_rules_with_text_ids_and_a_rule_that_fails(spark):
    """Ids may be any text; a rule that fails while it runs is told in the status and takes no other's alerts with it."""
    day = D(2024, 1, 1)
    refs = [(f"R{i}", "PRV002", "PRV009" if i % 2 else "PRV010", f"M{i}", day, f"C{i:03}" if i else None) for i in range(24)]
    t = {"referrals": spark.createDataFrame(refs, "referral_id string, referring_provider_id string, target_provider_id string, member_id string, referral_date date, claim_id string")}
    R.run_rules(spark, t, only=["R07d"])
    boom = F.udf(lambda x: 1 // 0, "string")
    R.register_rule("R99", lambda tables, cfg: R.to_alerts(tables["referrals"].withColumn("bad", boom("referral_id")), "R99", "provider", "bad", F.lit("never"), "LOW"), {"referrals": ("referral_id",)})
    try:
        alerts, status = R.run_rules(spark, t, R.RuleConfig(concentration=0.4), only=["R07a", "R99", "R04a"])
        found = alerts.collect()
    finally:
        R._REGISTRY.pop("R99")
    assert {r.rule: r.status for r in status.collect()} == {"R07a": "ok", "R99": "failed", "R04a": "skipped"}
    # Ties go to the smaller id; claims in order, those without one left out.
    assert [(r.entity_id, r.claim_ids) for r in found] == [("PRV002", [f"C{i:03}" for i in range(1, 24, 2)])]


def test_queries_do_not_pass_over_a_rule_that_fails(spark, sf_dir, monkeypatch):
    """a rule that fails, or that finds a column missing, is no empty result of a query."""
    from claimsieve.queries import network as Q
    from claimsieve.queries import rules as QR

    R.run_rules(spark, {}, only=["R10"])
    boom = F.udf(lambda x: 1 // 0, "string")
    bad = lambda t, c: R.to_alerts(t["claims"].withColumn("bad", boom("claim_id")), "R05", "provider", "bad", F.lit("never"), "LOW")
    for name in ("R05a", "R10"):
        monkeypatch.setitem(R._REGISTRY, name, (bad, R._REGISTRY[name][1]))
    monkeypatch.setattr(Q, "_communities", lambda *a: spark.createDataFrame([("provider:1", "provider:1")], "provider string, community string"))
    monkeypatch.setattr(Q, "_projection", lambda *a: (None, None))
    for query, rule in ((QR.r00, "R10"), (QR.r00_claims, "R05a"), (QR.r00_rows, "R05a"), (Q.n05, "R10")):
        with pytest.raises(RuntimeError, match=f"{rule} failed"):
            query(spark, sf_dir)
    with pytest.raises(RuntimeError, match="R10 skipped"):
        R.alerts_of(spark, {}, only=["R10"])


def test_quantiles_of_skewed_groups(spark):
    """As ``percentile``, with a group of most rows, ties, NULL keys and values, one value, and no values."""
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.random() * 100, 7.0])) for _ in range(3000)] + [(f"g{i % 40}", float(rng.randrange(9))) for i in range(400)] + [(None, 1.0), (None, 4.0), ("one", 3.0), ("none", None), ("hot", None), ("hot", -0.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"a": 0.25, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    got = {r.k: r for r in W.quantiles(df, ["k"], "v", probs).collect()}
    for r in df.groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()), F.count("v").alias("n")).collect():
        assert (r.k not in got) if r.n == 0 else ([got[r.k][n] for n in probs] == [r[n] for n in probs] and got[r.k].n_values == r.n)
    whole = W.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [df.agg(F.percentile("v", F.lit(0.5))).first()[0]]
    assert W.quantiles(df.where("k = 'none'"), ["k"], "v", probs).count() == 0 and W.quantiles(df.limit(0), [], "v", probs).count() == 0
    z = {(r.k, r.v): r for r in W.with_mad_z(df.distinct(), "v", "k").collect()}
    assert len(z) == df.distinct().count() and z[(None, 1.0)].peer_median == 2.5 and z[(None, 1.0)].peer_mad == 1.5 and z[("none", None)].peer_median is None


def test_shapley_is_the_mean_over_orders():
    """Against all orders of features, on random trees that test a feature several times and categories."""
    rng = random.Random(3)

    def grow(nodes, depth):
        me = len(nodes)
        nodes.append(())
        if depth == 0 or rng.random() < 0.15:
            nodes[me] = (-1, 0.0, -1, -1, rng.uniform(-2, 2), False, 0.0)
            return me
        f, share = rng.randrange(4), rng.uniform(0.05, 0.95)
        cut = ([0.0, 2.0], True) if f == 3 else (rng.random(), False)
        left, right = grow(nodes, depth - 1), grow(nodes, depth - 1)
        nodes[me] = (f, cut[0], left, right, nodes[left][4] * share + nodes[right][4] * (1 - share), cut[1], share)
        return me

    def worth(tree, x, known, at=0):
        f, cut, left, right, value, categorical, share = tree[at]
        if f < 0:
            return value
        if f in known:
            return worth(tree, x, known, left if (x[f] in cut if categorical else x[f] <= cut) else right)
        return share * worth(tree, x, known, left) + (1 - share) * worth(tree, x, known, right)

    x = np.array([[rng.random(), rng.random(), rng.random(), float(rng.randrange(3))] for _ in range(6)])
    for depth in (0, 1, 3, 5, 5):
        trees = []
        for _ in range(2):
            trees.append([])
            grow(trees[-1], depth)
        parts, margin = M.shapley([p for t in trees for p in M.leaf_paths(t)], x)
        for row, got, total in zip(x, parts, margin):
            want, orders = np.zeros(4), list(itertools.permutations(range(4)))
            for order in orders:
                for i, f in enumerate(order):
                    want[f] += sum(worth(t, row, set(order[: i + 1])) - worth(t, row, set(order[:i])) for t in trees) / len(orders)
            assert got == pytest.approx(want, abs=1e-12)
            assert total == pytest.approx(sum(worth(t, row, {0, 1, 2, 3}) for t in trees)) and total == pytest.approx(sum(t[0][4] for t in trees) + got.sum())


def test_upcoding_tells_low_complexity_visits(spark):
    """One evidence for the share and one for each of the first ten level-5 visits of low complexity, with short ones told."""
    rows = [(f"c{p}-{i:03}", f"m{i}", f"p{p}", "99215" if p == 0 or i < 3 else "99212", D(2024, 1, 1 + i % 28), 1 if p == 0 and i < 14 else 4, 5.0 if p == 0 and i % 4 == 1 else 40.0) for p in range(9) for i in range(60 + p)]
    claims = spark.createDataFrame(rows, "claim_id string, member_id string, provider_id string, procedure_code string, service_date date, dx_complexity int, service_minutes double")
    tables = {"claims": claims}
    cfg = RuleConfig(min_em_claims=10)
    alerts, status = R.run_rules(spark, tables, cfg, ["R02"])
    assert [s.status for s in status.collect()] == ["ok"]
    flagged = {r.provider_id for r in R.upcoding(tables, cfg).collect()}
    got = {r.entity_id: r for r in alerts.collect()}
    assert set(got) == flagged and "p0" in flagged
    told = got["p0"].evidence
    assert len(told) == 11 and [e.claim_ids for e in told[1:]] == [[f"c0-{i:03}"] for i in range(10)] and {e.severity for e in told[1:]} == {"MEDIUM"} and len({e.evidence_id for e in told}) == 11
    p25 = np.percentile([r[6] for r in rows if r[3] == "99215"], 25)
    for i, e in enumerate(told[1:]):
        short = bool(rows[i][6] < p25)
        assert e.fields_matched == ["em_level", "dx_complexity"] + ["service_minutes"] * short and ("below peer p25" in e.plain_text) == short
    assert all(len(r.evidence) == 1 for p, r in got.items() if p != "p0")


def test_alerts_name_all_their_claims(spark):
    """Lists are cut at two claims here; rows have all, a claim without an id has none, and short lists are taken as they are."""
    day = D(2024, 1, 1)
    rows = [(f"c{i:02d}", f"m{i % 3}", "p", "1", day, 5.0, None, None, 300.0) for i in range(9)] + [(None, "m", "p", "1", day, 5.0, None, None, 300.0), ("z1", "m", "q", "1", day, 5.0, None, None, 10.0)]
    rows += [("d1", "m", "q", "1", day, 7.0, None, None, 1.0), ("d2", "m", "q", "1", day, 7.0, None, None, 1.0)]
    t = {"claims": spark.createDataFrame(rows, CLAIM + ", service_minutes double")}
    cfg = RuleConfig(listed_claims=2, day_minutes=600)
    found, _ = R.run_rules(spark, t, cfg, only=["R01a", "R06a"])
    assert {r.rule_id: len(r.claim_ids) for r in found.collect() if r.rule_id == "R06"} == {"R06": 2}
    got = R.alert_claims(found, t, cfg)
    assert sorted(r.claim_id for r in got.where("rule_id = 'R06'").collect()) == [f"c{i:02d}" for i in range(9)]
    pairs = found.where("rule_id = 'R01'").select("alert_id", F.explode("claim_ids").alias("claim_id"))
    assert sorted(map(tuple, got.where("rule_id = 'R01'").select("alert_id", "claim_id").collect())) == sorted(map(tuple, pairs.collect())) and pairs.count() > 2
    truth = spark.createDataFrame([("R06", f"c{i:02d}", True) for i in range(9)], "rule_id string, claim_id string, is_fraud boolean")
    assert {r.rule_id: (r.tp, r.fn) for r in Ev.claim_quality(got, truth).collect()}["R06"] == (9, 0)
    assert {r.rule_id: (r.tp, r.fn) for r in Ev.claim_quality(found, truth).collect()}["R06"] == (2, 7)
    assert R.alert_claims(found.limit(0), t, cfg).count() == 0 and R.alert_claims(found, {}, cfg).where("rule_id = 'R06'").count() == 2


def test_fixture_cases(spark):
    """Entities of any kind, no claims, no evidence, missing tables, ties in the queue and an empty table."""
    from claimsieve.operators import cases as K

    alert = lambda i, kind, who, rule, sev, money, ids, ev: (i, rule, kind, who, ids, sev, money, ev)
    e = lambda i, text, amount, note="", fields=("f", "g"), ids=("c1",): (i, None, None, list(ids) if ids is not None else None, list(fields), text, amount, None, note)
    kind = "array<struct<evidence_id:string,rule_id:string,rule_version:string,claim_ids:array<string>,fields_matched:array<string>,plain_text:string,est_overpay:double,severity:string,fp_notes:string>>"
    schema = f"alert_id string, rule_id string, entity_type string, entity_id string, claim_ids array<string>, severity string, est_dollars double, evidence {kind}"
    rows = [
        alert("a1", "provider", "p", "R02", "HIGH", 1000.0, ["c1", "c2"], [e(f"e{k}", f"text {k % 6}", 0.0, "note" if k == 3 else "") for k in range(8)]), alert("a2", "provider", "p", "R99", "CRITICAL", None, ["c2", "c3"], [e("e9", "text 0", 5.0, fields=(), ids=None)]),
        alert("a3", "member", "m", "R05", "LOW", 10.0, [], []), alert("a4", "member", "n", "R05", "LOW", 10.0, [], []), alert("a5", "member", None, "R05", "LOW", 10.0, [], []),
    ]
    a = spark.createDataFrame(rows, schema)
    got = {r.case_id: r for r in K.fixture_cases(a).collect()}
    p, m = got["CASE-PRO-p"], got["CASE-MEM-m"]
    assert len(got) == 3 and (p.score, p.priority, p.claims, p.members_affected) == (35 + 24 + 4.5, "HIGH", 3, 1) and p.top_reasons == [f"text {k}" for k in range(4)]
    assert p.why_flagged == ["Triggered R02 (Upcoding)", "Triggered R99 (R99)"] and p.benign_explanations == ["note"] and (p.exposure_low, p.exposure_high, p.network_id) == (800.0, 1200.0, None)
    assert (m.score, m.priority, m.claims, m.exposure_high, m.entity_name) == (20, "LOW", 0, 500.0, "Member m") and m.top_reasons == ["Triggered R05 (Excessive Utilization)"]
    claims = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "x"), ("c4", "z")], "claim_id string, member_id string")
    nets = spark.createDataFrame([("p", "N1", 0.5), (None, "N2", 1.0)], "hub_provider_id string, network_id string, hard_link_score double")
    full = {r.case_id: r for r in K.fixture_cases(a, claims, nets, spark.createDataFrame([("p", "Clinic")], "provider_id string, provider_name string")).collect()}
    assert (full["CASE-PRO-p"].members_affected, full["CASE-PRO-p"].network_id, full["CASE-PRO-p"].network_risk, full["CASE-PRO-p"].entity_name) == (2, "N1", 0.5, "Clinic") and full["CASE-MEM-m"].members_affected == 1
    ledger = {r.evidence_id: r for r in K.fixture_evidence(a).collect()}
    assert len(ledger) == 9 and (ledger["e0"].est_overpay, ledger["e0"].field_name, ledger["e0"].severity, ledger["e0"].fp_notes) == (1000.0, "f, g", "HIGH", None)
    assert (ledger["e9"].est_overpay, ledger["e9"].field_name, ledger["e9"].claim_id, ledger["e9"].source_artifact) == (5.0, "multiple", "c2", "rule_engine/r99")
    queue = {r.case_id: (r.queue_rank, r.effort_hours, r.ev_per_hour) for r in K.fixture_queue(K.fixture_cases(a)).collect()}
    assert queue == {"CASE-PRO-p": (1, 2.3, 521.74), "CASE-MEM-m": (2, 2.0, 250.0), "CASE-MEM-n": (3, 2.0, 250.0)}
    assert K.fixture_cases(a.limit(0)).count() == 0 and K.fixture_evidence(a.limit(0)).count() == 0


def test_unbundling_groups_claims_once(spark):
    """The pairs and the rates come from one grouping of the claims, which is written; a modifier allows a day's pairs."""
    rows = [("c1", 1, 7, "A", 10.0, None), ("c2", 1, 7, "B", 4.0, None), ("c3", 1, 7, "B", 5.0, "X"), ("c4", 2, 7, "A", 1.0, "59"), ("c5", 2, 7, "B", 2.0, None), ("c6", 3, 8, "A", 3.0, None), (None, 1, 7, "A", 1.0, None)]
    claims = materialize(spark.createDataFrame(rows, "claim_id string, member_id long, provider_id long, procedure_code string, paid_amount double, modifier string").withColumn("service_date", F.to_date(F.lit("2024-01-02"))), "bundling-claims")
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "comprehensive_cpt string, component_cpt string")
    found = R.unbundling({"claims": claims, "bundling_pairs": pairs}, R.RuleConfig(override_modifiers=("59",)))
    got = [(r.member_id, r.provider_id, r.comprehensive_cpt, r.component_cpt, r.est_dollars, r.claim_ids) for r in found.collect()]
    assert got == [(1, 7, "A", "B", 9.0, ["c1", "c2", "c3"])]
    assert "bundling-claims" not in found._jdf.queryExecution().toString()


def read_rows(spark, df):
    """The table and how many of its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(seen, df.schema), made


def test_claims_and_referrals_are_made_once(spark):
    """the second package makes claims once for all findings, the runner referrals for all rules; pairs and panels are as before."""
    from claimsieve.operators import variants as V2
    from claimsieve.plans import storage

    day = lambda i: D(2024, 1, 1 + i)
    rows = [(f"c{i}", "m", "p", "99213", day(i), 10.0, 10.0, None, None, 5.0) for i in range(3)] + [("d1", "m", "p", "99213", day(0), 10.0, 10.0, None, None, 5.0), ("e1", "m", "q", "99213", day(0), 10.0, 10.0, None, None, 5.0), ("n1", None, "p", "99213", day(0), 10.0, 10.0, None, None, 5.0), ("n2", None, "p", "99213", day(1), 10.0, 10.0, None, None, 5.0)]
    rows += [(f"l{i}", "m", "r", x, day(0), 1.0 + i, 1.0, None, None, 5.0) for i, x in enumerate(["80061", "82465", "84478", "other", None])]
    claim_table = spark.createDataFrame(rows, "claim_id string, member_id string, provider_id string, procedure_code string, service_date date, billed_amount double, paid_amount double, status string, modifier string, service_minutes double")
    c, made = read_rows(spark, claim_table)
    found = V2.run_detection({"claims": c})
    assert sorted((x.claim_id_a, x.claim_id_b, x.gap) for x in found["near_duplicates"].collect()) == sorted((x.claim_id_a, x.claim_id_b, x.gap) for x in R.near_duplicates({"claims": claim_table}).collect())
    assert [(x.member_id, x.claim_ids, x.est_dollars) for x in found["duplicates"].collect()] == [("m", ["c0", "d1"], 10.0)]
    assert [(x.panel, x.components, x.est_dollars, x.severity) for x in found["panels"].collect()] == [("80061", "82465,84478", 5.0, "HIGH")]
    assert {x.claim_id for x in V2.repeated(claim_table, ["member_id", "provider_id", "procedure_code"]).collect()} == {"c0", "c1", "c2", "d1", "n1", "n2"}
    assert made.value == len(rows)
    c, made = read_rows(spark, claim_table)
    out = V2.detection_output({"claims": c})
    assert out["alerts"].count() == out["evidence"].count() > 0 and out["temporal_features"].count() == 3 and made.value == len(rows)

    refs = [(f"R{i}", "A", f"B{i % 3}", f"m{i}", day(i % 9), f"C{i}") for i in range(24)]
    r, made = read_rows(spark, spark.createDataFrame(refs, "referral_id string, referring_provider_id string, target_provider_id string, member_id string, referral_date date, claim_id string"))
    alerts, status = R.run_rules(spark, {"referrals": r}, RuleConfig(concentration=0.3), only=["R07a", "R07b"])
    assert {x.status for x in status.collect()} == {"ok"} and alerts.count() == 1 and made.value == len(refs)
    assert not [p for p in storage._NAMED.paths if "/referrals-" in p]  # nor kept when the rules are done
