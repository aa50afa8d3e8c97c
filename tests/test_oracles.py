"""Every query with SQL against DuckDB on the smallest tables; the others against what must hold of them, or brute force."""

import glob
import os

import duckdb
import pytest

import claimsieve.queries as Q

ENTRIES = Q._entries()


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(float(x), 9) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ENTRIES.items() if sql))
def test_oracle(spark, sf_dir, duck, name):
    f, sql = ENTRIES[name]
    df = f(spark, sf_dir)
    c = duck.execute(sql)
    columns = [x[0] for x in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(c.fetchall(), columns)


def q(spark, sf_dir, name):
    return ENTRIES[name][0](spark, sf_dir).collect()


def test_folds(spark, sf_dir):
    rows = q(spark, sf_dir, "m02_grouped_folds")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3, 4] and sum(r.n for r in rows) == events.count() and sum(r.providers for r in rows) == events.select("user_id").distinct().count()
    assert max(r.providers for r in rows) - min(r.providers for r in rows) <= 1


def test_claim_scores_and_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = q(spark, sf_dir, "m03_claim_scores")
    assert sum(r.n for r in rows) == n and all(0 <= r.least <= r.most <= 1 for r in rows)
    table = q(spark, sf_dir, "m07_claim_table")
    assert sum(r.n for r in table) == n and sorted(r.oof_fold for r in table) == [0, 1, 2] and not any(r.differ for r in table) and all(r.first_reasons >= 1 and r.most > 0 for r in table)


def test_attributions_sum_to_margins(spark, sf_dir):
    rows = q(spark, sf_dir, "m06_attributions")
    assert not any(r.unreconciled for r in rows) and {r.reason_1 for r in rows} <= {"paid_amount", "service_minutes", "member_total_claims", "dist_member_provider_miles"}


def test_anomaly_and_future(spark, sf_dir):
    rows = q(spark, sf_dir, "m08_provider_anomaly")
    by = sorted(rows, key=lambda r: r.anomaly_score)
    assert all(0 < r.anomaly_score < 1 for r in rows) and [r.anomaly_percentile for r in by] == sorted(r.anomaly_percentile for r in rows)
    assert all(a.anomaly_flag <= b.anomaly_flag for a, b in zip(by, by[1:])) and sum(r.anomaly_flag for r in rows) <= max(1, len(rows) // 10)
    future = q(spark, sf_dir, "m11_future_risk")
    assert len({r.provider_id for r in future}) == len(future) > 0 and all(0 <= x <= 1 for r in future for x in (r.risk_30d, r.risk_60d, r.risk_90d))


def test_ablation_and_baselines(spark, sf_dir):
    rows = q(spark, sf_dir, "m12_ablation")
    assert {r.experiment for r in rows} == {"all", "amounts"}
    auc = {r.experiment: r.value for r in rows if r.metric == "roc_auc"}
    assert auc["all"] > 0.9 > auc["amounts"]  # labels are made from the amount
    random = {r.metric: r.value for r in q(spark, sf_dir, "m14_baselines") if r.ranker == "random"}
    assert 0.35 < random["roc_auc"] < 0.65 and 0 <= random["precision_at_50"] <= 1


def test_learning_run(spark, sf_dir):
    rows = {(r.part, r.metric): r.value for r in q(spark, sf_dir, "m16_learning_run")}
    assert {p for p, _ in rows} == {"claims", "calibration", "anomaly", "future_30", "future_60", "future_90"}
    assert rows["claims", "roc_auc"] > 0.9 and 0 <= rows["calibration", "ece"] <= 1 and rows["anomaly", "n_providers"] > 0


def test_communities_by_definition(spark, sf_dir):
    """Communities part the providers, hang together, and no provider alone would raise the modularity by a move."""
    from claimsieve.operators import graph as N
    from claimsieve.queries import network as W

    p = W._projection(spark, sf_dir)[0]
    of = {r.provider: r.community for r in N.communities(p).collect()}
    edges = [(r.u, r.v, r.weight) for r in N.connections(p).collect()]
    k, total = {}, 2 * sum(w for *_, w in edges)
    for u, v, w in edges:
        k[u], k[v] = k.get(u, 0) + w, k.get(v, 0) + w
    assert set(of) <= set(k)

    def quality(label):
        inside, size = sum(2 * w for u, v, w in edges if label[u] == label[v]), {}
        for u, x in k.items():
            size[label[u]] = size.get(label[u], 0) + x
        return inside / total - sum((s / total) ** 2 for s in size.values())

    full = {u: of.get(u, u) for u in k}
    assert quality(full) >= quality(dict.fromkeys(k, "one")) - 1e-9
    for u in k:
        for c in {full[v] for x, v, _ in edges if x == u} | {full[v] for v, x, _ in edges if x == u}:
            assert quality(full | {u: c}) <= quality(full) + 1e-6
    table = q(spark, sf_dir, "n04_communities")
    assert sum(r.size for r in table) == len(of) and all(sorted(x for x, c in of.items() if c == r.community) == r.providers.split(",") for r in table)
    nets = q(spark, sf_dir, "n07_networks")
    assert sorted(r.network_id for r in nets) == [f"NET-{i + 1:04}" for i in range(len(table))] and sum(r.claim_count for r in nets) <= 6200
    enriched = {r.community: r for r in q(spark, sf_dir, "n05_enriched")}
    assert {r.community: r.claim_count for r in nets} == {c: r.claim_count for c, r in enriched.items()}
    features = {r.provider: r for r in q(spark, sf_dir, "n06_features")}
    assert set(features) >= set(k) and all(abs(features[u].weighted_degree - x) <= 0.0051 for u, x in k.items())


def test_betweenness_of_the_projection(spark, sf_dir):
    rows = q(spark, sf_dir, "n08_betweenness")
    assert len(rows) == 10 and all(0 <= r.betweenness <= 1 for r in rows)


def test_fuzzy_owners_against_all_pairs(spark, sf_dir):
    from pyspark.sql import functions as F

    from claimsieve.functions import columns as C
    from claimsieve.queries import network as W

    p = W._owners(spark, sf_dir).select(C.normal_name(F.col("owner_name")).alias("plain"), C.normal_name(F.col("owner_name"), True).alias("owner"))
    names = p.groupBy("owner").agg(F.min("plain").alias("plain"))
    other = names.select(F.col("owner").alias("o"), F.col("plain").alias("b"))
    score = F.greatest(C.token_set_ratio("plain", "b"), C.token_set_ratio("owner", "o"))
    want = {f"{r.owner} ~ {r.o}" for r in names.crossJoin(other).where("owner < o").withColumn("s", score).where("s >= 88").collect()}
    assert {r.detail for r in q(spark, sf_dir, "e05_owner_fuzzy")} == want


def test_detection_counts(spark, sf_dir):
    rows = {r.finding: r.n for r in q(spark, sf_dir, "d12_detection")}
    assert {"duplicates", "near_duplicates", "panels", "days", "shared", "bursts", "upcoding", "volume"} <= set(rows) and all(n >= 0 for n in rows.values())


def test_entry_names():
    import __spark_entry__ as e

    assert set(ENTRIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_time_and_record_of_all_suppliers(spark, sf_dir):
    want = {str(r.s_suppkey) for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    assert {r.provider_id for r in q(spark, sf_dir, "u06_time_and_record")} == want
