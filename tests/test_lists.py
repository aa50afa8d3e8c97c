"""Lists of claims that rows carry stay out of what is ranked and written for the queue."""

from claimsieve.operators import windows as W
from claimsieve.queries import work


def test_queue_ranks_without_lists(spark, sf_dir, monkeypatch):
    seen, plain = [], W.ranked
    monkeypatch.setattr(W, "ranked", lambda df, order, out: (seen.append((out, set(df.columns))), plain(df, order, out))[1])
    queue = work._queue(spark, sf_dir)
    assert [out for out, _ in seen] == ["case_rank", "queue_rank"]
    assert not any(columns & set(work._LISTS) for _, columns in seen) and not set(queue.columns) & set(work._LISTS)
    assert queue.where("claim_count > 0").count() > 0


def test_both_forms_are_of_one_computation(spark, tmp_path):
    """the table is not computed again for its CSV, which is compressed."""
    import random

    from pyspark.sql import functions as F

    from claimsieve.sources import tables as T

    number = F.udf(lambda: random.random(), "double").asNondeterministic()
    T.write_both(spark.range(2000).withColumn("x", number()).withColumn("text", F.lit("one text " * 20)), f"{tmp_path}/a")
    other = T.read_either(spark, f"{tmp_path}/a.csv").select(F.col("id").cast("long"), F.col("x").cast("double").alias("y"), F.col("text").alias("t"))
    assert T.read_either(spark, f"{tmp_path}/a.parquet").join(other, "id").where("x = y and text = trim(t) || ' '").count() == 2000
    assert sum(p.stat().st_size for p in (tmp_path / "a.csv").iterdir()) < 100_000


def test_detail_writes_lists_of_one_case(spark, sf_dir, monkeypatch):
    """claims and alerts of other cases are not written."""
    from claimsieve.queries import work as W

    rows = {}

    def seen(df, name="table", plain=W.materialize):
        out = plain(df, name)
        rows[name] = out.count() if "case_claims" in out.columns else 0
        return out

    monkeypatch.setattr(W, "materialize", seen)
    parts = {r.part for r in W.q03(spark, sf_dir).select("part").distinct().collect()}
    assert {"case", "alerts", "claims", "evidence"} <= parts and [n for n in rows.values() if n] == [1]
