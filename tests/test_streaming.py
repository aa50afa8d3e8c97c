"""A stream of claims gives what the batch panel gives, once its watermark has passed."""

from claimsieve.operators.windows import weekly_panel
from claimsieve.queries.common import event_claims
from claimsieve.streaming.bursts import overload_stream, weekly_amount_stream


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, sf_dir, tmp_path):
    batch = event_claims(spark, sf_dir).withColumn("service_start_ts", __import__("pyspark").sql.functions.col("service_start_ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {(r.provider_id, r.week_start): round(r.weekly_amount, 2) for r in run(spark, weekly_amount_stream(rows), "weekly").collect()}
    want = {(r.provider_id, r.week_start): round(r.weekly_amount, 2) for r in weekly_panel(batch).collect()}
    assert got == want
    days = run(spark, overload_stream(rows, most=100), "days")
    assert days.count() == batch.groupBy("provider_id", "service_date").agg({"service_minutes": "sum"}).where("`sum(service_minutes)` > 100").count()
