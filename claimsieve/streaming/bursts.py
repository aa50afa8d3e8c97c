"""Streaming forms of the daily and weekly rules: windowed sums with a watermark over a stream of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overload_stream(claims: DataFrame, time: str = "service_start_ts", lateness: str = "1 day", most: float = 960) -> DataFrame:
    """Provider days with more service minutes than allowed; a day is final once the watermark has passed it."""
    daily = claims.withWatermark(time, lateness).groupBy("provider_id", F.window(time, "1 day")).agg(F.sum("service_minutes").alias("total_minutes"), F.count(F.lit(1)).alias("claim_count"))
    return daily.where(F.col("total_minutes") > most).select("provider_id", F.to_date("window.start").alias("service_date"), "total_minutes", "claim_count")


def weekly_amount_stream(claims: DataFrame, time: str = "service_start_ts", lateness: str = "7 days") -> DataFrame:
    """Dollars of a provider by Monday week (1970-01-05 was a Monday), as the batch panel has them."""
    w = F.window(time, "7 days", "7 days", "4 days")
    return claims.withWatermark(time, lateness).groupBy("provider_id", w).agg(F.sum(F.coalesce("paid_amount", F.lit(0.0))).alias("weekly_amount"), F.count(F.lit(1)).alias("weekly_claims")).select("provider_id", F.to_date("window.start").alias("week_start"), "weekly_amount", "weekly_claims")
