"""Windows and panels over claims and referrals. NULL keys and dates take no part, as in a grouping that drops them."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions.columns import week_start


def rolling_days_count(df: DataFrame, keys: list[str], date: str = "service_date", days: int = 30, out: str = "rolling_count") -> DataFrame:
    """Rows of the same keys from ``days`` before to the same day, ties included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-days, 0)
    known = F.col(date).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.where(known).withColumn(out, F.count(F.lit(1)).over(w))


def daily_summary(claims: DataFrame) -> DataFrame:
    """Minutes and claims of a provider by day; NULL minutes count as 0."""
    return claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", "service_date").agg(
        F.sum(F.coalesce("service_minutes", F.lit(0.0))).alias("total_minutes"), F.count(F.lit(1)).alias("claim_count")
    )


def weekly_panel(claims: DataFrame, amount: str = "paid_amount") -> DataFrame:
    """Dollars and claims of a provider by Monday week, active weeks only; NULL amounts count as 0."""
    return claims.where("provider_id is not null and service_date is not null").groupBy("provider_id", week_start(F.col("service_date")).alias("week_start")).agg(
        F.sum(F.coalesce(amount, F.lit(0.0))).alias("weekly_amount"), F.count(F.lit(1)).alias("weekly_claims")
    )


def trailing_median(panel: DataFrame, weeks: int = 12, value: str = "weekly_amount") -> DataFrame:
    """Median of up to ``weeks`` rows before this one, and how many there are."""
    order = Window.partitionBy("provider_id").orderBy("week_start")
    before = order.rowsBetween(-weeks, -1)
    return panel.withColumn("trailing_median", F.percentile(value, F.lit(0.5)).over(before)).withColumn("history_weeks", F.least(F.row_number().over(order) - 1, F.lit(weeks)))


def dense_panel(claims: DataFrame, snapshot: str | None = None, spans: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """A row for each provider and day from the first claim to the last, with sums over the last days, this one included."""
    rows = claims.where("provider_id is not null and service_date is not null")
    if snapshot:
        rows = rows.where(F.col("service_date") <= F.to_date(F.lit(snapshot)))
    daily = rows.groupBy("provider_id", "service_date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("paid_amount", F.lit(0.0))).alias("amount"))
    days = daily.groupBy("provider_id").agg(F.explode(F.sequence(F.min("service_date"), F.max("service_date"))).alias("service_date"))
    dense = days.join(daily, ["provider_id", "service_date"], "left").fillna(0, ["n", "amount"])
    order = Window.partitionBy("provider_id").orderBy(F.unix_date("service_date"))
    return dense.select(
        "provider_id",
        "service_date",
        *(F.sum("n").over(order.rangeBetween(1 - d, 0)).alias(f"claims_{d}d") for d in spans),
        *(F.sum("amount").over(order.rangeBetween(1 - d, 0)).alias(f"amount_{d}d") for d in spans),
    )


def next_in(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the next row of the same key as ``next_*``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def weekly_zscore(referrals: DataFrame, weeks: int = 12) -> DataFrame:
    """Referrals sent by week against the mean and population deviation of exactly ``weeks`` active weeks before.

    From whole sums of counts and of their squares, so that a deviation of 0 and a z at a limit are exact.
    """
    weekly = referrals.where("referring_provider_id is not null and referral_date is not null").groupBy("referring_provider_id", week_start(F.col("referral_date")).alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("referring_provider_id").orderBy("week_start")
    before = order.rowsBetween(-weeks, -1)
    k, total, squares = F.count("n").over(before), F.sum("n").over(before), F.sum(F.col("n") * F.col("n")).over(before)
    out = weekly.withColumns({"_k": k, "_s": total, "row": F.row_number().over(order)}).withColumn("_v", F.col("_k") * squares - F.col("_s") * F.col("_s"))
    out = out.withColumns({"mean": F.when(F.col("_k") > 0, F.col("_s") / F.col("_k")), "std": F.when(F.col("_k") > 0, F.sqrt("_v") / F.col("_k"))})
    return out.withColumn("z", F.when((F.col("row") > weeks) & (F.col("_v") > 0), (F.col("_k") * F.col("n") - F.col("_s")) / F.sqrt("_v"))).drop("row", "_k", "_s", "_v")


def activity_runs(claims: DataFrame, key: str = "provider_id", date: str = "service_date") -> DataFrame:
    """Longest run of active days on end, share of them on weekends, and their number."""
    days = claims.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(key, F.col(date).alias("d")).distinct()
    island = F.unix_date("d") - F.row_number().over(Window.partitionBy(key).orderBy("d"))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("run"), F.sum((F.weekday("d") >= 5).cast("int")).alias("weekend"))
    return runs.groupBy(key).agg(F.max("run").alias("longest_run"), (F.sum("weekend") / F.sum("run")).alias("weekend_ratio"), F.sum("run").alias("active_days"))


def median_of(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``keys``, a column for each of ``probs`` and ``n_values``: exact quantiles of groups of any size, NULL values left out.

    Numbers are those of ``percentile`` (linear between ranks). Values are counted in each task first, ranged by group and value,
    and ranks are sums over ranges, so that a group with most rows is dealt to many tasks and none holds its values. A NULL key
    is a group; a group without values has no row.
    """
    from claimsieve.plans.storage import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = materialize(counts.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    # As many rows as groups and partitions together: only a group that spans partitions has several.
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("_part").alias("_b_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("n_values"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys), F.col("_part") == F.col("_b_part"))
    rows = dealt.withColumn("_own", own).join(base, met).withColumn("_below", F.col("_own") + F.col("_base"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))

    places = {name: (F.col("n_values") - 1) * F.lit(float(p)) for name, p in probs.items()}
    found = rows.groupBy(*keys, "n_values").agg(*(c for name, x in places.items() for c in (at(F.floor(x)).alias(f"_low_{name}"), at(F.ceil(x)).alias(f"_high_{name}"))))

    def between(name: str) -> Column:
        low, high, x = F.col(f"_low_{name}"), F.col(f"_high_{name}"), places[name]
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name)

    return found.select(*keys, *map(between, probs), "n_values")


def with_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Rows with the quantiles of their group, NULL where it has no values."""
    found = quantiles(df, keys, value, probs).select(*(F.col(k).alias(f"_q_{k}") for k in keys), *probs)
    return df.join(found, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys)), "left").drop(*(f"_q_{k}" for k in keys))


def with_mad_z(df: DataFrame, value: str, peer: str) -> DataFrame:
    """Peer median, MAD and robust z (by 1.4826 MAD) of each row; a MAD of 0 gives 0. Groups of any size, see ``quantiles``."""
    from claimsieve.plans.storage import materialize

    df = with_quantiles(materialize(df, "metrics"), [peer], value, {"peer_median": 0.5})
    df = with_quantiles(df.withColumn("_dev", F.abs(F.col(value) - F.col("peer_median"))), [peer], "_dev", {"peer_mad": 0.5}).drop("_dev")
    return df.withColumn("mad_z", F.when(F.col("peer_mad") > 0, (F.col(value) - F.col("peer_median")) / (1.4826 * F.col("peer_mad"))).otherwise(0.0))


def percent_rank_average(df: DataFrame, value: str, out: str = "percentile", partitions: int = 64) -> DataFrame:
    """Rank in percent with the mean rank for ties: counts per distinct value are ranked, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    below, total = cumulative(counts, value, "_n")
    return df.join(below.join(F.broadcast(total)).select(value, ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_all") * 100).alias(out)), value, "left")


def cumulative(counts: DataFrame, order: str, n: str, ascending: bool = True) -> tuple[DataFrame, DataFrame]:
    """``_below``: the sum of ``n`` over all rows before, in a total order, without a window over one partition.

    Rows are ranged into partitions, summed by partition, and each partition adds what stands before it.
    """
    key = F.col(order).asc() if ascending else F.col(order).desc()
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    from claimsieve.plans.storage import materialize

    dealt = materialize(dealt, "ranged")
    sums = dealt.groupBy("_part").agg(F.sum(n).alias("_sum"))
    # As many rows as partitions.
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn("_below", F.col("_own") + F.col("_base")).drop("_part", "_own", "_base"), sums.agg(F.sum("_sum").alias("_all"))


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number rows from 1 in a total order, without a window over one partition: as ``cumulative`` adds, for counts of rows."""
    from claimsieve.plans.storage import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as partitions.
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn(out, (F.col("_own") + F.col("_base")).cast("int")).drop("_part", "_own", "_base")


def greedy_capacity(items: DataFrame, capacity: float, order: str = "queue_rank", effort: str = "effort_hours", key: str = "case_id") -> DataFrame:
    """Take each item in order if it still fits, else go on (an item that doesn't fit leaves room for later ones).

    In rounds: of the items that still fit the longest run from the front is taken by a running sum over ranges; behind it, what
    no longer fits is dropped. Each round takes an item at least, and few are needed once the room is less than most items.
    Hours are added as decimals of six places, so that what fills the room to the last tenth fits.
    """
    from claimsieve.plans.storage import materialize

    rest = items.select(F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("_o"), F.col(effort).cast("double").try_cast("decimal(24,6)").alias("_e")).where("_e is not null")
    room = Decimal(str(capacity)).quantize(Decimal("0.000001"))
    used, parts = Decimal(0), []
    while True:
        below, _ = cumulative(rest.where(F.col("_e") <= F.lit(room - used)), "_o", "_e")
        taken = materialize(below.withColumn("hours_used", F.lit(used) + F.col("_below") + F.col("_e")).where(F.col("hours_used") <= F.lit(room)).select("_o", "hours_used"), "taken")
        last = taken.agg(F.max("hours_used").alias("used"), F.max("_o").alias("o")).first()
        if last["used"] is None:
            break
        parts.append(taken)
        used = last["used"]
        end = F.struct(F.lit(last["o"]["o"]).cast(items.schema[order].dataType).alias("o"), F.lit(last["o"]["k"]).cast(items.schema[key].dataType).alias("k"))
        rest = rest.where(F.col("_o") > end)
    if not parts:
        return items.withColumns({"hours_used": F.lit(None).cast("double"), "selected": F.lit(False)})
    chosen = reduce(lambda a, b: a.unionByName(b), parts).select(F.col("_o.k").alias(key), F.col("hours_used").cast("double").alias("hours_used"))
    return items.join(chosen, key, "left").withColumn("selected", F.col("hours_used").isNotNull())


def same_day_events(claims: DataFrame) -> DataFrame:
    """Days on which a member has several claims."""
    return claims.where("member_id is not null and service_date is not null").groupBy("member_id", "service_date").agg(
        F.count(F.lit(1)).alias("claim_count"), F.countDistinct("provider_id").alias("provider_count"), F.sum("paid_amount").alias("total_paid")
    ).where("claim_count > 1")


def referral_history(referrals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Referrals sent by provider with first and last day, and by pair."""
    rows = referrals.where("referring_provider_id is not null")
    sent = rows.groupBy("referring_provider_id").agg(F.count(F.lit(1)).alias("total_sent"), F.min("referral_date").alias("first_date"), F.max("referral_date").alias("last_date"))
    return sent, rows.where("target_provider_id is not null").groupBy("referring_provider_id", "target_provider_id").agg(F.count(F.lit(1)).alias("n"))
