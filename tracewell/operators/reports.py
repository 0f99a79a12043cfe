"""Statistics of events and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dataset_stats(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Totals, sources, span, and distinct (source, bucket) pairs of a table of events, in one row."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds)
    pairs = events.groupBy("src_ip", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    sources = pairs.groupBy("src_ip").agg(F.sum("n").alias("n"), F.count("*").alias("windows"), F.min("low").alias("low"), F.max("high").alias("high"))
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"), F.count("*").alias("source_ips"), F.coalesce(F.sum("windows"), F.lit(0)).alias("source_windows"), F.min("low").alias("first_ts"), F.max("high").alias("last_ts"))
    span = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    return total.withColumn("span_seconds", span).withColumn("avg_queries_per_window", F.try_divide(F.col("total_queries").cast("double"), F.col("source_windows")))


def source_stats(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Queries, distinct buckets, minutes that they cover, and the first and last time of each source."""
    pairs = events.groupBy("src_ip", F.floor(F.unix_timestamp("ts") / seconds).alias("bucket")).agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    return pairs.groupBy("src_ip").agg(
        F.sum("n").alias("queries"), F.count("*").alias("windows"), (F.count("*") * (seconds / 60)).alias("minutes"), F.min("low").alias("first_ts"), F.max("high").alias("last_ts")
    )


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("alerts"), F.count_if(F.col("severity").isin("high", "critical")).alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"),
        F.countDistinct("src_ip").alias("sources"), F.round(F.avg("threat_score"), 1).alias("mean_score"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def per_hour(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_trunc("hour", "window_start").alias("hour"), "src_ip").agg(F.count("*").alias("alerts"))


def source_report(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("src_ip").agg(F.count("*").alias("alerts"), F.max("threat_score").alias("max_score"), F.avg("threat_score").alias("mean_score"))


def top_sources(alerts: DataFrame, n: int = 10) -> DataFrame:
    return source_report(alerts).orderBy(F.desc("alerts"), "src_ip").limit(n)


def method_counts(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.explode("heuristics_fired").alias("method")).groupBy("method").agg(F.count("*").alias("alerts"))


def top_domains(domains: DataFrame, n: int = 20) -> DataFrame:
    """Domains by the number of window and source pairs that list them."""
    found = domains.groupBy("query").agg(F.count("*").alias("alerts"), F.sum("count").alias("queries"), F.max("suspicion_score").alias("max_score"), F.round(F.max("max_entropy"), 4).alias("max_entropy"))
    return found.orderBy(F.desc("alerts"), F.desc("queries"), F.desc("max_score"), "query").limit(n)


def scaler(windows: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population standard deviation of each feature, one row each."""
    stats = windows.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in features))).alias("x")).select("x.*")


def histogram(values: DataFrame, col: str, bins: int, by: str) -> DataFrame:
    """Counts of equal bins from the smallest to the largest value, for each ``by``; the largest value belongs to the last bin."""
    ends = values.agg(F.min(col).alias("low"), F.max(col).alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("low"), step)), F.lit(0)))
    return values.where(F.col(col).isNotNull()).join(F.broadcast(ends)).select(by, place.cast("long").alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))


def feature_correlation(windows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with ``target``; 0 with fewer than three rows or where one doesn't vary."""
    y = F.col(target).cast("double")
    def one(c: str):
        x = F.col(c).cast("double")
        return F.when(F.count(target) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(c)
    pairs = [one(c) for c in features]
    return windows.agg(*pairs).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("correlation")) for c in features))).alias("x")).select("x.*")


def readiness(events: DataFrame, now, seconds: int = 300) -> DataFrame:
    """New records, completed pairs of window and source, and records whose window isn't over at ``now``."""
    open_from = F.floor(F.unix_timestamp(now) / seconds)
    bucket = F.floor(F.unix_timestamp("ts") / seconds)
    pairs = events.groupBy("src_ip", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    done = F.col("bucket") < open_from
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(done).alias("completed"), F.coalesce(F.sum(F.when(~done, F.col("n"))), F.lit(0)).alias("pending"))


def keep_bounded(history: DataFrame, keys: list[str], seq: str, limit: int = 5000) -> DataFrame:
    """Of stored rows the last of each key, and of these the last ``limit``."""
    last = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return history.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth").orderBy(F.desc(seq), *keys).limit(limit)
