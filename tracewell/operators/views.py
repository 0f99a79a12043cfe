"""Views on scored windows, residuals and attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.detectors import exact_quantiles
from tracewell.schema import FEATURES

KEYS = ("window_start", "src_ip")


def top_rows(scored: DataFrame, by: str, n: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The ``n`` rows of highest ``by``, nulls and NaN left out, ties by the keys."""
    return scored.where(F.col(by).isNotNull() & ~F.isnan(by)).orderBy(F.desc(by), *keys).limit(n)


def latest_long(scored: DataFrame, columns: list[str], n: int = 500, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last ``n`` windows, one row for each of their ``columns``."""
    last = scored.where(F.col(keys[0]).isNotNull()).orderBy(*(F.desc(k) for k in keys)).limit(n).select(*keys, *columns)
    return last.unpivot(list(keys), columns, "series", "value")


def repeatable_sample(rows: DataFrame, keys: tuple[str, ...], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of the keys, the same ones however rows are partitioned."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return rows.orderBy(F.md5(text), *keys).limit(n)


def reading_card(scored: DataFrame, value: str, anomaly: Column) -> DataFrame:
    """Scored and anomalous windows, and the highest, lowest and mean value, in one row."""
    return scored.agg(F.count("*").alias("windows"), F.count_if(anomaly).alias("anomalous"), F.max(value).alias("highest"), F.min(value).alias("lowest"), F.avg(value).alias("mean"))


def score_summary(scored: DataFrame, score: str, anomaly: Column) -> DataFrame:
    """Extremes, mean, median and 0.99 quantile of scores, the share of anomalies, and the gap: the difference of both groups' medians, or the 0.95 quantile less the median if there is one group."""
    marked = scored.select(score, anomaly.alias("_anomaly"))
    median, p95, p99 = exact_quantiles(marked, score, (0.5, 0.95, 0.99))
    high, low = (exact_quantiles(marked.where(F.col("_anomaly") == on), score, (0.5,))[0] for on in (True, False))
    gap = high - low if high is not None and low is not None else (None if p95 is None else p95 - median)
    of = lambda v, n: F.lit(v).cast("double").alias(n)
    found = marked.agg(F.min(score).alias("lowest"), F.avg(score).alias("mean"), F.max(score).alias("highest"), F.avg(F.col("_anomaly").cast("int")).alias("anomaly_rate"))
    return found.select("lowest", "mean", "highest", "anomaly_rate", of(median, "median"), of(p99, "p99"), of(gap, "gap"))


def attribution_summary(long: DataFrame) -> DataFrame:
    """Mean absolute and mean value of each feature of a long table, and its dense rank by the first."""
    means = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))
    return means.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc(F.round("mean_abs", 12)))))  # a row for each feature


def attribution_values(explained: DataFrame, top: int = 15, features: list[str] = FEATURES, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each explained window and each of the ``top`` features of largest mean absolute attribution: its value, the value's percentile among the windows, the attribution, score and label.

    ``explained`` has the features, ``attribution``, ``isolation_score`` and ``predicted_label``. Equal means go by the feature's name.
    """
    size = attribution_summary(explained.select(*keys, F.inline(_named("attribution", features))))
    first = size.orderBy(F.desc(F.round("mean_abs", 12)), "feature").limit(top).select("feature")
    pair = F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("feature_value"), F.get("attribution", F.lit(k)).alias("attribution")) for k, f in enumerate(features)))
    long = explained.select(*keys, "isolation_score", "predicted_label", F.inline(pair)).join(F.broadcast(first), "feature")  # at most a row for each feature
    return percentile_rank(long, "feature", "feature_value").select(*keys, "feature", "feature_value", F.col("percentile").alias("feature_percentile"), "attribution", "isolation_score", "predicted_label")


def dependency(values: DataFrame) -> DataFrame:
    """Of a table of `attribution_values` the rows of the one feature of largest mean absolute attribution: how its value goes with its attribution."""
    strongest = values.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("size")).orderBy(F.desc(F.round("size", 12)), "feature").limit(1).select("feature")
    return values.join(F.broadcast(strongest), "feature").drop("feature_percentile")


def _named(column: str, features: list[str]) -> Column:
    return F.zip_with(F.array(*map(F.lit, features)), F.col(column), lambda n, v: F.struct(n.alias("feature"), v.alias("value")))


def percentile_rank(rows: DataFrame, by: str, col: str) -> DataFrame:
    """Adds ``percentile``: the mean rank of equal values within ``by``, as a share of its rows. Equal values are counted before they are ranked."""
    counts = rows.groupBy(by, col).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy(col)
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("percentile", (upto - (F.col("_n") - 1) / 2) / F.sum("_n").over(Window.partitionBy(by)))
    named = ranked.select(F.col(by).alias("_by"), F.col(col).alias("_col"), "percentile")
    return rows.join(named, F.col(by).eqNullSafe(F.col("_by")) & F.col(col).eqNullSafe(F.col("_col"))).drop("_by", "_col")


def residual_weights(windows: DataFrame, residuals: DataFrame, features: list[str] = FEATURES, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each feature its correlation with its own residual over windows joined on the keys (0 with fewer than three or without variation), and its mean residual as a share of the largest.

    ``residuals`` is a long table of ``feature`` and ``value``.
    """
    values = windows.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))))
    both = values.join(residuals, [*keys, "feature"])
    x, y = F.col("x"), F.col("value")
    found = both.groupBy("feature").agg(F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("correlation"), F.avg(y).alias("mean_residual"))
    share = F.coalesce(F.try_divide("mean_residual", F.max("mean_residual").over(Window.partitionBy())), F.lit(0.0))  # a row for each feature
    return found.select("feature", F.coalesce("correlation", F.lit(0.0)).alias("correlation"), "mean_residual", share.alias("relative_weight"))


def feature_summary(windows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Rows, sources, first and last window and the list of features, in one row."""
    return windows.agg(F.count("*").alias("windows"), F.countDistinct("src_ip").alias("sources"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window")).withColumns({"feature_count": F.lit(len(features)), "features": F.array(*map(F.lit, features))})


def misaligned(windows: DataFrame, events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Windows whose number of queries isn't that of the events of their time and source, and events without a window: empty if all is well."""
    counted = events.groupBy(F.window("ts", size).getField("start").alias("window_start"), "src_ip").agg(F.count("*").alias("events"))
    both = windows.select(*KEYS, "total_queries").join(counted, list(KEYS), "full")
    return both.where(~F.col("events").eqNullSafe(F.col("total_queries")))
