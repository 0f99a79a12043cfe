"""Suspicious domains of a window and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.events import settled

#: Reasons in order, their conditions on an event with features, and their points.
REASONS = (
    ("long_query", "query_len >= 80", 2), ("high_entropy", "entropy >= 4.0D", 2), ("long_label", "max_label_len >= 50", 2),
    ("deep_subdomain", "label_count >= 5", 1), ("high_digit_ratio", "digit_ratio >= 0.30D", 1), ("high_hyphen_ratio", "hyphen_ratio >= 0.15D", 1),
    ("txt_record", "qtype_name = 'TXT'", 2), ("nxdomain", "rcode_name = 'NXDOMAIN'", 1), ("servfail", "rcode_name = 'SERVFAIL'", 1),
    ("many_answers", "answer_count >= 4", 2), ("low_ttl", "is_low_ttl = 1", 2),
)
#: Columns of events that the ranking needs.
MEASURED = ("ts", "src_ip", "query_clean", "qtype_name", "rcode_name", "entropy", "query_len", "max_label_len", "digit_ratio", "answer_count", "answers", "ttl_min_event", "ttl_avg_event")


def reasons() -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(test), F.lit(name)) for name, test, _ in REASONS)))


def suspicious_domains(events: DataFrame, size: str = "5 minutes", top: int = 20) -> DataFrame:
    """The ``top`` domains of each window and source that have a reason, by score, count, answers, entropy, length and name.

    Events are matched to windows by the equality of bucket and source. One row per domain reaches the ranking. Different answers are counted in two steps, each its own key, so that no row holds those of a busy name.
    """
    marked = settled(events.select(*MEASURED, reasons().alias("reasons"))).where(F.size("reasons") > 0)
    marked, key = marked.withColumns({"window_start": F.window("ts", size).getField("start"), "query": F.col("query_clean")}), ["window_start", "src_ip", "query"]
    answered = marked.select(*key, F.explode("answers").alias("_answer")).distinct().groupBy(*key).agg(F.count("*").alias("unique_answer_ips"))
    grouped = marked.groupBy(*key).agg(
        F.count("*").alias("count"), F.sort_array(F.collect_set("qtype_name")).alias("qtypes"), F.sort_array(F.collect_set("rcode_name")).alias("rcodes"),
        F.max("entropy").alias("max_entropy"), F.avg("entropy").alias("avg_entropy"), F.max("query_len").alias("max_query_len"), F.max("max_label_len").alias("max_label_len"),
        F.avg("digit_ratio").alias("avg_digit_ratio"), F.max("answer_count").alias("answer_count_max"),
        F.min("ttl_min_event").alias("ttl_min"), F.avg("ttl_avg_event").alias("ttl_avg"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    grouped = grouped.alias("a").join(answered.alias("b"), same, "left").select("a.*", F.coalesce("b.unique_answer_ips", F.lit(0)).cast("long").alias("unique_answer_ips"))
    score = sum((F.when(F.array_contains("reasons", name), points).otherwise(0) for name, _, points in REASONS), F.lit(0))
    order = [F.desc("suspicion_score"), F.desc("count"), F.desc("unique_answer_ips"), F.round("max_entropy", 9).desc(), F.desc("max_query_len")]
    ranked = F.row_number().over(Window.partitionBy("window_start", "src_ip").orderBy(*order, "query"))
    return grouped.withColumn("suspicion_score", score).withColumn("rank", ranked).where(F.col("rank") <= top)


def context_domains(events: DataFrame, found: DataFrame, size: str = "5 minutes", top: int = 10) -> DataFrame:
    """For windows and sources without a suspicious domain: their ``top`` domains by queries, ties by name."""
    window = F.window("ts", size).getField("start").alias("window_start")
    counts = events.where("query_clean != ''").groupBy(window, "src_ip", F.col("query_clean").alias("query")).agg(F.count("*").alias("count"))
    bare = counts.join(found.select("window_start", "src_ip").distinct(), ["window_start", "src_ip"], "left_anti")
    ranked = F.row_number().over(Window.partitionBy("window_start", "src_ip").orderBy(F.desc("count"), "query"))
    return bare.withColumn("rank", ranked).where(F.col("rank") <= top).withColumns({"reasons": F.array(F.lit("isolation_window_context")), "suspicion_score": F.lit(0)})
