"""Events: normalising, deduplicating, and features of each event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import dns as D

#: Response codes and query types with a flag each.
RCODES, QTYPES = ("NXDOMAIN", "SERVFAIL", "NOERROR"), ("TXT", "A", "AAAA", "MX", "CNAME", "PTR", "SRV")
LONG_QUERY, HIGH_ENTROPY, LONG_LABEL, LOW_TTL = 80, 4.0, 50, 60


def normalize(raw: DataFrame) -> DataFrame:
    """Typed events from raw text fields: rows without a time or a source go, null markers become null, lists become arrays. Time and source are taken from their fields once: the filter on them stays above that."""
    some = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin("", "-", "(empty)"), F.trim(F.col(f"`{c}`")))
    timed = raw.withColumn("_ts", some("ts")).select("*", F.inline(F.array(F.struct(D.parse_time(F.col("_ts")).alias("_time"), some("id.orig_h").alias("_source"))))).where("_time is not null and _source is not null")
    return timed.select(
        F.col("_time").alias("ts"), some("uid").alias("uid"), F.col("_source").alias("src_ip"), some("id.orig_p").try_cast("int").alias("src_port"),
        F.coalesce(some("id.resp_h"), F.lit("unknown")).alias("dns_server"), some("id.resp_p").try_cast("int").alias("dns_port"), some("proto").alias("proto"), some("trans_id").try_cast("int").alias("trans_id"),
        F.coalesce(F.col("query"), F.lit("")).alias("query"), F.coalesce(F.upper(some("qtype_name")), F.lit("UNKNOWN")).alias("qtype_name"),
        F.coalesce(F.upper(some("rcode_name")), F.lit("UNKNOWN")).alias("rcode_name"), F.coalesce(some("rtt").try_cast("double"), F.lit(0.0)).alias("rtt"),
        D.normalize_list(F.col("answers")).alias("answers"), D.numbers(D.normalize_list(F.col("TTLs"))).alias("ttls"),
        *(some(c).try_cast("int").alias(c) for c in ("qclass", "qtype", "rcode")), *(D.to_bool(F.col(c)).alias(c.lower()) for c in ("AA", "TC", "RD", "RA", "Z", "rejected")),
    )


def keep_last(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``."""
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return events.withColumn("_nth", ranked).where("_nth = 1").drop("_nth")


def keep_first(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``: what a table that ignores later inserts of a key would hold."""
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.asc(c) for c in order)))
    return events.withColumn("_nth", ranked).where("_nth = 1").drop("_nth")


def union_inputs(frames: list[DataFrame]) -> DataFrame:
    """All rows of several inputs; columns that one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fingerprint(events: DataFrame) -> DataFrame:
    """Adds ``fingerprint``, equal for records that describe one event: a digest of seven fields if there is a uid, else of ten and the answers. Times count to the microsecond.

    Columns that ``events`` lacks count as null.
    """
    have = set(events.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    ts = F.unix_micros(F.col("ts")).alias("ts")
    named = F.struct(ts, *(col(c).alias(c) for c in ("uid", "src_ip", "dns_server", "query", "qtype_name", "rcode_name")))
    bare = F.struct(ts, *(col(c).alias(c) for c in ("src_ip", "src_port", "dns_server", "dns_port", "proto", "trans_id", "query", "qtype_name", "rcode_name")), F.coalesce(col("answers", "array<string>"), F.array().cast("array<string>")).alias("answers"))
    return events.withColumn("fingerprint", F.sha2(F.when(col("uid").isNotNull(), F.to_json(named)).otherwise(F.to_json(bare)), 256))


def completed(events: DataFrame, now: Column, seconds: int = 300) -> Column:
    """Whether the window of an event is over at ``now``: a condition to split events into those to score and those that wait."""
    return F.unix_timestamp("ts") < F.floor(F.unix_timestamp(now) / seconds) * seconds


def add_features(events: DataFrame) -> DataFrame:
    """Adds name, type, answer and TTL features to events with ``ts, src_ip, dns_server, query, qtype_name, rcode_name, rtt, answers, ttls``."""
    clean = events.where("ts is not null").withColumn("query_clean", D.clean_domain(F.col("query")))
    q = F.col("query_clean")
    named = clean.withColumn("query_len", F.length(q)).withColumns({
        "entropy": D.shannon_entropy(q, F.col("query_len")), "label_count": F.size(D.labels(q)), "max_label_len": D.max_label_len(q),
        "digit_ratio": D.safe_ratio(D.count_of(q, r"\p{Nd}"), F.length(q)), "hyphen_ratio": D.safe_ratio(D.count_of(q, "-"), F.length(q)),
        "answer_count": F.size("answers"), "ttl_avg_event": D.list_avg(F.col("ttls")), "ttl_min_event": D.list_min(F.col("ttls")),
        "rtt": F.coalesce(F.col("rtt"), F.lit(0.0)), "dns_server": F.coalesce("dns_server", F.lit("unknown")),
        "qtype_name": F.upper(F.coalesce("qtype_name", F.lit("UNKNOWN"))), "rcode_name": F.upper(F.coalesce("rcode_name", F.lit("UNKNOWN"))),
    })
    flags = {f"is_{c.lower()}": F.col("rcode_name") == c for c in RCODES} | {f"is_{c.lower()}": F.col("qtype_name") == c for c in QTYPES}
    flags |= {
        "is_long_query": F.col("query_len") >= LONG_QUERY, "is_high_entropy": F.col("entropy") >= HIGH_ENTROPY, "is_long_label": F.col("max_label_len") >= LONG_LABEL,
        "is_low_ttl": (F.col("answer_count") > 0) & (F.col("ttl_min_event") > 0) & (F.col("ttl_min_event") <= LOW_TTL),
    }
    return named.withColumns({k: v.cast("int") for k, v in flags.items()})


def settled(df: DataFrame) -> DataFrame:
    """The same rows, past a generator: a later filter isn't pushed below it, which would compute the columns that it names a second time."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
