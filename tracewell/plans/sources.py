"""Registered queries on the readers and writers of records and alerts: events are written as logs of one kind, read back and compared, and the same in DuckDB's SQL over the tables they come from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators import alerts as A
from tracewell.operators import events, gates, store, views
from tracewell.plans.detection import _ALERTS, _TEXT, _all_alerts, _new_folder, _together
from tracewell.plans.learned import _SHORT, _TIME, _isolated, _isolated_sql, _scaled
from tracewell.plans.queries import _EVENTS, _ISO, _R, _RULES, _SHORT_WINDOWS, _alerts, _rounded, _windows
from tracewell.schema import FEATURES
from tracewell.sources import records
from tracewell.sources.records import dns_events
from tracewell.streaming import live

FIELDS = ("ts", "uid", "id.orig_h", "id.resp_h", "query", "qtype_name", "rcode_name", "rtt", "answers", "TTLs", "AA")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text fields of a log: epoch seconds, lists joined by commas, ``-`` for what is empty."""
    own = dns_events(spark, sf)
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).otherwise("-")
    text = {
        "ts": F.format_string("%d.%06d", F.floor(F.unix_micros("ts") / 1_000_000), F.unix_micros("ts") % 1_000_000), "uid": F.col("uid"), "id.orig_h": F.col("src_ip"), "id.resp_h": F.when(~F.col("uid").endswith("7"), F.col("dns_server")).otherwise("-"), "query": F.col("query"),
        "qtype_name": F.lower("qtype_name"), "rcode_name": F.col("rcode_name"), "rtt": F.when(F.col("rtt") > 0, F.col("rtt").cast("string")).otherwise("-"), "answers": listed("answers"), "TTLs": listed("ttls"), "AA": F.when(F.col("uid").endswith("1"), "T").otherwise("F"),
    }
    return own.select(*(text[c].alias(c) for c in FIELDS), F.date_trunc("hour", "ts").alias("hour"))


def _told(read: DataFrame) -> DataFrame:
    """What normalised records say, for comparison."""
    own = events.normalize(read)
    return _rounded(own.select("uid", "ts", "src_ip", "dns_server", D.clean_domain(F.col("query")).alias("query"), "qtype_name", "rcode_name", "rtt", F.array_join("answers", ",").alias("answers"), F.size("ttls").alias("n_ttls"), F.coalesce(F.try_element_at("ttls", F.lit(1)), F.lit(0.0)).alias("ttl"), "aa"))


def dns_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events from lines of JSON among comments, blank and broken lines."""
    path = _new_folder(spark, "json")
    raw = _raw(spark, sf)
    line = F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in FIELDS)))
    odd = F.when(F.col("uid").endswith("00"), F.array(line, F.lit("# a comment"), F.lit(""), F.lit("{broken"), F.lit("[1]"))).otherwise(F.array(line))
    raw.select(F.explode(odd).alias("value")).write.text(path)
    return _told(records.read_json(spark, path))


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lambda column: pa.RecordBatch.from_arrays([column], schema=pa.schema([("value", pa.string())]))
    yield of(pa.array(["#separator \\x09", "#fields\t" + "\t".join(FIELDS)]))
    for batch in batches:
        yield of(batch.column(0))


def dns_tsv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events from tab-separated logs, each with its header."""
    path = _new_folder(spark, "tsv")
    _raw(spark, sf).select(F.concat_ws("\t", *(F.col(f"`{c}`") for c in FIELDS)).alias("value")).mapInArrow(_headed, "value string").write.option("compression", "gzip").text(path)
    return _told(records.read_tsv(spark, path))


def dns_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events from documents of JSON that hold an array each, one for each hour."""
    path = _new_folder(spark, "documents")
    item = F.struct(*(F.col(f"`{c}`").alias(c) for c in FIELDS))
    _raw(spark, sf).groupBy(F.date_format("hour", "yyyyMMddHH").alias("hour")).agg(F.to_json(F.collect_list(item)).alias("value")).repartition("hour").write.partitionBy("hour").text(path)
    return _told(records.read_documents(spark, f"{path}/hour=*"))


def _by_day(spark: SparkSession, sf: str, path: str) -> None:
    lines = _raw(spark, sf).select(F.date_format("hour", "yyyyMMdd").alias("day"), F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in FIELDS))).alias("value"))
    lines.repartition("day").write.partitionBy("day").text(path)


def dns_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files and records of each day's folder, by the manifest of inputs."""
    path = _new_folder(spark, "days")
    _by_day(spark, sf, path)
    found = records.input_manifest(spark, f"{path}/day=*").withColumn("day", F.regexp_extract("path", r"day=(\d+)", 1))
    return found.groupBy("day").agg(F.sum("records").alias("records"), (F.min("bytes") > 0).alias("filled"), (F.min(F.length("digest")) == 64).alias("digested"))


def dns_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """Events by source of the days' segments put together."""
    path, out = _new_folder(spark, "days"), _new_folder(spark, "together")
    _by_day(spark, sf, path)
    n = records.consolidate(spark, path, out, "part-*")
    own = events.normalize(records.read_json(spark, out))
    return own.groupBy("src_ip").agg(F.count("*").alias("events"), F.lit(n).cast("long").alias("records"))


def dns_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two overlapping inputs, merged by fingerprint, written in the order of time and read again."""
    path = _new_folder(spark, "merged")
    own = dns_events(spark, sf)
    both = events.union_inputs([own.where("ts < '2024-01-20'").withColumn("input", F.lit(1)), own.where("ts >= '2024-01-10'").withColumn("input", F.lit(2))])
    records.write_events(events.keep_first(events.fingerprint(both), ["fingerprint"], ["input", "uid"]), path)
    return _rounded(spark.read.schema("uid string, ts timestamp, input int, query string").json(path).select("uid", "ts", "input", D.clean_domain(F.col("query")).alias("query")))


def dns_written_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as it is written and read."""
    path = _new_folder(spark, "features")
    records.write_features(_windows(spark, sf), path)
    return _rounded(spark.read.parquet(path).select("window_start", "src_ip", *FEATURES[:12]))


def dns_alerts_once(spark: SparkSession, sf: str) -> DataFrame:
    """Rule alerts that are appended in two overlapping batches: each once."""
    path = _new_folder(spark, "once")
    own = _alerts(spark, sf).select("id", "window_start", "src_ip", "threat_score")
    for batch in (own.where("window_start < '2024-01-20'"), own.where("window_start >= '2024-01-05'").unionByName(own.where("window_start >= '2024-01-25'"))):
        live.append_new(batch, path)
    return _rounded(spark.read.schema("id string, window_start timestamp, src_ip string, threat_score int").parquet(path).select("id", "window_start", "src_ip", "threat_score"))


def dns_alert_files(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 40 rule alerts as lines of JSON hold them."""
    path = _new_folder(spark, "alerts")
    A.write_alerts(_together(_all_alerts(spark, sf)).withColumn("alert_uid", F.col("id")), path)
    return _rounded(A.read_alerts(spark, path, "rules", 40).select("id", "window_start", "src_ip", "severity", "threat_score", "status", "heuristics_fired"))


def dns_alert_status(spark: SparkSession, sf: str) -> DataFrame:
    """Rule alerts with the latest status that a growing table of changes gives them."""
    own = _alerts(spark, sf).select(F.col("id").alias("alert_uid"), "src_ip", F.lit("New").alias("status"), F.dayofmonth("window_start").alias("day"))
    changes = own.select("alert_uid", F.explode(F.slice(F.array(*(F.lit(k) for k in (1, 2, 3))), F.lit(1), F.col("day") % 4)).alias("changed_at"))
    changes = changes.withColumns({"status": F.get(F.array(*map(F.lit, ("Open", "Closed", "Reopened"))), F.col("changed_at") - 1), "note": F.concat(F.lit("note "), F.col("changed_at").cast("string"))})
    return _rounded(store.with_status(own.drop("day"), changes))


def dns_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable sample of 500 windows."""
    return _rounded(views.repeatable_sample(_windows(spark, sf).withColumn("key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), ("key", "src_ip"), 500).select("window_start", "src_ip", "total_queries"))


def dns_top_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """The ten windows that the fitted forest isolates soonest."""
    found, _ = _isolated(_scaled(_windows(spark, sf)), 0.99)
    return _rounded(views.top_rows(found, "isolation", 10).select("window_start", "src_ip", "isolation"))


def dns_sample_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The check of the first 2,000 records, under other names of time and source and without some columns."""
    raw = _raw(spark, sf).select(F.col("ts").alias("timestamp"), F.col("`id.orig_h`").alias("client"), "uid")
    named = gates.with_required(gates.with_aliases(raw.withColumn("none", F.lit(None).cast("string")), ["none", "timestamp"], ["client"]))
    return gates.sample_gate(named.orderBy("uid").select("ts", "src_ip", *(F.col(f"`{c}`") for c in ("query", "rcode_name")))).drop("reason")


def dns_quality_percent(spark: SparkSession, sf: str) -> DataFrame:
    """How well events' round trips are, as a percentage that falls with them."""
    own = dns_events(spark, sf).select("uid", D.reconstruction_quality(F.col("rtt")).alias("quality"))
    return _rounded(own)


def dns_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose window was over at a fixed time, and those that wait, by source."""
    own = dns_events(spark, sf).withColumn("done", events.completed(dns_events(spark, sf), F.to_timestamp(F.lit("2024-01-15 12:02:00"))))
    return own.groupBy("src_ip").agg(F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("pending"))


QUERIES = (
    dns_json_lines, dns_tsv_lines, dns_documents, dns_manifest, dns_consolidated, dns_merged, dns_written_features, dns_alerts_once, dns_alert_files, dns_alert_status, dns_sample, dns_top_isolation, dns_sample_gate,
    dns_quality_percent, dns_completed,
)

_READ = f"WITH {_EVENTS} SELECT uid, {_TEXT('ts')} AS ts, src_ip, CASE WHEN suffix(uid, '7') THEN 'unknown' ELSE dns_server END AS dns_server, query_clean AS query, qtype_name, rcode_name, round(rtt, 6) AS rtt, array_to_string(answers, ',') AS answers, CAST(n AS BIGINT) AS n_ttls, ttl_event AS ttl, suffix(uid, '1') AS aa FROM e"
_RULE = _RULES + f", ra AS (SELECT 'HEUR-' || upper(substr(sha256('heuristics|' || {_ISO} || '|' || src_ip || '|' || array_to_string(fired, '|')), 1, 20)) AS id, * FROM a)"

SQL = {
    "dns_json_lines": _READ, "dns_tsv_lines": _READ, "dns_documents": _READ,
    "dns_manifest": f"WITH {_EVENTS} SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS records, true AS filled, true AS digested FROM e GROUP BY ALL",
    "dns_consolidated": f"WITH {_EVENTS} SELECT src_ip, count(*) AS events, (SELECT count(*) FROM e) AS records FROM e GROUP BY src_ip",
    "dns_merged": f"WITH {_EVENTS} SELECT uid, {_TEXT('ts')} AS ts, CAST(CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS BIGINT) AS input, query_clean AS query FROM e",
    "dns_written_features": f"WITH {_SHORT_WINDOWS} SELECT {_TEXT('ws')} AS window_start, src_ip, " + ", ".join(f if f in ("total_queries", "unique_queries") else _R(f) for f in FEATURES[:12]) + " FROM w",
    "dns_alerts_once": f"WITH {_RULE} SELECT id, window_start, src_ip, threat_score FROM ra",
    "dns_alert_status": f"WITH {_RULE} SELECT id AS alert_uid, src_ip, ['New', 'Open', 'Closed', 'Reopened'][1 + day(ws) % 4] AS status, CASE WHEN day(ws) % 4 > 0 THEN 'note ' || (day(ws) % 4) END AS note FROM ra",
    "dns_alert_files": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity, CAST(threat_score AS DOUBLE) AS threat_score, 'New' AS status, array_to_string(fired, ',') AS heuristics_fired FROM ru ORDER BY ws DESC, id DESC LIMIT 40",
    "dns_sample": f"WITH {_SHORT_WINDOWS} SELECT {_TEXT('ws')} AS window_start, src_ip, total_queries FROM w ORDER BY md5('42|' || {_TEXT('ws')} || '|' || src_ip), ws, src_ip LIMIT 500",
    "dns_top_isolation": f"WITH {_SHORT}{_isolated_sql(0.99)} SELECT {_TIME}, src_ip, round(isolation, 6) AS isolation FROM si ORDER BY si.isolation DESC, ws, src_ip LIMIT 10",
    "dns_sample_gate": f"WITH {_EVENTS} SELECT CAST(least(2000, count(*)) AS BIGINT) AS records, CAST(0 AS BIGINT) AS without_source, CAST(0 AS BIGINT) AS invalid, true AS passed FROM e",
    "dns_quality_percent": f"WITH {_EVENTS} SELECT uid, round(round_even(100.0 / (1.0 + greatest(rtt, 0)), 4), 6) AS quality FROM e",
    "dns_completed": f"WITH {_EVENTS} SELECT src_ip, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 12:00:00') AS completed, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15 12:00:00') AS pending FROM e GROUP BY src_ip",
}
