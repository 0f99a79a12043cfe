"""Registered queries over the test tables, and the same in DuckDB's SQL. Doubles are rounded to six digits in both.

Statistics of windows and the learned detectors take windows of five minutes and each user as a source. No such window of these tables holds the ten or twenty events that
rules ask for, so queries on rules and alerts take windows of a day, and pool the users of each kind as one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators import detectors, domains, gates, reports, store
from tracewell.operators.events import add_features
from tracewell.operators.windows import POINTS, build_windows, evaluate_rules, rule_alerts
from tracewell.schema import FEATURES
from tracewell.sources.records import dns_events
from tracewell.sources.scratch import written

DAY, SHORT = "1 day", "5 minutes"
TIME = "yyyy-MM-dd HH:mm:ss"


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    def one(c: str):
        col = F.col(c)
        if kinds[c] == "double":
            return (F.round(col * 1e6) / 1e6).alias(c)  # in binary, as the other engine rounds
        if kinds[c].startswith("timestamp"):
            return F.date_format(col, TIME).alias(c)
        return F.array_join(col, ",").alias(c) if kinds[c].startswith("array") else (col.cast("bigint").alias(c) if kinds[c] == "int" else col)
    return df.select(*map(one, df.columns))


def _features(spark: SparkSession, sf: str, pooled: bool = True) -> DataFrame:
    return add_features(dns_events(spark, sf, pooled))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five minutes, by user."""
    return build_windows(_features(spark, sf, False), SHORT)


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rule_alerts(evaluate_rules(build_windows(_features(spark, sf), DAY)))


def dns_event_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ("uid", "src_ip", "query_clean", "query_len", "entropy", "label_count", "max_label_len", "digit_ratio", "hyphen_ratio", "answer_count", "ttl_avg_event", "ttl_min_event", "is_low_ttl")
    return _rounded(_features(spark, sf).select(*names))


def dns_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_windows(spark, sf).select("window_start", "src_ip", *FEATURES))


def dns_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate_rules(build_windows(_features(spark, sf), DAY))
    return _rounded(judged.select("window_start", "src_ip", *POINTS, "rogue_dns_servers"))


def dns_rule_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_alerts(spark, sf).select("id", "window_start", "src_ip", "heuristics_fired", "threat_score", "severity"))


def dns_suspicious_domains(spark: SparkSession, sf: str) -> DataFrame:
    found = domains.suspicious_domains(_features(spark, sf), SHORT)
    return _rounded(found.select("window_start", "src_ip", "query", "count", "qtypes", "rcodes", "max_entropy", "avg_entropy", "max_query_len", "answer_count_max", "unique_answer_ips", "ttl_min", "ttl_avg", "reasons", "suspicion_score", "rank"))


def dns_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.top_domains(domains.suspicious_domains(_features(spark, sf), SHORT)))


def dns_dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.dataset_stats(dns_events(spark, sf)))


def dns_source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.source_stats(dns_events(spark, sf)))


def dns_alert_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.alert_kpis(_alerts(spark, sf)))


def dns_severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.severity_counts(_alerts(spark, sf))


def dns_alerts_per_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.per_hour(_alerts(spark, sf)))


def dns_source_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.source_report(_alerts(spark, sf)))


def dns_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.top_sources(_alerts(spark, sf)))


def dns_method_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.method_counts(_alerts(spark, sf))


def dns_scaler(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.scaler(_windows(spark, sf), FEATURES))


def dns_page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Name features of the hosts in ``pages``."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    q = D.clean_domain(host)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", q.alias("host"))
    return _rounded(pages.select("page_id", "host", D.shannon_entropy(F.col("host")).alias("entropy"), F.size(D.labels(F.col("host"))).alias("label_count"), D.max_label_len(F.col("host")).alias("max_label_len")))


def dns_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Mean round trips of windows in 35 bins, by training and validation."""
    found = written(_windows(spark, sf), "windows")
    return reports.histogram(found.withColumn("split", detectors.split(found)), "avg_rtt", 35, "split")


def dns_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(detectors.error_thresholds(written(_windows(spark, sf).select("avg_rtt"), "rtt"), "avg_rtt", 0.975))


def dns_feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """How each feature goes with the number of queries."""
    return _rounded(reports.feature_correlation(_windows(spark, sf), FEATURES[1:], "total_queries"))


def dns_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return reports.readiness(dns_events(spark, sf), F.to_timestamp(F.lit("2024-01-15 12:02:00")))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return written(detectors.scale(written(_windows(spark, sf), "windows")).select("window_start", "src_ip", "scaled"), "scaled")


def dns_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, their error, and the ratio of it to the 0.99 quantile of all errors."""
    scaled = _scaled(spark, sf)
    scored = detectors.score_reconstruction(scaled, detectors.fit_reconstruction(scaled))
    scored = written(scored.select("window_start", "src_ip", "reconstruction_error", detectors.top_features("residuals", 10).alias("top_features")), "reconstructed")
    limit = detectors.exact_quantiles(scored, "reconstruction_error", (0.99,))[0]
    return scored.select("window_start", "src_ip", "reconstruction_error", F.try_divide(F.col("reconstruction_error"), F.lit(limit)).alias("threshold_ratio"), "top_features")


def dns_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, their isolation, its margin over the quantile that leaves out one in a hundred, and its percentile."""
    scaled = _scaled(spark, sf)
    scored = written(detectors.score_isolation(scaled, detectors.fit_isolation(scaled)).select("window_start", "src_ip", "isolation", detectors.top_features("scaled", 8).alias("top_features")), "isolated")
    labelled, _ = detectors.label_isolation(scored)
    return detectors.share_not_above(labelled, scored, "isolation")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Rule alerts with their suspicious domains."""
    methods = F.map_from_arrays("heuristics_fired", F.transform("heuristics_fired", lambda _: F.lit(True)))
    alerts = _alerts(spark, sf).withColumn("detection_methods", methods)
    return store.with_domains(alerts, domains.suspicious_domains(_features(spark, sf), DAY))


def dns_alert_store(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(store.stored_alerts(_listed(spark, sf)).select("alert_uid", "window_start", "src_ip", "alert_type", "status", "threat_score", "severity"))


def dns_alert_domains(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(store.stored_domains(_listed(spark, sf)).select("alert_uid", "query", "count", "reasons", "suspicion_score", "max_entropy", "max_query_len"))


def dns_linked_domains(spark: SparkSession, sf: str) -> DataFrame:
    listed = _listed(spark, sf)
    return _rounded(store.linked_domains(store.stored_domains(listed), store.stored_alerts(listed)))


def dns_context_domains(spark: SparkSession, sf: str) -> DataFrame:
    events = _features(spark, sf)
    found = domains.context_domains(events, domains.suspicious_domains(events, SHORT), SHORT)
    return _rounded(found.select("window_start", "src_ip", "query", "count", "rank"))


def dns_training_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.training_gate(_windows(spark, sf), FEATURES).drop("reason")


def dns_time_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(gates.time_gate(dns_events(spark, sf)).drop("reason"))


#: What no SQL can express; tests hold these against plain versions.
LEARNED = (dns_reconstruction, dns_isolation)

QUERIES = (
    dns_event_features, dns_windows, dns_rules, dns_rule_alerts, dns_suspicious_domains, dns_top_domains, dns_dataset_stats, dns_source_stats, dns_alert_kpis,
    dns_severity_counts, dns_alerts_per_hour, dns_source_report, dns_top_sources, dns_method_counts, dns_scaler, dns_page_hosts,
    dns_histogram, dns_thresholds, dns_feature_correlation, dns_readiness,
    dns_alert_store, dns_alert_domains, dns_linked_domains, dns_context_domains, dns_training_gate, dns_time_gate, *LEARNED,
)

def _events_sql(source: str) -> str:
    return _EVENTS.replace("'10.0.0.' || r AS src_ip", f"{source} AS src_ip")


_EVENTS = """
b AS (SELECT event_id, ts, event_type, value, user_id, user_id % 10 AS r, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k, sha256(CAST(event_id AS VARCHAR)) AS h FROM events),
e0 AS (SELECT *, CASE WHEN r = 0 AND k % 10 < 9 THEN 'NXDOMAIN' WHEN r = 3 AND k % 10 < 8 THEN 'SERVFAIL' ELSE 'NOERROR' END AS rcode_name,
 CASE WHEN r = 1 AND k % 5 < 4 THEN 'TXT' WHEN event_type = 'click' THEN 'AAAA' WHEN event_type = 'signup' THEN 'MX' ELSE 'A' END AS qtype_name,
 CASE WHEN r = 0 THEN substr(h, 1, 20 + k % 9) || '.dga.example.com' WHEN r = 1 THEN substr(h, 1, 52) || '.' || substr(h, 3, 40) || '.t.example.net'
 WHEN r = 2 THEN 'node-' || (1000 + event_id % 9000) || '.edge.example.com' ELSE lower(event_type) || '-' || (k % 20) || '.example.org' END AS q FROM b),
e1 AS (SELECT *, CASE WHEN rcode_name <> 'NOERROR' THEN 0 WHEN r = 2 THEN 4 + k % 5 ELSE 1 + k % 2 END AS n, CASE WHEN r = 2 THEN 15 + k % 16 ELSE 120 + 60 * (k % 5) END AS ttl FROM e0),
e AS (SELECT event_id, ts, 'C' || event_id AS uid, '10.0.0.' || r AS src_ip, CASE WHEN r = 4 THEN '203.0.113.' || (1 + k % 6) ELSE '192.0.2.' || (1 + k % 2) END AS dns_server,
 q AS query_clean, qtype_name, rcode_name, value / 1000 AS rtt, n, list_transform(range(n), lambda i: '198.51.100.' || ((event_id * 7 + i) % 250)) AS answers,
 CAST(length(q) AS BIGINT) AS query_len, list_entropy(string_split(q, '')) AS entropy, CAST(len(string_split(q, '.')) AS BIGINT) AS label_count,
 CAST(list_max(list_transform(string_split(q, '.'), lambda x: length(x))) AS BIGINT) AS max_label_len,
 length(regexp_replace(q, '[^0-9]', '', 'g')) / CAST(length(q) AS DOUBLE) AS digit_ratio, length(regexp_replace(q, '[^-]', '', 'g')) / CAST(length(q) AS DOUBLE) AS hyphen_ratio,
 CAST(n AS BIGINT) AS answer_count, CASE WHEN n > 0 THEN CAST(ttl AS DOUBLE) ELSE 0 END AS ttl_event, CAST(n > 0 AND ttl <= 60 AS BIGINT) AS is_low_ttl FROM e1)
"""
_FLAG = {"nxdomain_rate": "rcode_name = 'NXDOMAIN'", "servfail_rate": "rcode_name = 'SERVFAIL'", "noerror_rate": "rcode_name = 'NOERROR'", **{f"{t.lower()}_rate": f"qtype_name = '{t}'" for t in ("TXT", "A", "AAAA", "MX", "CNAME", "PTR", "SRV")}, "long_query_rate": "query_len >= 80", "high_entropy_rate": "entropy >= 4", "long_label_rate": "max_label_len >= 50", "low_ttl_rate": "is_low_ttl = 1"}
_AGG = {
    "total_queries": "count(*)", "unique_queries": "count(DISTINCT query_clean)", "unique_query_ratio": "count(DISTINCT query_clean) / CAST(count(*) AS DOUBLE)", "repeated_query_ratio": "1 - count(DISTINCT query_clean) / CAST(count(*) AS DOUBLE)",
    **{k: f"avg(CAST({v} AS INTEGER))" for k, v in _FLAG.items()}, "avg_query_len": "avg(query_len)", "max_query_len": "max(query_len)", "avg_entropy": "avg(entropy)", "max_entropy": "max(entropy)",
    "avg_label_count": "avg(label_count)", "max_label_count": "max(label_count)", "avg_max_label_len": "avg(max_label_len)", "max_max_label_len": "max(max_label_len)", "digit_ratio_avg": "avg(digit_ratio)",
    "hyphen_ratio_avg": "avg(hyphen_ratio)", "unique_dns_servers": "count(DISTINCT dns_server)", "avg_rtt": "avg(rtt)", "max_rtt": "max(rtt)", "answer_count_avg": "avg(answer_count)", "answer_count_max": "max(answer_count)",
    "ttl_avg": "avg(ttl_event)", "ttl_min": "min(ttl_event)", "unique_answer_ips": "CAST(len(list_distinct(flatten(list(answers)))) AS BIGINT)",
}
_WHOLE = {"total_queries", "unique_queries", "max_query_len", "max_label_count", "max_max_label_len", "unique_dns_servers", "answer_count_max", "unique_answer_ips"}
_GROUPED = ", ".join(f"{_AGG[f]} AS {f}" for f in FEATURES) + ", list_sort(list_distinct(list(dns_server))) AS servers FROM e GROUP BY ALL)"
_WINDOWS = _EVENTS + ", w AS (SELECT date_trunc('day', ts) AS ws, src_ip, " + _GROUPED
_BUCKET = "time_bucket(INTERVAL '5 minutes', ts)"
_USERS = _events_sql("'10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256)")
_SHORT_WINDOWS = f"{_USERS}, w AS (SELECT {_BUCKET} AS ws, src_ip, {_GROUPED}"
_RULES = _WINDOWS + """, j AS (SELECT *, total_queries >= 20 AND unique_query_ratio >= 0.9 AND nxdomain_rate >= 0.5 AND high_entropy_rate >= 0.5 AS heuristic_dga,
 total_queries >= 20 AND (txt_rate >= 0.4 OR long_query_rate >= 0.4 OR long_label_rate >= 0.3) AND high_entropy_rate >= 0.4 AS heuristic_tunnel,
 total_queries >= 10 AND (answer_count_avg >= 3 OR answer_count_max >= 5 OR unique_answer_ips >= 10) AND ttl_min > 0 AND (ttl_min <= 60 OR low_ttl_rate >= 0.3) AS heuristic_fastflux,
 total_queries >= 20 AND (servfail_rate >= 0.5 OR nxdomain_rate >= 0.7) AS heuristic_resolver_failure, unique_dns_servers >= 3 AS heuristic_rogue_resolver FROM w),
a0 AS (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in sorted(POINTS)) + """], lambda x: x IS NOT NULL) AS fired, least(100, """ + " + ".join(f"CASE WHEN {k} THEN {v} ELSE 0 END" for k, v in POINTS.items()) + """) AS score FROM j),
a AS (SELECT *, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, array_to_string(fired, ',') AS heuristics_fired, CAST(score AS BIGINT) AS threat_score,
 CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity FROM a0 WHERE len(fired) > 0)"""
_REASON_SQL = "[" + ", ".join(f"CASE WHEN {test.replace('D', '') if test.endswith('D') else test} THEN '{name}' END" for name, test, _ in domains.REASONS) + "]"
_DOMAINS = _EVENTS + f""", m AS (SELECT *, list_filter({_REASON_SQL}, lambda x: x IS NOT NULL) AS rs FROM e),
g AS (SELECT date_trunc('day', ts) AS ws, src_ip, query_clean AS query, count(*) AS count, list_sort(list_distinct(list(qtype_name))) AS qt, list_sort(list_distinct(list(rcode_name))) AS rc,
 max(entropy) AS max_entropy, avg(entropy) AS avg_entropy, max(query_len) AS max_query_len, max(answer_count) AS answer_count_max, CAST(len(list_distinct(flatten(list(answers)))) AS BIGINT) AS unique_answer_ips,
 min(ttl_event) AS ttl_min, avg(ttl_event) AS ttl_avg, list_sort(list_distinct(flatten(list(rs)))) AS reasons FROM m WHERE len(rs) > 0 GROUP BY ALL),
s AS (SELECT *, """ + " + ".join(f"CASE WHEN list_contains(reasons, '{n}') THEN {p} ELSE 0 END" for n, _, p in domains.REASONS) + """ AS suspicion_score FROM g),
d AS (SELECT *, row_number() OVER (PARTITION BY ws, src_ip ORDER BY suspicion_score DESC, count DESC, unique_answer_ips DESC, round(max_entropy, 9) DESC, max_query_len DESC, query) AS rank FROM s QUALIFY rank <= 20)"""
_SHORT_DOMAINS = _DOMAINS.replace("date_trunc('day', ts)", _BUCKET)
_STORE = _RULES + _DOMAINS[len(_EVENTS):] + """, st AS (SELECT a.ws, a.src_ip, id AS alert_uid, window_start, severity, CAST(least(100, score + CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.ws = a.ws AND d.src_ip = a.src_ip) THEN 15 ELSE 0 END) AS BIGINT) AS threat_score FROM
 (SELECT *, 'HEUR-' || upper(substr(sha256('heuristics|' || strftime(ws, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || src_ip || '|' || array_to_string(fired, '|')), 1, 20)) AS id FROM a) a)"""
_ISO = "strftime(ws, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_SPLIT = f"CASE WHEN CAST('0x' || substr(md5('42|' || {_ISO} || '|' || src_ip), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'validation' END"
_R = lambda c: f"round({c}, 6) AS {c}"

SQL = {
    "dns_event_features": f"WITH {_EVENTS} SELECT uid, src_ip, query_clean, query_len, {_R('entropy')}, label_count, max_label_len, {_R('digit_ratio')}, {_R('hyphen_ratio')}, answer_count, ttl_event AS ttl_avg_event, ttl_event AS ttl_min_event, is_low_ttl FROM e",
    "dns_windows": f"WITH {_SHORT_WINDOWS} SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, " + ", ".join(f if f in _WHOLE else _R(f) for f in FEATURES) + " FROM w",
    "dns_rules": f"WITH {_RULES} SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, {', '.join(POINTS)}, CASE WHEN heuristic_rogue_resolver THEN array_to_string(servers, ',') ELSE '' END AS rogue_dns_servers FROM j",
    "dns_rule_alerts": f"WITH {_RULES} SELECT 'HEUR-' || upper(substr(sha256('heuristics|' || strftime(ws, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || src_ip || '|' || array_to_string(fired, '|')), 1, 20)) AS id, window_start, src_ip, heuristics_fired, threat_score, severity FROM a",
    "dns_suspicious_domains": f"WITH {_SHORT_DOMAINS} SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, query, count, array_to_string(qt, ',') AS qtypes, array_to_string(rc, ',') AS rcodes, {_R('max_entropy')}, {_R('avg_entropy')}, max_query_len, answer_count_max, unique_answer_ips, {_R('ttl_min')}, {_R('ttl_avg')}, array_to_string(reasons, ',') AS reasons, CAST(suspicion_score AS BIGINT) AS suspicion_score, CAST(rank AS BIGINT) AS rank FROM d",
    "dns_top_domains": f"WITH {_SHORT_DOMAINS} SELECT query, count(*) AS alerts, CAST(sum(count) AS BIGINT) AS queries, CAST(max(suspicion_score) AS BIGINT) AS max_score, round(max(max_entropy), 4) AS max_entropy FROM d GROUP BY query ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 20",
    "dns_dataset_stats": f"WITH {_EVENTS} SELECT count(*) AS total_queries, count(DISTINCT src_ip) AS source_ips, count(DISTINCT (src_ip, floor(epoch(ts) / 300))) AS source_windows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span_seconds, round(count(*) / CAST(count(DISTINCT (src_ip, floor(epoch(ts) / 300))) AS DOUBLE), 6) AS avg_queries_per_window FROM e",
    "dns_source_stats": f"WITH {_EVENTS} SELECT src_ip, count(*) AS queries, count(DISTINCT floor(epoch(ts) / 300)) AS windows, CAST(5 * count(DISTINCT floor(epoch(ts) / 300)) AS DOUBLE) AS minutes, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM e GROUP BY src_ip",
    "dns_alert_kpis": f"WITH {_RULES} SELECT count(*) AS alerts, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(DISTINCT src_ip) AS sources, round(avg(threat_score), 1) AS mean_score FROM a",
    "dns_severity_counts": f"WITH {_RULES} SELECT severity, count(*) AS alerts FROM a GROUP BY severity",
    "dns_alerts_per_hour": f"WITH {_RULES} SELECT window_start AS hour, src_ip, count(*) AS alerts FROM a GROUP BY ALL",
    "dns_source_report": f"WITH {_RULES} SELECT src_ip, count(*) AS alerts, max(threat_score) AS max_score, round(avg(threat_score), 6) AS mean_score FROM a GROUP BY src_ip",
    "dns_top_sources": f"WITH {_RULES} SELECT src_ip, count(*) AS alerts, max(threat_score) AS max_score, round(avg(threat_score), 6) AS mean_score FROM a GROUP BY src_ip ORDER BY 2 DESC, 1 LIMIT 10",
    "dns_method_counts": f"WITH {_RULES} SELECT method, count(*) AS alerts FROM (SELECT unnest(fired) AS method FROM a) GROUP BY method",
    "dns_scaler": f"WITH {_SHORT_WINDOWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM w" for f in FEATURES),
    "dns_page_hosts": "WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '\\.$', '') AS host FROM pages) SELECT page_id, host, round(list_entropy(string_split(host, '')), 6) AS entropy, CAST(len(string_split(host, '.')) AS BIGINT) AS label_count, CAST(list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS BIGINT) AS max_label_len FROM p",
    "dns_histogram": f"WITH {_SHORT_WINDOWS}, x AS (SELECT min(avg_rtt) AS low, max(avg_rtt) AS high FROM w) SELECT {_SPLIT} AS split, CAST(least(34, coalesce(floor((avg_rtt - low) / nullif((high - low) / 35, 0)), 0)) AS BIGINT) AS bin, count(*) AS n FROM w, x WHERE avg_rtt IS NOT NULL GROUP BY ALL",
    "dns_thresholds": f"WITH {_SHORT_WINDOWS} SELECT round(quantile_cont(avg_rtt, 0.95), 6) AS p95, round(quantile_cont(avg_rtt, 0.99), 6) AS p99, round(quantile_cont(avg_rtt, 0.975), 6) AS threshold, round(avg(avg_rtt) + 3 * stddev_pop(avg_rtt), 6) AS mean_3std FROM w",
    "dns_feature_correlation": f"WITH {_SHORT_WINDOWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(CASE WHEN var_pop({f}) > 0 THEN corr({f}, total_queries) END, 0), 6) AS correlation FROM w" for f in FEATURES[1:]),
    "dns_readiness": f"WITH {_EVENTS}, p AS (SELECT src_ip, floor(epoch(ts) / 300) AS bucket, count(*) AS n FROM e GROUP BY ALL), d AS (SELECT *, bucket < floor(epoch(TIMESTAMP '2024-01-15 12:02:00') / 300) AS done FROM p) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(*) FILTER (WHERE done) AS completed, CAST(coalesce(sum(n) FILTER (WHERE NOT done), 0) AS BIGINT) AS pending FROM d",
    "dns_alert_store": f"WITH {_STORE} SELECT alert_uid, window_start, src_ip, 'anomaly_candidate' AS alert_type, 'New' AS status, threat_score, CASE WHEN threat_score >= 75 THEN 'high' WHEN threat_score >= 50 THEN 'medium' WHEN threat_score >= 25 THEN 'low' ELSE severity END AS severity FROM st",
    "dns_alert_domains": f"WITH {_STORE} SELECT alert_uid, query, count, array_to_string(reasons, ',') AS reasons, CAST(suspicion_score AS BIGINT) AS suspicion_score, {_R('max_entropy')}, max_query_len FROM d JOIN st USING (ws, src_ip)",
    "dns_linked_domains": f"WITH {_STORE} SELECT query AS domain, count(DISTINCT alert_uid) AS linked_alerts, CAST(sum(count) AS BIGINT) AS observed_queries, CAST(max(suspicion_score) AS BIGINT) AS max_suspicion_score, round(max(max_entropy), 4) AS max_entropy, max(window_start) AS latest_alert FROM d JOIN st USING (ws, src_ip) GROUP BY query ORDER BY 4 DESC, 2 DESC, 3 DESC, 1 LIMIT 20",
    "dns_context_domains": f"WITH {_SHORT_DOMAINS}, c AS (SELECT {_BUCKET} AS ws, src_ip, query_clean AS query, count(*) AS count FROM e WHERE query_clean <> '' GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY ws, src_ip ORDER BY count DESC, query) AS rank FROM c ANTI JOIN d USING (ws, src_ip) QUALIFY rank <= 10) SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, query, count, CAST(rank AS BIGINT) AS rank FROM f",
    "dns_training_gate": f"WITH {_SHORT_WINDOWS} SELECT count(*) AS windows, count(DISTINCT src_ip) AS sources, count(*) FILTER (WHERE ws IS NULL OR trim(coalesce(src_ip, '')) = '') AS blank_keys, count(*) FILTER (WHERE {' OR '.join(f'NOT coalesce(isfinite(CAST({f} AS DOUBLE)), false)' for f in FEATURES)}) AS bad_rows, count(*) >= 50 AND blank_keys = 0 AND bad_rows = 0 AS passed FROM w",
    "dns_time_gate": f"WITH {_EVENTS} SELECT count(*) AS records, count(*) FILTER (WHERE NOT coalesce(year(ts) BETWEEN 2000 AND 2099, false)) AS invalid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400, 6) AS span_days, count(*) > 0 AND invalid = 0 AND span_days <= 3660 AS passed FROM e",
}
