"""Registered queries on the detectors' alerts, their correlation and the views on them, and the same in DuckDB's SQL.

SQL can't fit components or trees. So that everything behind the scores has an exact counterpart, these queries score windows by their mean absolute
z-score: the error of a reconstruction without components. The isolation alerts take the same scores. Windows are those of a day, by kind of user.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators import alerts as A
from tracewell.operators import correlation, detectors, domains, events, gates, models, reports, store, views
from tracewell.operators.windows import DEFINITIONS, build_windows, described, evaluate_definitions, evaluate_rules, fired_rules, rule_definitions
from tracewell.plans.queries import _EVENTS, _ISO, _R, _RULES, _SHORT_WINDOWS, _SPLIT, _STORE, _WINDOWS, DAY, SHORT, _features, _rounded, _windows
from tracewell.schema import FEATURES
from tracewell.sources import records
from tracewell.sources import tail as tailing
from tracewell.sources.records import dns_events
from tracewell.sources.scratch import shared_folder, written
from tracewell.streaming import live

#: The share of windows that the plain score leaves unflagged.
SHARE = 0.9
NOW = "2024-01-20 00:00:00"
CONFIG = correlation.Config(window=DAY)


def _day(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Windows of a day, and events with features."""
    own = _features(spark, sf)
    return written(build_windows(own, DAY), "day_windows"), own


def _plain(windows: DataFrame) -> DataFrame:
    """Windows scored without components, flagged by the `SHARE` quantile."""
    scored = written(detectors.score_reconstruction(detectors.scale(windows), detectors.fit_reconstruction(windows, 0)), "plain")
    return detectors.flagged(scored, detectors.exact_quantiles(scored, "reconstruction_error", (SHARE,))[0])


def _isolated(scored: DataFrame) -> DataFrame:
    """The same scores as an isolation's, with labels and percentiles."""
    named = scored.drop("latent", "residuals", "reconstructed", "threshold", "threshold_ratio", "anomaly").withColumnRenamed("reconstruction_error", "isolation")
    labelled, _ = detectors.label_isolation(named, 1 - SHARE)
    return detectors.share_not_above(labelled, named, "isolation")


def _all_alerts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    own = written(_features(spark, sf), "features")
    windows = written(build_windows(own, DAY), "day_windows")
    found = written(domains.suspicious_domains(own, DAY), "domains")
    scored = _plain(windows)
    return {
        "isolation": A.isolation_alerts(_isolated(scored), found, domains.context_domains(own, found, DAY), DAY), "reconstruction": A.reconstruction_alerts(scored, found, DAY),
        "rules": A.rule_alerts(evaluate_rules(windows), found, DAY),
    }


def _correlated(alerts: dict[str, DataFrame]) -> DataFrame:
    return correlation.correlate(correlation.evidence(alerts["isolation"], alerts["reconstruction"], alerts["rules"], CONFIG), CONFIG)


def _together(alerts: dict[str, DataFrame]) -> DataFrame:
    """Alerts of all families with the columns that lists show."""
    lists = ("heuristics_fired", "threshold", "reconstruction_error", "isolation_score", "score_percentile", "threat_score")
    slim = lambda df: df.select("id", "window_start", "src_ip", "status", "severity", "alert_type", "detection_type", "detection_methods", F.size("suspicious_domains").alias("n_domains"), *(F.col(c).cast("double").alias(c) if c != "heuristics_fired" else F.col(c) for c in lists if c in df.columns))
    return events.union_inputs([slim(df) for df in alerts.values()])


def dns_scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_plain(_day(spark, sf)[0]).select("window_start", "src_ip", "reconstruction_error", "threshold", "threshold_ratio", "anomaly"))


def dns_top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.top_rows(_plain(_day(spark, sf)[0]), "reconstruction_error").select("window_start", "src_ip", "reconstruction_error"))


def dns_latest_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The last 100 windows' errors and thresholds, one row each."""
    return _rounded(views.latest_long(_plain(_day(spark, sf)[0]), ["reconstruction_error", "threshold"], 100))


def dns_reading_card(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.reading_card(_plain(_day(spark, sf)[0]), "reconstruction_error", F.col("anomaly")))


def dns_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.score_summary(_plain(_day(spark, sf)[0]), "reconstruction_error", F.col("anomaly")))


def dns_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in 55 bins, by label."""
    return reports.histogram(_isolated(_plain(_day(spark, sf)[0])), "isolation", 55, "predicted_label")


def dns_residual_weights(spark: SparkSession, sf: str) -> DataFrame:
    scored = _plain(_day(spark, sf)[0])
    return _rounded(views.residual_weights(scored, detectors.long_form(scored, "residuals")))


def dns_residual_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.attribution_summary(detectors.long_form(_plain(_day(spark, sf)[0]), "residuals")))


def dns_value_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile ranks, equal values in the mean, of three features' values."""
    windows = _day(spark, sf)[0]
    names = ["total_queries", "unique_dns_servers", "answer_count_max"]
    long = windows.select("window_start", "src_ip", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["window_start", "src_ip"], names, "feature", "value")
    return _rounded(views.percentile_rank(long, "feature", "value"))


def dns_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_isolated(_plain(_day(spark, sf)[0])).select("window_start", "src_ip", "isolation_score", "score_percentile", "predicted_label"))


def dns_isolation_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _all_alerts(spark, sf)["isolation"]
    return _rounded(alerts.select("id", "window_start", "src_ip", "severity", "threat_score", "isolation_score", "score_percentile", F.size("suspicious_domains").alias("n_domains"), "alert_fingerprint"))


def dns_reconstruction_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _all_alerts(spark, sf)["reconstruction"]
    return _rounded(alerts.select("id", "window_start", "src_ip", "severity", "reconstruction_error", "threshold_ratio", F.size("suspicious_domains").alias("n_domains"), F.element_at("possible_causes", 1).alias("cause")))


def dns_rule_alert_details(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _all_alerts(spark, sf)["rules"]
    return _rounded(alerts.select("id", "severity", "threat_score", F.size("suspicious_domains").alias("n_domains"), F.array_join("possible_causes", "; ").alias("causes"), "rogue_dns_servers", F.to_json("detection_methods").alias("m")).withColumn("methods", D.enabled_methods(F.col("m"))).drop("m"))


def dns_final_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All windows with an alert of some detector, what they say together, and what was suppressed and why."""
    found = _correlated(_all_alerts(spark, sf)).drop("contributing_ids")
    return _rounded(found)


def dns_run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.run_statistics(_correlated(_all_alerts(spark, sf)))


def dns_final_list(spark: SparkSession, sf: str) -> DataFrame:
    final = A.load_final(A.final_alerts(_correlated(_all_alerts(spark, sf)), CONFIG), 50)
    return _rounded(final.select("id", "window_start", "src_ip", "severity", "threat_score", "final_score", "models_agreeing", "active_models", "contributing_alert_ids", "contributing_alert_count"))


def dns_unified_counters(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _all_alerts(spark, sf)
    return A.unified_counters(A.final_alerts(_correlated(alerts), CONFIG), _together(alerts))


def dns_families(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of each source by family, in both readings."""
    alerts = _together(_all_alerts(spark, sf)).withColumns({"family": A.family(), "shown_as": A.family("dashboard")})
    return alerts.groupBy("src_ip", "family", "shown_as").agg(F.count("*").alias("alerts"))


def dns_filtered_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """New high and medium alerts of the 120 hours before a fixed time, of three sources."""
    found = A.filter_alerts(_together(_all_alerts(spark, sf)), ["high", "medium"], ["New"], ["10.0.0.0", "10.0.0.1", "10.0.0.3"], 120, F.to_timestamp(F.lit(NOW)))
    return _rounded(found.select("id", "window_start", "src_ip", "severity"))


def dns_latest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(A.latest(_together(_all_alerts(spark, sf)), 20).select("id", "window_start", "src_ip", "severity"))


def dns_report(spark: SparkSession, sf: str) -> DataFrame:
    found = A.report(_together(_all_alerts(spark, sf)), F.lit(NOW))
    return _rounded(found.withColumns({"threshold": F.round("threshold", 6), "reconstruction_error": F.round("reconstruction_error", 6)}))


def dns_alert_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The domains of the first ten rule alerts by id."""
    alerts = A.rule_alerts(evaluate_rules((day := _day(spark, sf))[0]), domains.suspicious_domains(day[1], DAY), DAY)
    first = [r.id for r in alerts.select("id").orderBy("id").limit(10).collect()]
    return _rounded(A.alert_domains(store.stored_domains(alerts), first).select("alert_uid", "query", "count", "suspicion_score", "max_entropy"))


def dns_first_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two overlapping inputs, the first of each fingerprint kept, counted by source and hour."""
    own = dns_events(spark, sf)
    early, late = own.where("ts < '2024-01-20'").withColumn("input", F.lit(1)), own.where("ts >= '2024-01-10'").withColumn("input", F.lit(2)).drop("ttls")
    kept = events.keep_first(events.fingerprint(events.union_inputs([early, late])), ["fingerprint"], ["input", "uid"])
    return _rounded(kept.groupBy("src_ip", "input", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events")))


def dns_last_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each source and name."""
    kept = events.keep_last(_features(spark, sf), ["src_ip", "query_clean"], ["ts", "uid"])
    return _rounded(kept.select("src_ip", "query_clean", "uid", "ts"))


def dns_merge_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters and verdict of merging an input with itself, of which one row in fifty can't be used."""
    own = events.fingerprint(dns_events(spark, sf)).withColumn("valid", ~F.col("uid").endswith("50"))
    both = events.union_inputs([own.withColumn("file", F.lit("a")), own.withColumn("file", F.lit("b"))])
    return gates.merge_gate(gates.merge_counters(both, "valid", "fingerprint", "file"), 2, 2).drop("reason")


def dns_feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.feature_summary(_windows(spark, sf)).drop("features"))


def dns_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """How many windows don't count the events of their time and source: none."""
    found = views.misaligned(_windows(spark, sf), dns_events(spark, sf, False), SHORT)
    return found.agg(F.count("*").alias("misaligned"))


def dns_split(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf)
    return windows.groupBy(detectors.split(windows).alias("split")).agg(F.count("*").alias("windows"))


def dns_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """How many windows of each label a stratified sample of 100 takes."""
    scored = _isolated(_plain(_day(spark, sf)[0]))
    return detectors.stratified_sample(scored, "predicted_label", 100, ("window_start", "src_ip")).groupBy("predicted_label").agg(F.count("*").alias("windows"))


def dns_stratified_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of that sample."""
    scored = _isolated(_plain(_day(spark, sf)[0]))
    return _rounded(detectors.stratified_sample(scored, "predicted_label", 100, ("window_start", "src_ip")).select("window_start", "src_ip", "predicted_label"))


def dns_history(spark: SparkSession, sf: str) -> DataFrame:
    """Scored windows of three passes: the last of each window counts, and of these the last 150."""
    scored = _plain(_day(spark, sf)[0]).select("window_start", "src_ip", "reconstruction_error")
    passes = events.union_inputs([scored.withColumn("seq", F.unix_timestamp("window_start") + F.lit(k)) for k in range(3)])
    return _rounded(reports.keep_bounded(passes, ["window_start", "src_ip"], "seq", 150))


def dns_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Features that were made unusable in places, repaired, in sums by source."""
    broken = _day(spark, sf)[0].withColumns({"avg_rtt": F.when(F.dayofmonth("window_start") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("avg_rtt")), "max_rtt": F.when(F.dayofmonth("window_start") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("max_rtt"))})
    return _rounded(gates.repaired(broken, FEATURES).groupBy("src_ip").agg(F.sum("avg_rtt").alias("avg_rtt"), F.sum("max_rtt").alias("max_rtt"), F.sum("total_queries").cast("long").alias("total_queries")))


def dns_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How long each source was seen, as text."""
    found = reports.source_stats(dns_events(spark, sf))
    return found.select("src_ip", D.duration_text(F.col("minutes")).alias("covered"), D.readable_time(F.unix_timestamp("first_ts")).alias("first_seen"))


def dns_stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Rule alerts of a stream over the events: those of windows that the watermark, an hour behind the last event, has passed."""
    source, _ = _landed(spark, sf)
    root = _new_folder(spark, "stream")
    live.start_rules(live.live_windows(source, DAY, "1 hour"), f"{root}/alerts", f"{root}/checkpoint").awaitTermination()
    kinds = "id string, window_start timestamp, src_ip string, heuristics_fired array<string>, threat_score int"
    return _rounded(spark.read.schema(kinds).parquet(f"{root}/alerts").select("id", "window_start", "src_ip", "heuristics_fired", "threat_score"))


def dns_stream_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Final alerts of all three detectors on a stream, by a model that was fitted on all windows and loaded again."""
    source, static = _landed(spark, sf)
    root = _new_folder(spark, "stream")
    models.publish(models.fit(written(build_windows(events.add_features(static), DAY), "day_windows"), trees=100), f"{root}/models", "1")
    model = models.load(spark, f"{root}/models", "1")
    live.start_detectors(live.live_windows(source, DAY, "1 hour", live.COUNTED), static, model, f"{root}/alerts", f"{root}/checkpoint", DAY).awaitTermination()
    kinds = "id string, window_start timestamp, src_ip string, severity string, threat_score int, final_score double, models_agreeing int, active_models array<string>, source_alert_ids array<string>"
    return spark.read.schema(kinds).parquet(f"{root}/alerts/final")


#: Events before this time land first, but for one in seven of the two days before it, which land with the later ones: too late by then, most of them.
TURN, LATE = "2024-01-20 00:00:00", "2024-01-18 00:00:00"
#: Rules alone decide.
RULES_ONLY = correlation.Config(weights=(0, 0, 1), min_percentile=101, min_ratio=1e9, min_detectors=1, min_score=40, bonus_two=0, bonus_three=0, window=DAY)
FINAL = "id string, window_start timestamp, src_ip string, severity string, threat_score int, final_score double, models_agreeing int, active_models array<string>, source_alert_ids array<string>"


def _in_turns(spark: SparkSession, sf: str, start, path: str) -> None:
    """Lands events in two turns, and runs a stream over the folder after each; ``start`` starts it."""
    own = dns_events(spark, sf)
    held = (F.substring("uid", 2, 20).cast("long") % 7 == 0) & (F.col("ts") >= LATE)
    first = (F.col("ts") < TURN) & ~held
    for turn in (first, ~first):
        own.where(turn).write.mode("append").parquet(path)
        start(spark.readStream.schema(own.schema).parquet(path)).awaitTermination()


def _chained(spark: SparkSession, sf: str, config: correlation.Config, **fitting) -> DataFrame:
    root = _new_folder(spark, "stream")
    model = models.fit(written(build_windows(events.add_features(dns_events(spark, sf)), DAY), "day_windows"), **fitting)
    _in_turns(spark, sf, lambda own: live.start_final(live.live_windows(own, DAY, "1 hour", live.CHAINED), model, f"{root}/final", f"{root}/checkpoint", config), f"{root}/landed")
    return spark.read.schema(FINAL).parquet(f"{root}/final")


def dns_stream_rule_final(spark: SparkSession, sf: str) -> DataFrame:
    """Final alerts of one streaming plan with an aggregation of windows behind that of events, over two turns with late events; rules alone decide, which SQL can follow."""
    return _rounded(_chained(spark, sf, RULES_ONLY, k=3, trees=10).select("id", "window_start", "src_ip", "severity", "threat_score", "source_alert_ids"))


def dns_stream_final(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all three detectors."""
    return _chained(spark, sf, correlation.Config(window=DAY, min_score=40, min_percentile=90), trees=100, contamination=0.1, chosen=0.9)


def dns_tailed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by source and hour that a cursor over logs reads in two turns, between which logs are added and the stream starts again."""
    root = _new_folder(spark, "tail")
    own = dns_events(spark, sf)
    lines = own.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "uid", F.col("src_ip").alias("id.orig_h"), "query")).alias("value"), (F.col("ts") < TURN).alias("early"))
    for turn in ("early", "not early"):
        lines.where(turn).select("value").write.mode("append").text(f"{root}/logs")
        read = events.normalize(records.parse_lines(tailing.tail(spark, f"{root}/logs", "part-*")))
        read.select("ts", "src_ip", "uid").writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("ts timestamp, src_ip string, uid string").parquet(f"{root}/events")
    return _rounded(found.groupBy("src_ip", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events"), F.countDistinct("uid").alias("uids")))


def dns_rules_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that fire by a table of definitions, in which one has lower thresholds and one is off, with their descriptions."""
    table = rule_definitions(spark).withColumn("enabled", F.col("rule_name") != "heuristic_fastflux")
    lower = F.when((F.col("rule_name") == "heuristic_dga") & (F.col("feature") == "nxdomain_rate"), 0.9).when((F.col("rule_name") == "heuristic_resolver_failure") & (F.col("feature") == "total_queries"), 5.0)
    judged = evaluate_definitions(_day(spark, sf)[0], table.withColumn("threshold", F.coalesce(lower, "threshold")))
    return _rounded(described(judged.select("window_start", "src_ip", fired_rules().alias("heuristics_fired")), table).select("window_start", "src_ip", "rule_name", "description"))


def dns_alert_uids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that rule and reconstruction alerts get which have none."""
    alerts = _all_alerts(spark, sf)
    bare = [alerts[k].drop("id", "alert_uid") for k in ("reconstruction", "rules")]
    return _rounded(events.union_inputs([a.select("window_start", "src_ip", "alert_type", store.alert_uid(a).alias("alert_uid")) for a in bare]))


def dns_stored_flat(spark: SparkSession, sf: str) -> DataFrame:
    """All flat columns of the stored alerts of all families."""
    flat = [store.stored_alerts(a) for a in _all_alerts(spark, sf).values()]
    return _rounded(events.union_inputs([f.select("alert_uid", *store.COLUMNS, "threat_score", "severity") for f in flat]))


def dns_source_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(A.timeline(_together(_all_alerts(spark, sf))))


def dns_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts of one source."""
    return _rounded(A.investigate(_together(_all_alerts(spark, sf)), "10.0.0.1"))


def dns_time_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of times of which one in eleven was read in the wrong unit, and one in a hundred can't be recovered."""
    own = dns_events(spark, sf)
    number = F.substring("uid", 2, 20).cast("long")
    raw = F.when(number % 100 != 0, F.unix_micros("ts").cast("string"))
    broken = own.withColumns({"ts_raw": raw, "ts": F.when(number % 11 == 0, F.timestamp_seconds(F.lit(253_000_000_000))).otherwise(F.col("ts"))})
    return _rounded(gates.time_gate(gates.recovered(broken)).drop("reason"))


def dns_contour(spark: SparkSession, sf: str) -> DataFrame:
    """The decision of a forest over the plane of two principal components, on a grid."""
    scaled = written(detectors.scale(written(_windows(spark, sf), "windows")).select("window_start", "src_ip", "scaled"), "scaled")
    forest = detectors.fit_isolation(scaled, trees=100)
    offset = detectors.exact_quantiles(written(detectors.score_isolation(scaled, forest).select("isolation"), "isolated"), "isolation", (0.99,))[0]
    axes, _ = detectors.fit_plane(scaled)
    return detectors.contour(detectors.project_plane(scaled, axes), axes, forest, offset)


def dns_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """What pushes the anomalous windows toward isolation: mean attributions of the features and their ranks."""
    scaled = written(detectors.scale(written(_windows(spark, sf), "windows")).select("window_start", "src_ip", "scaled"), "scaled")
    forest = detectors.fit_isolation(scaled)
    labelled, _ = detectors.label_isolation(written(detectors.score_isolation(scaled, forest), "isolated"))
    odd = detectors.attribute_isolation(labelled.where("predicted_label = 'anomaly'"), forest)
    return views.attribution_summary(detectors.long_form(odd, "attribution"))


def dns_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Windows on the plane of two principal components."""
    scaled = written(detectors.scale(written(_windows(spark, sf), "windows")).select("window_start", "src_ip", "scaled"), "scaled")
    axes, _ = detectors.fit_plane(scaled)
    return detectors.project_plane(scaled, axes).drop("scaled")


def dns_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    value, rows, why = detectors.silhouette(_isolated(_plain(_day(spark, sf)[0])), "predicted_label")
    return spark.createDataFrame([(value, rows, why)], "silhouette double, windows long, undefined string")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events as a stream over files that landed in a folder, and as a table of the same files."""
    path = _new_folder(spark, "landed")
    own = dns_events(spark, sf)
    own.write.parquet(path)
    return spark.readStream.schema(own.schema).parquet(path), spark.read.schema(own.schema).parquet(path)


#: What no SQL can express, or would not say more than a count; tests hold their operators against plain versions.
UNCHECKED = (dns_stream_detectors, dns_stream_final, dns_contour, dns_attributions, dns_plane, dns_silhouette)

QUERIES = (
    dns_scored_windows, dns_top_errors, dns_latest_windows, dns_reading_card, dns_score_summary, dns_score_histogram, dns_residual_weights, dns_residual_summary, dns_value_ranks,
    dns_percentiles, dns_isolation_alerts, dns_reconstruction_alerts, dns_rule_alert_details, dns_final_alerts, dns_run_statistics, dns_final_list, dns_unified_counters, dns_families,
    dns_filtered_alerts, dns_latest_alerts, dns_report, dns_alert_lookup, dns_first_events, dns_last_events, dns_merge_counters, dns_feature_summary, dns_alignment, dns_split,
    dns_stratified, dns_history, dns_repaired, dns_coverage, dns_stream_alerts, dns_stream_rule_final, dns_tailed_events,
    dns_rules_by_table, dns_alert_uids, dns_stored_flat, dns_stratified_rows, dns_source_timeline, dns_source_rows, dns_time_recovered, *UNCHECKED,
)

_SCORED = ", z AS (SELECT *, " + ", ".join(f"coalesce((CAST({f} AS DOUBLE) - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0) AS z_{f}" for f in FEATURES) + " FROM w), pl AS (SELECT *, (" + " + ".join(f"abs(z_{f})" for f in FEATURES) + f""") / {len(FEATURES)} AS err FROM z),
th AS (SELECT quantile_cont(err, {SHARE}) AS th FROM pl),
sc AS (SELECT pl.*, th, err / th AS ratio, err > th AS anomaly, 100.0 * count(*) OVER (ORDER BY err RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS pct, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start FROM pl, th)"""
_PLAIN = _WINDOWS + _SCORED


def _id(prefix: str, basis: str) -> str:
    return f"'{prefix}' || upper(substr(sha256({basis}), 1, 20))"


_CASES = "CASE " + " ".join(f"WHEN list_contains(fired, '{k}') THEN '{v}' END, CASE" for k, v in D.RULE_CAUSES.items())
_CAUSES = "array_to_string(list_filter([" + _CASES.removesuffix(", CASE") + "], lambda x: x IS NOT NULL), '; ')"
_ALERTS = _STORE + _SCORED + f""", nd AS (SELECT ws, src_ip, count(*) AS nd FROM d GROUP BY ALL),
cx AS (SELECT date_trunc('day', ts) AS ws, src_ip, least(10, count(DISTINCT query_clean)) AS nc FROM e WHERE query_clean <> '' GROUP BY ALL),
ru AS (SELECT st.ws, st.src_ip, alert_uid AS id, st.window_start, st.threat_score, CASE WHEN st.threat_score >= 90 THEN 'critical' WHEN st.threat_score >= 70 THEN 'high' WHEN st.threat_score >= 40 THEN 'medium' ELSE 'low' END AS severity,
 coalesce(nd, 0) AS n_domains, fired, CASE WHEN heuristic_rogue_resolver THEN array_to_string(servers, ',') ELSE '' END AS rogue FROM st JOIN a USING (ws, src_ip) LEFT JOIN nd USING (ws, src_ip)),
ia AS (SELECT sc.ws, src_ip, window_start, {_id("CATF-", f"'categorization_forest|' || {_ISO} || '|' || src_ip")} AS id, CASE WHEN pct >= 99.9 THEN 'critical' WHEN pct >= 99 THEN 'high' WHEN pct >= 97.5 THEN 'medium' ELSE 'low' END AS severity,
 CAST(round_even(least(100, pct), 0) AS BIGINT) AS threat_score, err - th AS isolation_score, pct, coalesce(nd, nc, 0) AS n_domains, sha256({_ISO} || '|' || src_ip || '|categorization_forest|dns_isolation_forest') AS alert_fingerprint
 FROM sc LEFT JOIN nd USING (ws, src_ip) LEFT JOIN cx USING (ws, src_ip) WHERE anomaly),
ra AS (SELECT sc.ws, src_ip, window_start, {_id("AE-", f"'autoencoder|' || {_ISO} || '|' || src_ip")} AS id, CASE WHEN ratio >= 2 THEN 'high' WHEN ratio >= 1.5 THEN 'medium' ELSE 'low' END AS severity, err, th, round(ratio, 6) AS ratio, coalesce(nd, 0) AS n_domains
 FROM sc LEFT JOIN nd USING (ws, src_ip) WHERE anomaly),
al AS (SELECT ws, src_ip, window_start, id, severity, CAST(threat_score AS DOUBLE) AS threat_score, NULL AS err, NULL AS th, 'isolation' AS family, 'categorization_forest, isolation_forest' AS methods FROM ia
 UNION ALL SELECT ws, src_ip, window_start, id, severity, NULL, err, th, 'reconstruction', 'autoencoder' FROM ra
 UNION ALL SELECT ws, src_ip, window_start, id, severity, CAST(threat_score AS DOUBLE), NULL, NULL, 'rules', array_to_string(fired, ', ') FROM ru),
k AS (SELECT coalesce(x.ws, r.ws) AS ws, coalesce(x.src_ip, r.src_ip) AS src_ip, x.iid, x.aid, r.id AS rid, CASE WHEN pct >= 95 THEN least(100, pct) END AS i, CASE WHEN x.ratio >= 1.2 THEN least(100, 50 + 25 * (x.ratio - 1)) END AS n, CASE WHEN r.threat_score >= 40 THEN CAST(r.threat_score AS DOUBLE) END AS h
 FROM (SELECT ia.*, ra.id AS aid, ia.id AS iid, ra.ratio FROM ia JOIN ra USING (ws, src_ip)) x FULL JOIN ru r ON x.ws = r.ws AND x.src_ip = r.src_ip),
k1 AS (SELECT *, CAST(i IS NOT NULL AS BIGINT) + CAST(n IS NOT NULL AS BIGINT) + CAST(h IS NOT NULL AS BIGINT) AS active, 0.3 * coalesce(i, 0) + 0.3 * coalesce(n, 0) + 0.4 * coalesce(h, 0) AS base FROM k),
k2 AS (SELECT *, round(least(100, base + CASE WHEN active >= 3 THEN 25 WHEN active = 2 THEN 15 ELSE 0 END), 6) AS total FROM k1),
co AS (SELECT {_id("FINAL-", f"'final-correlation|' || src_ip || '|' || {_ISO}")} AS id, *, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, CASE WHEN total >= 90 THEN 'critical' WHEN total >= 75 THEN 'high' WHEN total >= 60 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN active < 2 THEN 'suppressed_consensus' WHEN total < 65 THEN 'suppressed_score' ELSE 'alert' END AS outcome FROM k2)"""
_TEXT = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_HOUR = _TEXT("date_trunc('hour', ts)")
_RULE_ID = _id("HEUR-", f"'heuristics|' || {_ISO} || '|' || src_ip || '|' || array_to_string(fired, '|')")
_NOT_NULL = "lambda x: x IS NOT NULL"
#: Events that a stream in two turns takes: those of the first turn, and of the second those behind an hour before the first's last event.
_TURNS = _EVENTS.replace("e AS (SELECT event_id", "ea AS (SELECT event_id") + f""", fi AS (SELECT *, ts < TIMESTAMP '{TURN}' AND NOT (event_id % 7 = 0 AND ts >= TIMESTAMP '{LATE}') AS early FROM ea),
e AS (SELECT fi.* FROM fi, (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM fi WHERE early) WHERE early OR ts > wm)"""

_SAID = "CASE r " + " ".join(f"WHEN '{k}' THEN '{said}'" for k, (said, _) in DEFINITIONS.items()) + " END"
_DOMAIN_NAMES = "dn AS (SELECT ws, src_ip, array_to_string(list(query ORDER BY rank)[1:5], ',') AS names FROM d GROUP BY ALL)"
_MICRO = "CAST(CAST(round(err * 1e6) AS BIGINT) AS VARCHAR)"
_END = _ISO.replace("strftime(ws,", "strftime(ws + INTERVAL 1 DAY,")

def _stored(kind: str, source: str, values: dict[str, str]) -> str:
    """A family's alerts as they are stored: what every column holds that the family doesn't have, and its own."""
    k, day = A.KINDS[kind], "strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')"
    held = {c: "'" + str(other) + "'" if kind == "string" else f"CAST({other} AS {'BIGINT' if kind == 'int' else 'DOUBLE'})" for c, (kind, other) in store.COLUMNS.items()}
    held |= {"alert_name": f"'{k.alert_name}'", "alert_type": f"'{k.alert_type}'", "window_start": "window_start", "window_end": day, "src_ip": "src_ip", "model_name": f"'{k.model_name}'", "window_size": f"'{DAY}'"} | values
    severity = "CASE WHEN threat_score >= 75 THEN 'high' WHEN threat_score >= 50 THEN 'medium' WHEN threat_score >= 25 THEN 'low' ELSE severity END"
    return f"SELECT id AS alert_uid, {', '.join(f'{v} AS {c}' for c, v in held.items())}, threat_score, {severity} AS severity FROM {source}"


_STORED = " UNION ALL ".join((
    _stored("isolation", "ia", {"isolation_score": "round(isolation_score, 6)", "score_margin": "round(isolation_score, 6)", "score_percentile": "round(pct, 6)"}),
    _stored("reconstruction", "(SELECT *, CAST(20 + CASE WHEN n_domains > 0 THEN 15 ELSE 0 END + CASE WHEN err / th >= 2 THEN 15 WHEN err / th >= 1.5 THEN 8 ELSE 0 END AS BIGINT) AS threat_score FROM ra)", {"reconstruction_error": "round(err, 6)", "threshold": "round(th, 6)"}),
    _stored("rules", "ru", {}),
))

SQL = {
    "dns_stratified_rows": f"WITH {_PLAIN}, p AS (SELECT ws, window_start, src_ip, CASE WHEN anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label, CAST('0x' || substr(md5('42|' || {_ISO} || '|' || src_ip), 1, 15) AS BIGINT) AS place FROM sc),"
    " n AS (SELECT predicted_label, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT predicted_label, least(n, greatest(2, round_even(100 * n / sum(n) OVER (), 0))) AS want FROM n),"
    " r AS (SELECT p.*, want, row_number() OVER (PARTITION BY predicted_label ORDER BY place, ws, src_ip) AS nth FROM p JOIN q USING (predicted_label))"
    " SELECT window_start, src_ip, predicted_label FROM r ORDER BY CASE WHEN nth <= least(2, want) THEN 2 WHEN nth <= want THEN 1 ELSE 0 END DESC, place, ws, src_ip LIMIT 100",
    "dns_stored_flat": f"WITH {_ALERTS} {_STORED}",
    "dns_rules_by_table": f"WITH {_RULES}, x AS (SELECT window_start, src_ip, CASE WHEN heuristic_dga AND nxdomain_rate >= 0.9 THEN 'heuristic_dga' END AS r FROM (SELECT *, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start FROM j) UNION ALL SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), src_ip, 'heuristic_tunnel' FROM j WHERE heuristic_tunnel"
    " UNION ALL SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), src_ip, 'heuristic_resolver_failure' FROM j WHERE total_queries >= 5 AND (servfail_rate >= 0.5 OR nxdomain_rate >= 0.7) UNION ALL SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), src_ip, 'heuristic_rogue_resolver' FROM j WHERE heuristic_rogue_resolver)"
    f" SELECT window_start, src_ip, r AS rule_name, {_SAID} AS description FROM x WHERE r IS NOT NULL",
    "dns_alert_uids": f"WITH {_ALERTS}, {_DOMAIN_NAMES} SELECT window_start, src_ip, 'autoencoder_anomaly' AS alert_type, id AS alert_uid FROM ra UNION ALL SELECT window_start, src_ip, 'heuristics_rule', sha256({_ISO} || '|' || {_END} || '|' || src_ip || '|heuristics_rule|||' || array_to_string(list_sort(fired), ', ') || '|' || coalesce(names, '')) FROM ru LEFT JOIN dn USING (ws, src_ip)",
    "dns_source_timeline": f"WITH {_ALERTS} SELECT src_ip, strftime(date_trunc('hour', ws), '%Y-%m-%d %H:%M:%S') AS hour, family, count(*) AS alerts, max(coalesce(threat_score, 0)) AS max_score FROM al GROUP BY ALL",
    "dns_source_rows": f"WITH {_ALERTS}, so AS (SELECT ws, src_ip, err - th AS score FROM sc) SELECT id, window_start, family, CASE family WHEN 'isolation' THEN 'categorization_forest' WHEN 'reconstruction' THEN 'autoencoder_anomaly' ELSE 'heuristics_rule' END AS alert_type, severity, threat_score, 'New' AS status, round(CASE WHEN family = 'isolation' THEN score END, 6) AS isolation_score, round(al.err, 6) AS reconstruction_error, methods AS detection_type FROM al JOIN so USING (ws, src_ip) WHERE src_ip = '10.0.0.1'",
    "dns_time_recovered": f"WITH {_EVENTS}, r AS (SELECT *, event_id % 11 = 0 AND event_id % 100 = 0 AS lost FROM e) SELECT count(*) AS records, count(*) FILTER (WHERE lost) AS invalid, {_TEXT('min(ts) FILTER (WHERE NOT lost)')} AS first_ts, {_TEXT('max(ts) FILTER (WHERE NOT lost)')} AS last_ts, round((floor(epoch(max(ts) FILTER (WHERE NOT lost))) - floor(epoch(min(ts) FILTER (WHERE NOT lost)))) / 86400, 6) AS span_days, count(*) > 0 AND invalid = 0 AND span_days <= 3660 AS passed FROM r",
    "dns_stream_rule_final": f"WITH {_TURNS}{_STORE[len(_EVENTS):]}, f AS (SELECT st.*, {_id('FINAL-', f"'final-correlation|' || src_ip || '|' || {_ISO}")} AS id FROM st WHERE threat_score >= 40 AND ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR)"
    " SELECT id, window_start, src_ip, CASE WHEN threat_score >= 90 THEN 'critical' WHEN threat_score >= 75 THEN 'high' WHEN threat_score >= 60 THEN 'medium' ELSE 'low' END AS severity, threat_score, alert_uid AS source_alert_ids FROM f",
    "dns_tailed_events": f"WITH {_EVENTS} SELECT src_ip, {_HOUR} AS hour, count(*) AS events, count(DISTINCT uid) AS uids FROM e GROUP BY ALL",
    "dns_scored_windows": f"WITH {_PLAIN} SELECT window_start, src_ip, round(err, 6) AS reconstruction_error, round(th, 6) AS threshold, round(ratio, 6) AS threshold_ratio, anomaly FROM sc",
    "dns_top_errors": f"WITH {_PLAIN} SELECT window_start, src_ip, round(err, 6) AS reconstruction_error FROM sc ORDER BY err DESC, ws, src_ip LIMIT 10",
    "dns_latest_windows": f"WITH {_PLAIN}, l AS (SELECT * FROM sc ORDER BY ws DESC, src_ip DESC LIMIT 100) SELECT window_start, src_ip, 'reconstruction_error' AS series, round(err, 6) AS value FROM l UNION ALL SELECT window_start, src_ip, 'threshold', round(th, 6) FROM l",
    "dns_reading_card": f"WITH {_PLAIN} SELECT count(*) AS windows, count(*) FILTER (WHERE anomaly) AS anomalous, round(max(err), 6) AS highest, round(min(err), 6) AS lowest, round(avg(err), 6) AS mean FROM sc",
    "dns_score_summary": f"WITH {_PLAIN} SELECT round(min(err), 6) AS lowest, round(avg(err), 6) AS mean, round(max(err), 6) AS highest, round(avg(CAST(anomaly AS INTEGER)), 6) AS anomaly_rate, round(quantile_cont(err, 0.5), 6) AS median, round(quantile_cont(err, 0.99), 6) AS p99,"
    " round(coalesce(quantile_cont(err, 0.5) FILTER (WHERE anomaly) - quantile_cont(err, 0.5) FILTER (WHERE NOT anomaly), quantile_cont(err, 0.95) - quantile_cont(err, 0.5)), 6) AS gap FROM sc",
    "dns_score_histogram": f"WITH {_PLAIN}, x AS (SELECT min(err) AS low, max(err) AS high FROM sc) SELECT CASE WHEN anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label, CAST(least(54, coalesce(floor((err - low) / nullif((high - low) / 55, 0)), 0)) AS BIGINT) AS bin, count(*) AS n FROM sc, x GROUP BY ALL",
    "dns_residual_weights": f"WITH {_PLAIN}, r AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(CASE WHEN count(*) >= 3 AND var_pop({f}) > 0 AND var_pop(abs(z_{f})) > 0 THEN corr({f}, abs(z_{f})) END, 0) AS c, avg(abs(z_{f})) AS m FROM sc" for f in FEATURES)
    + ") SELECT feature, round(c, 6) AS correlation, round(m, 6) AS mean_residual, round(coalesce(m / nullif(max(m) OVER (), 0), 0), 6) AS relative_weight FROM r",
    "dns_residual_summary": f"WITH {_PLAIN}, r AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs(z_{f})) AS m FROM sc" for f in FEATURES) + ") SELECT feature, round(m, 6) AS mean_abs, round(m, 6) AS mean, dense_rank() OVER (ORDER BY round(m, 12) DESC) AS rank FROM r",
    "dns_value_ranks": f"WITH {_WINDOWS}, v AS (" + " UNION ALL ".join(f"SELECT ws, src_ip, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM w" for f in ("total_queries", "unique_dns_servers", "answer_count_max"))
    + f") SELECT {_TEXT('ws')} AS window_start, src_ip, feature, round(value, 6) AS value, round((rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2) / count(*) OVER (PARTITION BY feature), 6) AS percentile FROM v",
    "dns_percentiles": f"WITH {_PLAIN} SELECT window_start, src_ip, round(err - th, 6) AS isolation_score, round(pct, 6) AS score_percentile, CASE WHEN anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label FROM sc",
    "dns_isolation_alerts": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity, threat_score, round(isolation_score, 6) AS isolation_score, round(pct, 6) AS score_percentile, n_domains, alert_fingerprint FROM ia",
    "dns_reconstruction_alerts": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity, round(err, 6) AS reconstruction_error, ratio AS threshold_ratio, n_domains, '{D.BASELINE_CAUSE}' AS cause FROM ra",
    "dns_rule_alert_details": f"WITH {_ALERTS} SELECT id, severity, threat_score, n_domains, {_CAUSES} AS causes, rogue AS rogue_dns_servers, array_to_string(fired, ', ') AS methods FROM ru",
    "dns_final_alerts": f"WITH {_ALERTS} SELECT id, src_ip, window_start, round(coalesce(i, 0), 6) AS isolation_evidence, round(coalesce(n, 0), 6) AS reconstruction_evidence, round(coalesce(h, 0), 6) AS rules_evidence, active, round(base, 6) AS base, round(total, 6) AS threat_score, severity, outcome FROM co",
    "dns_run_statistics": f"WITH {_ALERTS} SELECT count(*) AS windows, count(*) FILTER (WHERE active = 2) AS two_detectors, count(*) FILTER (WHERE active = 3) AS three_detectors, count(*) FILTER (WHERE outcome = 'suppressed_consensus') AS suppressed_consensus, count(*) FILTER (WHERE outcome = 'suppressed_score') AS suppressed_score, count(*) FILTER (WHERE outcome = 'alert') AS final_alerts FROM co",
    "dns_final_list": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity, CAST(round_even(total, 0) AS BIGINT) AS threat_score, round_even(total, 4) AS final_score, active AS models_agreeing, array_to_string(list_filter([CASE WHEN i > 0 THEN 'Isolation Forest' END, CASE WHEN n > 0 THEN 'Autoencoder' END, CASE WHEN h > 0 THEN 'Heuristics' END], {_NOT_NULL}), ', ') AS active_models,"
    f" array_to_string(list_filter([CASE WHEN i IS NOT NULL THEN iid END, CASE WHEN n IS NOT NULL THEN aid END, CASE WHEN h IS NOT NULL THEN rid END], {_NOT_NULL}), ', ') AS contributing_alert_ids, active AS contributing_alert_count FROM co WHERE outcome = 'alert' ORDER BY ws DESC, round_even(total, 4) DESC, id LIMIT 50",
    "dns_unified_counters": f"WITH {_ALERTS} SELECT (SELECT count(*) FROM ia) AS isolation_alerts, (SELECT count(*) FROM ra) AS reconstruction_alerts, (SELECT count(*) FROM ru) AS rules_alerts, count(*) AS final_alerts, count(*) FILTER (WHERE active >= 3) AS three_detectors FROM co WHERE outcome = 'alert'",
    "dns_families": f"WITH {_ALERTS} SELECT src_ip, family, family AS shown_as, count(*) AS alerts FROM al GROUP BY ALL",
    "dns_filtered_alerts": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity FROM al WHERE severity IN ('high', 'medium') AND src_ip IN ('10.0.0.0', '10.0.0.1', '10.0.0.3') AND ws >= TIMESTAMP '{NOW}' - INTERVAL 120 HOUR",
    "dns_latest_alerts": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity FROM al ORDER BY ws DESC, id DESC LIMIT 20",
    "dns_report": f"WITH {_ALERTS} SELECT id, window_start, src_ip, severity, threat_score, 'New' AS status, round(err, 6) AS reconstruction_error, round(th, 6) AS threshold, methods AS detection_type, '{NOW}' AS created_at_utc FROM al",
    "dns_alert_lookup": f"WITH {_ALERTS}, f AS (SELECT ws, src_ip, id FROM ru ORDER BY id LIMIT 10) SELECT f.id AS alert_uid, query, count, CAST(suspicion_score AS BIGINT) AS suspicion_score, {_R('max_entropy')} FROM d JOIN f USING (ws, src_ip)",
    "dns_first_events": f"WITH {_EVENTS} SELECT src_ip, CAST(CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS BIGINT) AS input, {_HOUR} AS hour, count(*) AS events FROM e GROUP BY ALL",
    "dns_last_events": f"WITH {_EVENTS} SELECT src_ip, query_clean, uid, {_TEXT('ts')} AS ts FROM e QUALIFY row_number() OVER (PARTITION BY src_ip, query_clean ORDER BY ts DESC, uid DESC) = 1",
    "dns_merge_counters": f"WITH {_EVENTS}, v AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT suffix(uid, '50')) AS k FROM e) SELECT 2 * n AS lines_read, CAST(2 AS BIGINT) AS files_processed, k AS inserted, k AS duplicates, 2 * (n - k) AS invalid, k > 0 AND n = k AS passed FROM v",
    "dns_feature_summary": f"WITH {_SHORT_WINDOWS} SELECT count(*) AS windows, count(DISTINCT src_ip) AS sources, {_TEXT('min(ws)')} AS first_window, {_TEXT('max(ws)')} AS last_window, CAST({len(FEATURES)} AS BIGINT) AS feature_count FROM w",
    "dns_alignment": f"WITH {_SHORT_WINDOWS}, c AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ws, src_ip, count(*) AS n FROM e GROUP BY ALL) SELECT count(*) AS misaligned FROM w FULL JOIN c USING (ws, src_ip) WHERE total_queries IS DISTINCT FROM n",
    "dns_split": f"WITH {_SHORT_WINDOWS} SELECT {_SPLIT} AS split, count(*) AS windows FROM w GROUP BY ALL",
    "dns_stratified": f"WITH {_PLAIN}, c AS (SELECT CASE WHEN anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label, count(*) AS n FROM sc GROUP BY ALL) SELECT predicted_label, CAST(least(n, greatest(2, round_even(100 * n / sum(n) OVER (), 0))) AS BIGINT) AS windows FROM c",
    "dns_history": f"WITH {_PLAIN} SELECT window_start, src_ip, round(err, 6) AS reconstruction_error, CAST(epoch(ws) AS BIGINT) + 2 AS seq FROM sc ORDER BY seq DESC, ws, src_ip LIMIT 150",
    "dns_repaired": f"WITH {_WINDOWS} SELECT src_ip, round(sum(CASE WHEN day(ws) % 3 = 0 THEN 0 ELSE avg_rtt END), 6) AS avg_rtt, round(sum(CASE WHEN day(ws) % 4 = 0 THEN 0 ELSE max_rtt END), 6) AS max_rtt, CAST(sum(total_queries) AS BIGINT) AS total_queries FROM w GROUP BY src_ip",
    "dns_coverage": f"WITH {_EVENTS}, c AS (SELECT src_ip, CAST(5 * count(DISTINCT floor(epoch(ts) / 300)) AS DOUBLE) AS m, min(ts) AS first_ts FROM e GROUP BY src_ip) SELECT src_ip, CASE WHEN m < 60 THEN format('{{:,.0f}} min', m) WHEN m < 2880 THEN format('{{:,.2f}} h', m / 60) ELSE format('{{:,.2f}} days', m / 1440) END AS covered, {_TEXT('first_ts')} || ' UTC' AS first_seen FROM c",
    "dns_stream_alerts": f"WITH {_RULES} SELECT {_RULE_ID} AS id, window_start, src_ip, heuristics_fired, threat_score FROM a WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR",
}
