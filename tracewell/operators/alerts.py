"""Alerts of the three detectors in full, and the readers and views that work on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators import windows as W
from tracewell.operators.correlation import Config
from tracewell.operators.detectors import top_features
from tracewell.operators.store import with_domains
from tracewell.schema import FEATURES


@dataclass(frozen=True)
class Kind:
    prefix: str
    basis: str
    alert_name: str
    alert_type: str
    detection_type: str
    model_name: str


#: Prefix and basis of the ids of each family's alerts, and what their columns say.
KINDS = {
    "isolation": Kind("CATF-", "categorization_forest", "DNS categorization Isolation Forest anomaly", "categorization_forest", "categorization_forest", "dns_isolation_forest"),
    "reconstruction": Kind("AE-", "autoencoder", "DNS autoencoder anomaly", "autoencoder_anomaly", "deep_learning_autoencoder", "DNS Autoencoder"),
    "rules": Kind("HEUR-", "heuristics", "DNS heuristic rule detection", "heuristics_rule", "heuristics", "DNS Heuristics"),
}
#: The types by which the dashboards know rule alerts.
RULE_TYPES = ("heuristics_rule", "rule_based_suspicious", "high_confidence_suspicious")
#: Columns that a list of each family's alerts shows, in order.
SHOWN = {
    "isolation": ("id", "window_start", "src_ip", "severity", "threat_score", "status", "isolation_score", "isolation_threshold", "score_percentile"),
    "reconstruction": ("id", "window_start", "src_ip", "severity", "alert_type", "reconstruction_error", "threshold", "threshold_ratio"),
    "rules": ("id", "window_start", "src_ip", "severity", "threat_score", "status", "heuristics_fired"),
}
#: Columns of a report, in order.
REPORT = ("id", "window_start", "src_ip", "severity", "threat_score", "status", "reconstruction_error", "threshold", "detection_type", "created_at_utc")
#: An alert as it is stored in a line of JSON.
STORED = (
    "id string, alert_uid string, window_start timestamp, window_end timestamp, src_ip string, status string, alert_name string, alert_type string, detection_type string, model_name string, "
    "window_size string, severity string, threat_score double, reconstruction_error double, threshold double, threshold_ratio double, isolation_score double, isolation_threshold double, "
    "score_margin double, score_percentile double, detection_methods map<string,boolean>, heuristics_fired array<string>, rogue_dns_servers array<string>, possible_causes array<string>, scoring_mode string"
)


def alert_id(family: str, *parts: Column) -> Column:
    """The id of a family's alert of a window and source; rule alerts add the fired rules."""
    kind = KINDS[family]
    return D.stable_id(kind.prefix, F.lit(kind.basis), D.iso_time(F.col("window_start")), F.col("src_ip"), *parts)


def _common(family: str, size: str, mode: str, ident: Column) -> dict[str, Column]:
    kind = KINDS[family]
    return {
        "id": ident, "alert_uid": ident, "status": F.lit("New"), "alert_name": F.lit(kind.alert_name), "alert_type": F.lit(kind.alert_type), "detection_type": F.lit(kind.detection_type),
        "model_name": F.lit(kind.model_name), "window_size": F.lit(size), "scoring_mode": F.lit(mode), "features": F.struct(*FEATURES),
        "alert_fingerprint": D.alert_fingerprint(D.iso_time(F.col("window_start")), F.col("src_ip"), F.lit(kind.alert_type), F.lit(kind.model_name)),
    }


def _flags(*names: str) -> Column:
    return F.create_map(*(F.lit(x) for n in names for x in (n, True)))


def _domains_or(alerts: DataFrame, domains: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """``suspicious_domains`` of each alert's window; where it has none, those of ``context``; else an empty array."""
    if context is not None:
        shared = [f for f in domains.schema.fields if f.name in context.columns]
        domains = domains.select(*(f.name for f in shared)).unionByName(context.select(*(F.col(f.name).cast(f.dataType) for f in shared)))
    listed = with_domains(alerts, domains)
    return listed.withColumn("suspicious_domains", F.coalesce("suspicious_domains", F.array().cast(listed.schema["suspicious_domains"].dataType)))


def rule_alerts(judged: DataFrame, domains: DataFrame, size: str = "5 minutes", mode: str = "full-log") -> DataFrame:
    """Alerts of the windows in which a rule fired, with causes, domains, resolvers, features and flags."""
    alerts = W.rule_alerts(judged, domains)
    methods = F.create_map(*(x for k in W.POINTS for x in (F.lit(k), F.col(k))))
    named = alerts.withColumns(_common("rules", size, mode, F.col("id")) | {"detection_methods": methods, "possible_causes": D.rule_causes(F.col("heuristics_fired"))})
    return _domains_or(named, domains).drop(*FEATURES, *W.POINTS, "n_domains", "dns_servers", "w")


def reconstruction_alerts(scored: DataFrame, domains: DataFrame, size: str = "5 minutes", mode: str = "full-log") -> DataFrame:
    """Alerts of scored windows whose error exceeds a positive ``threshold``, with the ten features of largest residual and the window's domains."""
    ratio = F.col("reconstruction_error") / F.col("threshold")
    found = scored.where("threshold > 0 and reconstruction_error > threshold")
    pair = F.zip_with("scaled", "residuals", lambda s, r: F.struct(s.alias("input_scaled"), r.alias("residual")))
    named = F.zip_with(F.array(*map(F.lit, FEATURES)), F.zip_with(pair, "reconstructed", lambda p, y: F.struct(p["input_scaled"].alias("x"), p["residual"].alias("r"), y.alias("y"))), lambda n, v: F.struct(v["r"].alias("absolute_error"), n.alias("feature"), v["x"].alias("input_scaled"), v["y"].alias("reconstructed_scaled")))
    top = F.transform(F.slice(F.sort_array(named, asc=False), 1, 10), lambda s: F.struct(s["feature"].alias("feature"), *(F.round(s[c], 8).alias(c) for c in ("absolute_error", "input_scaled", "reconstructed_scaled"))))
    alerts = found.withColumns({
        **_common("reconstruction", size, mode, alert_id("reconstruction")), "severity": D.severity_reconstruction(ratio), "detection_methods": _flags("autoencoder"),
        "top_contributing_features": top, "possible_causes": F.array(F.lit(D.BASELINE_CAUSE)), "threshold_ratio": F.round(ratio, 6),
    })
    return _domains_or(alerts, domains).drop(*FEATURES, "scaled", "latent", "residuals", "reconstructed", "dns_servers", "suspicious", "w")


def isolation_alerts(scored: DataFrame, domains: DataFrame, context: DataFrame | None = None, size: str = "5 minutes", mode: str = "full-log") -> DataFrame:
    """Alerts of scored windows that are labelled anomalies, with their percentile's severity, the strongest features and the window's domains, or else its commonest ones.

    ``scored`` has ``isolation_score`` (above 0: an anomaly), ``isolation_threshold``, ``score_percentile`` and, where trees were asked, ``attribution``.
    """
    score, share = F.col("isolation_score"), F.col("score_percentile")
    found = scored.where("predicted_label = 'anomaly'")
    if "attribution" in scored.columns:
        top = F.transform(top_features("attribution", 8), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), F.when(s["value"] > 0, "toward_anomaly").otherwise("toward_normal").alias("direction"), F.lit("tree_shap").alias("explanation_method")))
    else:
        top = F.transform(top_features("scaled", 8), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), F.lit("unusual_magnitude").alias("direction"), F.lit("scaled_deviation_fallback").alias("explanation_method")))
    alerts = found.withColumns({
        **_common("isolation", size, mode, alert_id("isolation")), "severity": D.severity_isolation_alert(share, score), "threat_score": D.isolation_points(share, score),
        "detection_methods": _flags("categorization_forest", "isolation_forest"), "top_contributing_features": top, "decision_function": -score, "score_margin": score - F.col("isolation_threshold"),
    })
    alerts = alerts.withColumn("possible_causes", D.feature_causes(F.transform("top_contributing_features", lambda s: s["feature"])))
    return _domains_or(alerts, domains, context).drop(*FEATURES, "scaled", "attribution", "dns_servers", "suspicious", "w")


def _on(name: str) -> Column:
    return F.coalesce(F.try_element_at("detection_methods", F.lit(name)), F.lit(False))


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def family(variant: str = "correlation") -> Column:
    """The family of an alert, null if it is of none.

    ``correlation`` looks at type, detection type and flags; an alert with a rule's flag is none of the reconstruction. ``dashboard`` tells
    isolation by type, rules by type or flag, and takes all others for the reconstruction's.
    """
    rule = F.lit(False)
    for k in W.POINTS:
        rule = rule | _on(k)
    if variant == "dashboard":
        return F.when(_is("alert_type", "categorization_forest"), "isolation").when(_is("alert_type", *RULE_TYPES) | rule, "rules").otherwise("reconstruction")
    kind = {n: _is("alert_type", k.alert_type) | _is("detection_type", k.detection_type) for n, k in KINDS.items()}
    isolation = kind["isolation"] | _on("categorization_forest") | _on("isolation_forest")
    return F.when(isolation, "isolation").when((kind["reconstruction"] | _on("autoencoder")) & ~rule, "reconstruction").when(kind["rules"] | rule, "rules")


def filter_alerts(alerts: DataFrame, severities: list[str] | None = None, statuses: list[str] | None = None, sources: list[str] | None = None, hours: float | None = None, now: Column | None = None) -> DataFrame:
    """Alerts of the given severities, statuses and sources, of the last ``hours``; None is no condition."""
    for column, chosen in (("severity", severities), ("status", statuses), ("src_ip", sources)):
        alerts = alerts.where(F.col(column).isin(chosen)) if chosen is not None else alerts
    since = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {round((hours or 0) * 3600)} SECONDS")
    return alerts if hours is None else alerts.where(F.col("window_start") >= since)


def latest(alerts: DataFrame, n: int = 20, time: str = "window_start", ident: str = "id") -> DataFrame:
    """The latest ``n`` alerts, equal times by id."""
    return alerts.orderBy(F.desc(time), F.desc(ident)).limit(n)


def read_alerts(spark: SparkSession, path: str, which: str, limit: int = 500) -> DataFrame:
    """The latest ``limit`` alerts of one family from lines of JSON, with the columns that its list shows. Malformed lines are left out."""
    found = spark.read.schema(STORED).option("mode", "DROPMALFORMED").json(path).withColumn("id", F.coalesce("alert_uid", "id"))
    return latest(found.where(family() == which), limit).select(*SHOWN[which])


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Lines of JSON that `read_alerts` reads; ``overwrite`` replaces what is there, as final alerts do."""
    alerts.write.mode(mode).json(path)


def final_alerts(correlated: DataFrame, config: Config = Config()) -> DataFrame:
    """Correlated windows that pass, as alerts, latest and highest first."""
    return final_rows(correlated, config).orderBy(F.desc("window_start"), F.desc("final_score"), "id")


def final_rows(correlated: DataFrame, config: Config = Config()) -> DataFrame:
    """Correlated windows that pass, as alerts in any order."""
    names = F.array_compact(F.array(*(F.when(F.col(f"{n}_evidence") > 0, F.lit(said)) for n, said in (("isolation", "Isolation Forest"), ("reconstruction", "Autoencoder"), ("rules", "Heuristics")))))
    return correlated.where("outcome = 'alert'").select(
        "id", F.col("id").alias("alert_uid"), F.lit("DNS final correlated alert").alias("alert_name"), F.lit("final_correlated_alert").alias("alert_type"), F.lit("final_correlation").alias("detection_type"),
        "window_start", (F.col("window_start") + F.expr(f"INTERVAL {config.window}")).alias("window_end"), "src_ip", F.lit("New").alias("status"), "severity",
        F.bround("threat_score").cast("int").alias("threat_score"), F.bround("threat_score", 4).alias("final_score"), F.bround("base", 4).alias("weighted_base_score"),
        F.when(F.col("active") >= 3, config.bonus_three).when(F.col("active") == 2, config.bonus_two).otherwise(0.0).alias("consensus_bonus"), F.col("active").alias("models_agreeing"),
        names.alias("active_models"), *(F.bround(f"{n}_evidence", 4).alias(f"{n}_evidence") for n in ("isolation", "reconstruction", "rules")), F.col("contributing_ids").alias("source_alert_ids"),
    )


def load_final(alerts: DataFrame, limit: int = 500) -> DataFrame:
    """The first ``limit`` final alerts by time and score, arrays as text, with the number of contributing alerts."""
    return alerts.orderBy(F.desc("window_start"), F.desc("final_score"), "id").limit(limit).withColumns({
        "active_models": F.array_join("active_models", ", "), "contributing_alert_ids": D.ids_text(F.col("source_alert_ids")), "contributing_alert_count": D.ids_count(F.col("source_alert_ids")),
    }).drop("source_alert_ids")


def report(alerts: DataFrame, created: Column | None = None) -> DataFrame:
    """The columns of a report; ``detection_type`` lists the enabled methods. Missing columns are null."""
    made = alerts.withColumns({"detection_type": D.enabled_methods(F.to_json("detection_methods")), "created_at_utc": F.current_timestamp() if created is None else created})
    return made.select(*(F.col(c) if c in made.columns else F.lit(None).cast("double").alias(c) for c in REPORT))


def export_report(alerts: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    report(alerts).write.mode("overwrite").option("header", True).csv(path)


def alert_domains(domains: DataFrame, alert_uids: list[str]) -> DataFrame:
    """The domains of some alerts, by score and count."""
    return domains.where(F.col("alert_uid").isin(alert_uids)).orderBy(F.desc("suspicion_score"), F.desc("count"), "alert_uid", "query")


def unified_counters(final: DataFrame, detector_alerts: DataFrame) -> DataFrame:
    """Alerts of each family, final ones, and those that all three families agree on, in one row."""
    which = F.col("family")
    each = detector_alerts.select(family().alias("family")).agg(*(F.count_if(which == n).alias(f"{n}_alerts") for n in KINDS))
    ended = final.agg(F.count("*").alias("final_alerts"), F.count_if(F.col("models_agreeing") >= 3).alias("three_detectors"))
    return each.join(F.broadcast(ended))  # one row each


#: Columns of the list of one source's alerts, in order.
INVESTIGATED = ("id", "window_start", "family", "alert_type", "severity", "threat_score", "status", "isolation_score", "reconstruction_error", "detection_type")


def families(alerts: DataFrame) -> DataFrame:
    """Alerts of each source by family, as dashboards tell it, their highest score, and the first and last window."""
    counts = (F.count_if(F.col("family") == f).alias(f) for f in ("isolation", "reconstruction", "rules"))
    return alerts.withColumn("family", family("dashboard")).groupBy("src_ip").agg(F.count("*").alias("alerts"), *counts, F.max(F.coalesce("threat_score", F.lit(0))).alias("max_score"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"))


def timeline(alerts: DataFrame) -> DataFrame:
    """Alerts of each source and hour, by family; alerts without a time aren't in it."""
    hours = alerts.where("window_start is not null").groupBy("src_ip", F.date_trunc("hour", "window_start").alias("hour"), family("dashboard").alias("family"))
    return hours.agg(F.count("*").alias("alerts"), F.max(F.coalesce("threat_score", F.lit(0))).alias("max_score"))


def investigate(alerts: DataFrame, src_ip: str) -> DataFrame:
    """One source's alerts with their family and methods, latest first; columns that ``alerts`` lacks aren't in it."""
    made = alerts.where(F.col("src_ip") == src_ip).withColumns({"family": family("dashboard"), "detection_type": D.enabled_methods(F.to_json("detection_methods"))})
    return made.select(*(c for c in INVESTIGATED if c in made.columns)).orderBy(F.desc("window_start"), "id")
