"""The alert store: flat alerts, one row for each of their domains, and the status that analysts gave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators.windows import DOMAIN_POINTS, POINTS

#: The flag and type of isolation alerts, the flag of reconstruction alerts and its points.
ISOLATION, RECONSTRUCTION, RECONSTRUCTION_POINTS = "categorization_forest", "autoencoder", 20
#: Columns of a stored alert, their types, and what stands for null.
COLUMNS = {
    "alert_name": ("string", "DNS anomaly detected"), "alert_type": ("string", "anomaly_candidate"), "window_start": ("timestamp", None), "window_end": ("timestamp", None),
    "src_ip": ("string", ""), "status": ("string", "New"), "model_name": ("string", ""), "window_size": ("string", ""),
    "reconstruction_error": ("double", 0.0), "threshold": ("double", 0.0), "isolation_score": ("double", 0.0), "isolation_threshold": ("double", 0.0),
    "score_margin": ("double", 0.0), "score_percentile": ("double", 0.0), "contamination": ("double", 0.0), "n_estimators": ("int", 0), "max_samples": ("string", ""), "max_features": ("string", ""),
}
NESTED = ("detection_methods", "top_contributing_features", "possible_causes")


def store_score(alert_type: Column, methods: Column, has_domains: Column, ratio: Column, own: Column, percentile: Column) -> Column:
    """Isolation alerts keep their score, else their percentile, else 50; other alerts add up points, at most 100."""
    on = lambda k: F.coalesce(F.try_element_at(methods, F.lit(k)), F.lit(False))
    explicit = F.bround(own).cast("int")
    kept = F.when(explicit > 0, explicit).when(percentile > 0, F.bround(percentile).cast("int")).otherwise(50)
    given = {RECONSTRUCTION: RECONSTRUCTION_POINTS, **POINTS}
    points = sum((F.when(on(k), v).otherwise(0) for k, v in given.items()), F.when(has_domains, DOMAIN_POINTS).otherwise(0))
    points = points + F.when(ratio >= 2, 15).when(ratio >= 1.5, 8).otherwise(0)
    isolation = F.coalesce(alert_type == ISOLATION, F.lit(False)) | on(ISOLATION)
    return F.least(F.lit(100), F.when(isolation, kept).otherwise(points)).cast("int")


def derived_uid(alerts: DataFrame) -> Column:
    """The id of an alert that has none: of a reconstruction's without a rule that of its window and source, of any other a SHA-256 of its times, source, type, scores to the millionth, methods and first five domains.

    Columns that ``alerts`` lacks count as null, and nulls as empty text.
    """
    have = set(alerts.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    time = lambda c: F.coalesce(D.iso_time(col(c, "timestamp")), F.lit(""))
    methods = col("detection_methods", "map<string,boolean>")
    on = lambda k: F.coalesce(F.try_element_at(methods, F.lit(k)), F.lit(False))
    ruled = F.lit(False)
    for k in POINTS:
        ruled = ruled | on(k)
    rebuilt = F.coalesce(col("alert_type") == "autoencoder_anomaly", F.lit(False)) | F.coalesce(col("detection_type") == "deep_learning_autoencoder", F.lit(False)) | on(RECONSTRUCTION)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    millionth = lambda c: text(F.round(col(c, "double") * 1e6).try_cast("bigint"))
    listed = alerts.schema["suspicious_domains"].dataType.elementType.typeName() if "suspicious_domains" in have else ""
    names = F.transform("suspicious_domains", lambda d: d["query"] if listed == "struct" else d.cast("string")) if listed else F.lit(None).cast("array<string>")
    basis = F.concat_ws("|", time("window_start"), time("window_end"), text(col("src_ip")), text(col("alert_type")), millionth("reconstruction_error"), millionth("isolation_score"), text(D.enabled_methods(F.to_json(methods))), text(F.array_join(F.slice(names, 1, 5), ",")))
    return F.when(rebuilt & ~ruled, D.stable_id("AE-", F.lit("autoencoder"), time("window_start"), text(col("src_ip")))).otherwise(F.sha2(basis, 256))


def alert_uid(alerts: DataFrame) -> Column:
    """The uid of an alert, else its id, else what `derived_uid` makes; blank ones count as none."""
    have = [F.col(c) for c in ("alert_uid", "id") if c in alerts.columns]
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in have), derived_uid(alerts))


def with_domains(alerts: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds ``suspicious_domains``, in the order of their rank. A window has no more than `suspicious_domains` lets pass."""
    fields = [c for c in domains.columns if c not in ("window_start", "src_ip")]
    listed = domains.groupBy("window_start", "src_ip").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias("suspicious_domains"))
    return alerts.join(listed, ["window_start", "src_ip"], "left")


def stored_alerts(alerts: DataFrame) -> DataFrame:
    """Flat rows of the store: ``alert_uid``, `COLUMNS`, score and severity, nested columns as JSON. Missing columns and nulls take their defaults."""
    have = set(alerts.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    plain = {c: F.coalesce(col(c, kind).try_cast(kind), F.lit(other)) if other is not None else col(c, kind) for c, (kind, other) in COLUMNS.items()}
    ratio = F.when(plain["threshold"] > 0, plain["reconstruction_error"] / plain["threshold"])
    has = F.coalesce(F.size(col("suspicious_domains", "array<string>")) > 0, F.lit(False))
    score = store_score(plain["alert_type"], col("detection_methods", "map<string,boolean>"), has, ratio, col("threat_score", "double").try_cast("double"), plain["score_percentile"])
    rows = alerts.select(
        alert_uid(alerts).alias("alert_uid"), *(v.alias(c) for c, v in plain.items()),
        score.alias("threat_score"), F.coalesce(col("severity", "string"), F.lit("info")).alias("_was"), *(F.to_json(c).alias(f"{c}_json") for c in NESTED if c in have),
    )
    return rows.withColumn("severity", D.severity_store(F.col("threat_score"), F.col("_was"))).drop("_was")


def stored_domains(alerts: DataFrame) -> DataFrame:
    """One row for each domain of an alert."""
    key = F.col("alert_uid") if "alert_uid" in alerts.columns else F.col("id").alias("alert_uid")
    return alerts.select(key, F.explode("suspicious_domains").alias("d")).select("alert_uid", "d.*")


def new_only(batch: DataFrame, stored: DataFrame, key: str = "alert_uid") -> DataFrame:
    """Rows of a batch whose key is neither stored nor earlier in the batch; rows without a key go."""
    return batch.dropna(subset=[key]).dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def linked_domains(domains: DataFrame, alerts: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` domains by score, distinct alerts, queries and name. Domains whose alert is missing count, without a time."""
    name = F.rtrim(F.lower(F.trim("query")), F.lit("."))
    named = domains.withColumn("domain", name).where(F.trim("query") != "").join(alerts.select("alert_uid", "window_start"), "alert_uid", "left")
    found = named.groupBy("domain").agg(
        F.countDistinct("alert_uid").alias("linked_alerts"), F.sum(F.coalesce("count", F.lit(0))).alias("observed_queries"), F.max(F.coalesce("suspicion_score", F.lit(0))).alias("max_suspicion_score"),
        F.round(F.max(F.coalesce("max_entropy", F.lit(0.0))), 4).alias("max_entropy"), F.max("window_start").alias("latest_alert"),
    )
    return found.orderBy(F.desc("max_suspicion_score"), F.desc("linked_alerts"), F.desc("observed_queries"), "domain").limit(n)


def with_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with the latest ``status`` and ``note`` of a table that only grows: ``alert_uid, changed_at, status, note``. Of equal times the last status by name counts."""
    last = changes.groupBy("alert_uid").agg(F.max_by(F.struct("status", "note"), F.struct("changed_at", "status")).alias("last"))
    joined = alerts.join(last, "alert_uid", "left")
    return joined.withColumn("status", F.coalesce("last.status", "status")).withColumn("note", F.col("last.note")).drop("last")


def gate_rules(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that the table ``rule_name, enabled`` switches off don't fire; a rule that it doesn't list is on. Five flags reach the driver."""
    on = rules.agg(*(F.coalesce(F.max(F.when(F.col("rule_name") == k, F.col("enabled"))), F.lit(True)).alias(k) for k in POINTS)).first()
    return judged.withColumns({k: F.col(k) & F.lit(on[k]) for k in POINTS})
