"""The alert store and the gates on hand-made rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators import alerts as A
from tracewell.operators import domains, gates, store
from tracewell.operators.events import add_features
from tracewell.operators.windows import POINTS, build_windows, described, evaluate_definitions, evaluate_rules, rule_definitions
from tracewell.sources.records import dns_events

DAY = dt.datetime(2024, 1, 1)


def test_stored_alerts(spark):
    rows = [
        ("a", "x", None, {"heuristic_dga": True, "heuristic_tunnel": True}, 0.0, 0.0, None, None, ["d"]),
        ("b", "x", None, {"autoencoder": True}, 2.0, 1.0, 99.0, None, []),
        ("c", "x", None, {"autoencoder": True}, 1.5, 1.0, None, None, None),
        ("d", "y", "categorization_forest", None, None, None, 66.5, 12.0, None),
        ("e", "y", None, {"categorization_forest": True}, None, None, None, 97.5, None),
        ("f", "y", "categorization_forest", None, None, None, None, None, None),
        ("g", "y", None, None, None, None, None, None, None),
    ]
    kinds = "id string, src_ip string, alert_type string, detection_methods map<string,boolean>, reconstruction_error double, threshold double, threat_score double, score_percentile double, suspicious_domains array<string>"
    alerts = spark.createDataFrame(rows, kinds).withColumn("window_start", F.lit(DAY))
    flat = store.stored_alerts(alerts)
    got = {r.alert_uid: (r.threat_score, r.severity) for r in flat.collect()}
    assert got == {"a": (90, "high"), "b": (35, "low"), "c": (28, "low"), "d": (66, "medium"), "e": (98, "high"), "f": (50, "medium"), "g": (0, "info")}
    assert flat.where("alert_uid = 'g'").first().alert_name == "DNS anomaly detected"
    assert {r.src_ip: (r.isolation, r.reconstruction, r.rules, r.max_score) for r in A.families(alerts.drop("threat_score").join(flat.select(F.col("alert_uid").alias("id"), "threat_score"), "id")).collect()} == {"x": (0, 2, 1, 90), "y": (2, 2, 0, 98)}
    assert {r.alert_uid for r in store.new_only(flat.union(flat), flat.where("alert_uid < 'f'")).collect()} == {"f", "g"}
    assert [(r.alert_uid, r[1]) for r in store.stored_domains(alerts.withColumn("suspicious_domains", F.transform("suspicious_domains", lambda d: F.struct(d.alias("query"))))).collect()] == [("a", "d")]


def test_latest_status(spark):
    alerts = spark.createDataFrame([("a", "New"), ("b", "New")], "alert_uid string, status string")
    changes = spark.createDataFrame([("a", 1, "Open", "first"), ("a", 2, "Closed", None), ("z", 3, "Open", "")], "alert_uid string, changed_at int, status string, note string")
    assert sorted((r.alert_uid, r.status, r.note) for r in store.with_status(alerts, changes).collect()) == [("a", "Closed", None), ("b", "New", None)]


def test_rules_switched_off(spark):
    judged = spark.createDataFrame([tuple([True] * len(POINTS))], ", ".join(f"{k} boolean" for k in POINTS))
    rules = spark.createDataFrame([("heuristic_dga", False), ("heuristic_tunnel", True), ("unknown", False)], "rule_name string, enabled boolean")
    assert store.gate_rules(judged, rules).first().asDict() == {k: k != "heuristic_dga" for k in POINTS}


def test_rules_by_definitions(spark, sf_dir):
    windows = build_windows(add_features(dns_events(spark, sf_dir)), "1 day")
    table = rule_definitions(spark)
    key = ["window_start", "src_ip"]
    rows = lambda df: sorted(map(str, df.select(*key, *POINTS, "rogue_dns_servers").collect()))
    assert rows(evaluate_definitions(windows, table)) == rows(evaluate_rules(windows)) and rows(evaluate_definitions(windows, table, ["192.0.2.1"])) == rows(evaluate_rules(windows, ["192.0.2.1"]))
    lower = table.withColumn("threshold", F.when(F.col("feature") == "total_queries", 1.0).otherwise(F.col("threshold"))).withColumn("enabled", F.col("rule_name") != "heuristic_tunnel")
    more = evaluate_definitions(windows, lower)
    assert more.where("heuristic_tunnel").count() == 0 and more.where("heuristic_dga").count() > evaluate_rules(windows).where("heuristic_dga").count()
    assert evaluate_definitions(windows, table.where("rule_name = 'heuristic_dga'")).where("heuristic_rogue_resolver or heuristic_fastflux").count() == 0
    with pytest.raises(ValueError, match="can't be judged"):
        evaluate_definitions(windows, table.withColumn("feature", F.lit("no_such")))
    said = described(spark.createDataFrame([("x", ["heuristic_dga", "heuristic_rogue_resolver"])], "id string, heuristics_fired array<string>"), table)
    assert {r.rule_name: r.description[:4] for r in said.collect()} == {"heuristic_dga": "Many", "heuristic_rogue_resolver": "A ho"}


def test_uids(spark):
    kinds = "k string, alert_uid string, id string, alert_type string, window_start timestamp, src_ip string, reconstruction_error double, detection_methods map<string,boolean>, suspicious_domains array<string>"
    rows = [
        ("a", "u", "i", None, DAY, "s", 1.0, None, None), ("b", " ", "i", None, DAY, "s", 1.0, None, None), ("c", None, None, "autoencoder_anomaly", DAY, "s", 1.0, None, None), ("d", None, "", None, DAY, "s", 1.0, {"autoencoder": True}, ["x"]),
        ("e", None, None, "autoencoder_anomaly", DAY, "s", 1.0, {"heuristic_dga": True}, None), ("f", None, None, None, DAY, "s", 1.0, {"heuristic_dga": True}, list("abcdef")), ("g", None, None, None, DAY, "s", 1.0, {"heuristic_dga": True}, list("abcde")),
        ("h", None, None, None, DAY, "s", 1.1, {"heuristic_dga": True}, list("abcde")), ("i", None, None, None, None, None, None, None, None), ("j", None, None, None, DAY, "s", 1.0, {"heuristic_dga": True, "heuristic_tunnel": False}, list("abcde")),
    ]
    got = {r.k: r[1] for r in spark.createDataFrame(rows, kinds).select("k", store.alert_uid(spark.createDataFrame(rows, kinds))).collect()}
    rebuilt = "AE-" + hashlib.sha256(b"autoencoder|2024-01-01T00:00:00+00:00|s").hexdigest()[:20].upper()
    assert (got["a"], got["b"], got["c"], got["d"]) == ("u", "i", rebuilt, rebuilt) and got["f"] == got["g"] == got["j"]
    assert got["f"] == hashlib.sha256(b"2024-01-01T00:00:00+00:00||s||1000000||heuristic_dga|a,b,c,d,e").hexdigest() and len({got[k] for k in "efhi"}) == 4
    bare = spark.createDataFrame([("s",)], "src_ip string")
    assert bare.select(store.alert_uid(bare)).first()[0]


def test_timeline_and_rows_of_a_source(spark):
    kinds = "id string, alert_type string, detection_methods map<string,boolean>, src_ip string, window_start timestamp, threat_score double, severity string"
    hour = lambda h, m=0: DAY + dt.timedelta(hours=h, minutes=m)
    rows = [("a", "categorization_forest", None, "x", hour(1), 50.0, "low"), ("b", "heuristics_rule", {"heuristic_dga": True}, "x", hour(1, 30), 70.0, "high"), ("c", "heuristics_rule", None, "x", hour(1, 59), None, "low"), ("d", None, None, "x", None, 1.0, "low"), ("e", None, None, "y", hour(1), 2.0, "low")]
    alerts = spark.createDataFrame(rows, kinds)
    got = {(r.src_ip, r.hour, r.family): (r.alerts, r.max_score) for r in A.timeline(alerts).collect()}
    assert got == {("x", hour(1), "isolation"): (1, 50.0), ("x", hour(1), "rules"): (2, 70.0), ("y", hour(1), "reconstruction"): (1, 2.0)}
    own = A.investigate(alerts, "x")
    assert [r.id for r in own.collect()] == ["c", "b", "a", "d"] and own.columns == ["id", "window_start", "family", "alert_type", "severity", "threat_score", "detection_type"] and A.families(alerts).where("src_ip = 'x'").first().max_score == 70


def test_times_are_recovered_from_raw_text(spark):
    rows = spark.createDataFrame([("1704103200", "2024-01-01 10:00:00"), ("1704103200", "9999-01-01 00:00:00"), ("x", "1970-01-01 00:00:00"), (None, None)], "ts_raw string, t string").withColumn("ts", F.to_timestamp("t"))
    fixed = gates.recovered(rows)
    assert [str(r.ts) for r in fixed.collect()] == ["2024-01-01 10:00:00", "2024-01-01 10:00:00", "None", "None"] and gates.time_gate(fixed).first().invalid == 2


def test_context_only_without_suspicious_domains(spark):
    events = spark.createDataFrame([(DAY, s, q) for s, q in [("x", "b"), ("x", "a"), ("x", "b"), ("x", ""), ("y", "c")]], "ts timestamp, src_ip string, query_clean string")
    found = spark.createDataFrame([(DAY, "y")], "window_start timestamp, src_ip string")
    assert [(r.src_ip, r["query"], r["count"], r["rank"]) for r in domains.context_domains(events, found).orderBy("rank").collect()] == [("x", "b", 2, 1), ("x", "a", 1, 2)]


def test_gates(spark):
    windows = spark.createDataFrame([(DAY, "x", 1.0), (DAY, " ", float("nan")), (None, "y", None)], "window_start timestamp, src_ip string, f double")
    row = gates.training_gate(windows, ["f"], 3).first()
    assert (row.windows, row.blank_keys, row.bad_rows, row.passed, row.reason) == (3, 2, 2, False, "windows without time or source")
    assert gates.training_gate(windows.limit(0), ["f"]).first().reason == "fewer than 50 windows"
    with pytest.raises(ValueError, match="missing"):
        gates.training_gate(windows, ["g"])
    times = spark.createDataFrame([(DAY,), (dt.datetime(1999, 5, 1),), (None,)], "ts timestamp")
    assert (gates.time_gate(times).first().invalid, gates.time_gate(times.where("ts > '2000-01-01'")).first().passed) == (2, True)
    assert gates.time_gate(times.limit(0)).first().reason == "no records"
    with pytest.raises(ValueError, match="times out of bounds"):
        gates.require(gates.time_gate(times))


def test_merge_counters(spark):
    records = spark.createDataFrame([("f1", True, "p"), ("f1", True, "p"), ("f2", True, "q"), ("f2", False, None)], "file string, valid boolean, print string")
    counted = gates.merge_counters(records, "valid", "print", "file")
    assert counted.first().asDict() == {"lines_read": 4, "files_processed": 2, "inserted": 2, "duplicates": 1, "invalid": 1}
    assert gates.merge_gate(counted, 2, 2).first().reason == "invalid records"
    clean = gates.merge_counters(records.where("valid"), "valid", "print", "file")
    assert gates.merge_gate(clean, 2, 2).first().passed and gates.merge_gate(clean, 3, 2).first().reason == "not all staged files were discovered"
    assert gates.merge_gate(gates.merge_counters(records.limit(0), "valid", "print", "file"), 2, 2).first().reason == "not all files were processed"


def test_aliases_and_required_columns(spark):
    rows = spark.createDataFrame([("1", None, "a"), (None, "2", " "), (None, "3", "b")], "ts string, timestamp string, `id.orig_h` string")
    assert [(r.ts, r.src_ip) for r in gates.with_aliases(rows, ["ts", "timestamp"], ["src_ip", "id.orig_h"]).collect()] == [("1", "a"), ("3", "b")]
    assert set(gates.REQUIRED) <= set(gates.with_required(rows).columns)
