"""Column helpers, readers, scenarios and the stream, by hand-made rows."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators.events import add_features, fingerprint, keep_last, normalize
from tracewell.operators.windows import build_windows, evaluate_rules, rule_alerts
from tracewell.sources.records import dns_events, read_documents, read_json
from tracewell.streaming.live import append_new, live_windows, start_rules

@pytest.mark.parametrize("column,value,want", [
    (lambda c: D.shannon_entropy(c), "google.com", 2.646439), (lambda c: D.shannon_entropy(c), "", 0.0), (lambda c: D.shannon_entropy(c), None, 0.0),
    (lambda c: D.clean_domain(c), "  WWW.Example.COM. ", "www.example.com"), (lambda c: D.clean_domain(c), "a.b..", "a.b."), (lambda c: D.strip_dots(c), "a.b..", "a.b"), (lambda c: D.clean_domain(c), None, ""),
    (lambda c: F.size(D.labels(c)), "a..b", 3), (lambda c: F.size(D.labels(c)), "", 0), (lambda c: D.max_label_len(c), "a..bc", 2), (lambda c: D.max_label_len(c), "", 0),
    (lambda c: D.safe_ratio(c, F.lit(0)), "1", 0.0), (lambda c: D.normalize_list(c), '["a","b"]', ["a", "b"]), (lambda c: D.normalize_list(c), "a, b", ["a", "b"]), (lambda c: D.normalize_list(c), None, []),
    (lambda c: D.numbers(D.normalize_list(c)), "1,x,2.5", [1.0, 2.5]), (lambda c: D.list_avg(D.numbers(D.normalize_list(c))), "", 0.0), (lambda c: D.list_min(D.numbers(D.normalize_list(c))), "3,2", 2.0),
    (lambda c: D.to_bool(c), "T", True), (lambda c: D.to_bool(c), "0", False), (lambda c: D.to_bool(c), "-", None), (lambda c: D.reconstruction_quality(c.cast("double")), "1", 50.0),
    (lambda c: D.severity_reconstruction(c.cast("double")), "1.49", "low"), (lambda c: D.severity_reconstruction(c.cast("double")), "1.5", "medium"), (lambda c: D.severity_reconstruction(c.cast("double")), "2", "high"),
    (lambda c: D.severity_isolation(c.cast("double")), "99.9", "critical"), (lambda c: D.severity_final(c.cast("double")), "60", "medium"), (lambda c: D.severity_store(c.cast("double"), F.lit("none")), "10", "none"),
])
def test_function(spark, column, value, want):
    got = spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]
    assert (round(got, 6) if isinstance(got, float) else got) == want


@pytest.mark.parametrize("value", ["1700000000", "1700000000000", "1700000000000000", "1700000000000000000", "2023-11-14T22:13:20Z"])
def test_time(spark, value):
    df = spark.createDataFrame([(value,), ("abc",)], "x string").select(D.parse_time(F.col("x")).alias("t"))
    assert [r[0] for r in df.select(F.unix_timestamp("t")).collect()] == [1700000000, None]


def test_readers(spark, tmp_path):
    row = {"ts": 1700000000.5, "uid": "C1", "id.orig_h": "192.0.2.1", "query": "A.example.", "answers": ["192.0.2.9"], "TTLs": [60], "qtype_name": "a", "AA": "T"}
    with gzip.open(tmp_path / "dns.log.gz", "wt") as f:
        f.write("\n".join(["#x", "", "{bad", json.dumps(row), json.dumps(row | {"ts": "abc"}), json.dumps(row | {"uid": "C2", "id.orig_h": "-"})]))
    (tmp_path / "doc.json").write_text(json.dumps([row, row]))
    got = normalize(read_json(spark, f"{tmp_path}/dns.log.gz", keep_raw=True)).collect()
    assert [(r.uid, r.src_ip, r.dns_server, r.answers, r.ttls, r.qtype_name, r.aa) for r in got] == [("C1", "192.0.2.1", "unknown", ["192.0.2.9"], [60.0], "A", True)]
    assert normalize(read_documents(spark, f"{tmp_path}/doc.json")).count() == 2


EVENT = "ts timestamp, uid string, src_ip string, dns_server string, query string, qtype_name string, rcode_name string, rtt double, answers array<string>, ttls array<double>"


def rows(n, src="s", query=lambda i: f"q{i}.example.com", qtype="A", rcode="NOERROR", server=lambda i: "192.0.2.1", answers=1, ttl=120.0):
    t = dt.datetime(2024, 1, 1, 10)
    return [(t + dt.timedelta(seconds=i), f"{src}{i}", src, server(i), query(i), qtype, rcode, 0.1, [f"198.51.100.{(i * 7 + k) % 250}" for k in range(answers)], [ttl] * answers if ttl else []) for i in range(n)]


def fired(spark, data, approved=None):
    got = rule_alerts(evaluate_rules(build_windows(add_features(spark.createDataFrame(data, EVENT)), "5 minutes"), approved)).collect()
    return {r.src_ip: set(r.heuristics_fired) for r in got}


def test_scenarios(spark):
    import hashlib

    name = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    data = rows(40, "dga", lambda i: name(i)[:26] + ".example.com", rcode="NXDOMAIN", answers=0) + rows(40, "tunnel", lambda i: name(i)[:52] + "." + name(i)[:40] + ".example.net", "TXT")
    data += rows(40, "flux", answers=5, ttl=20.0) + rows(40, "fail", rcode="SERVFAIL", answers=0) + rows(19, "few", rcode="SERVFAIL", answers=0) + rows(40, "rogue", server=lambda i: f"203.0.113.{i % 3}") + rows(40, "two", server=lambda i: f"203.0.113.{i % 2}")
    assert fired(spark, data) == {"dga": {"heuristic_dga", "heuristic_resolver_failure"}, "tunnel": {"heuristic_tunnel"}, "flux": {"heuristic_fastflux"}, "fail": {"heuristic_resolver_failure"}, "rogue": {"heuristic_rogue_resolver"}}
    assert fired(spark, rows(3, "x", server=lambda i: None), ["192.0.2.1"]) == {"x": {"heuristic_rogue_resolver"}}


def test_one_event_without_ttl_blocks_fast_flux(spark):
    assert fired(spark, rows(40, "flux", answers=5, ttl=20.0) + rows(1, "flux", ttl=None)) == {}


def test_dedupe(spark):
    df = spark.createDataFrame([*rows(2), *rows(1)], EVENT)
    assert keep_last(df, ["uid", "ts", "src_ip", "query"], ["rtt"]).count() == 2 and fingerprint(df).select("fingerprint").distinct().count() == 2


def test_stream_equals_batch_and_reruns_write_nothing(spark, sf_dir, tmp_path):
    events = dns_events(spark, sf_dir)
    last = events.agg(F.max("ts")).first()[0]
    closing = events.limit(1).withColumn("ts", F.lit(last + dt.timedelta(days=40))).withColumn("uid", F.lit("end"))
    events.unionByName(closing).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    windows = live_windows(stream, "10 days", "1 day")
    start_rules(windows, f"{tmp_path}/alerts", f"{tmp_path}/check").awaitTermination(120)
    batch = rule_alerts(evaluate_rules(build_windows(add_features(events), "10 days")))
    got = spark.read.parquet(f"{tmp_path}/alerts")
    assert {r.id for r in got.collect()} == {r.id for r in batch.collect()} and got.count() > 0
    n = got.count()
    append_new(batch.withColumn("scored", F.lit(True)), f"{tmp_path}/alerts")
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == n
