"""Streams: the chained correlation against a replay, bounded state, and shares by a table."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_units import EVENT, rows
from tracewell.operators import correlation, detectors, models
from tracewell.operators.events import add_features
from tracewell.operators.windows import SKETCH, build_windows
from tracewell.plans import detection as P
from tracewell.sources.records import dns_events
from tracewell.streaming import live


def test_chained_final_alerts_equal_the_replays(spark, sf_dir, tmp_path):
    config = correlation.Config(window=P.DAY, min_score=20, min_percentile=50, min_detectors=1, min_ratio=1.0, min_rules=0)
    own = dns_events(spark, sf_dir).repartition(3)
    windows = build_windows(add_features(own), P.DAY)
    model = models.fit(windows, k=3, trees=20, contamination=0.3, chosen=0.7)
    def start(stream):
        return live.start_final(live.live_windows(stream, P.DAY, "1 hour", live.CHAINED), model, f"{tmp_path}/final", f"{tmp_path}/check", config)
    P._in_turns(spark, sf_dir, start, f"{tmp_path}/in")
    start(spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in")).awaitTermination()  # nothing new
    first = (F.col("ts") < P.TURN) & ~((F.substring("uid", 2, 20).cast("long") % 7 == 0) & (F.col("ts") >= P.LATE))
    mark = own.where(first).agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    kept = own.where(first | (F.col("ts") > F.lit(mark)))
    assert own.count() - kept.count() > 0 and kept.where(~first & (F.col("ts") < P.TURN)).count() >= 0
    end = kept.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    closed = build_windows(add_features(kept), P.DAY).where(F.col("window_end") <= F.lit(end))
    replay = live.detect(closed, add_features(kept), model, P.DAY, config=config)["final"]
    columns = ("id", "window_start", "src_ip", "severity", "threat_score", "final_score", "models_agreeing", "active_models", "source_alert_ids")
    got = spark.read.schema(P.FINAL).parquet(f"{tmp_path}/final")
    order = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert order(got) == order(replay) and got.where("models_agreeing = 3").count() > 0


def test_state_of_a_window_is_bounded(spark, tmp_path):
    n = 30_000
    data = spark.range(n).select(
        (F.timestamp_seconds(F.lit(1_704_103_200)) + F.make_dt_interval(secs=F.col("id") % 200)).alias("ts"), F.concat(F.lit("u"), "id").alias("uid"), F.lit("busy").alias("src_ip"), F.concat(F.lit("203.0.113."), F.col("id") % 7).alias("dns_server"),
        F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".example.com")).alias("query"), F.lit("A").alias("qtype_name"), F.lit("NOERROR").alias("rcode_name"), F.lit(0.5).alias("rtt"),
        F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"), F.concat(F.lit("a"), "id")).alias("answers"), F.array(F.lit(60.0)).alias("ttls"),
    ).unionByName(spark.createDataFrame([(dt.datetime(2024, 1, 3), *rows(1, "end")[0][1:])], EVENT))
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "5 minutes")
    query = build_windows(add_features(stream)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    batch = build_windows(add_features(data)).where("src_ip = 'busy'").first()
    got = spark.read.schema(build_windows(add_features(data)).schema).parquet(f"{tmp_path}/out").where("src_ip = 'busy'").first()
    for name in batch.asDict():
        want = getattr(batch, name)
        if name in ("unique_queries", "unique_answer_ips", "unique_query_ratio", "repeated_query_ratio"):
            scale = max(abs(want), 1.0)
            assert abs(getattr(got, name) - want) < 4 * 2 ** (-SKETCH / 2) * scale, name
        else:
            assert getattr(got, name) == (pytest.approx(want) if isinstance(want, float) else want), name
    assert batch.unique_queries == n and batch.unique_answer_ips == 2 * n
    used = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(o["customMetrics"]["stateOnCurrentVersionSizeBytes"] for o in used) < 2 * 80_000  # two windows; sets of 90,000 values were above 2 MB


def test_few_values_are_counted_exactly(spark, tmp_path):
    data = rows(300, "a", lambda i: f"q{i % 250}.example.com", answers=3, server=lambda i: f"192.0.2.{i % 120}") + rows(40, "b", answers=0) + [(dt.datetime(2024, 1, 3), *rows(1, "end")[0][1:])]
    df = spark.createDataFrame(data, EVENT)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    live.live_windows(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    batch = build_windows(add_features(df)).where("src_ip != 'end'")
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    close = lambda r: {k: round(v, 9) if isinstance(v, float) else len(v) if isinstance(v, list) and len(v) > 90 else v for k, v in r.asDict().items()}
    a, b = (sorted(map(close, x.collect()), key=str) for x in (got, batch))
    for x, y in zip(a, b, strict=True):
        assert {k: v for k, v in x.items() if k != "dns_servers"} == {k: v for k, v in y.items() if k != "dns_servers"} and (x["dns_servers"] == y["dns_servers"] or x["dns_servers"] == 100)


def test_shares_by_a_table(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([(float(x),) for x in np.round(rng.beta(20, 30, 4000), 4)] + [(None,), (0.0,), (1.0,)], "isolation double")
    asked = spark.createDataFrame([(float(x),) for x in np.round(rng.random(500), 4)] + [(0.0,), (1.0,)], "isolation double")
    a = {r.isolation: r.score_percentile for r in detectors.share_not_above(asked, ref, "isolation").collect()}
    b = {r.isolation: r.score_percentile for r in detectors.share_by(asked, detectors.share_table(ref, "isolation"), "isolation").collect()}
    assert a == b and len(a) > 400
