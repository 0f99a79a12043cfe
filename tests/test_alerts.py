"""Alerts in full, their views, models and streams on hand-made rows."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators import alerts as A
from tracewell.operators import detectors, models, views
from tracewell.operators.events import add_features, completed, fingerprint, keep_first, union_inputs
from tracewell.operators.windows import build_windows
from tracewell.schema import FEATURES
from tracewell.sources.records import dns_events
from tracewell.streaming import live
from tests.test_units import EVENT, rows

DAY = dt.datetime(2024, 1, 1, 10)


@pytest.mark.parametrize("column,value,want", [
    (lambda c: D.isolation_points(c.cast("double"), F.lit(0.0)), "98.5", 98), (lambda c: D.isolation_points(c.cast("double"), F.lit(0.3)), None, 100), (lambda c: D.isolation_points(c.cast("double"), F.lit(-1.0)), None, 50),
    (lambda c: D.severity_isolation_alert(c.cast("double"), F.lit(0.1)), None, "high"), (lambda c: D.severity_isolation_alert(c.cast("double"), F.lit(0.05)), None, "medium"), (lambda c: D.severity_isolation_alert(c.cast("double"), F.lit(0.0)), "99", "high"),
    (lambda c: D.rule_causes(F.split(c, ",")), "heuristic_tunnel,heuristic_dga", [D.RULE_CAUSES["heuristic_dga"], D.RULE_CAUSES["heuristic_tunnel"]]),
    (lambda c: D.reconstruction_causes(F.create_map(c, F.lit(True))), "autoencoder", [D.BASELINE_CAUSE]), (lambda c: D.reconstruction_causes(F.create_map(c, F.lit(True))), "heuristic_rogue_resolver", [D.OTHER_RULE_CAUSES["heuristic_rogue_resolver"]]),
    (lambda c: D.feature_causes(F.array(c)), "avg_rtt", [D.FEATURE_CAUSES[3][1]]), (lambda c: D.feature_causes(F.array(c)), "a_rate", [D.WINDOW_CAUSE]),
    (lambda c: D.enabled_methods(c), '{"b":true,"a":true,"c":false}', "a, b"), (lambda c: D.enabled_methods(c), "[1]", "none"), (lambda c: D.enabled_methods(c), None, "none"),
    (lambda c: D.ids_text(F.split(c, ",")), "x, ,y", "x, y"), (lambda c: D.ids_count(F.split(c, ",")), "x, ,y", 2), (lambda c: D.ids_count(F.split(c, ",")), None, 0),
    (lambda c: D.family_ids_text(F.create_map(F.lit("rules"), c, F.lit("isolation"), F.lit("i")), ("isolation", "rules")), "r", "isolation: i | rules: r"),
    (lambda c: D.duration_text(c), "59.4", "59 min"), (lambda c: D.duration_text(c), "90", "1.50 h"), (lambda c: D.duration_text(c), "4320", "3.00 days"), (lambda c: D.duration_text(c), "-5", "0 min"),
    (lambda c: D.readable_time(c.cast("long")), "1700000000", "2023-11-14 22:13:20 UTC"), (lambda c: D.shannon_entropy(c), "a\U0001f600a\U0001f600", 1.0),
])
def test_function(spark, column, value, want):
    got = spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]
    assert got == want


def test_ids_are_those_of_the_stated_texts(spark):
    at = spark.createDataFrame([(DAY, "192.0.2.1", ["a", "b"])], "window_start timestamp, src_ip string, fired array<string>")
    got = at.select(A.alert_id("isolation"), A.alert_id("reconstruction"), A.alert_id("rules", F.array_join("fired", "|"))).first()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()[:20].upper()
    assert tuple(got) == ("CATF-" + digest("categorization_forest|2024-01-01T10:00:00+00:00|192.0.2.1"), "AE-" + digest("autoencoder|2024-01-01T10:00:00+00:00|192.0.2.1"), "HEUR-" + digest("heuristics|2024-01-01T10:00:00+00:00|192.0.2.1|a|b"))


def test_fingerprints(spark):
    kinds = "ts timestamp, uid string, src_ip string, src_port int, dns_server string, dns_port int, proto string, trans_id int, query string, qtype_name string, rcode_name string, answers array<string>, rtt double"
    base = (DAY, "u", "s", 1, "d", 53, "udp", 7, "q", "A", "NOERROR", ["x"], 0.1)
    vary = lambda **v: tuple(v.get(n.split()[0], x) for n, x in zip(kinds.split(", "), base))
    data = [base, vary(trans_id=8), vary(rtt=0.2), vary(query="p"), vary(uid=None), vary(uid=None, trans_id=8), vary(uid=None, rtt=9.0), vary(uid=None, answers=[]), vary(uid=None, answers=None)]
    p = [r.fingerprint for r in fingerprint(spark.createDataFrame(data, kinds)).collect()]
    assert p[0] == p[1] == p[2] and len({p[0], p[3], p[4], p[5], p[7]}) == 5 and p[4] == p[6] and p[7] == p[8]
    both = union_inputs([spark.createDataFrame([(1, "a")], "n int, k string"), spark.createDataFrame([(2, "a", 5)], "n int, k string, more int")])
    assert [(r.n, r.more) for r in keep_first(both, ["k"], ["n"]).collect()] == [(1, None)]
    times = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(minutes=4, seconds=59),), (DAY + dt.timedelta(minutes=5),)], "ts timestamp")
    assert [r[0] for r in times.select(completed(times, F.lit(DAY + dt.timedelta(minutes=9)))).collect()] == [True, True, False]


def test_families_and_filters(spark):
    kinds = "id string, alert_type string, detection_type string, detection_methods map<string,boolean>, severity string, status string, src_ip string, window_start timestamp"
    data = [("a", "categorization_forest", None, None, "high", "New"), ("b", None, None, {"isolation_forest": True}, "low", "New"), ("c", "autoencoder_anomaly", None, {"heuristic_dga": True}, "high", "Closed"),
            ("d", None, "deep_learning_autoencoder", None, "high", "New"), ("e", "heuristics_rule", None, None, "low", "New"), ("f", None, None, {"autoencoder": False}, "low", "New"), ("g", "rule_based_suspicious", None, None, "low", "New")]
    alerts = spark.createDataFrame([(*r, f"s{k % 2}", DAY + dt.timedelta(hours=k)) for k, r in enumerate(data)], kinds)
    got = {r.id: (r.one, r.two) for r in alerts.select("id", A.family().alias("one"), A.family("dashboard").alias("two")).collect()}
    assert got == {"a": ("isolation", "isolation"), "b": ("isolation", "reconstruction"), "c": ("rules", "rules"), "d": ("reconstruction", "reconstruction"), "e": ("rules", "rules"), "f": (None, "reconstruction"), "g": (None, "rules")}
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(A.filter_alerts(alerts, ["high"], ["New"])) == ["a", "d"] and ids(A.filter_alerts(alerts, sources=["s1"])) == ["b", "d", "f"] and ids(A.filter_alerts(alerts, [])) == []
    assert ids(A.filter_alerts(alerts, hours=2, now=F.lit(DAY + dt.timedelta(hours=6)))) == ["e", "f", "g"] and [r.id for r in A.latest(alerts, 2).collect()] == ["g", "f"]


def test_alert_files(spark, tmp_path):
    made = spark.createDataFrame([(f"AE-{k}", DAY + dt.timedelta(hours=k), "s", "low", "autoencoder_anomaly", {"autoencoder": True}, float(k), 1.0) for k in range(5)], "id string, window_start timestamp, src_ip string, severity string, alert_type string, detection_methods map<string,boolean>, reconstruction_error double, threshold double")
    A.write_alerts(made, f"{tmp_path}/a")
    A.write_alerts(made.limit(1).withColumns({"id": F.lit("HEUR-1"), "alert_type": F.lit("heuristics_rule")}), f"{tmp_path}/a")
    (tmp_path / "a" / "bad.json").write_text("{broken\n[1]\n")
    got = A.read_alerts(spark, f"{tmp_path}/a", "reconstruction", 3)
    assert [r.id for r in got.collect()] == ["AE-4", "AE-3", "AE-2"] and tuple(got.columns) == A.SHOWN["reconstruction"]
    A.export_report(made, f"{tmp_path}/r")
    report = spark.read.option("header", True).csv(f"{tmp_path}/r")
    assert tuple(report.columns) == A.REPORT and {r.detection_type for r in report.collect()} == {"autoencoder"} and report.count() == 5


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40, list(range(100)), [float(x) for x in np.random.default_rng(1).lognormal(0, 3, 5000)], [1e-9 * k for k in range(3000)] + [1e9], [float("nan"), 1.0],
    [float(k) for k in range(3000)] + [math.inf] * 40, [-math.inf] * 100 + [float(k % 7) for k in range(3000)], [math.inf] * 1500, [5e-324 * (k % 3) for k in range(4000)], [1.7e308 * (-1) ** k for k in range(3000)] + [1.0], [5e-324 * k for k in range(3000)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    own = sorted(v for v in values if not math.isnan(v))
    places = [p * (len(own) - 1) for p in shares]
    want = [a if (a := own[int(p)]) in (b := own[math.ceil(p)], -math.inf) else a + (b - a) * (p - int(p)) for p in places]
    assert detectors.exact_quantiles(df, "x", shares) == pytest.approx(want, rel=1e-12, abs=0)
    assert detectors.exact_quantiles(df.where("false"), "x", (0.5,)) == [None]


def test_attributions_add_up_and_point_at_the_odd_feature(spark):
    rng = np.random.default_rng(3)
    data = [(str(k), [float(x) for x in rng.normal(size=len(FEATURES))]) for k in range(300)] + [("odd", [0.0] * 7 + [12.0] + [0.0] * (len(FEATURES) - 8))]
    df = spark.createDataFrame(data, "src_ip string, scaled array<double>")
    forest = detectors.fit_isolation(df, ("src_ip",), trees=40)
    x = np.array([v for _, v in data])
    paths = sum(forest.path[at[-1]] for at in forest._steps(x)) / len(forest.roots)
    assert np.allclose(forest.attributions(x).sum(axis=1), forest.path[forest.roots].mean() - paths)
    odd = detectors.attribute_isolation(df.where("src_ip = 'odd'"), forest).first().attribution
    assert int(np.argmax(odd)) == 7
    again = detectors.fit_isolation(df.repartition(5), ("src_ip",), trees=40)
    assert (again.cut == forest.cut).all() and (again.feature == forest.feature).all()
    back = detectors.forest_of(detectors.nodes_of(spark, forest).repartition(3), forest.sample, forest.depth)
    assert all((getattr(back, f) == getattr(forest, f)).all() for f in ("feature", "cut", "left", "path", "size", "roots"))


def shapley(forest, row):
    """Shapley values by all subsets: the expected path when the features of a subset are known, cuts on others being followed by the sample's shares."""
    d = len(row)
    def expected(known, at):
        f = forest.feature[at]
        if f < 0:
            return forest.path[at]
        left, right = forest.left[at], forest.left[at] + 1
        if known >> int(f) & 1:
            return expected(known, right if row[f] >= forest.cut[at] else left)
        return (forest.size[left] * expected(known, left) + forest.size[right] * expected(known, right)) / forest.size[at]
    value = [float(np.mean([expected(known, root) for root in forest.roots])) for known in range(1 << d)]
    out = np.zeros(d)
    for i in range(d):
        for known in range(1 << d):
            if not known >> i & 1:
                k = known.bit_count()
                out[i] -= math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (value[known | 1 << i] - value[known])
    return out


@pytest.mark.parametrize("seed,d", [(0, 1), (1, 3), (2, 5), (3, 7)])
def test_attributions_are_shapley_values(spark, seed, d):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(80, d)), 1)  # with ties
    forest = detectors.fit_isolation(spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(data)], "src_ip string, scaled array<double>"), ("src_ip",), trees=6, sample=40)
    rows = np.vstack([data[:6], rng.normal(0, 4, size=(4, d)), np.full((1, d), forest.cut[forest.roots[0]])])
    assert np.allclose(forest.attributions(rows), [shapley(forest, r) for r in rows], atol=1e-12)


def test_attribution_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(60, len(FEATURES))).astype(float)
    w = rng.normal(size=(60, len(FEATURES))) * np.linspace(0.1, 2, len(FEATURES))
    rows = [(DAY, f"s{k}", *a.tolist(), b.tolist(), float(k), "anomaly" if k > 50 else "normal") for k, (a, b) in enumerate(zip(x, w))]
    df = spark.createDataFrame(rows, "window_start timestamp, src_ip string, " + ", ".join(f"{f} double" for f in FEATURES) + ", attribution array<double>, isolation_score double, predicted_label string")
    top = sorted(range(len(FEATURES)), key=lambda j: -np.abs(w[:, j]).mean())
    got = views.attribution_values(df, 4)
    assert {r.feature for r in got.select("feature").distinct().collect()} == {FEATURES[j] for j in top[:4]} and got.count() == 240
    one = {r.src_ip: r for r in got.where(F.col("feature") == FEATURES[top[0]]).collect()}
    for k in range(60):
        v = x[:, top[0]]
        assert (one[f"s{k}"].feature_value, one[f"s{k}"].attribution) == (v[k], w[k, top[0]]) and one[f"s{k}"].feature_percentile == pytest.approx(((v < v[k]).sum() + ((v == v[k]).sum() + 1) / 2) / 60)
    strongest = views.dependency(got)
    assert strongest.count() == 60 and {r.feature for r in strongest.collect()} == {FEATURES[top[0]]} and "predicted_label" in strongest.columns


def test_samples_planes_and_silhouettes(spark):
    rng = np.random.default_rng(4)
    data = [(str(k), "far" if k % 10 == 0 else "near", [float(x) for x in rng.normal(20 * (k % 10 == 0), 1, 3)]) for k in range(400)]
    df = spark.createDataFrame(data, "src_ip string, label string, scaled array<double>")
    drawn = detectors.stratified_sample(df, "label", 100, ("src_ip",))
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {"near": 90, "far": 10} and drawn.columns == df.columns
    assert sorted(r.src_ip for r in drawn.collect()) == sorted(r.src_ip for r in detectors.stratified_sample(df.repartition(7), "label", 100, ("src_ip",)).collect())
    assert detectors.stratified_sample(df, "label", 1000, ("src_ip",)).count() == 400 and detectors.stratified_sample(df.where("label = 'near' or src_ip = '0'"), "label", 50, ("src_ip",)).where("label = 'far'").count() == 1
    value, n, why = detectors.silhouette(df, "label", ("src_ip",), 200)
    x, g = np.array([v for *_, v in data]), np.array([lab for _, lab, _ in data])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    a = np.array([far[i][(g == g[i])].sum() / ((g == g[i]).sum() - 1) for i in range(len(x))])
    b = np.array([far[i][g != g[i]].mean() for i in range(len(x))])
    assert detectors.silhouette(df, "label", ("src_ip",), 400)[0] == pytest.approx(float(((b - a) / np.maximum(a, b)).mean())) and value > 0.8 and (n, why) == (200, None)
    assert detectors.silhouette(df.where("label = 'near'"), "label", ("src_ip",))[2] and detectors.silhouette(df.where("label = 'near' or src_ip = '0'"), "label", ("src_ip",))[0] is None
    axes, share = detectors.fit_plane(df, ("src_ip",))
    assert share[0] > 0.9 and (axes[np.abs(axes).argmax(axis=0), [0, 1]] > 0).all()
    row = detectors.project_plane(df, axes).first()
    assert (row.pca_1, row.pca_2) == pytest.approx(tuple(np.array(row.scaled) @ axes))


def test_views(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0)], "k string, v double")
    assert sorted((r.k, r.v or 0, r.percentile) for r in views.percentile_rank(df.where("v is not null"), "k", "v").collect()) == [("a", 1.0, 1 / 3), ("a", 2.0, 2.5 / 3), ("a", 2.0, 2.5 / 3), ("b", 5.0, 1.0)]
    summary = views.score_summary(df, "v", F.col("v") > 100).first()
    assert (summary.median, summary.gap, summary.anomaly_rate) == (2.0, pytest.approx(np.quantile([1, 2, 2, 5], 0.95) - 2), 0.0)
    assert [r.v for r in views.top_rows(df, "v", 2, ("k",)).collect()] == [5.0, 2.0]
    assert views.repeatable_sample(df, ("k", "v"), 2).collect() == views.repeatable_sample(df.repartition(4), ("k", "v"), 2).collect()


def test_models_are_published_and_loaded_for_their_features_only(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = [(DAY + dt.timedelta(minutes=5 * k), f"s{k % 3}", *(float(x) for x in rng.normal(size=len(FEATURES)))) for k in range(120)]
    windows = spark.createDataFrame(data, "window_start timestamp, src_ip string, " + ", ".join(f"{f} double" for f in FEATURES))
    model = models.fit(windows, trees=20)
    models.publish(model, str(tmp_path), "1")
    loaded = models.load(spark, str(tmp_path), "1")
    for one, two in zip(models.score(windows, model), models.score(windows, loaded)):
        names = [c for c in ("reconstruction_error", "isolation", "score_percentile", "predicted_label") if c in one.columns]
        assert sorted(map(tuple, one.select("window_start", "src_ip", *names).collect())) == sorted(map(tuple, two.select("window_start", "src_ip", *names).collect()))
    with pytest.raises(ValueError, match="exists"):
        models.publish(model, str(tmp_path), "1")
    made = models.artifacts(windows, model, 20)
    models.publish_artifacts(made, str(tmp_path), "1")
    contour = spark.read.parquet(f"{tmp_path}/1/artifacts/contour").toPandas().sort_values(["pca_2", "pca_1"])
    axes, _ = detectors.fit_plane(model.scale(windows))
    points = contour[["pca_1", "pca_2"]].to_numpy()
    assert len(contour) == 400 and np.allclose(contour.anomaly_score, model.forest.scores(points @ axes.T) - model.offset) and (contour.is_anomaly == (contour.anomaly_score > 0)).all()
    plane = spark.read.parquet(f"{tmp_path}/1/artifacts/plane").toPandas()
    low, high = np.quantile(plane.pca_1, [0.01, 0.99])
    assert (contour.pca_1.min(), contour.pca_1.max()) == (pytest.approx(low - 0.1 * (high - low)), pytest.approx(high + 0.1 * (high - low)))
    assert spark.read.parquet(f"{tmp_path}/1/artifacts/errors").where("split = 'train'").count() > 60 and set(made) == {"scores", "errors", "plane", "contour", "attributions", "dependency"}
    spark.read.parquet(f"{tmp_path}/1/config").withColumn("features", F.reverse("features")).write.parquet(f"{tmp_path}/2/config")
    with pytest.raises(ValueError, match="order"):
        models.load(spark, str(tmp_path), "2")


def test_stream_counts_events_without_a_uid_and_repeats_once(spark, tmp_path):
    data = [(*r[:1], None, *r[2:]) for r in rows(6, "s", lambda i: "same.example.com")]
    far = (DAY + dt.timedelta(days=2), None, *rows(1, "end")[0][2:])
    spark.createDataFrame([*data, data[0], far], EVENT).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    query = live.live_windows(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.src_ip, r.total_queries) for r in spark.table("counted").collect()] == [("s", 6)]


def test_all_detectors_on_a_stream_agree_with_a_replay_and_write_once(spark, sf_dir, tmp_path):
    own = dns_events(spark, sf_dir)
    own.write.parquet(f"{tmp_path}/in")
    static = spark.read.parquet(f"{tmp_path}/in")
    windows = build_windows(add_features(static), "10 days")
    model = models.fit(windows, k=3, trees=20, contamination=0.2, chosen=0.8)
    stream = spark.readStream.schema(static.schema).parquet(f"{tmp_path}/in")
    for turn in "ab":  # a second stream over the same input finds all alerts written
        live.start_detectors(live.live_windows(stream, "10 days", "1 day", live.COUNTED), static, model, f"{tmp_path}/out", f"{tmp_path}/check{turn}", "10 days").awaitTermination(200)
    closed = windows.where(F.col("window_end") <= static.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0])
    replay = live.detect(closed, add_features(static), model, "10 days")
    for name, made in replay.items():
        want = sorted(r.id for r in made.select("id").collect())
        assert sorted(r.id for r in spark.read.schema("id string").parquet(f"{tmp_path}/out/{name}").collect()) == want, name
        assert want or name == "final"
