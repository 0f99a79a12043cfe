"""Detectors, correlation and record sources against plain versions and hand-made rows."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import correlation, detectors, reports
from tracewell.plans.queries import LEARNED
from tracewell.sources.records import consolidate, input_manifest, line_digests, manifest_signature, output_digest, read_documents, read_tsv, source_manifest

CASES = [  # isolation score, percentile; ratio; rule score; active, score, outcome
    ((0.1, 100.0), 3.0, 100, 3, 100.0, "alert"), ((0.1, 100.0), 3.0, None, 2, 75.0, "alert"), (None, 3.0, 40, 2, 61.0, "suppressed_score"),
    (None, None, 100, 1, 40.0, "suppressed_consensus"), ((0.1, 94.9), 3.0, 100, 2, 85.0, "alert"), ((-0.1, 100.0), 1.19, 39, 0, 0.0, "suppressed_consensus"),
]


def test_correlation_cases(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:02:00"))
    rows = lambda x, cols: spark.createDataFrame(x, cols).withColumn("window_start", at).withColumn("id", F.concat(F.lit("x"), "src_ip"))
    iso = rows([(str(k), *c[0], None) for k, c in enumerate(CASES) if c[0]], "src_ip string, isolation_score double, score_percentile double, threat_score double")
    rec = rows([(str(k), c[1]) for k, c in enumerate(CASES) if c[1]], "src_ip string, threshold_ratio double")
    own = rows([(str(k), c[2]) for k, c in enumerate(CASES) if c[2]], "src_ip string, threat_score long")
    found = correlation.correlate(correlation.evidence(iso, rec, own))
    assert {int(r.src_ip): (r.active, r.threat_score, r.outcome) for r in found.collect()} == {k: c[3:] for k, c in enumerate(CASES)}
    stats = correlation.run_statistics(found).first()
    assert (stats.final_alerts, stats.suppressed_consensus, stats.suppressed_score, stats.two_detectors, stats.three_detectors) == (3, 2, 1, 3, 1)


def test_isolation_ranks_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(str(k), [float(x) for x in rng.normal(size=4)]) for k in range(400)] + [(f"far{k}", [9.0, -9.0, 9.0, 9.0 + k]) for k in range(3)]
    df = spark.createDataFrame(rows, "src_ip string, scaled array<double>")
    forest = detectors.fit_isolation(df, ("src_ip",), trees=60)
    scored = detectors.share_not_above(detectors.score_isolation(df, forest), detectors.score_isolation(df, forest), "isolation").collect()
    assert {r.src_ip for r in sorted(scored, key=lambda r: -r.isolation)[:3]} == {"far0", "far1", "far2"}
    values = np.array([r.isolation for r in scored])
    assert all(r.score_percentile == pytest.approx(100 * np.mean(values <= r.isolation)) for r in scored)
    assert detectors.fit_isolation(df.where("false"), ("src_ip",)) is None


def test_reconstruction_is_exact_on_the_subspace(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(6, 2)))[0]
    points = rng.normal(size=(200, 2)) @ basis.T
    points -= points.mean(axis=0)
    df = spark.createDataFrame([(p.tolist(),) for p in points], "scaled array<double>")
    components = detectors.fit_reconstruction(df, 2)
    assert detectors.score_reconstruction(df, components).agg(F.max("reconstruction_error")).first()[0] < 1e-9
    off = spark.createDataFrame([((points[0] + np.linalg.svd(basis.T)[2][-1]).tolist(),)], "scaled array<double>")
    assert detectors.score_reconstruction(off, components).first().reconstruction_error > 0.1


@pytest.mark.parametrize("query", LEARNED, ids=lambda q: q.__name__)
def test_learned_queries_cover_their_windows(spark, sf_dir, query):
    rows = query(spark, sf_dir).select("window_start", "src_ip").collect()
    assert rows and len(rows) == len(set(rows))


def test_tsv(spark, tmp_path):
    (tmp_path / "dns.log").write_text("#separator \\x09\n#fields\tts\tuid\tquery\n1\ta\tx.org\n2\tb\n3\tc\ty.org\textra\n")
    with gzip.open(tmp_path / "dns2.log.gz", "wt") as f:
        f.write("#separator \\x7c\n#fields|query|ts\nz.org|4\n")
    (tmp_path / "dns3.log").write_text("5\td\tno.header\n#fields\tts\tquery\n\n6\ta.org\r\n#close\n{\"ts\": 7, \"query\": \"j.org\"}\n{broken\n#separator ,\n#fields,uid,ts,uid\nfirst,8,last\n#fields\n9\n")
    got = {r.ts: (r.uid, r["query"]) for r in read_tsv(spark, str(tmp_path)).collect()}
    assert got == {"1": ("a", "x.org"), "2": ("b", "-"), "3": ("c", "y.org"), "4": (None, "z.org"), "6": (None, "a.org"), "7": (None, "j.org"), "8": ("last", None)}
    assert read_tsv(spark, str(tmp_path), keep_invalid=True).where("not valid").count() == 3
    before = manifest_signature(source_manifest(spark, str(tmp_path)))
    assert source_manifest(spark, str(tmp_path)).count() == 3
    (tmp_path / "dns4.log").write_text("#fields\tts\n")
    assert manifest_signature(source_manifest(spark, str(tmp_path))) != before


def test_documents(spark, tmp_path):
    read = lambda text: [(tmp_path / "d.json").write_bytes(text if isinstance(text, bytes) else text.encode()), read_documents(spark, f"{tmp_path}/d.json").collect()][1]
    assert [r.uid for r in read('{"uid":\n "a"}')] == ["a"] and [r.uid for r in read('\ufeff [{"uid": "a"}, {"uid": "b"}] ')] == ["a", "b"] and [r.uid for r in read('{"uid": "a"}\n\n{"uid": "b"}\n')] == ["a", "b"]
    assert [r.uid for r in read('[{"uid": "a"}]\n[1]'.replace("\n[1]", " "))] == ["a"] and [(r.uid, r["query"]) for r in read('{"uid": "a", "query": "é\\n"}')] == [("a", "é\n")]
    for bad in ("", " \n", "[]", '[{"uid": "a"}, 1]', "[", "text", '{"uid": "a"}\nx', '{"uid": "a"} {"uid": "b"}', '[{"uid": "a"}]]', "null", '{"uid": "a"}\n[]', b'{"uid": "\xff"}'):
        with pytest.raises(Exception, match="not JSON objects"):
            read(bad)
    (tmp_path / "many [1]").mkdir()
    (tmp_path / "many [1]" / "a b%20.json").write_text('{"uid":\n "a"}')
    (tmp_path / "many [1]" / "c.json").write_text('{"uid": "b"}\n' * 2000)
    with gzip.open(tmp_path / "many [1]" / "d.json.gz", "wt") as f:
        f.write('[{"uid": "c"}]')
    found = read_documents(spark, f"{tmp_path}/many \\[1\\]")
    assert {r.uid: r["count"] for r in found.groupBy("uid").count().collect()} == {"a": 1, "b": 2000, "c": 1}
    (tmp_path / "many [1]" / "empty.json").write_text("")
    with pytest.raises(Exception, match="not JSON objects"):
        read_documents(spark, f"{tmp_path}/many \\[1\\]")


def test_manifests_and_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dns1.log").write_text("#fields\tts\n1\n2\n\n")
    with gzip.open(tmp_path / "in" / "dns2.log.gz", "wt") as f:
        f.write("3\n")
    got = {r.path.rpartition("/")[2]: (r.bytes, r.records) for r in input_manifest(spark, f"{tmp_path}/in").collect()}
    assert got["dns1.log"] == (16, 2) and got["dns2.log.gz"][1] == 1
    assert consolidate(spark, f"{tmp_path}/in", f"{tmp_path}/out") == 3
    once = output_digest(spark, f"{tmp_path}/out")
    consolidate(spark, f"{tmp_path}/in", f"{tmp_path}/again")
    assert output_digest(spark, f"{tmp_path}/again") == once != output_digest(spark, f"{tmp_path}/in")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["#fields\tts", "1", "2", "3"]


def test_bounded_history(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 3, "x"), ("c", 4, "y")], "k string, seq int, v string")
    assert [(r.k, r.v) for r in reports.keep_bounded(rows, ["k"], "seq", 2).collect()] == [("c", "y"), ("b", "x")]


def test_digests_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {k} \u00e9\n" for k in range(5000))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text(text.replace("line 4000 ", "line 4001 ", 1))
    (tmp_path / "c.log").write_text(text.replace("line 1 \u00e9\nline 2 \u00e9\n", "line 2 \u00e9\nline 1 \u00e9\n"))
    with gzip.open(tmp_path / "d.log.gz", "wt") as f:
        f.write(text)
    digest = lambda: {r.path.rpartition("/")[2]: (r.lines, r.digest) for r in line_digests(spark, str(tmp_path)).collect()}
    whole = digest()
    assert whole["a.log"] == whole["d.log.gz"] and len({d for _, d in whole.values()}) == 3 and {n for n, _ in whole.values()} == {5000}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        assert digest() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_source_families_count_the_fitted_detectors_alerts(spark, sf_dir):
    """Isolation alerts are the forest's and reconstruction alerts those of the components, by plain versions of both; the two differ."""
    import __spark_entry__
    from tracewell.operators.windows import build_windows
    from tracewell.plans import learned, queries

    windows = build_windows(queries._features(spark, sf_dir), queries.DAY)
    scaled = detectors.scale(windows, digits=learned.DIGITS).select("window_start", "src_ip", "scaled").cache()
    rows = scaled.toPandas()
    x = np.array(rows["scaled"].tolist())
    forest = detectors.fit_isolation(scaled, trees=learned.TREES, sample=learned.SAMPLE, seed=learned.SEED)
    isolation = forest.scores(x)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    kept = vectors[:, values > 1]
    error = np.abs(x - x @ kept @ kept.T).mean(axis=1)
    want = {s: (int((isolation[at] > np.quantile(isolation, 0.9)).sum()), int((error[at] > np.quantile(error, 0.9)).sum())) for s, at in rows.groupby("src_ip").indices.items()}
    got = {r.src_ip: (r.isolation, r.reconstruction) for r in __spark_entry__.queries()["dns_source_families"](spark, sf_dir).collect()}
    assert got == {s: n for s, n in want.items() if any(n) or s in got} and any(a != b for a, b in got.values())
