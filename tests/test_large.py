"""Steps whose cost a row must not grow with the plan around them."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import dense, detectors
from tracewell.operators.events import normalize
from tracewell.plans import detection, learned, queries
from tracewell.sources import scratch
from tracewell.sources.records import read_tsv


def test_lines_are_cut_once(spark, tmp_path):
    """Filters on fields don't bring the cutting of lines below them a second time."""
    (tmp_path / "dns.log").write_text('#separator \\x09\n#fields\tts\tuid\tid.orig_h\tquery\tquery\n1.5\tC1\t10.0.0.1\ta\tb\n2.5\tC2\t10.0.0.2\n-\tC3\t10.0.0.3\tc\td\n{"ts": "3.5", "uid": "C4", "id.orig_h": "10.0.0.4", "query": "e"}\n{broken\n')
    read = normalize(read_tsv(spark, str(tmp_path)))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(ts") == 1 and plan.count("split(value") == 1
    assert sorted((r.uid, r.src_ip, r["query"], r.ts.timestamp()) for r in read.collect()) == [("C1", "10.0.0.1", "b", 1.5), ("C2", "10.0.0.2", "-", 2.5), ("C4", "10.0.0.4", "e", 3.5)]


def test_a_step_reads_its_own_blocks(spark, sf_dir):
    """An epoch of the dense reconstruction reads the blocks once, not once a step."""
    windows = detectors.scale(queries._windows(spark, sf_dir))
    blocks = dense._blocks(windows, ("window_start", "src_ip"), 10 * dense.BLOCK, 3, 42)
    step = blocks.where("part = 'train' and step = 1")
    assert step.count() and len(step._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]) > 0
    assert {r.step for r in blocks.select("step").distinct().collect()} == {0, 1, 2} and blocks.agg(F.sum("n")).first()[0] == windows.count()


def test_alerts_share_the_features(spark, sf_dir):
    """No alert works out the features of events again."""
    plans = [a._jdf.queryExecution().optimizedPlan().toString() for a in detection._all_alerts(spark, sf_dir).values()]
    assert not any("get_json_object" in p or "event_type" in p for p in plans)


def test_written_scores_are_narrow(spark, sf_dir):
    """Scores are written with their keys alone where nothing else is read, and the session's settings stay."""
    usual = spark.conf.get(scratch.LIMIT)
    found, _ = learned._isolated(learned._scaled(queries._windows(spark, sf_dir)), 0.99)
    assert set(found.columns) == {"window_start", "src_ip", "isolation", "isolation_score", "isolation_threshold", "predicted_label", "score_percentile"}
    assert spark.conf.get(scratch.LIMIT) == usual


def test_residuals_and_errors(spark):
    """A matrix in and out of a task, and its errors, against plain sums."""
    rows = [[0.5, -1.0, 3.0], [2.0, 0.25, -0.125], [0.0, 0.0, 0.0]]
    axes = np.array([[1.0], [0.0], [0.0]])
    found = detectors.score_reconstruction(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, scaled array<double>"), axes).orderBy("i").collect()
    assert [(r.latent, r.reconstructed, r.residuals, r.reconstruction_error) for r in found] == [([a], [a, 0.0, 0.0], [0.0, abs(b), abs(c)], (abs(b) + abs(c)) / 3) for a, b, c in rows]


def test_the_plane_is_that_of_all_rows(spark):
    """No row is left out however many there are: three far rows among 60,000 turn the plane to them."""
    k = F.col("id").cast("double")
    near = F.array(F.sin(k * 12.9898), F.sin(k * 78.233) / 2, F.lit(0.0))
    df = spark.range(60_000).select(F.col("id").cast("string").alias("src_ip"), F.when(k % 20_000 == 7, F.array(F.lit(0.0), F.lit(0.0), k)).otherwise(near).alias("scaled"))
    axes, share = detectors.fit_plane(df, ("src_ip",))
    values, vectors = np.linalg.eigh(np.cov(np.array(df.toPandas()["scaled"].tolist()).T))
    want = vectors[:, [2, 1]]
    assert np.allclose(axes, want * np.sign(want[np.abs(want).argmax(axis=0), [0, 1]]), atol=1e-9) and np.allclose(share, values[[2, 1]] / values.sum(), rtol=1e-9)
