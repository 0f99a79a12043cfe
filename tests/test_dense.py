"""The dense reconstruction: gradients by differences, the start as components, training again, and held-out errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import dense as N
from tracewell.operators import detectors

D = 6


def net(seed=1, hidden=(5, 3, 5)):
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(D, D)))[0][:, : min(hidden)]
    out = N.started(hidden, axes, np.linspace(1, 2, min(hidden)), seed)
    return out.like(out.flat() + rng.normal(0, 0.3, out.flat().size)), axes


@pytest.mark.parametrize("dropped", [False, True])
def test_gradients_are_differences(dropped):
    one, _ = net()
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, D))
    drop = [(rng.random((7, len(b))) > 0.3) / 0.7 for b in one.biases[:-1]] if dropped else None
    slope, loss = one.gradient(x, drop)
    flat = one.flat()
    assert loss == pytest.approx(np.abs(one.layers(x, drop)[-1] - x).mean(axis=1).sum())
    for k in rng.choice(len(flat), 60, replace=False):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert slope[k] == pytest.approx((one.like(flat + step).gradient(x, drop)[1] - one.like(flat - step).gradient(x, drop)[1]) / 2e-6, abs=1e-4)


def test_it_starts_as_the_components():
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(D, D)))[0][:, :3]
    x = rng.normal(size=(50, D))
    latent, made = N.started((8, 3, 8), axes, np.ones(3), 0).project(x)
    assert np.allclose(made, x @ axes @ axes.T) and latent.shape == (50, 3)


def bent(spark, n=700, parts=3):
    """Rows on a curved sheet, which planes miss."""
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-2, 2, (2, n))
    x = np.column_stack([a, b, np.abs(a), np.abs(b), np.maximum(a, b), a - b]) + rng.normal(0, 0.02, (n, 6))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    return spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(x)], "src_ip string, scaled array<double>").repartition(parts)


def test_training_beats_components_and_repeats(spark, tmp_path):
    keys = ("src_ip",)
    df = bent(spark)
    one = N.fit_dense(df, keys, epochs=12, hidden=(24, 2, 24))
    two = N.fit_dense(bent(spark, parts=5), keys, epochs=12, hidden=(24, 2, 24))
    assert np.array_equal(one.flat(), two.flat()) and one.history == two.history
    held = df.where(detectors.split(df, keys) == "validation")
    mean = lambda scored: scored.agg(F.avg("reconstruction_error")).first()[0]
    linear = mean(detectors.score_reconstruction(held, np.linalg.eigh(np.cov(np.array([r.scaled for r in df.collect()]).T))[1][:, -2:]))
    assert mean(N.score_dense(held, one)) == pytest.approx(min(h[2] for h in one.history), abs=1e-6) and mean(N.score_dense(held, one)) < linear
    N.publish_dense(spark, one, f"{tmp_path}/m", list("abcdef"))
    again = N.load_dense(spark, f"{tmp_path}/m", list("abcdef"))
    assert np.array_equal(again.flat(), one.flat()) and again.history == one.history and again.middle == one.middle == 2
    with pytest.raises(ValueError, match="features"):
        N.load_dense(spark, f"{tmp_path}/m", list("abcdfe"))
    with pytest.raises(Exception, match="exist"):
        N.publish_dense(spark, two, f"{tmp_path}/m", list("abcdef"))


def test_query_is_no_worse_than_components_on_held_out_windows(spark, sf_dir):
    from tracewell.plans import learned

    row = learned.dns_dense_history(spark, sf_dir).orderBy("epoch").collect()
    assert [r.epoch for r in row] == list(range(len(row))) and min(r.validation_error for r in row) <= row[0].validation_error
    found = learned.dns_dense_reconstruction(spark, sf_dir)
    assert found.count() == found.select("window_start", "src_ip").distinct().count() > 50


def test_without_rows_and_with_one(spark):
    df = bent(spark)
    assert N.fit_dense(df.where("false"), ("src_ip",)) is None
    few = N.fit_dense(df.limit(1), ("src_ip",), epochs=2)
    assert N.score_dense(df.limit(3), few).count() == 3


def test_the_query_trains_the_whole_network(spark, sf_dir):
    """The layers that the number of windows asks for, and as many epochs as the operator gives them: all, or until none of the last ones was the best of training."""
    from tracewell.plans import learned

    scaled, net = learned._dense(spark, sf_dir)
    hidden, _ = N.NARROW if scaled.count() < N.SMALL else N.WIDE
    errors = [e for _, _, e in net.history[1:]]
    assert tuple(len(b) for b in net.biases[:-1]) == hidden
    assert len(errors) == N.EPOCHS or len(errors) == N.PATIENCE + 1 + int(np.argmin(errors))


def test_a_good_start_does_not_end_training(spark):
    """Rows on a plane, which the start gives exactly: training goes on while its own errors fall, and the start is what counts."""
    x = np.random.default_rng(5).normal(size=(300, 2)) @ np.random.default_rng(6).normal(size=(2, D))
    df = spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(x - x.mean(axis=0))], "src_ip string, scaled array<double>")
    one = N.fit_dense(df, ("src_ip",), epochs=12, hidden=(24, 2, 24), patience=1)
    errors = [e for _, _, e in one.history[1:]]
    assert one.history[0][2] < 1e-6 and min(errors) > 1e-6 and len(errors) == min(12, 2 + int(np.argmin(errors))) and len(errors) > 1
    assert N.score_dense(df, one).agg(F.max("reconstruction_error")).first()[0] < 1e-6


def test_equal_entries_leave_the_start_as_it_is(spark):
    """Which of two equal entries of a component is the larger by a last bit doesn't turn it round: rows in other parts give the same network."""
    x = np.random.default_rng(7).normal(size=(400, 3)) / 3
    x = np.column_stack([x, -x])
    rows = [(str(k), r.tolist()) for k, r in enumerate(x - x.mean(axis=0))]
    own = [N.fit_dense(spark.createDataFrame(rows, "src_ip string, scaled array<double>").repartition(p), ("src_ip",), epochs=0, hidden=(8, 3, 8)).flat() for p in (1, 3, 7)]
    assert np.array_equal(own[0], own[1]) and np.array_equal(own[0], own[2])
