"""Whitening against plain fractions and numpy."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import queries as Q
from llm.whitening import LARGEST, covariance, whiten


def plain(rows, most=8):
    """id, component -> n, deviation, whitened, explained of (id, vector) rows, in fractions as far as eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and abs(c) < LARGEST for c in v)]
    if not good:
        return []
    sizes = Counter(len(v) for _, v in good)
    d = max(sizes, key=lambda k: (sizes[k], k))
    x = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in good if len(v) == d]
    n, s = len(x), [sum(v[k] for _, v in x) for k in range(d)]
    cov = np.array([[float(sum((v[a] - Fraction(s[a], n)) * (v[b] - Fraction(s[b], n)) for _, v in x) / n) for b in range(d)] for a in range(d)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    out = []
    for i, v in x:
        y = np.array([float(v[k] - Fraction(s[k], n)) for k in range(d)])
        for c in range(min(most, d)):
            white = y @ axes[:, c] / np.sqrt(e[c]) if e[c] > e[0] * d * 2.0**-52 else None
            out.append((i, c + 1, n, sum((n * v[k] - s[k]) ** 2 for k in range(d)), white, e[c] / np.trace(cov) if np.trace(cov) > 0 else None))
    return out


def compare(got, want):
    assert len(got) == len(want)
    order = lambda r: (str(r[0]), r[1], r[3], abs(r[4] or 0))
    signs = {}
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert tuple(g[:4]) == w[:4]
        if w[4] is None:
            assert g[4] is None
        else:
            assert abs(g[4]) == pytest.approx(abs(w[4]), rel=1e-7, abs=1e-9)
            if abs(w[4]) > 1e-6:
                signs.setdefault(w[1], set()).add(g[4] * w[4] > 0)
        assert g[5] == (None if w[5] is None else pytest.approx(w[5], rel=1e-9, abs=1e-14))
    assert all(len(s) == 1 for s in signs.values())


def test_rows_against_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0]), (106, [LARGEST] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "w": F.lit(2), "x.y": F.lit(3)}).repartition(5)
    found = whiten(df).collect()
    compare([(r.id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in found], plain(rows))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-12 and found[0].n == 63


def test_covariances_are_exact_for_large_values(spark):
    rng = np.random.default_rng(2)
    rows = [([float(c) for c in rng.integers(-(1 << 35), 1 << 35, 3)],) for _ in range(50)] + [([0.25, -0.25, 2.0**-12],)]
    s, v = covariance(spark.createDataFrame(rows, "v array<double>").repartition(4), 3, 51)
    x = [[math.floor(1024 * c) + 100000 for c in r[0]] for r in rows]
    assert list(s) == [sum(r[k] for r in x) for k in range(3)]
    for a in range(3):
        for b in range(3):
            assert v[a, b] == float(sum((r[a] - Fraction(s[a], 51)) * (r[b] - Fraction(s[b], 51)) for r in x) / 51)


def test_without_variance(spark):
    of = lambda rows: [tuple(r)[1:] for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert of([]) == of([(1, None)]) == []
    assert of([(1, [0.5, 0.5])]) == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    two = of([(1, [0.0, 1.0]), (2, [1.0, 2.0])])
    assert [(r[0], r[1], r[2], abs(r[3]) if r[3] else None, round(r[4], 12)) for r in two] == [(1, 2, 2 * 1024**2, pytest.approx(1), 1), (2, 2, 2 * 1024**2, None, 0)] * 2


def test_query_against_fractions(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 40").collect()]
    assert rows  # the plain version on some rows, numpy on all
    compare([(r.id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()], plain(rows))
    got = Q.op12_whitening(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(table.embedding).astype(float)) + 100000
    y = x - x.mean(axis=0)
    e, axes = np.linalg.eigh(y.T @ y / len(x))
    white = y @ axes[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(white), atol=1e-6) and np.allclose(np.cov(wide.T, bias=True), np.eye(8), atol=1e-10)
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(table.vec_id, ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1).astype(int)))
