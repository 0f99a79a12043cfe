"""Embedding whitening by exact covariances: squares of centred whole numbers are summed for every dimension and for every sum of two dimensions, and half of what a sum's variance has over its two is their covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._common import materialize

#: A component is `UNIT` times as large and `SHIFT` larger as a whole number.
UNIT, SHIFT = 1024, 100_000
#: Entries of this size or more count as not finite: sums of their squares wouldn't fit in 38 digits.
LARGEST = float(1 << 36)
#: Rows whose squares are summed in 64 bits, and the size of centred values up to which this is exact.
BLOCK, SMALL = 1024, 1 << 25


def _whole(part: pa.Array, d: int) -> np.ndarray:
    values = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(UNIT * values).astype(np.int64) + SHIFT


def _summed(vectors: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], places: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Exact sums of what ``of`` makes of each block of rows, one value for each of ``places``: each task adds up its own rows, and rows of sums meet by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places), dtype=object)
        for batch in batches:
            x = _whole(batch.column(0), d)
            for k in range(0, len(x), BLOCK):
                total += of(x[k : k + BLOCK])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in places], pa.int32()), pa.array([j for _, j in places], pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "j", "s"])

    rows = vectors.select("v").mapInArrow(add, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # a row for each place
    found = {(r.i, r.j): int(r.s) for r in rows}
    return {p: found.get(p, 0) for p in places}


def covariance(vectors: DataFrame, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact sums S of the ``d`` whole numbers of ``n`` vectors ``v``, and their covariances, each rounded once, to double.

    Values are centred at the whole part of S/n, which keeps them small and whole; the rest, less than one, comes off their sums of squares exactly: n * sum((x - S/n)^2) = n * sum(z^2) - sum(z)^2.
    """
    one = [(i, i) for i in range(d)]
    sums = _summed(vectors, d, lambda x: x.sum(axis=0).astype(object), one)
    s = np.array([sums[p] for p in one], dtype=object)
    middle = s // n
    centre, rest = middle.astype(np.int64), s - n * middle
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def squares(x: np.ndarray) -> np.ndarray:
        z = x - centre
        z = z if abs(z).max(initial=0) < SMALL else z.astype(object)
        out = []
        for i in range(d):
            own = z[:, i:] + z[:, i : i + 1]
            own[:, 0] = z[:, i]
            out.append((own * own).sum(axis=0).astype(object))
        return np.concatenate(out)

    q = _summed(vectors, d, squares, pairs)
    var = [n * q[i, i] - int(rest[i]) ** 2 for i in range(d)]
    v = np.zeros((d, d))
    for i, j in pairs:
        twice = 2 * var[i] if i == j else n * q[i, j] - int(rest[i] + rest[j]) ** 2 - var[i] - var[j]
        v[i, j] = v[j, i] = twice / (2 * n * n)  # whole numbers: the quotient is rounded once
    return s, v


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns. The largest entry of each is positive."""
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return e, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each vector and each of its first ``most`` components: ``id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty or hold null, NaN, infinite values or ones of `LARGEST` and more take no part, nor do those of another length than most have, of equally frequent lengths the largest.
    Rows that repeat an id, and null ids, each count on their own. A component without variance has a null ``whitened``. If nothing varies ``explained`` and ``identity_error`` are null, and
    without vectors there are no rows. ``deviation`` is an exact decimal of 38 digits, null where it has more. The driver holds one value for each two dimensions. Other columns aren't in the result, whatever their names.
    """
    vectors = rows.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    usual = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kind = rows.select(F.col(f"`{ident}`").alias("id")).schema["id"].dataType
    out = f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if usual is None:
        return rows.sparkSession.createDataFrame([], out)
    d, n = usual.d, usual.n
    vectors = vectors.where(F.size("v") == d)
    s, v = covariance(vectors, d, n)
    e, axes = components(v)
    k = min(most, d)
    kept = [c for c in range(k) if e[c] > max(float(e[0]), 0.0) * d * np.finfo(float).eps]
    middle = s // n
    centre, rest = middle.astype(np.int64), s - n * middle
    part = np.array([int(r) / n for r in rest])
    turn = axes[:, kept] / np.sqrt(e[kept])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _whole(batch.column(1), d) - centre
            wide = n * (int(abs(z).max(initial=0)) + 1)
            y = n * z - rest.astype(np.int64) if d * wide * wide < 1 << 63 else n * z.astype(object) - rest
            far = [int(t) for t in (y * y).sum(axis=1)]
            white = np.full((len(z), k), np.nan)
            white[:, kept] = (z - part) @ turn
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * k + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(t) if t < 10**38 else None for t in far], pa.decimal128(38, 0)), lists], ["id", "deviation", "w"])

    scored = materialize(vectors.mapInArrow(score, f"id {kind.simpleString()}, deviation decimal(38,0), w array<double>"), "whitened")
    pairs = [(a, b) for a in kept for b in kept if a <= b]
    found = scored.agg(*(F.covar_pop(F.get("w", F.lit(a)), F.get("w", F.lit(b))) for a, b in pairs)).first() if pairs else []
    error = max((abs(c - (a == b)) for (a, b), c in zip(pairs, found, strict=True)), default=None)
    total = float(np.trace(v))
    share = F.array(*(F.lit(max(float(e[c]), 0.0) / total if total > 0 else None).cast("double") for c in range(k)))
    placed = scored.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return placed.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
