"""The dense reconstruction: a network with a narrow middle, trained on executors by mini-batches.

Parameters go out with each step's tasks, and gradients come back as sums. A block of windows is one row of a written table, its windows in the order of their keys, so that its gradient doesn't depend on how Spark lays
out the rows, and sums over blocks are of whole numbers, so that they don't depend on their order: training again gives the same network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.detectors import key_digest, rebuilt, split
from tracewell.schema import FEATURES
from tracewell.sources.scratch import discard, written

#: Layers and dropout for fewer than `SMALL` training windows and for more, and how training goes.
SMALL, NARROW, WIDE = 1000, ((24, 12, 24), 0.0), ((96, 48, 18, 48, 96), 0.1)
EPOCHS, PATIENCE, BATCH = 50, 7, 256
#: A tenth of the usual rate: the start is near a minimum, and its shifted units turn small changes of weights into large ones of values.
RATE = 1e-4
#: Windows in a block, about, and steps of an epoch at most.
BLOCK, STEPS = 1024, 8
#: Sums are counted in parts of one: exact for a thousand million windows.
UNIT = float(1 << 30)


@dataclass
class Dense:
    """Weights and biases of each layer, all but the last with ReLU; ``middle`` is the number of the layer that gives the latent values. ``history`` has epoch, training and validation error."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    middle: int
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def layers(self, x: np.ndarray, drop: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """What each layer gives for rows, the rows themselves first. ``drop`` multiplies hidden layers."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            y = out[-1] @ w + b
            if k < len(self.weights) - 1:
                y = np.maximum(y, 0)
                y = y if drop is None else y * drop[k]
            out.append(y)
        return out

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.layers(x)
        return out[self.middle], out[-1]

    def gradient(self, x: np.ndarray, drop: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
        """The gradient of the rows' summed mean absolute errors, in one vector, and the sum itself."""
        out = self.layers(x, drop)
        slope, parts = np.sign(out[-1] - x) / x.shape[1], []
        for k in reversed(range(len(self.weights))):
            parts += [slope.sum(axis=0), (out[k].T @ slope).ravel()]
            if k:
                slope = (slope @ self.weights[k].T) * (out[k] > 0)
                slope = slope if drop is None else slope * drop[k - 1]
        return np.concatenate(parts[::-1]), float(np.abs(out[-1] - x).mean(axis=1).sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for w, b in zip(self.weights, self.biases, strict=True) for p in (w, b)])

    def like(self, flat: np.ndarray) -> Dense:
        """The same layers with other parameters."""
        weights, biases, at = [], [], 0
        for w, b in zip(self.weights, self.biases, strict=True):
            weights.append(flat[at : at + w.size].reshape(w.shape))
            biases.append(flat[at + w.size : at + w.size + b.size])
            at += w.size + b.size
        return Dense(weights, biases, self.middle, self.history)


def started(hidden: tuple[int, ...], components: np.ndarray, deviations: np.ndarray, seed: int) -> Dense:
    """A network that does what principal components do, as far as eight deviations: their units are shifted so far that ReLU lets them pass. The other units begin at random, and without weight in the output."""
    rng, d, k = np.random.default_rng(seed), components.shape[0], components.shape[1]
    sizes, shift = (d, *hidden, d), 8 * np.maximum(deviations, 1e-3)
    weights, biases = [], []
    for a, b in zip(sizes, sizes[1:]):
        w, bias = rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)
        if not weights:
            w[:, :k], bias[:k] = components, shift
        elif len(weights) < len(hidden):
            w[:, :k] = 0
            w[:k, :k] = np.eye(k)
        else:
            w[:] = 0
            w[:k], bias = components.T, -components @ shift
        weights.append(w)
        biases.append(bias)
    return Dense(weights, biases, 1 + int(np.argmin(hidden)))


def _blocks(scaled: DataFrame, keys: tuple[str, ...], n: int, steps: int, seed: int) -> DataFrame:
    """Training and validation windows in blocks by a digest of their keys, each block's in the order of it. A step reads its own blocks alone, so that an epoch reads the table once."""
    many = max(1, n // BLOCK)
    own = scaled.select("scaled", split(scaled, keys, seed=seed).alias("part"), key_digest(scaled, keys, seed + 1).alias("digest"))
    own = own.withColumn("block", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % many)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(pdf.sort_values("digest")["scaled"].tolist(), dtype=float)
        return pd.DataFrame([(key[0], int(key[1]) % steps, int(key[1]), len(rows), rows.tobytes())], columns=["part", "step", "block", "n", "x"])

    made = own.groupBy("part", "block").applyInPandas(pack, "part string, step int, block long, n int, x binary")
    return written(made, "blocks", ("part", "step"))


def fit_dense(scaled: DataFrame, keys: tuple[str, ...] = ("window_start", "src_ip"), epochs: int = EPOCHS, seed: int = 42, hidden: tuple[int, ...] | None = None, patience: int = PATIENCE, rate: float = RATE) -> Dense | None:
    """A network for windows with ``scaled`` features, None without windows.

    It starts as their principal components, and each step follows the gradient over the windows of one part of the blocks; it stops when the error of the held-out fifth has been no lower than after some
    earlier epoch of training for ``patience`` epochs. The start doesn't end training, which first loses it: the best network counts, the start among them, so that it is never worse on these windows than the components.
    """
    n = scaled.count()
    if not n:
        return None
    usual, drop = NARROW if n < SMALL else WIDE
    hidden, drop = (usual, drop) if hidden is None else (hidden, 0.0)
    d = len(scaled.first().scaled)
    k = min(*hidden, d)
    axes, variances = np.eye(d)[:, :k], np.zeros(k)
    if n > 1:
        model = PCA(k=k, inputCol="v", outputCol="p").fit(scaled.select(array_to_vector("scaled").alias("v")))
        total = scaled.agg(sum(F.var_pop(F.get("scaled", F.lit(i))) for i in range(d))).first()[0] or 0.0
        axes, variances = model.pc.toArray(), np.nan_to_num(model.explainedVariance.toArray()) * total
    axes = np.round(axes, 9) + 0.0  # sums in another order differ by less, also in which of two equal entries is the largest
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    net = started(hidden, axes, np.round(np.sqrt(np.maximum(variances, 0)), 9), seed)
    steps = min(STEPS, max(1, n // BATCH))
    blocks = _blocks(scaled, keys, n, steps, seed)
    counts = {(r.part, r.step): r.n for r in blocks.groupBy("part", "step").agg(F.sum("n").alias("n")).collect()}
    held = sum(m for (part, _), m in counts.items() if part == "validation")
    judged = "validation" if held else "train"
    flat, m, v, t = net.flat(), np.zeros(net.flat().size), np.zeros(net.flat().size), 0
    best, best_flat, least, waited = _error(blocks, net, judged), flat.copy(), np.inf, 0
    history = [(0, _error(blocks, net, "train"), best)]
    for epoch in range(1, epochs + 1):
        paid = 0.0
        for step in range(steps):
            if not counts.get(("train", step)):
                continue
            slope, loss = _gradient(blocks.where((F.col("part") == "train") & (F.col("step") == step)), net, drop, [seed, epoch, step])
            slope, paid, t = slope / counts["train", step], paid + loss, t + 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
            net = net.like(flat)
        error = _error(blocks, net, judged)
        history.append((epoch, paid / max(1, sum(c for (part, _), c in counts.items() if part == "train")), error))
        if error < best:
            best, best_flat = error, flat.copy()
        least, waited = (error, 0) if error < least else (least, waited + 1)
        if waited >= patience:
            break
    discard(blocks)
    net = net.like(best_flat)
    net.history = history
    return net


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x) * UNIT).astype(np.int64)


def _rows(x: bytes, d: int) -> np.ndarray:
    return np.frombuffer(x, dtype=float).reshape(-1, d)


def _gradient(blocks: DataFrame, net: Dense, drop: float, seed: list[int]) -> tuple[np.ndarray, float]:
    """The summed gradient and error of some blocks: each task adds up its own, and places of the vector meet."""
    sent, d = blocks.sparkSession.sparkContext.broadcast(net), net.weights[0].shape[0]

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            for block, x in zip(pdf["block"], pdf["x"], strict=True):
                rows, masks = _rows(x, d), None
                if drop:
                    rng = np.random.default_rng([*seed, int(block)])
                    masks = [(rng.random((len(rows), len(b))) >= drop) / (1 - drop) for b in sent.value.biases[:-1]]
                    for mask in masks:  # the units that began as components stay
                        mask[:, : min(len(b) for b in sent.value.biases[:-1])] = 1
                slope, loss = sent.value.gradient(rows, masks)
                own = _whole(np.append(slope, loss))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "s": total})

    found = blocks.select("block", "x").mapInPandas(add, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()  # a row for each parameter
    out = np.zeros(len(found))
    out[found["place"].to_numpy()] = found["s"].to_numpy() / UNIT
    sent.unpersist()
    return out[:-1], float(out[-1])


def _error(blocks: DataFrame, net: Dense, part: str) -> float:
    """Mean over windows of their mean absolute error."""
    sent, d = blocks.sparkSession.sparkContext.broadcast(net), net.weights[0].shape[0]

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"n": pdf["n"], "s": [int(_whole(np.abs(sent.value.project(x)[1] - x).mean(axis=1).sum())) for x in (_rows(b, d) for b in pdf["x"])]})

    n, s = blocks.where(F.col("part") == part).select("n", "x").mapInPandas(add, "n long, s long").agg(F.sum("n"), F.sum("s")).first()
    return s / UNIT / n if n else float("nan")


def score_dense(scaled: DataFrame, net: Dense) -> DataFrame:
    """Adds ``latent``, ``reconstructed``, ``residuals`` (absolute, by feature) and ``reconstruction_error``, their mean, as `score_reconstruction` does."""
    sent = scaled.sparkSession.sparkContext.broadcast(net)
    return rebuilt(scaled, lambda rows: sent.value.project(rows))


def publish_dense(spark: SparkSession, net: Dense, path: str, features: list[str] = FEATURES) -> None:
    """The network as tables below ``path``: layers, the epochs' errors, and the features, which are written last. A path that holds a network is refused."""
    layers = [(k, w.shape[0], w.shape[1], w.ravel().tolist(), b.tolist(), net.middle) for k, (w, b) in enumerate(zip(net.weights, net.biases, strict=True))]
    spark.createDataFrame(layers, "layer int, rows int, columns int, weights array<double>, biases array<double>, middle int").write.parquet(f"{path}/layers")
    spark.createDataFrame(net.history, "epoch int, training_error double, validation_error double").write.parquet(f"{path}/history")
    spark.createDataFrame([(features,)], "features array<string>").write.parquet(f"{path}/features")


def load_dense(spark: SparkSession, path: str, features: list[str] = FEATURES) -> Dense:
    """A published network; an error if its features are others."""
    if list(spark.read.parquet(f"{path}/features").first().features) != features:
        raise ValueError("the network was fitted on other features, or in another order")
    layers = spark.read.parquet(f"{path}/layers").orderBy("layer").collect()  # a row for each layer
    history = [tuple(r) for r in spark.read.parquet(f"{path}/history").orderBy("epoch").collect()]
    return Dense([np.array(r.weights).reshape(r.rows, r.columns) for r in layers], [np.array(r.biases) for r in layers], layers[0].middle, history)
