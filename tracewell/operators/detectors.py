"""Learned detectors on window features: a rank-k reconstruction and an isolation forest. Both see every window when they are fitted, and score every window."""

from __future__ import annotations

from dataclasses import dataclass

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators.reports import scaler
from tracewell.schema import FEATURES

BUCKETS = 4096
#: Values that a quantile's interval may hold when they are fetched.
FEW = 1000


def matrix_of(rows: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix, without an object for each of them."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1 if len(rows) else 0)


def lists_of(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def rebuilt(scaled: DataFrame, project) -> DataFrame:
    """Adds ``latent``, ``reconstructed``, ``residuals`` (absolute, by feature) and ``reconstruction_error``, their mean. ``project`` gives the first two of a matrix."""

    @F.arrow_udf("latent array<double>, reconstructed array<double>, residuals array<double>, reconstruction_error double")
    def told(x: pa.Array) -> pa.Array:
        rows = matrix_of(x)
        latent, made = project(rows) if len(rows) else (rows, rows)
        residuals, total = np.abs(rows - made), np.zeros(len(rows))
        for k in range(rows.shape[1]):  # in the order of the features
            total += residuals[:, k]
        return pa.StructArray.from_arrays([*map(lists_of, (latent, made, residuals)), pa.array(total / max(1, rows.shape[1]))], ["latent", "reconstructed", "residuals", "reconstruction_error"])

    return scaled.withColumn("_p", told("scaled")).select("*", "_p.*").drop("_p")


def scale_by(windows: DataFrame, scaling: DataFrame, features: list[str] = FEATURES, digits: int | None = None) -> DataFrame:
    """Adds ``scaled``: z-scores of the features by a table of ``feature, mean, std``, of so many digits; 0 where a feature doesn't vary or is missing."""
    stats = {r.feature: r for r in scaling.collect()}  # a row for each feature
    def one(c: str) -> Column:
        mean, std = stats[c].mean, stats[c].std
        z = F.coalesce((F.col(c) - mean) / std, F.lit(0.0)) if std else F.lit(0.0)
        return z if digits is None else F.round(z * 10**digits) / 10**digits
    return windows.withColumn("scaled", F.array(*map(one, features)))


def scale(windows: DataFrame, like: DataFrame | None = None, features: list[str] = FEATURES, digits: int | None = None) -> DataFrame:
    """Adds ``scaled`` by the mean and population deviation of ``like``, or of the windows themselves."""
    return scale_by(windows, scaler(windows if like is None else like, features), features, digits)


def exact_quantiles(values: DataFrame, col: str, shares: tuple[float, ...]) -> list[float | None]:
    """Quantiles with linear interpolation, exactly; nulls and NaN are left out, and without values all are None. Infinite values are counted apart; between minus infinity and a larger value it is minus infinity.

    Each pass counts the values of the intervals that hold the wanted ranks in `BUCKETS` equal buckets, and narrows every interval to the
    one bucket that holds its rank, until it has `FEW` values or one. No task sorts all values, and the driver gets counts of bounded number.
    """
    x = F.col(col)
    values = values.select(x.cast("double").alias(col)).where(x.isNotNull() & ~F.isnan(x))
    n, least, most = values.agg(F.count("*"), F.count_if(x == -np.inf), F.count_if(x == np.inf)).first()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    ranks = sorted({r for p in places for r in (int(np.floor(p)), int(np.ceil(p)))})
    found = {r: -np.inf if r < least else np.inf for r in ranks if r < least or r >= n - most}
    found |= {r: v for r, v in _ranked(values.where(F.abs(x) < np.inf), col, [r - least for r in ranks if r not in found], least).items()}

    def between(p: float) -> float:
        low, high = found[int(np.floor(p))], found[int(np.ceil(p))]
        return float(low if low in (high, -np.inf) else low + (high - low) * (p - np.floor(p)))

    return [between(p) for p in places]


def _ranked(values: DataFrame, col: str, ranks: list[int], first: int) -> dict[int, float]:
    """The finite values at some ranks, which ``first`` is added to."""
    if not ranks:
        return {}
    x = F.col(col)
    n, low, high = values.agg(F.count("*"), F.min(col), F.max(col)).first()
    held = {r: (low, high, 0, n) for r in ranks}  # rank: low, high, values below, values in it
    while wide := sorted({h for h in held.values() if h[0] < h[1] and h[3] > FEW}):
        # halves don't overflow; neighbours too close for a difference of halves are told apart by value, of which there are few
        place = lambda a, b: F.least(F.lit(BUCKETS - 1), F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * BUCKETS)).cast("double") if b / 2 - a / 2 > 2.0**-1060 else x
        parts = [F.when(x.between(a, b), F.struct(F.lit(k).alias("k"), place(a, b).alias("bucket"))) for k, (a, b, _, _) in enumerate(wide)]
        rows = values.select(F.coalesce(*parts).alias("p"), col).where("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).orderBy("p").collect()
        after = {}
        for k, interval in enumerate(wide):
            below = interval[2]
            for r in (r for r in rows if r.p.k == k):
                for rank in (i for i, h in held.items() if h == interval and below <= i < below + r.n):
                    after[rank] = (r.a, r.b, below, r.n)
                below += r.n
        if all(after[i] == held[i] for i in after):
            raise RuntimeError(f"the interval of a quantile of {col} doesn't narrow")
        held |= after
    found = {i: h[0] for i, h in held.items() if h[0] == h[1]}
    narrow = {h for h in held.values() if h[0] < h[1]}
    inside = F.lit(False)
    for a, b, _, _ in narrow:
        inside = inside | x.between(a, b)
    few = np.array(sorted(r[0] for r in values.where(inside).collect())) if narrow else np.empty(0)  # at most two intervals a quantile
    for i, (a, b, below, _) in held.items():
        if a < b:
            found[i] = float(few[np.searchsorted(few, a) + i - below])
    return {first + i: v for i, v in found.items()}


def error_thresholds(scores: DataFrame, col: str, chosen: float = 0.99) -> DataFrame:
    """Exact quantiles 0.95, 0.99 and the chosen one, with linear interpolation, and the mean plus three population deviations, in one row."""
    p95, p99, threshold = (None if q is None else float(q) for q in exact_quantiles(scores, col, (0.95, 0.99, chosen)))
    of = lambda v, n: F.lit(v).cast("double").alias(n)
    return scores.agg((F.avg(col) + 3 * F.stddev_pop(col)).alias("mean_3std")).select(of(p95, "p95"), of(p99, "p99"), of(threshold, "threshold"), "mean_3std")


def split(rows: DataFrame, keys: tuple[str, ...] = ("window_start", "src_ip"), share: int = 80, seed: int = 42) -> Column:
    """``train`` or ``validation`` by a digest of the keys, so that the split is the same however rows are partitioned."""
    return F.when(F.conv(F.substring(key_digest(rows, keys, seed), 1, 8), 16, 10).cast("long") % 100 < share, "train").otherwise("validation")


def fit_reconstruction(scaled: DataFrame, k: int | None = 12) -> np.ndarray:
    """The ``k`` principal components of the scaled features, as columns. None of them (``k`` 0) reconstructs every row by the mean; ``k`` None takes those whose variance exceeds that of a scaled feature, 1."""
    if k == 0:
        return np.zeros((len(FEATURES), 0))
    if k is None:
        total = scaled.agg(sum(F.var_pop(F.get("scaled", F.lit(i))) for i in range(len(FEATURES)))).first()[0] or 0.0
        model = PCA(k=len(FEATURES), inputCol="v", outputCol="p").fit(scaled.select(array_to_vector("scaled").alias("v")))
        return model.pc.toArray()[:, model.explainedVariance.toArray() * total > 1]
    return PCA(k=k, inputCol="v", outputCol="p").fit(scaled.select(array_to_vector("scaled").alias("v"))).pc.toArray()


def score_reconstruction(scaled: DataFrame, components: np.ndarray) -> DataFrame:
    """Adds ``latent``, ``reconstructed``, ``residuals`` (absolute, by feature) and ``reconstruction_error``, their mean."""

    components = np.ascontiguousarray(components)  # products of equal layouts are equal to the last bit

    def project(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        latent = rows @ components
        return latent, latent @ components.T

    return rebuilt(scaled, project)


def flagged(scored: DataFrame, threshold: float, mode: str = "full-log") -> DataFrame:
    """Scored windows with ``threshold``, the ratio to it, whether it is exceeded, and the mode."""
    error = F.col("reconstruction_error")
    return scored.withColumns({"threshold": F.lit(threshold), "threshold_ratio": F.when(F.lit(threshold) > 0, error / threshold), "anomaly": (F.lit(threshold) > 0) & (error > threshold), "scoring_mode": F.lit(mode)})


def long_form(scored: DataFrame, array: str, names: list[str] = FEATURES, keys: tuple[str, ...] = ("window_start", "src_ip")) -> DataFrame:
    """One row for each name and value of an array column: the residual, latent and attribution tables."""
    return scored.select(*keys, F.inline(F.zip_with(F.array(*map(F.lit, names)), F.col(array), lambda n, v: F.struct(n.alias("feature"), v.alias("value")))))


def top_features(values: str, k: int, features: list[str] = FEATURES) -> Column:
    """The ``k`` features of largest absolute value in an array column, as structs of name and value."""
    named = F.zip_with(F.array(*map(F.lit, features)), F.col(values), lambda n, v: F.struct(F.abs(v).alias("size"), n.alias("feature"), v.alias("value")))
    return F.transform(F.slice(F.sort_array(named, asc=False), 1, k), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1 at a leaf), cut, left child (the right one follows it), the mean path length of the node's sample, and its size."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    size: np.ndarray
    roots: np.ndarray
    sample: int
    depth: int

    def _steps(self, rows: np.ndarray):
        """For each tree the nodes that the rows stand at, level by level."""
        every = np.arange(len(rows))
        for root in self.roots:
            at = [np.full(len(rows), root)]
            for _ in range(self.depth):
                f = self.feature[at[-1]]
                at.append(np.where(f < 0, at[-1], self.left[at[-1]] + (rows[every, f] >= self.cut[at[-1]])))
            yield at

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over the expected one: near 1 for rows that are isolated early."""
        total = np.zeros(len(rows))
        for at in self._steps(rows):
            total += self.path[at[-1]]
        return 2.0 ** (-total / len(self.roots) / max(float(_average_path(self.sample)), 1e-12))

    def leaves(self) -> dict[int, tuple[np.ndarray, ...]]:
        """Leaves by how many features their paths cut: of each such feature its number, the share of the sample that its cuts let through, and the interval that they leave; and the leaf's path length."""
        found: dict[int, list] = {}
        for root in self.roots:
            todo = [(root, {})]
            while todo:
                at, way = todo.pop()
                f = int(self.feature[at])
                if f < 0:
                    found.setdefault(len(way), []).append((list(way), [w[0] for w in way.values()], [w[1] for w in way.values()], [w[2] for w in way.values()], self.path[at]))
                    continue
                share, low, high = way.get(f, (1.0, -np.inf, np.inf))
                for child, ends in ((self.left[at], (low, min(high, self.cut[at]))), (self.left[at] + 1, (max(low, self.cut[at]), high))):
                    todo.append((child, way | {f: (share * self.size[child] / self.size[at], *ends)}))
        return {m: tuple(np.array(c, dtype=int if k == 0 else float) for k, c in enumerate(zip(*rows, strict=True))) for m, rows in found.items()}

    def attributions(self, rows: np.ndarray) -> np.ndarray:
        """Exact Shapley values of the features for minus the mean path length, features that aren't known following the sample's shares at each cut. A row's sum is the mean path at the roots less its own.

        A leaf with m features on its path pays feature i its length times (o - z), whether the row passes i's cuts less the share that does, times the mean over all orders of the product of the others' o or z.
        This mean is the integral from 0 to 1 of the product of z (1 - t) + o t, a polynomial of degree m - 1, for which Gauss's rule of m / 2 points is exact.
        """
        leaves = self.__dict__.setdefault("_leaves", None) or self.leaves()
        self.__dict__["_leaves"] = leaves
        out = np.zeros(rows.shape)
        for m, (feature, share, low, high, path) in leaves.items():
            if not m:
                continue
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            step = max(1, (1 << 22) // share.size)
            for k in range(0, len(rows), step):
                x = rows[k : k + step][:, feature]
                passes = (low <= x) & (x < high)
                paid = np.zeros(x.shape)
                for t, w in zip((points + 1) / 2, weights / 2, strict=True):
                    each = share * (1 - t) + passes * t
                    paid += w * each.prod(axis=2, keepdims=True) / each
                paid *= (passes - share) * path[:, None]
                for r in range(len(x)):
                    out[k + r] -= np.bincount(feature.ravel(), paid[r].ravel(), rows.shape[1])
        return out / len(self.roots)


#: Hashes of rows and trees are numbers below this prime.
PRIME = (1 << 31) - 1


def _uniform(*parts: object) -> float:
    """A number from 0 up to 1 that a text of the parts decides."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def turns(tree: int, seed: int) -> tuple[int, int]:
    """Factor and summand by which a tree reorders the hashes of rows."""
    return 1 + int(_uniform(seed, tree, "a") * (PRIME - 1)), int(_uniform(seed, tree, "b") * PRIME)


def _grow(rows: np.ndarray, seed: int, tree: int, deepest: int) -> list[list]:
    """One tree: each node is cut at a random place of a random feature that varies. Random numbers are hashes of the node's place in the tree, so that any engine grows the same tree."""
    nodes, todo = [None], [(0, 1, rows, 0)]
    while todo:
        at, place, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= deepest or not len(varied):
            nodes[at] = [-1, 0.0, 0, depth + float(_average_path(len(part))), len(part)]
            continue
        f = int(varied[int(_uniform(seed, tree, place, "f") * len(varied))])
        cut = low[f] + _uniform(seed, tree, place, "c") * (high[f] - low[f])
        cut = cut if cut > low[f] else high[f]
        nodes[at] = [f, float(cut), len(nodes), 0.0, len(part)]
        above = part[:, f] >= cut
        todo += [(len(nodes), 2 * place, part[~above], depth + 1), (len(nodes) + 1, 2 * place + 1, part[above], depth + 1)]
        nodes += [None, None]
    for at in reversed(range(len(nodes))):  # children follow their parents
        f, _, left, _, n = nodes[at]
        if f >= 0:
            nodes[at][3] = (nodes[left][3] * nodes[left][4] + nodes[left + 1][3] * nodes[left + 1][4]) / n
    return nodes


def key_digest(rows: DataFrame, keys: tuple[str, ...], seed: int) -> Column:
    """An MD5 of the seed and the keys as text, times as ISO text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(D.iso_time(F.col(k)) if rows.schema[k].dataType.typeName().startswith("timestamp") else F.col(k).cast("string") for k in keys)))


def fit_isolation(scaled: DataFrame, keys: tuple[str, ...] = ("window_start", "src_ip"), trees: int = 300, sample: int = 256, seed: int = 42) -> Forest | None:
    """A forest of random trees, None without rows. Each tree draws ``sample`` rows of all windows by a hash of the row's keys and the tree's number, and grows on an executor."""
    n = scaled.count()
    if not n:
        return None
    size = min(sample, n)
    deepest = max(1, int(np.ceil(np.log2(max(size, 2)))))
    # a few more than needed reach each tree, which takes the first in its order among them
    limit = int(np.ceil(min(1.0, (sample + 8 * np.sqrt(sample)) / n) * PRIME))
    factors = [turns(t, seed) for t in range(trees)]
    a, b = (F.array(*map(F.lit, c)).cast("array<bigint>") for c in zip(*factors, strict=True))
    own = scaled.select("scaled", key_digest(scaled, keys, seed).alias("digest")).withColumn("own", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % PRIME)
    place = lambda t: (F.col("own") * F.get(a, t) + F.get(b, t)) % PRIME

    @F.arrow_udf("array<int>")
    def drawing(own: pa.Array) -> pa.Array:
        """The trees that draw each row."""
        fa, fb = np.array(factors, dtype=np.int64).T
        rows, found = np.nonzero((own.to_numpy(zero_copy_only=False)[:, None] * fa + fb) % PRIME < limit)
        return pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(len(own) + 1)).astype(np.int32), pa.array(found.astype(np.int32)))

    drawn = own.withColumn("trees", drawing("own")).select("scaled", "digest", "own", F.explode("trees").alias("tree"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "digest"]).head(size)
        grown = _grow(np.array(pdf["scaled"].tolist(), dtype=float), seed, int(key[0]), deepest)
        return pd.DataFrame([(int(key[0]), k, *node) for k, node in enumerate(grown)], columns=["tree", "node", "feature", "cut", "left", "path", "size"])

    nodes = drawn.select("scaled", "digest", "tree", place(F.col("tree")).alias("place")).groupBy("tree").applyInPandas(build, "tree long, node long, feature long, cut double, left long, path double, size long")
    return forest_of(nodes, size, deepest)


def forest_of(nodes: DataFrame, sample: int, depth: int) -> Forest:
    """The forest of a table of nodes: at most ``2 * sample`` a tree."""
    own = nodes.toPandas().sort_values(["tree", "node"])
    roots = np.flatnonzero(own["node"].to_numpy() == 0)
    number = np.cumsum(own["node"].to_numpy() == 0) - 1
    return Forest(own["feature"].to_numpy(), own["cut"].to_numpy(), own["left"].to_numpy() + roots[number], own["path"].to_numpy(), own["size"].to_numpy(), roots, sample, depth)


def nodes_of(spark: SparkSession, forest: Forest) -> DataFrame:
    """The table of nodes of a forest."""
    number = np.searchsorted(forest.roots, np.arange(len(forest.path)), side="right") - 1
    first = forest.roots[number]
    return spark.createDataFrame(pd.DataFrame({"tree": number, "node": np.arange(len(first)) - first, "feature": forest.feature, "cut": forest.cut, "left": forest.left - first, "path": forest.path, "size": forest.size}))


def score_isolation(scaled: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``isolation``, between 0 and 1."""
    shared = scaled.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(matrix_of(x)) if len(x) else np.zeros(0))

    return scaled.withColumn("isolation", score("scaled"))


def attribute_isolation(scaled: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``attribution``: for each feature how much it pushes a row toward anomaly, a Shapley value in path length."""
    shared = scaled.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("array<double>")
    def explain(x: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.attributions(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES)))))

    return scaled.withColumn("attribution", explain("scaled"))


def label_isolation(scored: DataFrame, contamination: float = 0.01, offset: float | None = None) -> tuple[DataFrame, float]:
    """Adds ``isolation_score``, above 0 for the ``contamination`` share of highest isolation, and ``predicted_label``; the offset is also returned, to label later windows by."""
    offset = exact_quantiles(scored, "isolation", (1 - contamination,))[0] if offset is None else offset
    score = F.col("isolation") - F.lit(offset)
    return scored.withColumns({"isolation_score": score, "isolation_threshold": F.lit(0.0), "predicted_label": F.when(score > 0, "anomaly").otherwise("normal")}), offset


def _bucket(c: Column) -> Column:
    return F.least(F.floor(c * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def share_not_above(scores: DataFrame, reference: DataFrame, col: str, name: str = "score_percentile") -> DataFrame:
    """Adds the percentage of reference values not above each row's value, exactly; values lie between 0 and 1.

    Values are ranked within narrow buckets, and the counts of lower buckets, a table of bounded size, are added: no task sees all rows.
    """
    bucket = _bucket
    known = reference.select(F.col(col).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n")).withColumn("_bucket", bucket(F.col("_v")))
    per = known.groupBy("_bucket").agg(F.sum("_n").alias("_in"))
    ordered = Window.orderBy("_bucket")  # at most BUCKETS rows
    below = scores.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_bucket")).join(per, "_bucket", "left")
    below = below.select("_bucket", (F.sum(F.coalesce("_in", F.lit(0))).over(ordered) - F.coalesce("_in", F.lit(0))).alias("_below"), F.sum("_in").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    asked = scores.select(F.col(col).alias("_v")).where("_v is not null").distinct().withColumn("_n", F.lit(0).cast("long")).withColumn("_bucket", bucket(F.col("_v")))
    ranked = known.unionByName(asked).withColumn("_own", F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)))
    placed = ranked.groupBy("_bucket", "_v").agg(F.max("_own").alias("_own")).join(F.broadcast(below), "_bucket")
    share = placed.select("_v", F.try_divide(100.0 * (F.col("_own") + F.col("_below")), F.col("_all")).alias(name))
    return scores.join(share, F.col(col) == F.col("_v"), "left").drop("_v")


def share_table(reference: DataFrame, col: str) -> DataFrame:
    """What `share_by` needs of a reference, in `BUCKETS` rows: how many values lie in lower buckets, and how many of a bucket's own aren't above each of them."""
    known = reference.select(F.col(col).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("v")))
    placed = known.withColumn("upto", F.sum("n").over(Window.partitionBy("bucket").orderBy("v")))
    own = placed.groupBy("bucket").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("v", "upto"))).alias("own"))
    every = reference.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left")
    ordered = Window.orderBy("bucket")  # BUCKETS rows
    total = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")
    return every.select("bucket", (F.sum(F.coalesce("n", F.lit(0))).over(ordered) - F.coalesce("n", F.lit(0))).alias("below"), total, F.coalesce("own", F.array().cast(own.schema["own"].dataType)).alias("own"))


def share_by(scores: DataFrame, table: DataFrame, col: str, name: str = "score_percentile") -> DataFrame:
    """What `share_not_above` adds, for a stream too: each row meets one row of the table that `share_table` made."""
    met = scores.withColumn("bucket", _bucket(F.col(col))).join(table, "bucket")
    last = F.coalesce(F.array_max(F.transform(F.filter("own", lambda s: s["v"] <= F.col(col)), lambda s: s["upto"])), F.lit(0))
    return met.withColumn(name, F.try_divide(100.0 * (last + F.col("below")), F.col("total"))).drop("bucket", "below", "total", "own")


def stratified_sample(rows: DataFrame, label: str, limit: int, keys: tuple[str, ...], seed: int = 42) -> DataFrame:
    """``limit`` rows, or all if there are fewer: of each label its share, at least two, by a hash of the keys; what is missing or too much is made up over all labels."""
    placed = rows.withColumn("_place", F.conv(F.substring(key_digest(rows, keys, seed), 1, 15), 16, 10).cast("long"))
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())  # one row for each label
    share = counts.withColumn("_want", F.least(F.col("_n"), F.greatest(F.lit(2), F.bround(limit * F.col("_n") / total).cast("long"))))
    known = placed.join(F.broadcast(share.withColumnRenamed(label, "_label")), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    # of each label no more than `limit` rows can be in the sample: these lie among its smallest hashes, so that no label is sorted whole
    known = known.where(F.col("_place") / float(1 << 60) * F.col("_n") <= limit + 8 * limit**0.5 + 8)
    nth = F.row_number().over(Window.partitionBy(label).orderBy("_place", *keys))
    ranked = known.withColumn("_nth", nth).where(F.col("_nth") <= limit)
    first = F.when(F.col("_nth") <= F.least(F.lit(2), "_want"), 2).when(F.col("_nth") <= F.col("_want"), 1).otherwise(0)
    return ranked.withColumn("_first", first).orderBy(F.desc("_first"), "_place", *keys).limit(limit).drop("_place", "_n", "_want", "_nth", "_first")


def fit_plane(scaled: DataFrame, keys: tuple[str, ...] = ("window_start", "src_ip")) -> tuple[np.ndarray, np.ndarray]:
    """Two principal components, fitted on all rows, and the variance they explain. The largest entry of each is positive. No rows are drawn, so ``keys`` don't matter."""
    model = PCA(k=2, inputCol="v", outputCol="p").fit(scaled.select(array_to_vector("scaled").alias("v")))
    axes = model.pc.toArray()
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]]), model.explainedVariance.toArray()


def project_plane(scaled: DataFrame, axes: np.ndarray) -> DataFrame:
    """Adds ``pca_1`` and ``pca_2``, in expressions."""
    of = lambda k: F.aggregate(F.zip_with("scaled", F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return scaled.withColumns({"pca_1": of(0), "pca_2": of(1)})


def contour(plane: DataFrame, axes: np.ndarray, forest: Forest, offset: float, size: int = 70) -> DataFrame:
    """``pca_1, pca_2, anomaly_score, is_anomaly`` on a grid of ``size`` by ``size`` points over the middle 98 in 100 of each axis and a tenth more on either side, brought back from the plane to features and scored by the forest."""
    ends = []
    for name in ("pca_1", "pca_2"):
        low, high = exact_quantiles(plane, name, (0.01, 0.99))
        if low is None:
            return plane.select("pca_1", "pca_2", F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly")).limit(0)
        pad = max((high - low) * 0.1, 1e-6)
        ends.append((low - pad, (high - low + 2 * pad) / (size - 1)))
    k = F.col("id")
    points = plane.sparkSession.range(size * size).select((F.lit(ends[0][0]) + (k % size) * ends[0][1]).alias("pca_1"), (F.lit(ends[1][0]) + F.floor(k / size) * ends[1][1]).alias("pca_2"))
    back = points.withColumn("scaled", F.array(*(F.col("pca_1") * float(a) + F.col("pca_2") * float(b) for a, b in axes)))
    score = F.col("isolation") - F.lit(offset)
    return score_isolation(back, forest).select("pca_1", "pca_2", score.alias("anomaly_score"), (score > 0).alias("is_anomaly"))


def silhouette(labelled: DataFrame, label: str, keys: tuple[str, ...] = ("window_start", "src_ip"), limit: int = 5000, seed: int = 42) -> tuple[float | None, int, str | None]:
    """Mean Euclidean silhouette of two groups on a stratified sample of ``limit`` rows, the sample's size, and why it is undefined, if it is.

    The sample, of bounded size, is sent to all tasks; each row's distances to it are taken where the row lies.
    """
    sizes = {r[0]: r.n for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None, 0, "there is one group only"
    if min(sizes.values()) < 2:
        return None, 0, "a group has fewer than two rows"
    drawn = stratified_sample(labelled, label, limit, keys, seed).select(label, "scaled")
    rows = drawn.collect()
    groups = sorted({r[0] for r in rows}, key=str)
    if len(groups) < 2 or min(sum(r[0] == g for r in rows) for g in groups) < 2:
        return None, len(rows), "the sample doesn't hold two groups"
    shared = labelled.sparkSession.sparkContext.broadcast((np.array([r.scaled for r in rows], dtype=float), np.array([groups.index(r[0]) for r in rows])))

    def each(parts):
        x, g = shared.value
        for pdf in parts:
            own = pdf["i"].to_numpy()
            far = np.sqrt(np.maximum(((x[own][:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
            mean = np.stack([far[:, g == k].sum(axis=1) / (np.sum(g == k) - (g[own] == k)).clip(1) for k in range(len(groups))], axis=1)
            a = mean[np.arange(len(own)), g[own]]
            mean[np.arange(len(own)), g[own]] = np.inf
            b = mean.min(axis=1)
            yield pd.DataFrame({"s": np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    spark = labelled.sparkSession
    places = spark.range(len(rows)).repartition(max(1, -(-len(rows) // 250))).withColumnRenamed("id", "i")
    return places.mapInPandas(each, "s double").agg(F.avg("s")).first()[0], len(rows), None
