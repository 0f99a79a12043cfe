"""Fitted detectors as tables: published under a version, and loaded only for the features they were fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import detectors, views
from tracewell.operators.reports import scaler
from tracewell.schema import FEATURES
from tracewell.sources.scratch import written


@dataclass
class Fitted:
    """Scaling, components and threshold of the reconstruction, forest and offset of the isolation, and how often the windows it was fitted on had each isolation."""

    scaling: DataFrame
    components: np.ndarray
    threshold: float
    forest: detectors.Forest
    offset: float
    reference: DataFrame

    def scale(self, windows: DataFrame) -> DataFrame:
        return detectors.scale_by(windows, self.scaling)


def fit(windows: DataFrame, k: int = 12, trees: int = 300, contamination: float = 0.01, chosen: float = 0.99) -> Fitted:
    """Both learned detectors on a table of windows."""
    scaling = scaler(windows, FEATURES)
    scaled = detectors.scale_by(windows, scaling)
    components = detectors.fit_reconstruction(scaled, k)
    threshold = detectors.exact_quantiles(detectors.score_reconstruction(scaled, components), "reconstruction_error", (chosen,))[0]
    forest = detectors.fit_isolation(scaled, trees=trees)
    if forest is None:
        raise ValueError("there are no windows to fit on")
    scores = written(detectors.score_isolation(scaled, forest).select("isolation"), "isolation")
    _, offset = detectors.label_isolation(scores, contamination)
    return Fitted(scaling, components, threshold, forest, offset, scores)


def publish(model: Fitted, root: str, version: str) -> None:
    """Writes the tables of a version below ``root``; earlier versions stay, one that exists is refused, and the version counts once its ``config`` is there, which is written last. What a failed attempt left is replaced."""
    spark, to = model.scaling.sparkSession, f"{root}/{version}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/config/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"version {version} exists below {root}")
    if model.components.shape[0] != len(FEATURES):
        raise ValueError(f"the model has {model.components.shape[0]} features, not {len(FEATURES)}")
    model.scaling.write.mode("overwrite").parquet(f"{to}/scaling")
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(model.components)], "place int, component array<double>").write.mode("overwrite").parquet(f"{to}/components")
    detectors.nodes_of(spark, model.forest).write.mode("overwrite").parquet(f"{to}/forest")
    model.reference.write.mode("overwrite").parquet(f"{to}/reference")
    config = spark.createDataFrame([(FEATURES, model.threshold, model.offset, model.forest.sample, model.forest.depth)], "features array<string>, threshold double, offset double, sample int, depth int")
    config.write.mode("overwrite").parquet(f"{to}/config")


def load(spark: SparkSession, root: str, version: str) -> Fitted:
    """A published version; an error if its features aren't `FEATURES` in their order."""
    at = f"{root}/{version}"
    config = spark.read.parquet(f"{at}/config").first()
    if list(config.features) != FEATURES:
        raise ValueError("the model was fitted on other features, or in another order")
    rows = spark.read.parquet(f"{at}/components").orderBy("place").collect()  # a row for each feature
    if len(rows) != len(FEATURES):
        raise ValueError(f"the model has {len(rows)} rows of components, not {len(FEATURES)}")
    forest = detectors.forest_of(spark.read.parquet(f"{at}/forest"), config["sample"], config["depth"])
    return Fitted(spark.read.parquet(f"{at}/scaling"), np.array([list(r.component) for r in rows], dtype=float).reshape(len(rows), -1), config.threshold, forest, config.offset, spark.read.parquet(f"{at}/reference"))


def score(windows: DataFrame, model: Fitted, mode: str = "full-log", explain: bool = True) -> tuple[DataFrame, DataFrame]:
    """Windows scored by the reconstruction and by the isolation, each flagged or labelled, as their alerts need it."""
    scaled = model.scale(windows)
    rebuilt = detectors.flagged(detectors.score_reconstruction(scaled, model.components), model.threshold, mode)
    isolated, _ = detectors.label_isolation(detectors.score_isolation(scaled, model.forest), offset=model.offset)
    isolated = detectors.share_not_above(isolated, model.reference, "isolation")
    if explain:  # only anomalies have an attribution
        odd = detectors.attribute_isolation(isolated.where("predicted_label = 'anomaly'"), model.forest)
        isolated = isolated.where("predicted_label != 'anomaly'").withColumn("attribution", F.lit(None).cast("array<double>")).unionByName(odd)
    return rebuilt, isolated


def artifacts(windows: DataFrame, model: Fitted, grid: int = 70) -> dict[str, DataFrame]:
    """The tables that are shown beside a model: ``scores`` of its windows, ``errors`` by training and validation, ``plane`` and the ``contour`` of the decision on it, ``attributions`` of the anomalies and the ``dependency`` of the strongest feature."""
    rebuilt, isolated = score(windows, model)
    scaled = model.scale(windows)
    axes, _ = detectors.fit_plane(scaled)
    plane = detectors.project_plane(scaled, axes).select("window_start", "src_ip", "pca_1", "pca_2")
    explained = views.attribution_values(isolated.where("predicted_label = 'anomaly'"))
    return {
        "scores": isolated.select("window_start", "src_ip", "isolation", "isolation_score", "score_percentile", "predicted_label"), "errors": rebuilt.select("window_start", "src_ip", "reconstruction_error", "threshold_ratio", detectors.split(rebuilt).alias("split")),
        "plane": plane, "contour": detectors.contour(plane, axes, model.forest, model.offset, grid), "attributions": explained, "dependency": views.dependency(explained),
    }


def publish_artifacts(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes the tables beside a version's own."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{version}/artifacts/{name}")
