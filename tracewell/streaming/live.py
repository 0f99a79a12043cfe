"""The batch transforms on a stream: windows close when the watermark passes them, all detectors see the same windows, and alerts are written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions import dns as D
from tracewell.operators import alerts as A
from tracewell.operators import correlation, detectors, models
from tracewell.operators.domains import context_domains, suspicious_domains
from tracewell.operators.events import add_features
from tracewell.operators.windows import build_windows, evaluate_rules, fired_rules, rule_alerts, rule_id, rule_score
from tracewell.sources.scratch import discard, written

#: What makes two records of a stream one event. Without a uid the time, the type and the answer's code still tell events apart.
SAME_EVENT = ["uid", "ts", "src_ip", "dns_server", "query", "qtype_name", "rcode_name"]

#: Columns of windows besides their features: how many events are suspicious; and the window itself, for an aggregation behind.
COUNTED, CHAINED = ("suspicious",), ("suspicious", "w")


def landed(spark: SparkSession, path: str, schema, glob: str = "*") -> DataFrame:
    """A stream of the JSON-line files that land in a folder; the checkpoint remembers which were read. A growing file isn't read twice: land closed segments."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).json(path)


def once(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """A stream without the events that come later than ``late``, and with repeated ones within it once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(SAME_EVENT)


def live_windows(events: DataFrame, size: str = "5 minutes", late: str = "5 minutes", also: tuple[str, ...] = ()) -> DataFrame:
    """Windows of a stream of events; events later than ``late`` are dropped, and repeated ones within it count once. ``also`` may name `COUNTED`, or `CHAINED` for windows that are aggregated again."""
    return build_windows(add_features(once(events, late)), size, also)


def correlated(windows: DataFrame, model: models.Fitted, shares: DataFrame, config: correlation.Config, approved: list[str] | None = None) -> DataFrame:
    """Correlated windows of a stream of chained windows: a second aggregation behind the windows' own, whose rows come out when the watermark has passed both.

    Each window is scored once, by all detectors, and is a row of evidence for each that has an alert of it. ``shares`` is the table that `detectors.share_table` makes of the model's reference.
    Rows are those that `correlation.correlate` gives for the alerts that `detect` makes of the same windows.
    """
    judged = evaluate_rules(detectors.score_reconstruction(model.scale(windows), model.components), approved)
    isolated, _ = detectors.label_isolation(detectors.score_isolation(judged, model.forest), offset=model.offset)
    scored = detectors.flagged(detectors.share_by(isolated, shares, "isolation"), model.threshold)
    scored = scored.withColumns({"threshold_ratio": F.round("threshold_ratio", 6), "heuristics_fired": fired_rules()})
    points = rule_score(F.col("suspicious") > 0)
    share = F.coalesce("score_percentile", D.isolation_points(F.col("score_percentile"), F.col("isolation_score")).cast("double"), F.lit(0.0))
    has = (F.col("predicted_label") == "anomaly", F.col("anomaly"), F.size("heuristics_fired") > 0)
    ids = (A.alert_id("isolation"), A.alert_id("reconstruction"), rule_id())
    told = [F.when(test, F.struct(F.lit(n).alias("family"), i.alias("id"), e.alias("evidence"))) for n, test, i, e in zip(correlation.FAMILIES, has, ids, correlation.gated(config, rules=points, share=share), strict=True)]
    rows = scored.select(F.window_time("w").alias("at"), "src_ip", F.explode(F.array_compact(F.array(*told))).alias("e")).select("at", "src_ip", "e.*")
    return correlation.correlate(rows, config)


def start_final(windows: DataFrame, model: models.Fitted, path: str, checkpoint: str, config: correlation.Config, approved: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Final alerts of a stream of chained windows, appended as files, each once by the stream's own commits; in one plan, with no batch function."""
    shares = written(detectors.share_table(model.reference, "isolation"), "shares")
    made = A.final_rows(correlated(windows, model, shares, config, approved), config)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_new(batch: DataFrame, path: str) -> None:
    """Append the rows whose id isn't stored yet, one for each id. The table is partitioned by the window's day, and only the batch's days of it are read."""
    spark, new = batch.sparkSession, batch.dropDuplicates(["id"]).withColumn("window_day", F.to_date("window_start"))
    try:
        table = spark.read.schema("id string, window_day date").parquet(path)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        low, high = new.agg(F.min("window_day"), F.max("window_day")).first()
        new = new.join(table.where(F.col("window_day").between(low, high)).select("id"), "id", "left_anti")
    new.write.mode("append").partitionBy("window_day").parquet(path)


def _start(windows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    """One pass over what is there, or, with ``every``, a pass each such time until the query is stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_rules(windows: DataFrame, path: str, checkpoint: str, approved: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Score finished windows by the rules and append new alerts, once over what is there."""
    write = lambda batch, _: append_new(rule_alerts(evaluate_rules(batch, approved)).withColumn("scored", F.lit(True)), path)
    return _start(windows, write, checkpoint, every)


def detect(windows: DataFrame, events: DataFrame, model: models.Fitted, size: str = "5 minutes", approved: list[str] | None = None, mode: str = "full-log", config: correlation.Config | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Alerts of ``isolation``, ``reconstruction`` and ``rules``, and the ``final`` ones, of a batch of windows; ``events``, with features, are theirs. On all windows of a log it is a replay.

    ``keep`` may write a table that is read more than once: scores, domains, and the alerts that the final ones are made of.
    """
    rebuilt, isolated = models.score(windows, model, mode)
    found = keep(suspicious_domains(events, size))
    context = context_domains(events, found, size)
    own = {
        "isolation": A.isolation_alerts(isolated, found, context, size, mode), "reconstruction": A.reconstruction_alerts(rebuilt, found, size, mode),
        "rules": A.rule_alerts(evaluate_rules(windows, approved), found, size, mode),
    }
    own = {name: keep(made) for name, made in own.items()}
    config = config or correlation.Config(window=size)
    own["final"] = A.final_alerts(correlation.correlate(correlation.evidence(own["isolation"], own["reconstruction"], own["rules"], config), config), config)
    return own


def start_detectors(windows: DataFrame, events: DataFrame, model: models.Fitted, root: str, checkpoint: str, size: str = "5 minutes", approved: list[str] | None = None, config: correlation.Config | None = None, every: str | None = None) -> StreamingQuery:
    """All detectors on each batch of finished windows, and then their correlation; four tables below ``root``, to which new alerts are appended.

    ``events`` is the static table of landed events, from which a batch's domains are listed, by the time of its windows and, if it is partitioned by one, its ``event_day``. Repeated events count once there as in the
    windows. The own count of suspicious events of `COUNTED` windows decides scores, so that what came too late for a window is at most listed. Each detector runs once a batch: its alerts are written, and the final ones are made of what was
    written. A batch that is run again writes no alert twice, and the final alerts are correlated only after all detectors' alerts are written.
    """

    def write(batch: DataFrame, _: int) -> None:
        kept: list[DataFrame] = []
        keep = lambda df: kept.append(written(df, "batch")) or kept[-1]
        own = keep(batch)
        low, high = own.agg(F.min("window_start"), F.max("window_end")).first()
        if low is not None:
            near = events.where(F.col("event_day").between(low.date(), high.date())) if "event_day" in events.columns else events
            seen = near.where((F.col("ts") >= low) & (F.col("ts") < high)).dropDuplicates(SAME_EVENT)
            made = detect(own, add_features(seen), model, size, approved, "incremental", config, keep)
            for name in ("isolation", "reconstruction", "rules", "final"):
                append_new(made[name], f"{root}/{name}")
        discard(*kept)

    return _start(windows, write, checkpoint, every)
