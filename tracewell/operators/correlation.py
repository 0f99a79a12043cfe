"""Final alerts: what several detectors say about one source and window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import dns as D

FAMILIES = ("isolation", "reconstruction", "rules")


@dataclass(frozen=True)
class Config:
    """Gates, weights and limits. Fixed values are the defaults; out-of-range ones are clamped."""

    weights: tuple[float, float, float] = (30, 30, 40)
    min_percentile: float = 95
    min_isolation: float = 0
    min_ratio: float = 1.2
    min_rules: float = 40
    min_detectors: int = 2
    min_score: float = 65
    bonus_two: float = 15
    bonus_three: float = 25
    window: str = "5 minutes"

    def shares(self) -> list[float]:
        held = [max(0.0, float(w)) for w in self.weights]
        if not sum(held):
            raise ValueError("all weights are 0")
        return [w / sum(held) for w in held]


def _clamp(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def evidence(isolation: DataFrame, reconstruction: DataFrame, rules: DataFrame, config: Config = Config()) -> DataFrame:
    """``family, src_ip, window_start, id, evidence`` of every detector alert, null where the alert doesn't pass its gate.

    Isolation alerts have ``isolation_score, score_percentile, threat_score``, reconstruction alerts ``threshold_ratio``, rule alerts ``threat_score``.
    """
    window = F.window("window_start", config.window).getField("start").alias("window_start")
    kept = [df.select(F.lit(n).alias("family"), "src_ip", window, "id", e.alias("evidence")) for n, df, e in zip(FAMILIES, (isolation, reconstruction, rules), gated(config), strict=True)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def gated(config: Config, isolation: Column | None = None, rules: Column | None = None, share: Column | None = None) -> tuple[Column, Column, Column]:
    """The evidence of an alert of each family, null where it doesn't pass: of isolation by its percentile, of reconstruction by its ratio, of rules by their points."""
    share = F.coalesce("score_percentile", F.col("threat_score").cast("double"), F.lit(0.0)) if share is None else share
    iso = F.when(((F.col("isolation_score") if isolation is None else isolation) >= config.min_isolation) & (share >= config.min_percentile), _clamp(share))
    ratio = F.col("threshold_ratio")
    rec = F.when(ratio >= max(1.0, config.min_ratio), _clamp(50 + 25 * (ratio - 1)))
    points = (F.col("threat_score") if rules is None else rules).cast("double")
    return iso, rec, F.when(points >= config.min_rules, _clamp(points))


def correlate(found: DataFrame, config: Config = Config()) -> DataFrame:
    """One row for each source and window: the best alert of each family, how many are active, score, and ``outcome``.

    The outcome is ``alert``, ``suppressed_consensus`` (too few detectors) or ``suppressed_score``; the first is tested first.
    One shuffle, with partial aggregation, instead of outer joins. Of a stream of evidence, which has its time as ``at``, windows come out when the watermark passes them.
    """
    best = lambda n: F.max(F.when((F.col("family") == n) & F.col("evidence").isNotNull(), F.struct("evidence", "id"))).alias(n)
    if found.isStreaming:
        grouped = found.groupBy("src_ip", F.window("at", config.window).alias("w")).agg(*map(best, FAMILIES)).withColumn("window_start", F.col("w.start"))
    else:
        grouped = found.groupBy("src_ip", "window_start").agg(*map(best, FAMILIES))
    point = {n: F.coalesce(F.col(f"{n}.evidence"), F.lit(0.0)) for n in FAMILIES}
    active = sum((F.col(n).isNotNull().cast("int") for n in FAMILIES), F.lit(0))
    base = sum((p * w for p, w in zip(point.values(), config.shares(), strict=True)), F.lit(0.0))
    bonus = F.when(F.col("active") >= 3, config.bonus_three).when(F.col("active") == 2, config.bonus_two).otherwise(0.0)
    least = min(3, max(1, config.min_detectors))
    scored = grouped.withColumns({"active": active, "base": base}).withColumn("threat_score", F.round(_clamp(F.col("base") + bonus), 6))
    outcome = F.when(F.col("active") < least, "suppressed_consensus").when(F.col("threat_score") < config.min_score, "suppressed_score").otherwise("alert")
    ids = F.array_compact(F.array(*(F.col(f"{n}.id") for n in FAMILIES)))
    return scored.select(
        D.stable_id("FINAL-", F.lit("final-correlation"), F.col("src_ip"), D.iso_time(F.col("window_start"))).alias("id"), "src_ip", "window_start", *(p.alias(f"{n}_evidence") for n, p in point.items()),
        ids.alias("contributing_ids"), "active", "base", "threat_score", D.severity_final(F.col("threat_score")).alias("severity"), outcome.alias("outcome"),
    )


def run_statistics(correlated: DataFrame) -> DataFrame:
    """Counters of a correlation run, before suppressed rows are left out."""
    n = lambda test, name: F.count_if(test).alias(name)
    o = F.col("outcome")
    return correlated.agg(
        F.count("*").alias("windows"), n(F.col("active") == 2, "two_detectors"), n(F.col("active") == 3, "three_detectors"),
        n(o == "suppressed_consensus", "suppressed_consensus"), n(o == "suppressed_score", "suppressed_score"), n(o == "alert", "final_alerts"),
    )
