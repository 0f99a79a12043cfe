"""Checks that stand before training and after merging. Each is one aggregate row with a verdict and its reason; `require` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import dns as D

#: The fewest windows to train on, the years that times may lie in, the longest span in days.
LEAST_WINDOWS, FIRST_YEAR, LAST_YEAR, MOST_DAYS = 50, 2000, 2100, 3660
#: Required columns of a record, and other names of time and source in the order of preference.
REQUIRED = ("ts", "id.orig_h", "id.resp_h", "query", "qtype_name", "rcode_name", "rtt", "answers", "TTLs")


def with_required(records: DataFrame) -> DataFrame:
    """Adds the required columns that are missing, as null text."""
    return records.withColumns({c: F.lit(None).cast("string") for c in REQUIRED if c not in records.columns}) if set(REQUIRED) - set(records.columns) else records


def with_aliases(records: DataFrame, times: list[str], sources: list[str]) -> DataFrame:
    """``ts`` and ``src_ip`` from the first column of each list that isn't null; rows with a blank source go."""
    def first(names: list[str]) -> Column:
        have = [F.col(f"`{c}`").cast("string") for c in names if c in records.columns]
        if not have:
            raise ValueError(f"none of {names} is a column")
        return F.coalesce(*have)

    ts, src = first(times), F.trim(first(sources))
    return records.withColumns({"ts": ts, "src_ip": src}).where("src_ip != ''")


def _in_bounds(ts: Column) -> Column:
    return F.coalesce(F.year(ts).between(FIRST_YEAR, LAST_YEAR - 1), F.lit(False))


def recovered(events: DataFrame, raw: str = "ts_raw") -> DataFrame:
    """The events with times out of bounds read anew from the raw text, where that gives one; `time_gate` rejects what is left."""
    return events.withColumn("ts", F.when(_in_bounds(F.col("ts")), F.col("ts")).otherwise(D.parse_time(F.col(raw).cast("string"))))


def time_gate(events: DataFrame) -> DataFrame:
    """Whether all times lie in the bounds, and within the longest span."""
    found = events.agg(F.count("*").alias("records"), F.count_if(~_in_bounds(F.col("ts"))).alias("invalid"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    days = (F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 86400
    return _verdict(found.withColumn("span_days", days), (("no records", F.col("records") > 0), ("times out of bounds", F.col("invalid") == 0), ("span too long", F.col("span_days") <= MOST_DAYS)))


def training_gate(windows: DataFrame, features: list[str], least: int = LEAST_WINDOWS) -> DataFrame:
    """Whether there are enough windows, none without time or source, and all features are numbers."""
    missing = [f for f in features if f not in windows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    blank = F.col("window_start").isNull() | (F.trim(F.coalesce("src_ip", F.lit(""))) == "")
    bad = F.lit(False)
    for f in features:
        x = F.col(f).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = windows.agg(F.count("*").alias("windows"), F.countDistinct("src_ip").alias("sources"), F.count_if(blank).alias("blank_keys"), F.count_if(bad).alias("bad_rows"))
    return _verdict(found, ((f"fewer than {least} windows", F.col("windows") >= least), ("windows without time or source", F.col("blank_keys") == 0), ("features that are no numbers", F.col("bad_rows") == 0)))


def merge_counters(records: DataFrame, valid: str, fingerprint: str, file: str) -> DataFrame:
    """Lines, valid ones, different ones, duplicates, invalid ones and files of parsed records."""
    kinds = records.where(F.col(valid)).groupBy(fingerprint).agg(F.count("*").alias("n")).agg(F.count("*").alias("inserted"), F.coalesce(F.sum("n"), F.lit(0)).alias("usable"))
    lines = records.agg(F.count("*").alias("lines_read"), F.countDistinct(file).alias("files_processed"))
    return lines.join(F.broadcast(kinds)).select("lines_read", "files_processed", "inserted", (F.col("usable") - F.col("inserted")).alias("duplicates"), (F.col("lines_read") - F.col("usable")).alias("invalid"))


def merge_gate(counters: DataFrame, staged: int, discovered: int) -> DataFrame:
    """Whether every staged file was found and read, and only usable records were in them."""
    staged, discovered = F.lit(staged), F.lit(discovered)
    return _verdict(counters, (
        ("no staged files", staged > 0), ("not all staged files were discovered", discovered == staged), ("not all files were processed", F.col("files_processed") == discovered),
        ("no usable records", F.col("inserted") > 0), ("invalid records", F.col("invalid") == 0),
    ))


def _verdict(found: DataFrame, tests: tuple[tuple[str, Column], ...]) -> DataFrame:
    """Adds ``passed`` and ``reason``, the first test that fails; an unknown outcome fails."""
    failed = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests))
    return found.withColumn("reason", failed).withColumn("passed", F.col("reason").isNull())


def require(gate: DataFrame) -> None:
    """Raises where a gate doesn't pass."""
    row = gate.first()
    if not row.passed:
        raise ValueError(f"{row.reason}: {row.asDict()}")


def repaired(windows: DataFrame, features: list[str]) -> DataFrame:
    """The windows with 0 for features that are null, NaN, infinite or no numbers; a missing feature is an error."""
    missing = [f for f in features if f not in windows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    x = {f: F.col(f).try_cast("double") for f in features}
    return windows.withColumns({f: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v) for f, v in x.items()})


def sample_gate(records: DataFrame, n: int = 2000) -> DataFrame:
    """Whether the first ``n`` records have a time and a source, and all times parse and lie in the bounds. Records have text columns ``ts`` and ``src_ip``."""
    part = records.limit(n).select(D.parse_time(F.col("ts")).alias("t"), F.trim(F.coalesce("src_ip", F.lit(""))).alias("s"))
    found = part.agg(F.count("*").alias("records"), F.count_if(F.col("s") == "").alias("without_source"), F.count_if(~_in_bounds(F.col("t"))).alias("invalid"))
    return _verdict(found, (("no records", F.col("records") > 0), ("records without a source", F.col("without_source") == 0), ("times out of bounds", F.col("invalid") == 0)))
