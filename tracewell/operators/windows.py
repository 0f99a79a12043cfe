"""Windows of a source: 36 features. Distinct values are counted in two steps, so that no row holds all names of a busy source; streams count them by sketches of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dns as D
from tracewell.operators.domains import reasons
from tracewell.operators.events import QTYPES, RCODES
from tracewell.schema import FEATURES

#: Points of a fired rule.
POINTS = {"heuristic_dga": 35, "heuristic_tunnel": 40, "heuristic_fastflux": 30, "heuristic_resolver_failure": 15, "heuristic_rogue_resolver": 25}
DOMAIN_POINTS = 15


#: Distinct values of a stream's window are counted exactly up to 2 to this power, and beyond it with a standard error of one in its root: 1.6 in 100.
SKETCH = 12
#: So many resolvers of a stream's window are known by name, the most used first, and so many are followed for that.
RESOLVERS, FOLLOWED = 100, 1000


def _streamed(events: DataFrame, size: str, sums: dict[str, Column], answers: Column) -> DataFrame:
    """Windows of a stream, of bounded state: three sketches of at most 33 KB each, and the most used resolvers. An event has a row for each of its answers, and counts by the first of them."""
    suspicious = F.size(reasons()) > 0
    rows = events.withColumn("_suspicious", suspicious).select("*", F.posexplode_outer(F.array_distinct(answers)).alias("_place", "_answer"))
    first = F.coalesce(F.col("_place") == 0, F.lit(True))
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "src_ip").agg(
        *(v(first).alias(k) for k, v in sums.items()), F.count_if(first & F.col("_suspicious")).alias("suspicious"),
        F.theta_sketch_agg(F.when(first, F.col("query_clean")), F.lit(SKETCH)).alias("_names"), F.theta_sketch_agg("_answer", F.lit(SKETCH)).alias("_answers"),
        F.theta_sketch_agg("dns_server", F.lit(SKETCH)).alias("_resolvers"), F.expr(f"approx_top_k(dns_server, {RESOLVERS}, {FOLLOWED})").alias("_servers"),
    )
    return grouped.withColumns({
        "window_start": F.col("w.start"), "window_end": F.col("w.end"), "unique_queries": F.theta_sketch_estimate("_names"), "unique_answer_ips": F.theta_sketch_estimate("_answers"),
        "unique_dns_servers": F.theta_sketch_estimate("_resolvers"), "dns_servers": F.sort_array(F.filter(F.transform("_servers", lambda x: x["item"]), lambda x: x.isNotNull())),
    })


def build_windows(events: DataFrame, size: str = "5 minutes", also: tuple[str, ...] = ()) -> DataFrame:
    """``window_start, window_end, src_ip``, the features in their order, and ``dns_servers``, for events with features.

    In batch the sums, which combine before the shuffle, and the distinct names, servers and answers, each value its own key, are two
    aggregations joined on window and source. A row holds the source's resolvers, none its names or answers. A stream's windows are of one aggregation, with distinct values counted up to `SKETCH`; of its columns ``also``
    may name ``w``, the window that later aggregations of the stream need, and ``suspicious``, how many events have a reason to be so.
    """
    own = {
        "avg": [f"{c.lower()}_rate=is_{c.lower()}" for c in (*RCODES, *QTYPES)] + [
            "avg_query_len=query_len", "long_query_rate=is_long_query", "avg_entropy=entropy", "high_entropy_rate=is_high_entropy", "avg_label_count=label_count", "avg_max_label_len=max_label_len", "long_label_rate=is_long_label",
            "digit_ratio_avg=digit_ratio", "hyphen_ratio_avg=hyphen_ratio", "avg_rtt=rtt", "answer_count_avg=answer_count", "ttl_avg=ttl_avg_event", "low_ttl_rate=is_low_ttl"],
        "max": ["max_query_len=query_len", "max_entropy=entropy", "max_label_count=label_count", "max_max_label_len=max_label_len", "max_rtt=rtt", "answer_count_max=answer_count"], "min": ["ttl_min=ttl_min_event"],
    }
    named = {name: (getattr(F, how), column) for how, of in own.items() for name, _, column in (x.partition("=") for x in of)}
    answers = F.filter(F.transform("answers", lambda a: F.trim(a)), lambda a: a != "")
    if events.isStreaming:
        counted_once = {"total_queries": F.count_if} | {k: lambda first, how=how, c=c: how(F.when(first, F.col(c))) for k, (how, c) in named.items()}
        grouped = _streamed(events, size, counted_once, answers)
    else:
        placed = events.withColumn("window_start", F.window("ts", size).getField("start"))
        value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        values = F.concat(F.array(value("name", F.col("query_clean")), value("server", F.col("dns_server"))), F.transform(F.array_distinct(F.coalesce(answers, F.array().cast("array<string>"))), lambda a: value("answer", a)))
        different = placed.select("window_start", "src_ip", F.inline(values)).where("value is not null").distinct()
        of = lambda kind: F.col("kind") == kind
        counted = different.groupBy("window_start", "src_ip").agg(
            F.count_if(of("name")).alias("unique_queries"), F.sort_array(F.collect_list(F.when(of("server"), F.col("value")))).alias("dns_servers"), F.count_if(of("answer")).alias("unique_answer_ips")
        )
        sums = [F.count("*").alias("total_queries"), *(how(c).alias(k) for k, (how, c) in named.items())]
        grouped = placed.groupBy("window_start", "src_ip").agg(*sums).join(counted, ["window_start", "src_ip"]).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {size}"))
    unique = D.safe_ratio(F.col("unique_queries"), F.col("total_queries"))
    grouped = grouped if events.isStreaming else grouped.withColumn("unique_dns_servers", F.size("dns_servers").cast("long"))
    out = grouped.withColumns({"unique_query_ratio": unique, "repeated_query_ratio": 1 - unique})
    return out.select("window_start", "window_end", "src_ip", *FEATURES, "dns_servers", *also)


def evaluate_rules(windows: DataFrame, approved: list[str] | None = None) -> DataFrame:
    """Adds the five rules as booleans and ``rogue_dns_servers``. With a list of approved resolvers any other is rogue, without one three or more are."""
    c = F.col
    busy = c("total_queries") >= 20
    answers = (c("answer_count_avg") >= 3) | (c("answer_count_max") >= 5) | (c("unique_answer_ips") >= 10)
    known = F.array(*map(F.lit, approved or [])).cast("array<string>")
    others = F.array_except("dns_servers", known) if approved else F.when(F.size("dns_servers") >= 3, c("dns_servers")).otherwise(F.array().cast("array<string>"))
    return windows.withColumns({
        "heuristic_dga": busy & (c("unique_query_ratio") >= 0.9) & (c("nxdomain_rate") >= 0.5) & (c("high_entropy_rate") >= 0.5),
        "heuristic_tunnel": busy & ((c("txt_rate") >= 0.4) | (c("long_query_rate") >= 0.4) | (c("long_label_rate") >= 0.3)) & (c("high_entropy_rate") >= 0.4),
        "heuristic_fastflux": (c("total_queries") >= 10) & answers & (c("ttl_min") > 0) & ((c("ttl_min") <= 60) | (c("low_ttl_rate") >= 0.3)),
        "heuristic_resolver_failure": busy & ((c("servfail_rate") >= 0.5) | (c("nxdomain_rate") >= 0.7)),
        "rogue_dns_servers": others, "heuristic_rogue_resolver": F.size(others) > 0,
    })


#: What each rule looks for, and its conditions on a window: all of them must hold, of one with several parts any.
DEFINITIONS = {
    "heuristic_dga": ("Many unique random-looking domains with high NXDOMAIN rate.", ("total_queries >= 20", "unique_query_ratio >= 0.90", "nxdomain_rate >= 0.50", "high_entropy_rate >= 0.50")),
    "heuristic_tunnel": ("Long or high-entropy queries and TXT abuse suggesting DNS tunneling.", ("total_queries >= 20", "txt_rate >= 0.40 OR long_query_rate >= 0.40 OR long_label_rate >= 0.30", "high_entropy_rate >= 0.40")),
    "heuristic_fastflux": ("Many answer IPs with low TTL suggesting fast-flux.", ("total_queries >= 10", "answer_count_avg >= 3 OR answer_count_max >= 5 OR unique_answer_ips >= 10", "ttl_min > 0", "ttl_min <= 60 OR low_ttl_rate >= 0.30")),
    "heuristic_resolver_failure": ("High SERVFAIL or NXDOMAIN rate.", ("total_queries >= 20", "servfail_rate >= 0.50 OR nxdomain_rate >= 0.70")),
    "heuristic_rogue_resolver": ("A host uses an unauthorized DNS resolver.", ()),
}
COMPARISONS = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__, "=": Column.__eq__}


def rule_definitions(spark: SparkSession) -> DataFrame:
    """The rules as a table that can be changed: a row for each part of a condition, ``rule_name, enabled, description, condition, feature, comparison, threshold``; a rule without conditions has one row, of nulls."""
    rows = []
    for name, (said, conditions) in DEFINITIONS.items():
        parts = [(k, *part.split()) for k, condition in enumerate(conditions) for part in condition.split(" OR ")]
        rows += [(name, True, said, k, f, c, float(t)) for k, f, c, t in parts] or [(name, True, said, None, None, None, None)]
    return spark.createDataFrame(rows, "rule_name string, enabled boolean, description string, condition int, feature string, comparison string, threshold double")


def evaluate_definitions(windows: DataFrame, definitions: DataFrame, approved: list[str] | None = None) -> DataFrame:
    """What `evaluate_rules` adds, by the thresholds of a table of definitions, whose rows, a few for each rule, reach the driver. Rules that are off, or that it doesn't have, don't fire; unknown features and comparisons are errors."""
    rows = definitions.collect()
    unknown = {(r.feature, r.comparison) for r in rows if r.feature is not None and (r.feature not in FEATURES or r.comparison not in COMPARISONS)}
    if unknown:
        raise ValueError(f"rules can't be judged by {sorted(unknown, key=str)}")
    judged = evaluate_rules(windows, approved)
    fired = {}
    for name in POINTS:
        own = [r for r in rows if r.rule_name == name]
        test = F.lit(bool(own) and all(r.enabled for r in own))
        for k in sorted({r.condition for r in own if r.condition is not None}):
            any_of = F.lit(False)
            for r in own:
                if r.condition == k:
                    any_of = any_of | COMPARISONS[r.comparison](F.col(r.feature), F.lit(r.threshold))
            test = test & F.coalesce(any_of, F.lit(False))
        fired[name] = test & F.col(name) if name == "heuristic_rogue_resolver" else test
    return judged.withColumns(fired)


def described(alerts: DataFrame, definitions: DataFrame) -> DataFrame:
    """A row for each rule that fired of an alert, with its description."""
    said = definitions.groupBy("rule_name").agg(F.first("description", ignorenulls=True).alias("description"))
    return alerts.select("*", F.explode("heuristics_fired").alias("rule_name")).join(F.broadcast(said), "rule_name", "left")  # a row for each rule


def rule_score(has_domains: Column | None = None) -> Column:
    """Points of the fired rules, and of suspicious domains, at most 100."""
    points = sum((F.when(F.col(k), v).otherwise(0) for k, v in POINTS.items()), F.lit(0))
    return F.least(F.lit(100), points + (F.when(has_domains, DOMAIN_POINTS).otherwise(0) if has_domains is not None else 0))


def fired_rules() -> Column:
    """The names of a judged window's fired rules, in order."""
    return F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in sorted(POINTS))))


def rule_id() -> Column:
    return D.stable_id("HEUR-", F.lit("heuristics"), D.iso_time(F.col("window_start")), F.col("src_ip"), F.array_join("heuristics_fired", "|"))


def rule_alerts(judged: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """One row for each window in which a rule fired: fired rules, score, severity and a stable id. ``domains`` are the windows' suspicious domains; windows that count their ``suspicious`` events themselves don't need them."""
    alerts = judged.withColumn("heuristics_fired", fired_rules()).where(F.size("heuristics_fired") > 0)
    if "suspicious" in judged.columns:
        alerts = alerts.withColumnRenamed("suspicious", "n_domains")
    elif domains is not None:
        own = domains.groupBy("window_start", "src_ip").agg(F.count("*").alias("n_domains"))
        alerts = alerts.join(own, ["window_start", "src_ip"], "left")
    else:
        alerts = alerts.withColumn("n_domains", F.lit(0).cast("long"))
    alerts = alerts.withColumn("n_domains", F.coalesce("n_domains", F.lit(0))).withColumn("threat_score", rule_score(F.col("n_domains") > 0))
    return alerts.withColumns({"severity": D.severity_rules(F.col("threat_score")), "id": rule_id()})
