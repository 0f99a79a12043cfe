"""Column helpers for names, lists, times, scores and identifiers. Each takes and returns columns, so that they compose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_domain(name: Column) -> Column:
    """Without white space at the ends, in lower case, without one trailing dot; null is empty."""
    bare = F.regexp_replace(F.coalesce(name.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(bare), r"\.$", "")


def strip_dots(name: Column) -> Column:
    """As `clean_domain`, without all trailing dots: the dashboards' variant."""
    return F.regexp_replace(clean_domain(name), r"\.+$", "")


def shannon_entropy(text: Column, n: Column | None = None) -> Column:
    """Base-2 entropy over characters; 0 for empty and null. Characters are counted by what taking them out leaves, so the text is split once, and each is counted once. ``n`` may give the text's length as a column."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text) if n is None else n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 if b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def labels(name: Column) -> Column:
    """Labels between dots, empty ones too; none of an empty name."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(name, r"\."))


def max_label_len(name: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(labels(name), lambda x: F.length(x))), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def normalize_list(value: Column) -> Column:
    """A JSON list, a comma-separated text, a scalar or null as an array of trimmed, non-empty strings."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    items = F.coalesce(parsed, F.split(text, r"\s*,\s*"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin("", "-", "(empty)"))


def numbers(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))


def list_avg(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(0.0))


def list_min(items: Column) -> Column:
    return F.coalesce(F.array_min(items).cast("double"), F.lit(0.0))


def parse_time(value: Column) -> Column:
    """A timestamp from epoch s, ms, us or ns, told apart by magnitude, or from ISO text; null if neither."""
    number = value.try_cast("double")
    size = F.abs(number)
    micros = F.when(size >= 1e17, number / 1000).when(size >= 1e14, number).when(size >= 1e11, number * 1000).otherwise(number * 1e6)
    return F.coalesce(F.timestamp_micros(F.round(micros).try_cast("bigint")), F.try_to_timestamp(value))


def to_bool(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 20 upper-case hex digits of the SHA-256 of the parts, joined by bars."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def banded(value: Column, bands: tuple[tuple[float, str], ...], below: str) -> Column:
    """The name of the first band whose lower bound the value reaches."""
    out = None
    for bound, name in bands:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(below)


def severity_rules(score: Column) -> Column:
    return banded(score, ((90, "critical"), (70, "high"), (40, "medium")), "low")


def severity_final(score: Column) -> Column:
    return banded(score, ((90, "critical"), (75, "high"), (60, "medium")), "low")


def severity_reconstruction(ratio: Column) -> Column:
    return banded(ratio, ((2.0, "high"), (1.5, "medium")), "low")


def severity_isolation(percentile: Column) -> Column:
    return banded(percentile, ((99.9, "critical"), (99.0, "high"), (97.5, "medium")), "low")


def isolation_points(percentile: Column, score: Column) -> Column:
    """The percentile as a whole number, half to even; without one 50 and more, as the score lies above 0."""
    within = lambda low, x: F.greatest(F.lit(low), F.least(F.lit(100.0), x))
    return F.bround(F.when(percentile.isNotNull(), within(0.0, percentile)).otherwise(within(50.0, 50 + 250 * F.greatest(F.lit(0.0), score)))).cast("int")


def severity_isolation_alert(percentile: Column, score: Column) -> Column:
    """By the percentile; without one high from 75 points on, else medium."""
    return F.when(percentile.isNotNull(), severity_isolation(percentile)).when(isolation_points(percentile, score) >= 75, "high").otherwise("medium")


def severity_store(score: Column, existing: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").when(score >= 25, "low").otherwise(existing)


def reconstruction_quality(loss: Column) -> Column:
    return F.bround(100.0 / (1.0 + F.greatest(loss, F.lit(0.0))), 4)


#: What a fired rule may mean, for rule alerts and for alerts of the reconstruction.
RULE_CAUSES = {
    "heuristic_dga": "DGA-like domain generation or malware domain discovery",
    "heuristic_tunnel": "DNS tunneling, command-and-control, or DNS exfiltration",
    "heuristic_fastflux": "Fast-flux infrastructure or legitimate CDN behavior requiring validation",
    "heuristic_resolver_failure": "Dead domains, blocked domains, resolver failure, or DNS misconfiguration",
    "heuristic_rogue_resolver": "Unauthorized DNS resolver or incorrect endpoint DNS settings",
}
OTHER_RULE_CAUSES = RULE_CAUSES | {
    "heuristic_resolver_failure": "Dead C2 domains, blocked domains, resolver failure, or DNS misconfiguration",
    "heuristic_rogue_resolver": "Unauthorized external DNS resolver, DoT, or incorrect endpoint DNS settings",
}
BASELINE_CAUSE = "Behavior differs from the learned normal DNS baseline"
#: What unusual features may mean, and what is said if none of them is among the strongest.
FEATURE_CAUSES = (
    (("avg_entropy", "max_entropy", "high_entropy_rate", "avg_query_len", "max_query_len", "long_query_rate", "long_label_rate"), "Unusual domain length, label structure, or entropy compared with the learned DNS baseline."),
    (("nxdomain_rate", "servfail_rate", "noerror_rate"), "Unusual DNS response-code behavior compared with the learned baseline."),
    (("txt_rate", "mx_rate", "ptr_rate", "srv_rate"), "Unusual DNS record-type mix compared with the learned baseline."),
    (("unique_dns_servers", "avg_rtt", "max_rtt"), "Resolver-selection or DNS response-time behavior differs from the learned baseline."),
    (("ttl_avg", "ttl_min", "low_ttl_rate", "unique_answer_ips", "answer_count_avg", "answer_count_max"), "DNS answer, TTL, or returned-IP behavior differs from the learned baseline."),
    (("total_queries", "unique_queries", "unique_query_ratio", "repeated_query_ratio"), "DNS query volume or repetition pattern differs from the learned baseline."),
)
WINDOW_CAUSE = "The complete 36-feature DNS window is isolated from the learned baseline."


def rule_causes(fired: Column) -> Column:
    """Sentences for an array of fired rules, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(F.array_contains(fired, k), F.lit(v)) for k, v in RULE_CAUSES.items())))


def reconstruction_causes(methods: Column) -> Column:
    """Sentences for a map of flags; the learned baseline is named where the reconstruction alone speaks."""
    on = lambda k: F.coalesce(F.try_element_at(methods, F.lit(k)), F.lit(False))
    rules = F.array_compact(F.array(*(F.when(on(k), F.lit(v)) for k, v in OTHER_RULE_CAUSES.items())))
    return F.when((F.size(rules) == 0) & on("autoencoder"), F.array(F.lit(BASELINE_CAUSE))).otherwise(rules)


def feature_causes(names: Column) -> Column:
    """Sentences for the strongest features of a window, by the groups that they belong to."""
    found = F.array_compact(F.array(*(F.when(F.arrays_overlap(names, F.array(*map(F.lit, group))), F.lit(said)) for group, said in FEATURE_CAUSES)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(WINDOW_CAUSE)))


def enabled_methods(methods: Column) -> Column:
    """The enabled flags of a JSON object of flags as text; ``none`` if there is none or it isn't an object."""
    parsed = F.from_json(methods, "map<string,boolean>")
    names = F.sort_array(F.map_keys(F.map_filter(parsed, lambda _, on: F.coalesce(on, F.lit(False)))))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(names, ", ")).otherwise("none")


def ids_text(ids: Column) -> Column:
    """An array of alert ids as text, without blank ones."""
    return F.array_join(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), ", ")


def ids_count(ids: Column) -> Column:
    return F.size(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))


def family_ids_text(ids: Column, families: tuple[str, ...]) -> Column:
    """A map from family to alert id as ``family: id``, in the order of ``families``, blank ones left out."""
    each = (F.when(F.trim(F.try_element_at(ids, F.lit(f))) != "", F.concat(F.lit(f"{f}: "), F.try_element_at(ids, F.lit(f)))) for f in families)
    return F.array_join(F.array_compact(F.array(*each)), " | ")


def duration_text(minutes: Column) -> Column:
    """Minutes as ``min`` below one hour, ``h`` below two days, else ``days``; null and negative ones are 0."""
    m = F.greatest(F.coalesce(minutes.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(m < 60, F.concat(F.format_number(F.bround(m), 0), F.lit(" min"))).when(m < 2880, F.concat(F.format_number(m / 60, 2), F.lit(" h"))).otherwise(F.concat(F.format_number(m / 1440, 2), F.lit(" days")))


def readable_time(seconds: Column) -> Column:
    """Epoch seconds as text in UTC, for a session in that zone."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def alert_fingerprint(ts: Column, src_ip: Column, alert_type: Column, model_name: Column) -> Column:
    """SHA-256 over time, source, type and model of an alert; missing ones are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (ts, src_ip, alert_type, model_name))), 256)
