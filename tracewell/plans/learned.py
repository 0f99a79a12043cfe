"""Registered queries on detectors that are fitted on the tables, and the same fitting in DuckDB's SQL.

The reconstruction takes the components of variance above 1, whose projection SQL finds by Newton's iteration for the sign of a matrix, and the forest's random numbers are hashes of places, so that SQL grows the same
trees level by level and walks all windows through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import alerts as A
from tracewell.operators import correlation, dense, detectors, domains, views
from tracewell.operators.windows import build_windows, evaluate_rules
from tracewell.plans.detection import _ALERTS, CONFIG, SHARE, _id, _together
from tracewell.plans.queries import _ISO, _SHORT_WINDOWS, DAY, _features, _rounded, _windows
from tracewell.schema import FEATURES
from tracewell.sources.scratch import written

TREES, SEED, SAMPLE = 100, 42, 256
#: Errors that differ less are equal: products of matrices depend on how rows lie.
DIGITS = 9


def _scaled(windows: DataFrame, *kept: str) -> DataFrame:
    """Keys and ``kept`` columns of windows with scaled features of `DIGITS` digits: what differs by less is a sum in another order, and no feature that varies."""
    scaled = detectors.scale(written(windows, "windows"), digits=DIGITS)
    return written(scaled.select("window_start", "src_ip", *kept, "scaled"), "scaled")


def _rebuilt(scaled: DataFrame, share: float, kept: bool = False) -> DataFrame:
    """Keys and errors of windows, with ``kept`` all columns."""
    scored = detectors.score_reconstruction(scaled, detectors.fit_reconstruction(scaled, None))
    scored = written(scored.withColumn("reconstruction_error", F.round("reconstruction_error", DIGITS)) if kept else scored.select("window_start", "src_ip", F.round("reconstruction_error", DIGITS).alias("reconstruction_error")), "rebuilt")
    return detectors.flagged(scored, detectors.exact_quantiles(scored, "reconstruction_error", (share,))[0])


def _isolated(scaled: DataFrame, share: float, kept: bool = False) -> tuple[DataFrame, detectors.Forest]:
    """Keys and isolation of windows, with ``kept`` all columns, and the forest."""
    forest = detectors.fit_isolation(scaled, trees=TREES, sample=SAMPLE, seed=SEED)
    scored = detectors.score_isolation(scaled, forest)
    scored = written(scored if kept else scored.select("window_start", "src_ip", "isolation"), "isolated")
    labelled, _ = detectors.label_isolation(scored, 1 - share)
    return detectors.share_not_above(labelled, scored, "isolation"), forest


def dns_learned_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five minutes by their reconstruction from the components of variance above 1."""
    found = _rebuilt(_scaled(_windows(spark, sf)), 0.99)
    return _rounded(found.select("window_start", "src_ip", "reconstruction_error", "threshold_ratio", "anomaly"))


def dns_learned_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five minutes by a forest fitted on all of them."""
    found, _ = _isolated(_scaled(_windows(spark, sf)), 0.99)
    return _rounded(found.select("window_start", "src_ip", "isolation", "isolation_score", "score_percentile", "predicted_label"))


def dns_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of that forest: cut feature and place, size of the node's sample, and its mean path length."""
    nodes = detectors.nodes_of(spark, detectors.fit_isolation(_scaled(_windows(spark, sf)), trees=TREES, sample=SAMPLE, seed=SEED))
    named = F.get(F.array(*map(F.lit, FEATURES)), F.col("feature").cast("int"))
    return _rounded(nodes.select("tree", F.when(F.col("feature") >= 0, named).alias("feature"), F.when(F.col("feature") >= 0, F.col("cut")).alias("cut"), "size", F.when(F.col("feature") < 0, F.col("path")).alias("path")))


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    found, forest = _isolated(_scaled(_windows(spark, sf), *FEATURES), 0.99, True)
    return written(detectors.attribute_isolation(found.where("predicted_label = 'anomaly'"), forest), "explained")


def dns_attribution_balance(spark: SparkSession, sf: str) -> DataFrame:
    """What the attributions of an anomalous window's features add up to: by how much its path is shorter than a window's of the sample."""
    return _rounded(_explained(spark, sf).select("window_start", "src_ip", F.aggregate("attribution", F.lit(0.0), lambda a, x: a + x).alias("attributed")))


def dns_attribution_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values and attributions of the 15 features that tell most."""
    return views.attribution_values(_explained(spark, sf))


def dns_dependency(spark: SparkSession, sf: str) -> DataFrame:
    """How the values of the feature that tells most go with its attributions."""
    return views.dependency(views.attribution_values(_explained(spark, sf)))


def _all_alerts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Alerts of the fitted detectors and the rules on windows of a day."""
    own = written(_features(spark, sf), "features")
    windows = build_windows(own, DAY)
    scaled = _scaled(windows, *(c for c in windows.columns if c not in ("window_start", "src_ip")))
    found = written(domains.suspicious_domains(own, DAY), "domains")
    isolated, _ = _isolated(scaled, SHARE, True)
    return {"isolation": A.isolation_alerts(isolated, found, None, DAY), "reconstruction": A.reconstruction_alerts(_rebuilt(scaled, SHARE, True), found, DAY), "rules": A.rule_alerts(evaluate_rules(scaled), found, DAY)}


def _final(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _all_alerts(spark, sf)
    return correlation.correlate(correlation.evidence(alerts["isolation"], alerts["reconstruction"], alerts["rules"], CONFIG), CONFIG)


def dns_learned_final(spark: SparkSession, sf: str) -> DataFrame:
    """What the fitted detectors and the rules say together of each window of a day with an alert of one of them."""
    return _rounded(_final(spark, sf).drop("contributing_ids").withColumns({c: F.round(F.col(c) * 100) / 100 for c in ("base", "threat_score")}))


def dns_source_families(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of each source by family, of the fitted detectors and the rules."""
    return _rounded(A.families(_together(_all_alerts(spark, sf))))


def _dense(spark: SparkSession, sf: str) -> tuple[DataFrame, dense.Dense]:
    scaled = _scaled(_windows(spark, sf))
    return scaled, dense.fit_dense(scaled)


def dns_dense_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five minutes by their reconstruction by a network."""
    scaled, net = _dense(spark, sf)
    scored = written(dense.score_dense(scaled, net).select("window_start", "src_ip", "reconstruction_error", detectors.top_features("residuals", 10).alias("top_features")), "rebuilt")
    limit = detectors.exact_quantiles(scored, "reconstruction_error", (0.99,))[0]
    return detectors.flagged(scored, limit).select("window_start", "src_ip", "reconstruction_error", "threshold_ratio", "anomaly", "top_features")


def dns_dense_history(spark: SparkSession, sf: str) -> DataFrame:
    """The network's training and validation error by epoch; epoch 0 is its start as components."""
    return spark.createDataFrame(_dense(spark, sf)[1].history, "epoch int, training_error double, validation_error double")


QUERIES = (dns_learned_reconstruction, dns_learned_isolation, dns_forest, dns_attribution_balance, dns_learned_final, dns_source_families, dns_attribution_values, dns_dependency, dns_dense_reconstruction, dns_dense_history)

_D = len(FEATURES)
_PRIME = detectors.PRIME


def _z(windows: str) -> str:
    """Windows with their scaled features as a list, and the digest of their keys."""
    z = ", ".join(f"round(coalesce((CAST({f} AS DOUBLE) - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0) * 1e{DIGITS}) / 1e{DIGITS}" for f in FEATURES)
    return f"{windows}, zi AS MATERIALIZED (SELECT ws, src_ip, [{z}] AS z, md5('{SEED}|' || {_ISO} || '|' || src_ip) AS digest, count(*) OVER () AS n FROM w)"


def _sign_sql(turns: int = 45) -> str:
    """``pr``: columns of the projection on the components of variance above 1, (1 + sign(C - 1)) / 2 of the covariances C."""
    pairs = ", ".join(f"covar_pop(z[{min(i, j)}], z[{max(i, j)}])" for i in range(1, _D + 1) for j in range(1, _D + 1))
    out = f""", cm AS MATERIALIZED (SELECT CAST((k - 1) // {_D} + 1 AS INTEGER) AS i, CAST((k - 1) % {_D} + 1 AS INTEGER) AS j, m[k] AS v FROM (SELECT [{pairs}] AS m FROM zi), range(1, {_D * _D + 1}) t(k)),
x0 AS MATERIALIZED (SELECT i, j, (v - CAST(i = j AS INTEGER)) / sqrt(sum((v - CAST(i = j AS INTEGER)) ** 2) OVER ()) AS v FROM cm)"""
    for k in range(turns):
        out += f""", y{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM x{k} a JOIN x{k} b ON a.j = b.i GROUP BY ALL),
x{k + 1} AS MATERIALIZED (SELECT i, j, 1.5 * any_value(x) - 0.5 * sum(p) AS v FROM (SELECT a.i, b.j, a.v * b.v AS p, c.v AS x FROM x{k} a JOIN y{k} b ON a.j = b.i JOIN x{k} c ON c.i = a.i AND c.j = b.j) GROUP BY ALL)"""
    return out + f", pr AS MATERIALIZED (SELECT j, list((v + CAST(i = j AS INTEGER)) / 2 ORDER BY i) AS col FROM x{turns} GROUP BY j)"


def _rebuilt_sql(share: float) -> str:
    """``sr``: windows with error, threshold and ratio."""
    return f"""{_sign_sql()}, er AS MATERIALIZED (SELECT ws, src_ip, round(list_sum(list(abs(z[j] - list_inner_product(z, col)) ORDER BY j)) / {_D}, {DIGITS}) AS err FROM zi, pr GROUP BY ws, src_ip),
sr AS (SELECT er.*, th, err / th AS ratio, th > 0 AND err > th AS anomaly FROM er, (SELECT quantile_cont(err, {share}) AS th FROM er))"""


def _uniform_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def _path_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) END"


def _forest_sql() -> str:
    """``no``: the nodes of all trees by their place, 1 at the root and 2p and 2p + 1 below p."""
    levels = (SAMPLE - 1).bit_length()
    low, high = (", ".join(f"{f}(z[{i}])" for i in range(1, _D + 1)) for f in ("min", "max"))
    out = f""", tr AS (SELECT t AS tree, 1 + CAST(floor({_uniform_sql(f"'{SEED}|' || t || '|a'")} * {_PRIME - 1}) AS BIGINT) AS a, CAST(floor({_uniform_sql(f"'{SEED}|' || t || '|b'")} * {_PRIME}) AS BIGINT) AS b FROM range({TREES}) r(t)),
dr AS (SELECT tree, z, digest, n, (CAST('0x' || substr(digest, 1, 8) AS BIGINT) % {_PRIME} * a + b) % {_PRIME} AS place FROM zi, tr WHERE place < ceil(least(1.0::DOUBLE, {SAMPLE + 8 * SAMPLE**0.5}::DOUBLE / n) * {_PRIME})),
s0 AS MATERIALIZED (SELECT tree, 1 AS place, z, CAST(ceil(log2(greatest(2, least({SAMPLE}, n)))) AS INTEGER) AS deepest FROM dr QUALIFY row_number() OVER (PARTITION BY tree ORDER BY dr.place, digest) <= least({SAMPLE}, n))"""
    for k in range(levels + 1):
        out += f""", q{k} AS (SELECT tree, place, count(*) AS size, any_value(deepest) AS deepest, [{low}] AS lo, [{high}] AS hi FROM s{k} GROUP BY tree, place),
v{k} AS (SELECT *, list_filter(range(1, {_D + 1}), lambda i: hi[i] > lo[i]) AS varied FROM q{k}),
f{k} AS (SELECT *, CASE WHEN {k} < deepest AND len(varied) > 0 THEN varied[1 + CAST(floor({_uniform_sql(f"'{SEED}|' || tree || '|' || place || '|f'")} * len(varied)) AS BIGINT)] END AS f FROM v{k}),
c{k} AS MATERIALIZED (SELECT tree, place, {k} AS depth, size, f, CASE WHEN lo[f] + {_uniform_sql(f"'{SEED}|' || tree || '|' || place || '|c'")} * (hi[f] - lo[f]) > lo[f] THEN lo[f] + {_uniform_sql(f"'{SEED}|' || tree || '|' || place || '|c'")} * (hi[f] - lo[f]) ELSE hi[f] END AS cut FROM f{k}),
s{k + 1} AS MATERIALIZED (SELECT tree, 2 * place + CAST(z[f] >= cut AS INTEGER) AS place, z, deepest FROM s{k} JOIN c{k} USING (tree, place) WHERE f IS NOT NULL)"""
    nodes = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(levels + 1))
    return out + f", no AS MATERIALIZED (SELECT tree, place, size, f, cut, depth + {_path_sql('size')} AS path FROM ({nodes}))"


def _isolated_sql(share: float) -> str:
    """``si``: windows with isolation, score, percentile and label. ``pa`` has their mean paths."""
    out, levels = _forest_sql(), (SAMPLE - 1).bit_length()
    out += ", w0 AS (SELECT ws, src_ip, z, t AS tree, 1 AS place FROM zi, range({}) r(t))".format(TREES)
    for k in range(levels):
        out += f", w{k + 1} AS (SELECT ws, src_ip, z, w{k}.tree, CASE WHEN f IS NULL THEN w{k}.place ELSE 2 * w{k}.place + CAST(z[f] >= cut AS INTEGER) END AS place FROM w{k} JOIN no ON no.tree = w{k}.tree AND no.place = w{k}.place)"
    return out + f""", pa AS MATERIALIZED (SELECT ws, src_ip, list_sum(list(path ORDER BY e.tree)) / {TREES} AS path FROM w{levels} e JOIN no ON no.tree = e.tree AND no.place = e.place GROUP BY ws, src_ip),
io AS MATERIALIZED (SELECT ws, src_ip, 2 ** (-path / c) AS isolation FROM pa, (SELECT {_path_sql('m')} AS c FROM (SELECT least({SAMPLE}, any_value(n)) AS m FROM zi))),
si AS (SELECT io.*, isolation - o AS score, 100.0 * count(*) OVER (ORDER BY isolation RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS pct FROM io, (SELECT quantile_cont(isolation, {share}) AS o FROM io))"""


_SHORT = _z(_SHORT_WINDOWS)
_TIME = "strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start"


def _fitted_sql() -> str:
    """``ru``, alerts of the rules, and ``si`` and ``sr`` on windows of a day."""
    return _ALERTS[: _ALERTS.index("ia AS (SELECT")] + _z("")[2:] + _isolated_sql(SHARE) + _rebuilt_sql(SHARE)


def _families_sql() -> str:
    """``al``: alerts of the fitted detectors and the rules."""
    return f"""{_fitted_sql()}, al AS (SELECT ws, src_ip, 'isolation' AS family, round_even(least(100, pct), 0) AS threat_score FROM si WHERE score > 0
 UNION ALL SELECT ws, src_ip, 'reconstruction', NULL FROM sr WHERE anomaly UNION ALL SELECT ws, src_ip, 'rules', CAST(threat_score AS DOUBLE) FROM ru)"""


def _final_sql() -> str:
    tail = _ALERTS[_ALERTS.index("al AS (SELECT") :]
    isolated = f"""ia AS (SELECT ws, src_ip, {_id("CATF-", f"'categorization_forest|' || {_ISO} || '|' || src_ip")} AS id, pct FROM si WHERE score > 0),
ra AS (SELECT ws, src_ip, {_id("AE-", f"'autoencoder|' || {_ISO} || '|' || src_ip")} AS id, round(ratio, 6) AS ratio FROM sr WHERE anomaly),
k AS (SELECT ws, src_ip, CASE WHEN pct >= 95 THEN least(100, pct) END AS i, CASE WHEN ratio >= 1.2 THEN least(100, 50 + 25 * (ratio - 1)) END AS n, CASE WHEN threat_score >= 40 THEN CAST(threat_score AS DOUBLE) END AS h
 FROM (SELECT ws, src_ip FROM ia UNION SELECT ws, src_ip FROM ra UNION SELECT ws, src_ip FROM ru) LEFT JOIN ia USING (ws, src_ip) LEFT JOIN ra USING (ws, src_ip) LEFT JOIN ru USING (ws, src_ip)),
"""
    return _fitted_sql() + ", " + isolated + tail[tail.index("k1 AS (SELECT") :]


SQL = {
    "dns_learned_reconstruction": f"WITH {_SHORT}{_rebuilt_sql(0.99)} SELECT {_TIME}, src_ip, round(err, 6) AS reconstruction_error, round(ratio, 6) AS threshold_ratio, anomaly FROM sr",
    "dns_learned_isolation": f"WITH {_SHORT}{_isolated_sql(0.99)} SELECT {_TIME}, src_ip, round(isolation, 6) AS isolation, round(score, 6) AS isolation_score, round(pct, 6) AS score_percentile, CASE WHEN score > 0 THEN 'anomaly' ELSE 'normal' END AS predicted_label FROM si",
    "dns_forest": f"WITH {_SHORT}{_forest_sql()} SELECT tree, [{', '.join(repr(f) for f in FEATURES)}][f] AS feature, round(CASE WHEN f IS NOT NULL THEN cut END, 6) AS cut, size, round(CASE WHEN f IS NULL THEN path END, 6) AS path FROM no",
    "dns_attribution_balance": f"WITH {_SHORT}{_isolated_sql(0.99)}, ro AS (SELECT sum(size * path) / sum(size) AS whole FROM no WHERE f IS NULL) SELECT {_TIME}, src_ip, round(whole - path, 6) AS attributed FROM si JOIN pa USING (ws, src_ip), ro WHERE score > 0",
    "dns_learned_final": f"WITH {_final_sql()} SELECT id, src_ip, window_start, round(coalesce(i, 0), 6) AS isolation_evidence, round(coalesce(n, 0), 6) AS reconstruction_evidence, round(coalesce(h, 0), 6) AS rules_evidence, active, round(base * 100) / 100 AS base, round(total * 100) / 100 AS threat_score, severity, outcome FROM co",
    "dns_source_families": f"WITH {_families_sql()} SELECT src_ip, count(*) AS alerts, count(*) FILTER (WHERE family = 'isolation') AS isolation, count(*) FILTER (WHERE family = 'reconstruction') AS reconstruction, count(*) FILTER (WHERE family = 'rules') AS rules, max(coalesce(threat_score, 0)) AS max_score, strftime(min(ws), '%Y-%m-%d %H:%M:%S') AS first_window, strftime(max(ws), '%Y-%m-%d %H:%M:%S') AS last_window FROM al GROUP BY src_ip",
}
