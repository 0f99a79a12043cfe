"""URL filter: domain rules first, gradient-boosted trees on lexical features for the rest.

A rule decides the URLs of its host, subdomains and path prefix; the longest wins. The URLs that rules decide are the labelled ones, from which
the trees learn to judge the others. Features: lengths, depth, digit ratio, entropy, number of parameters, and the smoothed share
of blocked URLs among labelled ones with the same host suffix. Suffix shares come from one half of the labelled URLs and the trees from the other half,
so that no URL's own label is in its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._common import join_counted, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DomainRule:
    """``pattern`` is a host and a path prefix, such as ``example.net/en/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    DomainRule("net/", "block"), DomainRule("example.net/en/", "allow"),
    DomainRule("example.com/de/", "block"), DomainRule("org/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(rows: DataFrame, rules: tuple[DomainRule, ...]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``, null where no rule fits. A rule is an expression, so keep them to some hundreds."""
    hit = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        hit = F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))).otherwise(hit)
    return rows.withColumn("_hit", hit).select("*", "_hit.*").drop("_hit")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical_features(rows: DataFrame) -> DataFrame:
    """Adds one double column for each lexical feature of ``_url``, ``host`` and ``path``, and the suffixes to look up."""
    url, host = F.col("_url"), F.col("host")
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    labels = F.split(host, r"\.")
    found = {
        "f_url_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length("path"),
        "f_depth": _count(F.col("path"), "/"), "f_digit_ratio": _count(url, "0123456789") / n, "f_entropy": entropy,
        "f_params": F.when(F.instr(url, "?") > 0, _count(url, "&") + 1).otherwise(0), "f_labels": F.size(labels), "f_hyphens": _count(url, "-"),
    }
    rows = rows.select("*", *(v.cast("double").alias(k) for k, v in found.items()))
    return rows.withColumn("_suffix", F.array(*(F.concat_ws(".", F.slice(labels, -F.least(F.lit(k), F.size(labels)), k)) for k in (1, 2))))


def suffix_shares(labelled: DataFrame, overall: float, prior: float = 10.0) -> DataFrame:
    """``suffix`` and ``share``: of blocked URLs, drawn to the ``overall`` share as by ``prior`` more URLs."""
    each = labelled.select(F.explode(F.array_distinct("_suffix")).alias("suffix"), "_blocked")
    counted = each.groupBy("suffix").agg(F.sum("_blocked").alias("b"), F.count("*").alias("n"))
    return counted.select("suffix", ((F.col("b") + prior * overall) / (F.col("n") + prior)).alias("share"))


def _with_shares(rows: DataFrame, shares: DataFrame, overall: float) -> DataFrame:
    """Adds the share of each suffix. A suffix that very many rows have is looked up in parts."""
    for k in (1, 2):
        rows = rows.withColumn(f"_s{k}", F.col("_suffix")[k - 1])
    for k in (1, 2):
        own = rows.groupBy(f"_s{k}").agg(F.count("*").alias("rows"))
        known = own.join(shares.select(F.col("suffix").alias(f"_s{k}"), F.col("share").alias(f"f_suffix{k}")), f"_s{k}", "left").fillna(overall, [f"f_suffix{k}"])
        rows = join_counted(rows, materialize(known, "suffixes"), [f"_s{k}"], "rows", salt=F.xxhash64("id", "_url"))
    return rows


def judge(pages: DataFrame, rules: tuple[DomainRule, ...] = RULES, max_labelled: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 1, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, score`` of every page; ``score`` is the trees' probability of ``block``.

    Suffixes are counted over all labelled URLs of one half, by a hash of the URL, and the trees learn from those of the other half: from ``max_labelled`` rows at most, those of smallest hash of id and URL.
    If the labelled URLs are all of one kind, that is the verdict of the
    others; without any it is ``allow``. Null URLs and those without ``://`` have an empty host and path, fit no rule and are
    judged by the trees. Repeated rows and null ids are judged each on its own; an empty table gives no rows. Other columns aren't in the result, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = materialize(lexical_features(apply_rules(rows, rules)), "urls")
    labelled = rows.where("rule is not null").withColumn("_blocked", (F.col("rule_verdict") == "block").cast("int"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("_blocked"), F.lit(0))).first()
    out = ["id", "host", "path", "rule"]
    if blocked in (0, n):
        only = "block" if blocked else "allow"
        return rows.select(*out, F.coalesce("rule_verdict", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    overall = blocked / n
    half = F.pmod(F.xxhash64("_url", F.lit(seed + 1)), F.lit(2))
    shares = materialize(suffix_shares(labelled.where(half == 0), overall), "suffixes")
    names = [c for c in rows.columns if c.startswith("f_")] + ["f_suffix1", "f_suffix2"]
    vectors = VectorAssembler(inputCols=names, outputCol="_features")
    chosen = materialize(labelled.where(half == 1).orderBy(F.xxhash64("id", "_url", F.lit(seed))).limit(max_labelled).repartition(4), "labelled")
    train = vectors.transform(_with_shares(chosen, shares, overall)).select("_features", F.col("_blocked").cast("double").alias("_label"))
    if chosen.select("_blocked").distinct().count() < 2:
        return rows.select(*out, F.coalesce("rule_verdict", F.when(F.lit(2 * blocked >= n), "block").otherwise("allow")).alias("verdict"), F.lit(overall).alias("score"))
    model = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, seed=seed).fit(train)
    judged = model.transform(vectors.transform(_with_shares(rows, shares, overall))).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select(*out, F.coalesce("rule_verdict", own).alias("verdict"), "score")
