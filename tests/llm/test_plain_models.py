"""The learnt verdicts of op1 and op3 against the same models walked and summed row by row."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import toxicity as T
from llm import url_filter as U
from llm.queries import op1_url_filter, op3_toxicity


def plain_score(model, restorer, text):
    """A text's score: each word's largest weight of a feature, then the four figures, then the logistic function."""
    words = restorer.words(text or "")
    best = {w: max([model.weights.get(f, 0.0) for f in T.features_of(w)] or [0.0]) for w in set(words)}
    strong = sorted((v for v in best.values() if v > 0), reverse=True)
    x = [strong[0] if strong else 0.0, sum(strong[:5]), sum(v > 3 for v in strong), math.log(1 + len(words)), 1.0]
    z = max(-30.0, min(30.0, float(np.dot(x, model.coefficients))))
    return 1 / (1 + math.exp(-z))


def test_toxicity_query_against_a_plain_scorer(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fit(docs, labels.where(~T.held_out(F.col("doc_id"))))
    restorer = T.Restorer(model.costs)
    want = {r.doc_id: plain_score(model, restorer, r.text) for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in op3_toxicity(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for k, (score, predicted) in got.items():
        assert score == pytest.approx(want[k], abs=1e-9) and predicted == int(score >= 0.5)


def test_long_words_are_known_whole():
    a, b = "x" * 30 + "a", "x" * 30 + "b"
    assert set(T.features_of(a)) - set(T.features_of(b)) and T.features_of(a)[0] != T.features_of(b)[0] and T.features_of("abc") == ["=abc"]


def walk(lines, depth, features):
    """The prediction of a printed tree: `If` and `Else` at one depth, `Predict` at a leaf."""
    k = 0
    while k < len(lines):
        at, line = lines[k]
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        i, cut = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
        other = next(j for j in range(k + 1, len(lines)) if lines[j][0] == at and lines[j][1].startswith("Else"))
        k, lines = 0, lines[k + 1 : other] if features[int(i)] <= float(cut) else lines[other + 1 :]
    raise AssertionError("no leaf")


def plain_features(url, shares, overall):
    host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0] if "://" in url else ""
    path = re.match(r"[^?#]*", url.split("://", 1)[1][len(host):])[0] if "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    n, labels = max(1, len(url)), host.split(".")
    entropy = -sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url))
    suffix = [".".join(labels[-k:]) for k in (1, 2)]
    return [
        len(url), len(host), len(path), path.count("/"), sum(c in "0123456789" for c in url) / n, entropy, url.count("&") + 1 if "?" in url else 0, len(labels), url.count("-"), *(shares.get(x, overall) for x in suffix)
    ]


def test_url_query_against_a_plain_tree_walk(spark, sf_dir, monkeypatch):
    kept = {}

    class Kept(U.GBTClassifier):
        def fit(self, train):
            kept["model"] = super().fit(train)
            return kept["model"]

    real = U.suffix_shares
    monkeypatch.setattr(U, "GBTClassifier", Kept)
    monkeypatch.setattr(U, "suffix_shares", lambda labelled, overall: kept.setdefault("shares", (real(labelled, overall), overall))[0])
    rows = op1_url_filter(spark, sf_dir).collect()
    table, overall = kept["shares"]
    shares = {r.suffix: r.share for r in table.collect()}
    urls = {r.page_id: r.url or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    trees = [[(len(x) - len(x.lstrip()), x.strip()) for x in t.toDebugString.split("\n")[1:] if x.strip()] for t in kept["model"].trees]
    assert len(rows) == len(urls) and any(r.rule is None for r in rows)
    for r in rows:
        x = plain_features(urls[r.page_id], shares, overall)
        margin = sum(w * walk(t, 0, x) for w, t in zip(kept["model"].treeWeights, trees, strict=True))
        score = 1 / (1 + math.exp(-2 * margin))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.rule is not None or r.verdict == ("block" if score >= 0.5 else "allow")
