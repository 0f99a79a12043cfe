"""Mixing, quality rules."""

import math

import pytest
from pyspark.sql import functions as F

from llm.mixture_sampling import mix, source_targets
from llm.queries import op5_mixture, op8_quality
from llm.rule_cascade import Rule, base_signals, cascade, judge, measure
from tests.llm import brute

DOCS = "doc_id long, text string, source string, size long"


def waterfill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 10, "d": 500, None: 3},
    {"a": 100},
    {"a": 0, "b": 0},
    {"a": 5, "b": 5, "c": 5},
    {"x": 1, "y": 1, "z": 100000, "é": 7, "\U0001f600": 2, "￿": 2},
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = waterfill(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()))


def test_mix_takes_near_targets_and_reruns_agree(spark, sf_dir):
    a = op5_mixture(spark, sf_dir).toPandas()
    b = op5_mixture(spark.newSession(), sf_dir).toPandas()
    assert sorted(map(tuple, a.values.tolist())) == sorted(map(tuple, b.values.tolist()))
    assert (a.taken <= 3 * a["size"]).all() and (a.taken % a["size"].clip(lower=1) == 0).all()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").toPandas().merge(a, on="doc_id")
    assert (docs.text.map(lambda t: len(brute.words(t))) == docs["size"]).all()
    for _, own in docs.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_mix_prefix_is_that_of_the_keys(spark):
    rows = [(i, "w " * (1 + i * 7 % 11), "ab"[i % 2], i) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    few, many = (mix(docs, buckets=n).toPandas().sort_values("id").taken.tolist() for n in (1, 4096))
    assert few == many


def test_mix_edges(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "a b", "s", 1), (None, "a b", "s", 1), (2, "", "t", 0), (3, "x " * 5000, "s", 0)]
    got = mix(spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit(1)).withColumn("key", F.lit("k"))).collect()
    assert len(got) == 6 and {r.size for r in got if r.id == 1} == {0}
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_documents_without_words_are_taken_no_more_often_than_others(spark):
    rows = [(i, "", "small", 0) for i in range(200)] + [(500 + i, "w " * 5, "small", 0) for i in range(3)] + [(1000 + i, "w " * 50, "zzz", 0) for i in range(40)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.copies for r in got if r.source == "small"} == {3} and max(r.copies for r in got) <= 3


def plain_mix(rows, weights=(5, 2, 1), epochs=3, seed=5):
    """(id, text, source) -> {id: copies}"""
    import hashlib

    size = {i: len(brute.words(t)) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    out = {}
    for s, target in waterfill(total, weights, epochs).items():
        whole = math.floor(target / total[s]) if total[s] else 0
        rest, upto = target - whole * total[s], 0

        def key(row):
            i, t, _ = row
            bare = [c for c in t or "" if c not in " \t\n\x0b\f\r"]
            quality = 0.1 + 0.9 * sum(c not in "#*$%&|<>!" for c in bare) / max(1, len(bare))
            return -math.log((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality

        for i, _, _ in sorted((r for r in rows if r[2] == s), key=key):
            before, upto = upto, upto + size[i]
            out[i] = whole + (before < rest and (upto <= rest or upto - rest < rest - before))
    return out


def test_mix_against_a_plain_sampler(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_mix(rows)
    got = {r.id: (r.copies, r.size) for r in mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert all(c == want[i] or not n for i, (c, n) in got.items()) and got.keys() == want.keys()


def test_kept_against_a_plain_cascade(spark, sf_dir):
    import regex

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.kept for r in op8_quality(spark, sf_dir).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, _, failed = brute.quality(r.text)
        letters, upper, lines = len(regex.findall(r"\p{L}", r.text or "")), len(regex.findall(r"\p{Lu}", r.text or "")), len((r.text or "").split("\n"))
        rejected = failed or symbols * 4 > n or chars > 25 * n or chars < 2 * n or (dup >= 4 and 2 * dup > lines) or 2 * upper > letters or 2 * letters < chars
        assert got[r.doc_id] == (not rejected), r.doc_id


def test_columns_with_the_names_of_inner_ones_stay(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", 1, 2, 3, 4, "k")], "doc_id long, text string, _words int, _w int, _hashed int, _p int, kept string")
    row = judge(docs).first()
    assert (row["_words"], row["_w"], row["_hashed"], row["_p"], row.n_repeat_words, row.kept) == (1, 2, 3, 4, 6, False)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a b c d a b c", "x x x x x", "é b c\x0bd | # é b c d",
         "one line\none line\n\n \none line\r\n", "a b a b a b c d e f", "👍 # $ % & | < > *", "z " * 5000]


def test_base_signals(spark, sf_dir):
    own = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(TEXTS + own)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in base_signals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute.quality(t) for i, t in rows}


def test_cascade_order_does_not_change_the_result(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(100)], "doc_id long, text string")
    rules = [Rule("a", F.col("n_words") > 90), Rule("b", F.col("n_words") % 7 == 0), Rule("c", F.lit(None).cast("boolean"))]
    signals = base_signals(docs)
    kept = [sorted(r.doc_id for r in signals.where(cascade(order, F.col("base_failed")).isNull()).collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == [i for i in range(50, 91) if i % 7]


def test_measured_order_is_rejection_per_cost(spark):
    docs = spark.range(100).selectExpr("id", "id % 10 as x")
    ticks = iter([0, 1, 1, 2, 2, 5, 5, 6.5, 6.5, 7.5])
    rules = [Rule("dear", F.col("x") < 6), Rule("cheap", F.col("x") < 3), Rule("idle", F.lit(False))]
    got = measure(docs, rules, 100, clock=lambda: next(ticks))
    assert [m.rule.name for m in got] == ["cheap", "dear", "idle"]
    assert [round(m.rejected, 2) for m in got] == [0.3, 0.6, 0]


def test_judge_edges(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, "x"), (1, "w", "y"), (1, "w", "y")], "doc_id long, text string, n_words string")
    assert [r.kept for r in judge(docs).collect()] == [False] * 3
    assert judge(docs.limit(0)).count() == 0
    got = op8_quality(spark, sf_dir)
    assert got.where("kept and base_failed").count() == 0 and got.where("kept").count() > 0
