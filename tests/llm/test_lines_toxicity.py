import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import toxicity as T
from llm.line_dedup import dedup_lines, halves, variants, word_edit_at_most_one
from llm.queries import op3_toxicity, op4_line_dedup
from tests.llm import brute


def test_keys_are_complete():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 11))]
        b, i, kind = a[:], rng.randrange(len(a)), rng.randrange(3)
        if kind:
            b[i : i + (kind == 1)] = [rng.choice([b"x", b"a"])]
        elif len(a) > 5:
            del b[i]
        assert word_edit_at_most_one(a, b) and set(halves(a)) & set(halves(b))
        one, two = ({(int(v), k - 1) for k, v in enumerate(variants(x))} for x in (a, b))
        near = {(v, p) for v, p in one & two} or {v for v, p in one if p < 0} & {v for v, _ in two} or {v for v, p in two if p < 0} & {v for v, _ in one}
        assert near


def test_variant_hashes_are_those_of_the_shorter_lines():
    w = [b"a", b"b", b"a", b"c", b"", b"d"]
    assert [int(v) for v in variants(w)[1:]] == [int(variants(w[:i] + w[i + 1 :])[0]) for i in range(len(w))]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(5000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, up = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(up[j] + 1, d[-1] + 1, up[j - 1] + (x != y)))
        assert word_edit_at_most_one(a, b) == (d[-1] <= 1)


def check_lines(rows, got):
    kept = brute.kept_lines(rows)
    for k, (ident, text) in enumerate(rows):
        lines = (text or "").split("\n")
        want = None if text is None else "\n".join(x for x, on in zip(lines, kept[k]) if on)
        r = got[ident]
        assert (r.text, r.n_removed) == (want, kept[k].count(False)), ident
        assert r.n_lines == (0 if text is None else len(lines))


def test_lines_against_brute_force(spark):
    rng, rows = random.Random(3), []
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.choice([3, 5, 6, 9, 14]))) for _ in range(25)]
    for i in rng.sample(range(1000), 60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "beta gamma", ""])
            lines.append(rng.choice([" ", "", "\t"]) + " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(2000, None), (2001, ""), (2002, "w " * 30000 + "\n" + "w " * 29999)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, print string")).collect()}
    assert all(r["print"] == "k" for r in got.values())
    check_lines(rows, got)


def test_lines_edges(spark):
    line = "one two three four five"
    rows = [(None, line), (1, line), (1, line), (0, "a b c d\na b c d"), (2, "one two three four six\nx")]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, _gone string, _id int, print int")
    assert {(r["_gone"], r["_id"], r["print"]) for r in dedup_lines(docs).collect()} == {("k", 1, 2)}
    got = sorted(((r.doc_id is None, r.doc_id), r.text) for r in dedup_lines(docs).collect())
    assert [t for _, t in got] == ["a b c d", line, line, "x", ""]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = brute.kept_lines(rows)
    got = {r.doc_id: r for r in op4_line_dedup(spark, sf_dir).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {rows[k][0]: v.count(False) for k, v in kept.items()}


@pytest.fixture(scope="module")
def costs():
    words = ["idiot", "moron", "loser", "stupid", "the", "and", "there", "listen", "door", "book"] * 30
    counts = np.zeros(T.CLASSES**3)
    c = T.classes_of(" " + " ".join(words) + " ")
    np.add.at(counts, (c[:-2] * T.CLASSES + c[1:-1]) * T.CLASSES + c[2:], 1)
    return T.language_model(counts)


@pytest.mark.parametrize("raw,want", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("idiooooot", "idiot"), ("book", "book"), ("i-d-i-o-t,", "idiot"),
                                      ("the!!", "the"), ("and%%%", "and"), ("", ""), ("...", ""), ("1234", "")])
def test_restores(costs, raw, want):
    assert T.Restorer(costs).word(raw) == want


def test_spelled_out(costs):
    assert "idiot" in T.Restorer(costs).words("you I d i 0 t there") and T.Restorer(costs).words("a b there a") == ["a", "b", "there", "a"]


@pytest.mark.parametrize("text", ["you id io t, there", "the i d i 0 t. and", "book mo ro n"])
def test_spelled_out_in_pieces_with_marks(costs, text):
    assert {"idiot", "moron"} & set(T.Restorer(costs).words(text))


def test_a_very_long_run_of_single_letters(costs):
    assert "idiot" in "".join(T.Restorer(costs).words("i d i o t " * 3000)[-1:])


def test_viterbi_is_the_best_path(costs):
    def cost(said, channel):
        k = [0, 0, *(T._CLASS.get(c, T.OTHER) for c in said), 0]
        return channel + sum(costs[a, b, c] for a, b, c in zip(k, k[1:], k[2:]))

    for raw in ("1d10t", "5t00p!d", "l0..s3r", "b00k$"):
        paths = [("", 0.0)]
        for options in T.lattice(raw):
            paths = [(s + e, c + x) for s, c in paths for e, x in options]
        best = min(cost(s, c) for s, c in paths)
        assert min(cost(s, c) for s, c in paths if s == T.decode(raw, costs)) == pytest.approx(best)


def test_counts_are_those_of_all_texts(spark):
    docs = spark.createDataFrame([(1, "Ab"), (2, None), (3, ""), (4, "x" * 30000)], "doc_id long, text string").repartition(3)
    n = T.character_counts(docs)
    a, b, x = (T._CLASS[c] for c in "abx")
    assert n.sum() == 2 + 30000 and n[(0 * T.CLASSES + a) * T.CLASSES + b] == 1 and n[(x * T.CLASSES + x) * T.CLASSES + x] == 29998


def planted(n=600):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(30)]
        if i % 7 == 0:
            w[rng.randrange(30)] = rng.choice(["zorkface", "zorkhead", "zorknose"])
        rows.append((i, " ".join(w), int(i % 7 == 0)))
    return rows


def test_held_out_accuracy_and_disguises(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels.where(~T.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.97
    odd = spark.createDataFrame([(1, "abc zorkf4ce"), (2, "z o r k f a c e"), (3, "zooorkface"), (4, "z.o.r.k.h.e.a.d"), (5, ""), (6, None), (7, "abc " * 50000)], "doc_id long, text string")
    said = {r.doc_id: r.score for r in T.score(odd.withColumn("score", F.lit("x")), model).collect()}
    assert all(said[i] >= 0.5 for i in (1, 2, 3, 4)) and all(0 <= said[i] < 0.5 for i in (5, 6, 7))
    assert sorted(r.doc_id for r in T.drop_toxic(odd, model).collect()) == [5, 6, 7]
    kept = T.drop_toxic(odd.withColumns({"score": F.lit("mine"), "_score": F.lit(1)}), model)
    assert kept.columns == ["doc_id", "text", "score", "_score"] and {(r.score, r["_score"]) for r in kept.collect()} == {("mine", 1)}
    few = T.fit(docs, labels.where(~T.held_out(F.col("doc_id"))), max_labelled=50)
    assert few.weights.keys() != model.weights.keys()
    again = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(40)).select("doc_id", "text"))
    assert T.fit(again, labels.where(~T.held_out(F.col("doc_id")))).weights == model.weights


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, T.fit(docs, labels)).collect()} == {0.5}
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_query(spark, sf_dir):
    got = op3_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 200
