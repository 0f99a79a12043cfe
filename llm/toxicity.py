"""Toxicity by noisy-channel deobfuscation.

Disguised words (leetspeak, inserted separators, spelled-out letters, repeated letters) become lattices of characters. The Viterbi path through a lattice, under
a character trigram model of the corpus and the channel's costs, is the restored word. Texts are scored on their restored and plain words: weights of words and word beginnings come from
their frequency in toxic and clean training documents, and a logistic function of the strongest ones gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._common import fresh, materialize, remembered

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçéèêëíìîïñóòôöõúùûüßœæ"
#: Classes of characters: 0 is any non-letter, 1 to n the letters, and the last another letter.
OTHER = len(LETTERS) + 1
CLASSES = OTHER + 1
#: What a character may stand for, beside itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "€": "e", "£": "l", "(": "c", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "і": "i", "х": "x", "у": "y",
}
#: Costs, in natural-log units: a substituted, a dropped and a doubled character.
SUBSTITUTED, DROPPED, DOUBLED = 2.0, 1.0, 1.0
#: Most training documents, of all labelled ones, that word weights and the logistic function are fitted on.
MAX_LABELLED = 20_000
#: The least number of toxic documents that have a feature with a weight.
LEAST = 3
REMEMBERED = 100_000
#: The cost of a space that was put in.
GLUED = 1.0
_TRAILING = ".,;:?"
_EDGES = re.compile(r"^[^\w@$€£|+]+|[^\w@$€£|+!]+$|([^\w\s])\1+$|^([^\w\s])\2+|_+$|^_+")
_RUN = re.compile(r"(.)\1\1")


def classes_of(text: str) -> np.ndarray:
    """Class of each character of a lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    far = np.flatnonzero(codes >= len(_TABLE) - 1)
    if len(far):
        out[far] = [OTHER if text[i].isalpha() else 0 for i in far.tolist()]
    return out


def _table() -> np.ndarray:
    table = np.zeros(0x250, dtype=np.int64)
    for code in range(len(table)):
        c = chr(code)
        table[code] = LETTERS.index(c) + 1 if c in LETTERS else OTHER * c.isalpha()
    return table


_TABLE = _table()


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts. A task sends one row for each of the at most `CLASSES`^3 trigrams it has seen."""

    def batches(it):
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in it:
            for text in batch.column(0).to_pylist():
                if text:
                    c = np.concatenate([[0], classes_of(text.lower()), [0]])
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 20_000 else 0
                    if len(c) <= 20_000:
                        np.add.at(total, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    grams = docs.select(text_col).mapInArrow(batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3)
    for r in grams.collect():  # bounded by the number of trigrams
        counts[r.gram] = r.n
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -ln P(c | a, b) as an array indexed [a, b, c]: trigrams smoothed by bigrams, these by single characters."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    one = (tri.sum(axis=(0, 1)) + 1) / (tri.sum() + CLASSES)
    two = (tri.sum(axis=0) + 20 * one) / (tri.sum(axis=(0, 2))[:, None] + 20)
    three = (tri + 5 * two) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings it may stand for, with their channel costs."""
    columns, at = [], 0
    while at < len(word):
        c, to = word[at], at
        while to < len(word) and word[to] == c:
            to += 1
        n, options = to - at, []
        for letter, cost in [(c, 0.0)] * c.isalpha() + [(x, SUBSTITUTED) for x in LEET.get(c, "")]:
            options += [(letter, cost), (letter * 2, cost + (0 if n == 2 else DOUBLED))] if n > 1 else [(letter, cost)]
        if not c.isalpha():
            options.append(("", DROPPED))
        columns.append(options)
        at = to
    return columns


def best_path(columns: list[list[tuple[str, float]]], costs: np.ndarray) -> str:
    """The best path through a lattice, a column of options after the other. A state is the last two characters' classes; of equal paths the first found counts."""
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    for options in columns:
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, path) in states.items():
            for emitted, channel in options:
                x, y, total = a, b, cost + channel
                for c in emitted:
                    k = _CLASS.get(c, 0 if c == " " else OTHER)
                    total += costs[x, y, k]
                    x, y = y, k
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, emitted))
        states = after
    path = min(((cost + costs[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
    said = []
    while path:
        path, emitted = path
        said.append(emitted)
    return "".join(reversed(said))


def decode(word: str, costs: np.ndarray) -> str:
    """The best path through the word's lattice."""
    return best_path(lattice(word), costs)


_CLASS = {c: k + 1 for k, c in enumerate(LETTERS)}


class Restorer:
    """Words of a text, disguised ones restored. Remembers words in two generations."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def word(self, raw: str) -> str:
        """``raw`` is lower-case. Edges that are only punctuation go; what is all letters, with no letter three times, is itself."""
        core = raw
        if not core.isalpha():
            core = _EDGES.sub("", _EDGES.sub("", core))
        if not core or (core.isalpha() and not _RUN.search(core)):
            return core
        if not any(c.isalpha() for c in core) and not re.fullmatch(r"[^\W_]*[@$!|][\w@$!|]*", core):
            return ""
        return decode(core, self.costs)

    def words(self, text: str) -> list[str]:
        raw = text.lower().split()
        young, old, out = self.young, self.old, []
        for w in raw:
            r = young.get(w)
            if r is None:
                r = old.get(w)
                young[w] = r = self.word(w) if r is None else r
            out.append(r)
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out + self.spelled(raw)

    def spelled(self, raw: list[str]) -> list[str]:
        """Words spelled out in pieces of one or two characters, at least three of them: ``i d 1 o t``, ``id io t,``.

        A run of short pieces is one lattice, in which each space between two may stand or have been put in, so that the model finds where words begin and end.
        """
        out, run = [], []
        for w in [*raw, "   "]:
            core = w.rstrip(_TRAILING) or w
            if len(core) <= 2:
                run.append(core)
            if len(core) > 2 or core != w:  # a mark ends a run, as a longer word does
                if len(run) > 2:
                    out += self.joined(run)
                run = []
        return out

    def joined(self, run: list[str]) -> list[str]:
        """The words that a run of short pieces makes, where pieces were put together."""
        key = " ".join(run)
        said = self.young.get(key) if len(run) <= 8 else None
        if said is None:
            columns: list = []
            for piece in run:
                columns += [[(" ", 0.0), ("", GLUED)]] * bool(columns) + lattice(piece)
            said = best_path(columns, self.costs)
            if len(run) <= 8:
                self.young[key] = said
        return [w for w in said.split() if len(w) > 2]


def features_of(word: str) -> list[str]:
    """The word, a long one by a digest of all its letters, and its beginnings."""
    n = len(word)
    whole = f"={word}" if n <= 24 else f"#{hashlib.blake2b(word.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"
    return ([whole] if n >= 3 else []) + [word[:k] for k in (4, 5, 6, 7, 8) if n > k]


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the CRC-32 of the id as text, which no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float]
    coefficients: np.ndarray


def evidence(words: list[str], weights: dict[str, float], known: dict[str, float]) -> tuple[float, float, float, float]:
    """Largest weight of a word, sum of the five largest, number of strong words, and the log of the length. A word's weight is its best feature's."""
    found: dict[str, float] = {}
    for w in set(words):
        best = known.get(w)
        if best is None:
            best = known[w] = max((weights.get(f, 0.0) for f in features_of(w)), default=0.0)
        if best > 0:
            found[w] = best
    if len(known) > REMEMBERED:
        known.clear()
    top = sorted(found.values(), reverse=True)[:5]
    return (top[0] if top else 0.0, sum(top), float(sum(v > 3 for v in found.values())), math.log1p(len(words)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The character model of all ``docs``, and weights from the labelled ones.

    At most ``max_labelled`` labels, those of smallest hash, are used. The logistic function is fitted on evidence
    by the word weights of the other half of their documents, so that no document's own label is in it; the model keeps the weights of both halves. An id labelled twice counts once, as toxic if either label is; of several texts of an id the one of smallest hash is learnt from. Without labels of both kinds the score is their smoothed share.
    """
    spark = docs.sparkSession
    costs = language_model(character_counts(docs, text_col))
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = materialize(one.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_labelled), "labels")
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(sample.withColumn("half", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(2)).cast("int")).repartition(12), "sample")
    sizes = {(r.half, r.y): r.n for r in sample.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(sizes.get((h, y), 0) for h in (0, 1)) for y in (1, 0))
    if any(not sizes.get((h, y)) for h in (0, 1) for y in (0, 1)):
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Model(costs, {}, np.array([0, 0, 0, 0, math.log(share / (1 - share))]))
    costs_sent = spark.sparkContext.broadcast(costs)

    def counted(only: set[str] | None):
        def batches(it):
            restorer = Restorer(costs_sent.value)
            for batch in it:
                n: dict[tuple[str, int], int] = {}
                for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = {f for w in set(restorer.words(text)) for f in features_of(w)}
                    for f in seen if only is None else seen & only:
                        n[f, half] = n.get((f, half), 0) + 1
                yield pa.record_batch([pa.array([f for f, _ in n], pa.string()), pa.array([h for _, h in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["f", "half", "n"])

        return batches

    def by_half(y: int, only: set[str] | None) -> DataFrame:
        found = sample.where(F.col("y") == y).select("text", "half").mapInArrow(counted(only), "f string, half int, n long")
        return found.groupBy("f").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)))

    total = F.col("n0") + F.col("n1")
    bad = {r.f: (r.n0, r.n1) for r in by_half(1, None).where(total >= LEAST).collect()}  # of at most `max_labelled` texts, a third of their features at most
    good = {r.f: (r.n0, r.n1) for r in by_half(0, set(bad)).collect()}

    def weights_from(halves: tuple[int, ...]) -> dict[str, float]:
        n_bad, n_good = (sum(sizes[h, y] for h in halves) for y in (1, 0))
        out = {}
        for f, each in bad.items():
            a, b = sum(each[h] for h in halves), sum(good.get(f, (0, 0))[h] for h in halves)
            sure = math.log((a + 0.5) / (n_bad + 1)) - math.log((b + 0.5) / (n_good + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if sure > 0.7:
                out[f] = sure
        return out

    other = {0: weights_from((1,)), 1: weights_from((0,))}

    def rows(it):
        restorer, known = Restorer(costs_sent.value), ({}, {})
        for batch in it:
            out = [(float(y), *evidence(restorer.words(t), other[h], known[h])) for t, y, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.float64())] * 5, list("yabcd"))

    data = np.array(sample.select("text", "y", "half").mapInArrow(rows, "y double, a double, b double, c double, d double").collect())
    data = data[np.lexsort(data.T[::-1])]  # so that the sums don't depend on the order of rows
    return Model(costs, weights_from((0, 1)), _logistic(data[:, 1:], data[:, 0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with ``score``, or another ``name``, from 0 to 1. Null texts count as empty, and an empty text gets the score of a text without evidence. A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labels that features come from, and the number of trigrams

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = sent.value
        restorer, known = remembered(("toxicity", id(m)), lambda: (Restorer(m.costs), {}))
        x = np.array([[*evidence(restorer.words(t or ""), m.weights, known), 1.0] for t in texts]).reshape(-1, 5)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ m.coefficients, -30, 30))))

    return docs.withColumn(name, scored(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with the columns of ``docs`` as they are."""
    (name,) = fresh(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)
