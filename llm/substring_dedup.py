"""Removal of passages that an earlier document has: every window of 50 words that also starts in a document of a smaller id.

Recurring passages are confirmed first. Windows are grouped by their minimiser, the 8-word phrase of smallest hash in them, so that equal windows always meet under
one phrase. Consecutive windows with one minimiser make up a segment. Equal segments are settled whole by their hash: all but the earliest document's recur. Only where a
phrase has several different segments are the windows of one segment of each kind compared, by hash. So one row is shuffled for about 22 words, and
copies meet as one row: no group of copies is gathered. Neighbouring finds with one owner are joined to one passage, and the owner's words are fetched for it.

Then Aho-Corasick automata locate them. An automaton over all passages would outgrow an executor, and streaming every document through each shard of one would cost time in the
square of the input. So shards follow the documents: each block of documents gets the automaton of the passages that were confirmed for it, all documents stream
through their block's automaton once, and its size is bounded by its block's. Automata run on whole words, numbered within the block, so that what is removed was
found word for word; hashes only propose.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm._common import discard, join_counted, materialize

#: Words of a phrase.
PHRASE = 8
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Word hashes of a text, and hashes of its stretches in constant time each."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=self.n)
        self.before = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(own * _powers(BASE, self.n), out=self.before[1:])
        self.back = _powers(INVERSE, self.n + 1)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.before[end] - self.before[start]) * self.back[start] + (end - start).astype(np.uint64))


def segments(words: list[bytes], window: int = 50) -> list[np.ndarray]:
    """Phrase hash, segment hash, first window and number of windows of each segment; nothing if the text has no window."""
    n = len(words) - window + 1
    if n < 1:
        return [np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int32, np.int32)]
    hashed = Hashed(words)
    at = np.arange(len(words) - PHRASE + 1)
    phrases = hashed.stretches(at, at + PHRASE)
    # the left-most of the smallest: the place breaks ties
    low, width, span = (phrases & ~_PLACE) | (at.astype(np.uint64) & _PLACE), 1, window - PHRASE + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, n))
    place = first + ((low[first] - first.astype(np.uint64)) & _PLACE).astype(np.int64)
    return [phrases[place], hashed.stretches(first, first + count + window - 1), first.astype(np.int32), count.astype(np.int32)]


def _segment_rows(docs: DataFrame, window: int) -> DataFrame:
    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [segments(t.split(), window) for t in batch.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
                own = [np.concatenate([m[k] for m in made]) if made else np.empty(0, np.int64) for k in range(4)]
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.view(np.int64)) for x in own[:2]), *(pa.array(x.astype(np.int32)) for x in own[2:])],
                    ["id", "print", "phrase", "segment", "start", "n"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"id {kind}, print long, phrase long, segment long, start int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``phrase, id, print, begin, w``: a row for each window of the segments listed in ``which``."""
    kind = docs.schema["id"].dataType.simpleString()

    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                out = [[] for _ in range(4)]
                for k, (text, which) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    hashed = Hashed(text.split())
                    for s in which:
                        begin = np.arange(s["start"], s["start"] + s["n"])
                        own = (np.full(s["n"], s["phrase"]), np.full(s["n"], k), begin, hashed.stretches(begin, begin + window).view(np.int64))
                        for col, x in zip(out, own, strict=True):
                            col.append(x)
                flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
                rows = pa.array(flat[1].astype(np.int64))
                yield pa.record_batch([pa.array(flat[0]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(flat[2].astype(np.int32)), pa.array(flat[3])], ["phrase", "id", "print", "begin", "w"])

    return docs.mapInArrow(batches, f"phrase long, id {kind}, print long, begin int, w long")


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """``owner, owner_print, owner_start, n, words``: the words of the passages listed in ``which``, joined by one space."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["owner", "owner_print", "owner_start", "n", "words"]

    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, 50):
                batch = whole.slice(at, 50)
                rows, starts, counts, found = [], [], [], []
                for k, (text, which) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    words = text.split()
                    for s in which:
                        rows.append(k)
                        starts.append(s["owner_start"])
                        counts.append(s["n"])
                        found.append(b" ".join(words[s["owner_start"] : s["owner_start"] + s["n"] + window - 1]))
                place = pa.array(rows, pa.int64())
                yield pa.record_batch([batch.column(0).take(place), batch.column(1).take(place), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(found, pa.binary())], names)

    return docs.mapInArrow(batches, f"owner {kind}, owner_print long, owner_start int, n int, words binary")


class Automaton:
    """Aho-Corasick over passages, each with the smallest id among its owners; words are numbered as they first occur in a passage."""

    def __init__(self, owners: dict):
        self.numbers: dict = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for passage, owner in owners.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in passage.split())
            self.found.add_word(key, (len(key), owner))
        self.found.make_automaton()

    def covered(self, words: list[bytes], ident) -> np.ndarray | None:
        """Which words a passage of a document before ``ident`` covers; None if no word."""
        steps = None
        for end, (n, owner) in self.found.iter(tuple(self.numbers.get(w, 0) for w in words)):
            if owner < ident:
                steps = np.zeros(len(words) + 1, dtype=np.int64) if steps is None else steps
                steps[end + 1 - n] += 1
                steps[end + 1] -= 1
        return None if steps is None else np.cumsum(steps)[:-1] > 0


def _cut(docs: DataFrame, block: int) -> DataFrame:
    """Streams each block of documents through the automaton of its passages and leaves out what they cover."""
    kind = docs.schema["id"].dataType.simpleString()

    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                owners: dict = {}
                listed = batch.column(2).to_pylist()
                for p in (p for ps in listed for p in ps or ()):
                    owners[p["words"]] = min(p["owner"], owners.get(p["words"], p["owner"]))
                automaton = Automaton(owners) if owners else None
                n_words, n_removed, kept = [], [], []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = (text or b"").split()
                    gone = automaton.covered(words, ident) if automaton and words and ident is not None else None
                    n_words.append(len(words))
                    n_removed.append(0 if gone is None else int(gone.sum()))
                    kept.append(b" ".join(words if gone is None else (w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
                yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(batches, f"id {kind}, n_words long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = 50, block: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept`` of every row; ``kept`` is the UTF-8 text of the words left, joined by one space.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; what is left of earlier documents plays no part.
    ``block`` documents at most share an automaton. Null and empty texts have no words. Rows without an id keep all words and count for none. Rows that repeat an id aren't held against each other. An empty
    table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).cast("binary").alias("text"))
    rows = materialize(_segment_rows(slim.where("id is not null and text is not null"), window), "segments")
    kinds = rows.groupBy("phrase", "segment").agg(F.min(F.struct("id", "print", "start", "n")).alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
    kinds = materialize(kinds, "kinds")
    owner = ("owner", "owner_print", "owner_start")
    copies = materialize(kinds.where("last > first.id").select("phrase", "segment", *(F.col(f"first.{c}").alias(o) for c, o in zip(("id", "print", "start"), owner)), "rows"), "copies")
    whole = join_counted(rows, copies, ["phrase", "segment"], "rows", salt=F.xxhash64("id", "print", "start")).where("id > owner").select("id", "print", "start", "n", *owner)
    several = kinds.groupBy("phrase").agg(F.count("*").alias("kinds"), F.min("first.id").alias("a"), F.max("first.id").alias("b")).where("kinds > 1 and a != b").select("phrase")
    mixed = kinds.join(several, "phrase").select("phrase", "first.*")
    listed = mixed.groupBy("id", "print").agg(F.collect_list(F.struct("phrase", "start", "n")).alias("which"))
    texts = slim.dropna(subset=["id", "text"])
    made = texts.join(listed, ["id", "print"]).select("id", "print", "text", "which")
    windows = materialize(_windows(made, window), "windows")
    first = F.min(F.struct(F.col("id").alias("owner"), F.col("print").alias("owner_print"), F.col("begin").alias("owner_start"))).alias("first")
    owners = windows.groupBy("phrase", "w").agg(first, F.max("id").alias("top"), F.count("*").alias("rows")).where("first.owner != top")
    owners = materialize(owners.select("phrase", "w", "first.*", "rows"), "owners")
    partly = join_counted(windows, owners, ["phrase", "w"], "rows", salt=F.xxhash64("id", "print", "begin")).where("owner < id").select("id", "print", F.col("begin").alias("start"), F.lit(1).alias("n"), *owner)
    wanted = materialize(_joined(whole.unionByName(partly)), "wanted")
    discard(rows, kinds, copies, windows, owners)
    counted = wanted.groupBy(*owner, "n").agg(F.count("*").alias("rows"))
    asked = wanted.select(*owner, "n").distinct().groupBy(F.col("owner").alias("id"), F.col("owner_print").alias("print")).agg(F.collect_list(F.struct("owner_start", "n")).alias("which"))
    words = _passages(texts.join(asked, ["id", "print"]).select("id", "print", "text", "which"), window).dropDuplicates([*owner, "n"])
    # by id alone: the automaton finds a passage in every text of the id, and again further on in one text
    found = join_counted(wanted, words, [*owner, "n"], "rows", counted).groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("owner", "words")).alias("passages"))
    both = slim.join(found, F.col("id") == F.col("_id"), "left").select("id", "text", "passages")
    return _cut(both, block)


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of windows that follow on each other in the document and in their owner, as one."""
    shift = F.col("start") - F.col("owner_start")
    keys = ["id", "print", "owner", "owner_print", "shift"]
    order = Window.partitionBy(*keys).orderBy("start")
    upto = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("shift", shift).withColumn("new", (F.coalesce(upto, F.lit(-1)) < F.col("start")).cast("int"))
    placed = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("upto"))
    return joined.select("id", "print", "owner", "owner_print", (F.col("start") - F.col("shift")).alias("owner_start"), (F.col("upto") - F.col("start")).alias("n"))
