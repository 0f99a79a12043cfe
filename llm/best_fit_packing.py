"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie; only the pieces' lengths move. Pieces are dealt by hash into
groups of bounded size, and each group is packed on its own: longest piece first, into the open sequence with the
least room that still holds it. A segment tree over the possible remaining capacities finds that sequence
in a number of steps logarithmic in the sequence length.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._common import materialize, remembered

#: Pieces in a packing group, about. A group wastes about one sequence, that is one in a thousand.
GROUP = 8192
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Bytes of text that are encoded in one go.
BLOCK = 8 << 20
_MARKS = frozenset(".,;:!?")


class WordEncoder:
    """Ids of a text, from the remembered ids of its words.

    For tokenizers that split at white space and drop it, so that a word's ids don't depend on its neighbours.
    Words are cut at the ASCII white space only; rarer white space is left to the tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.young, self.old = remembered, {}, {}
        ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.ends = np.zeros(max(ends, default=0) + 2, dtype=bool)
        self.ends[list(ends)] = True

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """A word as lower-cased letters and one mark after them, which the tokenizer cuts too; other words stay whole."""
        low = word if "\u03a3" in word else word.lower()
        core, tail = (low[:-1], low[-1]) if low[-1:] in _MARKS and len(low) > 1 else (low, "")
        return (core, tail) if core.isalpha() and core.lower().isalpha() else (word, "")

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of letters are encoded in one go and told apart by the ids that end a word."""
        parts = [self._parts(w) for w in words]
        known: dict[str, bytes] = {"": b""}
        need = []
        for w in {p for both in parts for p in both}:
            ids = self.young.get(w) or self.old.get(w)
            if ids:
                known[w] = ids
            elif w:
                need.append(w)
        plain = [w for w in need if w.isalpha()]
        for at in range(0, len(plain), 500):
            block = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode(" ".join(block), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) == len(block):
                known.update(zip(block, (ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        rest = [w for w in need if w not in known]
        known.update(zip(rest, self._single(rest), strict=True))
        self.young.update((w, known[w]) for w in need)
        return [known[core] + known[tail] for core, tail in parts]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each of the different words, remembered or encoded."""
        found = list(map(self.young.get, words))
        missed = [k for k, ids in enumerate(found) if ids is None]
        seen = [self.old.get(words[k]) for k in missed]
        lost = [words[k] for k, ids in zip(missed, seen, strict=True) if ids is None]
        encoded = iter(self._encode(lost) if lost else ())
        for k, ids in zip(missed, seen, strict=True):
            found[k] = self.young[words[k]] = next(encoded) if ids is None else ids
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and each followed by ``end_id``, and the bounds of each. Null counts as empty.

        Texts are cut into words and the words numbered by Arrow; Python sees each different word of the block once.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = np.asarray(cut.offsets)
        numbered = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        gc.disable()  # many small objects and no cycles: the collector would only walk the remembered words again and again
        try:
            known = self._known(numbered.dictionary.to_pylist())
        finally:
            gc.enable()
        known.append(b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes())
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        at = np.cumsum(size) - size
        ends = bounds[1:] - bounds[0]
        codes = np.insert(np.asarray(numbered.indices), ends, len(known) - 1)
        own = size[codes]
        after = np.cumsum(own)
        kind = np.int32 if (len(after) == 0 or after[-1] < 1 << 31) and at[-1] < 1 << 31 else np.int64  # half the memory to walk, in all but huge texts
        places = np.repeat((at[codes] - after + own).astype(kind), own)
        places += np.arange(len(places), dtype=kind)
        return np.frombuffer(b"".join(known), dtype="<u4")[places], np.concatenate([[0], after[ends + np.arange(len(ends))]]).astype(np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        flat, bounds = self.encode(pa.array(texts, pa.large_string()))
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _blocks(texts: pa.Array) -> list[tuple[int, int]]:
    """First row and number of rows of blocks of about ``BLOCK`` bytes of text; a longer text is a block of its own."""
    before = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    cuts = np.flatnonzero(np.diff(before // BLOCK)) + 1 if len(before) else np.empty(0, dtype=np.int64)
    edges = [0, *cuts.tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of the documents' pieces; only documents longer than ``length`` have several."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        encoder = remembered(("packing", tokenizer), lambda: WordEncoder(tokenizer))
        for whole in it:
            for at, n in _blocks(whole.column(1)):
                batch = whole.slice(at, n)
                flat, bounds = encoder.encode(batch.column(1), end_id)
                per = -(-np.diff(bounds) // length)
                owner = np.repeat(np.arange(n), per)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * length
                size = np.minimum(length, np.diff(bounds)[owner] - start)
                first = bounds[owner] + start
                crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(batches, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, placed in the order given into the tightest open bin, or a new one.

    ``tree`` is a segment tree over remaining capacities, telling whether an open bin with one in that range exists.
    """
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    stacks: list[list[int]] = [[] for _ in range(size)]
    bins, offsets, opened = [], [], 0

    def count(room: int, by: int) -> None:
        at = room + size
        while at:
            tree[at] += by
            at >>= 1

    for n in lengths:
        at = n + size
        if not tree[at]:  # climb to the first subtree on the right with an open bin, then go down to its left-most one
            while at and not (at & 1 == 0 and tree[at + 1]):
                at >>= 1
            at += bool(at)
            while 0 < at < size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        if at:
            room = at - size
            chosen = stacks[room].pop()
            count(room, -1)
        else:
            room, chosen = capacity, opened
            opened += 1
        bins.append(chosen)
        offsets.append(capacity - room)
        if room > n:
            stacks[room - n].append(chosen)
            count(room - n, 1)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: their place in sequences of at most ``length`` tokens, without gaps.

    Null text counts as empty, so such a document is the end id alone. Rows with equal or null ids are packed each on its own.
    An empty table gives no rows. Other columns of ``docs``, those named like the result's included, are ignored. Pieces are dealt to groups by their contents and their
    place in the table of pieces, so that rows that repeat each other don't meet in one group.
    """
    cut = materialize(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    n = cut.count()
    groups = max(1, -(-n // group))
    salted = cut.withColumn("_group", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].tolist(), length)
        pdf["sequence_id"] = np.array(bins, dtype=np.int64) * groups + int(key[0])
        pdf["offset"] = np.array(offsets, dtype=np.int64)
        return pdf

    kind = cut.schema["id"].dataType.simpleString()
    out = salted.groupBy("_group").applyInPandas(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, _group long, sequence_id long, offset long")
    return out.drop("_group").withColumnRenamed("id", id_col)
