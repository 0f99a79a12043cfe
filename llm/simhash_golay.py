"""SimHash near-duplicates: fingerprints joined through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 23, 23 and 18 bits. Two fingerprints that differ in at most
two bits leave, by the pigeonhole principle, one segment equal and, in the cyclic order of segments, one equal
segment whose successor has at most one error. A key is therefore an exact segment joined with a fuzzy value of
its successor. The fuzzy values come from the perfect binary Golay code (23, 12, 7): a segment is decoded to the
index of its codeword, and so are its one-bit neighbours. A word within distance 2 of its codeword yields one index,
a word at distance 3 yields six; segments at distance one always share an index.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._common import connected_components, discard, join_counted, materialize, remembered

#: Widths of the segments, from the lowest bit.
SEGMENTS = (23, 23, 18)
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the Golay code.
GENERATOR = 0b110001110101
#: Most distinct fingerprints of one key that are compared in pairs. Larger groups are linked through shared one-bit neighbours,
#: which is exact as well.
PAIRED = 32


def _remainder(word: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder modulo the generator."""
    left = word.astype(np.uint32)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ np.uint32(GENERATOR << (bit - 11)), left)
    return left


@cache
def _errors() -> np.ndarray:
    """The error pattern, of at most three bits, of each of the 2048 syndromes."""
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
    words = np.array(patterns, dtype=np.uint32)
    table = np.zeros(2048, dtype=np.uint32)
    table[_remainder(words)] = words
    return table


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the only codeword within distance 3 of each 23-bit word."""
    return (words.astype(np.uint32) ^ _errors()[_remainder(words)]) >> 11


def fuzzy_keys(words: np.ndarray, width: int) -> np.ndarray:
    """A row for each word: its own index and those of its neighbours in the low ``width`` bits."""
    flips = np.array([0, *(1 << b for b in range(width))], dtype=np.uint32)
    return golay_index(words.astype(np.uint32)[:, None] ^ flips[None, :])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, in blocks, so that the bits of a very long text stay small."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 20_000):
        block = np.ascontiguousarray(hashes[at : at + 20_000]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; zero without hashes."""
    return int(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the whole text: the majority of its shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8", count=n))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Fingerprint of every row: ``id``, a hash ``text_print`` of the text, and ``fp``, a signed long of the 64 bits. Null or empty text: zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it):
        remembered("nothing")
        for batch in it:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["id", "text_print", "fp"])

    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col).cast("binary")).mapInArrow(batches, f"id {kind}, text_print long, fp long")


def _keys(batches):
    """``key``, ``fp`` for every fuzzy key of distinct fingerprints."""
    for pdf in batches:
        fp = pdf["fp"].to_numpy().astype(np.int64)
        bits, at, parts = fp.view(np.uint64), 0, []
        for width in SEGMENTS:
            parts.append((bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint64))
            at += width
        out = []
        for k, own in enumerate(parts):
            after = (k + 1) % len(parts)
            fuzzy = np.sort(fuzzy_keys(parts[after], SEGMENTS[after]), axis=1)
            first = np.ones_like(fuzzy, dtype=bool)
            first[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
            row, col = np.nonzero(first)
            key = np.uint64(k) << np.uint64(60) | own[row] << np.uint64(12) | fuzzy[row, col].astype(np.uint64)
            out.append(pd.DataFrame({"key": key.view(np.int64), "fp": fp[row]}))
        yield pd.concat(out)


def _close(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` that connect all those at distance 2 or less.

    Not every such pair gets an edge, but any such pair is connected by edges of distance 2 or less. Keys with up
    to ``paired`` fingerprints are compared in pairs and verified. The fingerprints of larger ones are grouped by all
    their one-bit neighbours: a group's members are within two bits of each other, so a star joins them.
    """
    keys = materialize(prints.mapInPandas(_keys, "key long, fp long"), "golay")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"))
    few = keys.join(counted.where((F.col("n") > 1) & (F.col("n") <= paired)).select("key"), "key")
    pairs = (
        few.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select("fps", F.posexplode("fps").alias("i", "a"))
        .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
        .where(_close("a", "b", 2)).distinct()
    )
    many = keys.join(counted.where(F.col("n") > paired).select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    near = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    hub = near.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b != top").select("centre", "b")
    stars = near.join(hub, "centre").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    out = materialize(pairs.unionByName(stars), "golay_links")
    discard(keys)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``id``, ``text_print``, ``fp``, ``root``, ``component_id`` of every row."""
    prints = materialize(simhash(docs, id_col, text_col, shingle, seed), "simhash")
    first = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "fingerprints")
    roots = connected_components(links(first.select("fp")))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    owner = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(rooted.join(owner, "root").select("fp", "root", "component_id", "rows"), "simhash_classes")
    return join_counted(prints, classes, ["fp"], "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` of every row.

    Fingerprints link at two or fewer differing bits; the component's id is the smallest id reachable, the row's own included.
    Null and empty texts have fingerprint zero and link like others. Rows with a null id get the component's smallest
    id, null if it has none. Repeated rows stay, each with the same result; an empty table gives an empty result; columns other than
    the two named are ignored.
    """
    return _classes(docs, id_col, text_col, shingle, seed).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, similar: bool = False) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id, null last, and then of the smallest hash of the text. All columns stay as they are.

    Documents link by their fingerprints' bits; with ``similar`` by a Jaccard similarity of 4/5 or more, for which fingerprints only propose. Texts under one id, or without
    an id, are judged each by itself; rows that repeat id and text are one document. An empty table gives no rows.
    """
    from llm import shingle_jaccard as jaccard

    if similar:
        return jaccard.drop_similar(docs, id_col, text_col, shingle)
    return jaccard.keep_one(docs, _classes(docs, id_col, text_col, shingle, seed), id_col, text_col)
