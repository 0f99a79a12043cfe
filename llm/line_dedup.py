"""Line deduplication by a deletion-neighbourhood join.

Two lines are near-duplicates if one word inserted, deleted or replaced makes them equal, or if they are equal. Every distinct line emits the hash of
itself and of each variant with one word deleted. Lines that share a variant with the deletion at the same place are one replacement apart; a line that
equals another's variant is one deletion apart. So the earliest line of each equal key is found by aggregation alone, in time linear in the
keys, and no pairs of a group are made. The word edit distance of a line and that earliest line is then verified.

Most lines have no near-duplicate, and are put aside before variants are emitted: near-duplicates agree on the first or on the last half of their words, so that a line
whose halves occur nowhere else needs no variants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._common import discard, fresh, join_counted, materialize, remembered

#: Lines with fewer words have no neighbourhood, so that one edit leaves at least four fifths of a line. Equality counts for all lines with a word.
LEAST = 5


def word_edit_at_most_one(a: list, b: list) -> bool:
    """Whether the word edit distance is 0 or 1."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k + (len(short) == len(long)) :] == long[k + 1 :]


def _digest(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 1)


def halves(words: list[bytes]) -> list[int]:
    """Keys that near-duplicates share one of: the first and the last words, as many as half of the shorter line of a pair, for either length that this may have."""
    out = []
    for shorter in (len(words) - 1, len(words)):
        k = shorter // 2
        out += [xxhash.xxh64_intdigest(b" ".join(part), 2 * shorter + side) for side, part in enumerate((words[:k], words[-k:]))]
    return out


#: An odd number and its inverse modulo 2^64. A line's hash is the sum of its words' hashes, each times the number to the power of its place.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line itself, which comes first, and of each variant with one word deleted, in time linear in the words."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    powers = np.full(len(words), BASE, dtype=np.uint64)
    powers[:1] = 1
    before = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(own * np.cumprod(powers), out=before[1:])
    return np.concatenate([before[-1:], before[:-1] + (before[-1] - before[1:]) * np.uint64(INVERSE)])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _lines(docs: DataFrame) -> DataFrame:
    """``id, print, line, h, keys``: each line with a word, its hash and the keys of its halves, none if it is short."""

    def batches(it):
        remembered("nothing")
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, lines, hashes, keys, ends = [], [], [], [], [0]
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for k, line in enumerate((text or b"").split(b"\n")):
                        words = line.split()
                        if words:
                            rows.append(row)
                            lines.append(k)
                            hashes.append(_digest(words))
                            keys += halves(words) if len(words) >= LEAST else []
                            ends.append(len(keys))
                taken = pa.array(rows, pa.int64())
                offsets = pa.array(ends, pa.int32())
                yield pa.record_batch(
                    [batch.column("id").take(taken), batch.column("print").take(taken), pa.array(lines, pa.int32()), _signed(hashes), pa.ListArray.from_arrays(offsets, _signed(keys))],
                    ["id", "print", "line", "h", "keys"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"id {kind}, print long, line int, h long, keys array<long>")


def _variants(lines: DataFrame) -> DataFrame:
    """``h, key, place`` of each line's deletions and of the line itself."""

    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [variants(t.split()) for t in batch.column(1).to_pylist()]
                sizes = [len(m) for m in made]
                places = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes])
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.concatenate(made).view(np.int64)), pa.array(places)], ["h", "key", "place"])

    return lines.select("h", "content").mapInArrow(batches, "h long, key long, place int")


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_edit_at_most_one(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype=bool)


def near_lines(contents: DataFrame) -> DataFrame:
    """``h`` of every distinct line that has an earlier one within one word edit, for ``h``, ``pos`` and ``content``.

    ``pos`` orders the lines. The witness is the earliest line of an equal key, and its distance is verified. A key that very many lines share is
    brought together with its earliest lines in parts.
    """
    made = materialize(_variants(contents), "variants")
    shared = materialize(made.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "shared_keys")
    some = materialize(join_counted(made, shared, ["key"], "rows").join(contents.select("h", "pos"), "h").select("h", "key", "place", F.struct("pos", "h").alias("me")), "shared")
    discard(made, shared)
    of_place = materialize(some.groupBy("key", "place").agg(F.min("me").alias("at_place"), F.count("*").alias("rows")), "places")
    earliest = lambda on: F.min(F.when(on, F.col("at_place")))
    of_key = of_place.groupBy("key").agg(earliest(F.col("place") < 0).alias("itself"), earliest(F.col("place") >= 0).alias("shortened"), F.sum("rows").alias("rows"))
    of_key = materialize(of_key, "keys")
    witness = F.when(F.col("place") < 0, F.col("shortened")).otherwise(F.least("itself", "at_place"))
    told = join_counted(join_counted(some, of_place, ["key", "place"], "rows"), of_key, ["key"], "rows").withColumn("witness", witness).where("witness.pos < me.pos")
    pairs = told.select("h", F.col("witness.h").alias("other")).distinct()
    texts = contents.select("h", "content")
    both = pairs.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("content").alias("_other")), "other")
    near = materialize(both.where(F.pandas_udf(_near, "boolean")("content", "_other")).select("h").distinct(), "near_lines")
    discard(some, of_place, of_key)
    return near


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with duplicate lines taken out of the text, and ``n_lines`` and ``n_removed``.

    Lines end at ``\\n``; words are separated by ASCII white space. A line goes if an earlier line, kept or not, of its own or another
    document has equal words, or if both have at least five words and are within one word edit; documents are in the order of their ids, null last, then of a hash of the text.
    Lines without words stay.
    Null text stays null, with no lines; a text whose lines are all removed becomes empty. Rows that repeat an id and a text count as one document
    and are treated alike. Other columns stay; those named ``n_lines`` and ``n_removed`` are replaced. An empty table gives no rows.
    """
    ident, print_of, gone_of, by_id, by_print = fresh(docs, "id", "print", "gone", "i", "p")
    named = docs.withColumn(ident, F.col(id_col)).withColumn(print_of, F.xxhash64(F.col(text_col)))
    slim = named.select(F.col(ident).alias("id"), F.col(print_of).alias("print"), F.col(text_col).cast("binary").alias("text"))
    where = F.struct(F.col("id").isNull().alias("last"), "id", "print", "line").alias("pos")
    lines = materialize(_lines(slim), "lines")
    first = materialize(lines.groupBy("h").agg(F.min(where).alias("pos"), F.count("*").alias("rows")), "first")
    keyed = lines.select("h", F.explode("keys").alias("key"))
    common = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("rows")).where("a != b").select("key", "rows")
    common = materialize(common, "common_halves")
    doubtful = join_counted(keyed, common, ["key"], "rows").select("h").distinct()
    listed = first.join(doubtful, "h").groupBy("pos.id", "pos.print").agg(F.collect_list(F.struct(F.col("pos.line").alias("line"), "h", "pos")).alias("which"))
    found = slim.join(listed, (slim["print"] == listed["print"]) & slim["id"].eqNullSafe(listed["id"])).select(F.split(F.col("text").cast("string"), "\n").alias("split"), F.explode("which").alias("w"))
    contents = materialize(found.select("w.h", "w.pos", F.get("split", F.col("w.line")).cast("binary").alias("content")).dropDuplicates(["h"]), "contents")
    near = near_lines(contents)
    fate = first.join(near.withColumn("near", F.lit(True)), "h", "left").select("h", F.col("pos").alias("kept"), F.coalesce("near", F.lit(False)).alias("near"), "rows").where("near or rows > 1")
    fate = materialize(fate, "fate")
    gone = join_counted(lines.select("h", where), fate, ["h"], "rows").where("near or pos != kept")
    by_doc = gone.groupBy(F.col("pos.id").alias(by_id), F.col("pos.print").alias(by_print)).agg(F.collect_set("pos.line").alias(gone_of))
    by_doc = materialize(by_doc, "gone")
    discard(lines, first, common, contents, near, fate)
    out = named.join(by_doc, (F.col(print_of) == F.col(by_print)) & F.col(ident).eqNullSafe(F.col(by_id)), "left").drop(by_id, by_print)
    split = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(split, lambda x, k: ~F.array_contains(F.col(gone_of), k)), "\n")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.coalesce(F.size(split), F.lit(0))).cast("long")
    out = out.withColumns({"n_lines": n_lines, "n_removed": F.coalesce(F.size(gone_of), F.lit(0)).cast("long")})
    return out.withColumn(text_col, F.when(F.col("n_removed") > 0, kept).otherwise(F.col(text_col))).drop(ident, print_of, gone_of)
