"""Near-duplicates by the Jaccard similarity of word shingles: fingerprints propose first, and prefix filtering makes the result complete.

Two fingerprints of similar sets are close, but no bound on the bits is wide enough for all pairs of similarity 4/5 and narrow enough for keys: at that
similarity fingerprints of 64 bits differ in about ten bits, with a wide spread. So what SimHash and the Golay keys propose is verified and
linked, and what they miss is found by prefix filtering.

Two sets of similarity 4/5 or more share at least four fifths of either set. So, with all shingles in one order, they share one of the first n - ceil(4n/5) + 1
of each set of n: these are the keys, and no similar pair is without a common one. Any order is right. Rare shingles come first, as counted in a table of
hash buckets of bounded size, so that a passage which many documents have is rarely a key. Candidates are verified by their whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import simhash_golay as golay
from llm._common import connected_components, discard, fresh, join_counted, materialize, one_of_equals, remembered, union_all

SHINGLE = 5
#: How many hubs of a key are tried before all pairs that are left.
TURNS = 4
#: Hash buckets in which shingles are counted, and the pieces in which counts are summed.
BUCKETS, PIECE = 1 << 18, 1 << 13
BASE = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of lower-case words, in order and with repeats; a text of fewer words has one of all its words, one without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    out, power = np.zeros(n, dtype=np.uint64), 1
    for i in range(k):
        out += own[i : i + n] * np.uint64(power)
        power = power * BASE % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many documents' shingles fall into each bucket. A task sends one table, whatever its rows."""

    def count(batches):
        remembered("nothing")
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _bucket(shingles(text.as_py(), shingle)), 1)
        pieces = total.reshape(-1, PIECE)
        yield pa.record_batch([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "counts"])

    def add(key, pdf):
        return pd.DataFrame({"piece": [key[0]], "counts": [sum(np.frombuffer(c, dtype=np.int64) for c in pdf["counts"]).tobytes()]})

    made = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInPandas(add, "piece int, counts binary")
    out = np.zeros((BUCKETS // PIECE, PIECE), dtype=np.int64)
    for r in made.collect():
        out[r.piece] = np.frombuffer(r.counts, dtype=np.int64)
    return out.ravel()


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, one of which each set of similarity 4/5 has among its own rarest."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts[_bucket(hashes)]))[: n - (4 * n + 4) // 5 + 1]] if n else hashes


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _prints(docs: DataFrame, counts: np.ndarray, shingle: int) -> DataFrame:
    """``id``, ``text_print``, and of the set of shingles a hash ``print``, the size ``n``, the fingerprint ``fp`` and the keys."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max() < 1 << 31 else counts)

    def batches(it):
        remembered("nothing")
        for batch in (whole.slice(at, 500) for whole in it for at in range(0, whole.num_rows, 500)):
            keys, own, sizes, fps = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle)
                fps.append(golay.majority(hashes))
                each = np.unique(hashes)
                keys.append(prefix(each, shared.value))
                own.append(xxhash.xxh64_intdigest(each.tobytes(), 7))
                sizes.append(len(each))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.record_batch(
                [batch.column("id"), batch.column("text_print"), _signed(np.array(own, dtype=np.uint64)), pa.array(sizes, pa.int32()), _signed(np.array(fps, dtype=np.uint64)), pa.ListArray.from_arrays(offsets, _signed(np.concatenate(keys)))],
                ["id", "text_print", "print", "n", "fp", "keys"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"id {kind}, text_print long, print long, n int, fp long, keys array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``print`` and the whole ``set`` of shingles."""

    def batches(it):
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(t.as_py(), shingle) for t in batch.column("text")]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.record_batch([batch.column("print"), pa.ListArray.from_arrays(offsets, _signed(np.concatenate(sets)))], ["print", "set"])

    return texts.select("print", "text").mapInArrow(batches, "print long, set array<long>")


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, shingle: int, proposed: DataFrame | None = None) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have a Jaccard similarity of 4/5 or more, of rows ``a, b, na, nb``, one for each key of both, and of ``proposed`` pairs.

    Sets that share ``s`` keys share at most the ``n`` less its keys of the one whose keys end earlier besides, so that most pairs need no sets.
    """
    rest = lambda n: F.floor((4 * F.col(n) + 4) / 5) - 1
    able = 9 * (F.col("s") + F.greatest(rest("na"), rest("nb"))) >= 4 * (F.col("na") + F.col("nb"))
    few = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s")).where(able).select("a", "b")
    few = materialize(few if proposed is None else few.unionByName(proposed).distinct(), "pairs")
    wanted = few.select(F.col("a").alias("print")).union(few.select("b")).distinct()
    of_print = prints.select("print", "text_print").join(wanted, "print", "left_semi").groupBy("print").agg(F.min("text_print").alias("text_print"))
    sets = materialize(_sets(docs.select("text_print", "text").join(of_print, "text_print").dropDuplicates(["print"]), shingle), "shingle_sets")
    both = few.join(sets.select(F.col("print").alias("a"), F.col("set").alias("_a")), "a").join(sets.select(F.col("print").alias("b"), F.col("set").alias("_b")), "b")
    similar = materialize(both.where(9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b"), "similar")
    discard(few, sets)
    return similar


def _ordered(p: str, n: str, q: str, m: str) -> list[Column]:
    first = F.col(p) < F.col(q)
    return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.when(first, F.col(n)).otherwise(F.col(m)).alias("na"), F.when(first, F.col(m)).otherwise(F.col(n)).alias("nb")]


def _proposed(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of different sets that have one fingerprint, or fingerprints that Golay keys bring together."""
    each = materialize(prints.select("fp", "print").distinct(), "fingerprints")
    hubs = materialize(each.groupBy("fp").agg(F.min("print").alias("hub"), F.count("*").alias("rows")), "fingerprint_hubs")
    same = join_counted(each, hubs, ["fp"], "rows").where("print != hub").select("print", "hub")
    of = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"_{c}"))
    near = golay.links(hubs.select("fp")).join(of("a"), "a").join(of("b"), "b").select("_a", "_b").where("_a != _b")
    both = same.union(near)
    out = materialize(both.select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct(), "proposed")
    discard(each, hubs)
    return out


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of a hub, one of each key and class of sizes, with the key's sets of other components whose sizes may be similar.

    Rows are ``key, print, n, root, shares``. A set meets at most three hubs of a key, so there are about as many pairs as rows, however large a key is.
    The hub is the set with the most shared keys, as the original of many copies is, and on later turns any other one.
    """
    sized = rows.withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    order = F.struct("shares", "print", "n", "root") if not turn else F.struct(F.xxhash64("print", F.lit(turn)).alias("shares"), "print", "n", "root")
    hubs = sized.groupBy("key", "size").agg(F.max(order).alias("hub"), F.count("*").alias("rows"))
    offered = hubs.select("key", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "hub")  # sizes that differ by a quarter are at most one class apart
    offered = offered.groupBy("key", "size").agg(F.collect_set("hub").alias("hubs")).join(hubs.select("key", "size", "rows"), ["key", "size"])
    offered = materialize(offered, "shingle_hubs")
    met = join_counted(sized, offered, ["key", "size"], "rows").select("key", "print", "n", "root", F.explode("hubs").alias("hub"))
    able = (F.col("root") != F.col("hub.root")) & (5 * F.least("n", F.col("hub.n")) >= 4 * F.greatest("n", F.col("hub.n")))
    out = materialize(met.where(able).select("print", "n", F.col("hub.print").alias("p"), F.col("hub.n").alias("_n")).select(*_ordered("print", "n", "p", "_n")), "stars")
    discard(offered)
    return out


def _pairs_left(rooted: DataFrame) -> tuple[int, int]:
    """How many rows there are, and how many pairs of sets outside a key's commonest component with sets of other components."""
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    of_key = each.groupBy("key").agg(F.sum("size").alias("all"), F.max("size").alias("main"), F.sum(F.col("size") * F.col("size")).alias("same"))
    r = of_key.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()
    return int(r[0] or 0), int(r[1] or 0)


def links(prints: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Edges ``a``, ``b`` between different sets' hashes, all of similarity 4/5 or more, that connect all such pairs.

    Pairs that fingerprints propose, and in each key the pairs of a hub and the other sets, come first. What these connect
    needs no pairs of its own: only sets outside the commonest component of a key are compared with every set of another component there. While that would be many more pairs
    than rows, further hubs are tried, at most `TURNS` times.
    """
    keyed = prints.select(F.explode("keys").alias("key"), "print", "n")
    common = keyed.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.count("*").alias("rows")).where("low != high").select("key", "rows")
    common = materialize(common, "common_shingles")
    shared = join_counted(keyed, common, ["key"], "rows").distinct()
    shared = materialize(shared, "shared_shingles")
    discard(common)
    shares = shared.groupBy("print").agg(F.count("*").alias("shares"))
    rooted = materialize(shared.join(shares, "print").withColumn("root", F.col("print")), "rooted_shingles")
    discard(shared)
    near, proposed, kept = None, _proposed(prints), []
    for turn in range(TURNS):
        stars = _stars(rooted, turn)
        found = _verified(stars, prints, docs, shingle, proposed)
        discard(stars, *([proposed] if proposed else []))
        kept.append(found)
        near, proposed, last = union_all(kept), None, rooted
        roots = connected_components(near).withColumnRenamed("node", "print")
        rooted = last.drop("root").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
        several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        rooted = materialize(rooted.join(several, "key", "left_semi"), "rooted_shingles")  # a key whose sets are connected is done
        discard(last)
        rows, pairs = _pairs_left(rooted)
        if pairs <= 4 * rows:
            break
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = each.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    left = rooted.join(main, "key").where("root != main").select("key", "main", F.col("print").alias("p"), F.col("n").alias("_n"), F.col("root").alias("_root"))
    across = left.join(rooted, "key").where("root != _root AND (root = main OR p < print) AND 5 * least(n, _n) >= 4 * greatest(n, _n)")  # each pair of a key once
    more = _verified(across.select(*_ordered("print", "n", "p", "_n")), prints, docs, shingle)
    discard(rooted)
    return near.unionByName(more)


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``text_print``, ``root``, ``component_id`` of every row."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_print"), F.col(text_col).cast("binary").alias("text"))
    prints = materialize(_prints(slim, bucket_counts(slim, shingle), shingle), "shingles")
    first = prints.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    roots = connected_components(links(prints, slim, shingle)).withColumnRenamed("node", "print")
    rooted = first.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    owner = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    rooted = materialize(rooted.join(owner, "root").select("print", "root", "component_id", "rows"), "shingle_classes")
    return join_counted(prints.select("id", "text_print", "print"), rooted, ["print"], "rows").drop("print")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``component_id`` of every row: the smallest id reachable over pairs whose shingles have a Jaccard similarity of 4/5 or more.

    Texts without words, null included, are alike. Rows with a null id get the component's smallest id, null if it has none. Repeated rows stay, each with
    the same result; an empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, shingle).select("id", "component_id")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component, for ``id, text_print, root`` of every row: of the smallest id, null last, and then the smallest hash of the text.

    Different texts under one id, or without an id, are different documents: each is judged by its own component. All columns stay as they are.
    """
    print_of, by_id, by_print = fresh(docs, "print", "i", "t")
    firsts = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_print")).alias("k")).select(F.col("k.id").alias(by_id), F.col("k.text_print").alias(by_print))
    named = docs.withColumn(print_of, F.xxhash64(text_col))
    kept = named.join(firsts, F.col(f"`{id_col}`").eqNullSafe(F.col(by_id)) & (F.col(print_of) == F.col(by_print)), "left_semi")
    return one_of_equals(kept, [id_col, print_of]).drop(print_of)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of similar documents, as `keep_one` says."""
    return keep_one(docs, _classes(docs, id_col, text_col, shingle), id_col, text_col)
