"""Exact top-k inner-product search with vector-approximation blocks.

Vectors are integers. Candidates lie in blocks; a block holds, beside its vectors, an approximation: every component is replaced by the index of one of
16 cells. For a query, cells bound each score from above and below with one small matrix product. A block reads its exact
vectors in the order of the upper bounds, best first, until no bound left can reach the k-th score found; then the block's best k are certain.
The best of all blocks are merged by rank.

Every query meets every block of candidates, as a search of a stated query set against all rows needs, and no more
than k rows for each query leave a block. A block's vectors come with the shuffle that deals out blocks, so the cells save work on exact scores, not reading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm._common import materialize

CELL_BITS = 4
#: Components in a block of candidates, 32 MB of them: all queries are sent to each block, so that blocks are as large as a task can hold. Bounds of scores that are held at a time.
BLOCK, BOUNDS = 1 << 22, 1 << 22
#: Candidates read exactly at a time, for each query.
STEP = 64


def quantise(x: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, the lowest value of cell 0 and the width of a cell: x lies in [low + width * cell, low + width * (cell + 1) - 1]."""
    low, high = x.min(axis=0), x.max(axis=0)
    span = (high - low) / 2.0**bits
    width = 2.0 ** np.ceil(np.log2(np.maximum(span, 1.0)))
    width = np.where((high - low) / width >= 2.0**bits, 2 * width, width)
    return np.floor((x - low) / width), low, width


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as int64, saturated; by floating point only where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[-1])
    if most < 2.0**53:
        return np.rint(x @ q).astype(np.int64)
    qi = [int(v) for v in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(qi, row)))) for row in x], dtype=np.int64)


class Cells:
    """The candidates of a block with their approximations, made once for all queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.cells, self.low, self.width = quantise(x)
        self.cells = self.cells.astype(np.uint8)
        self.largest = np.abs(x).max(initial=0)

    def top_k(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Query number, id and score of the block's k best for each query (ties to the smaller id), without the query's own id."""
        ids, x, low, width = self.ids, self.x, self.low, self.width
        most = np.abs(q).max(initial=0) * (self.largest + 2 * width.max()) * q.shape[1]
        kind = np.float32 if most < 2.0**24 else np.float64
        slack = 0.0 if most < 2.0**53 else most * q.shape[1] * 2.0**-50
        upper = (q * width).astype(kind) @ self.cells.T.astype(kind)
        shift = q @ low + np.maximum(q, 0) @ (width - 1) + slack  # the top of a cell where a query is positive, its bottom elsewhere
        out = []
        for i in range(len(q)):
            bound, todo, kth = upper[i], ids != q_ids[i], -np.inf
            best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
            take = max(STEP, 2 * k)
            while (rest := np.flatnonzero(todo & (bound >= kth))).size:
                part = rest[np.argpartition(-bound[rest], take)[:take]] if len(rest) > take else rest
                todo[part] = False
                best_ids, best = np.concatenate([best_ids, ids[part]]), np.concatenate([best, exact_scores(q[i], x[part])])
                keep = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[keep], best[keep]
                if len(best) == k:
                    kth = float(best[-1]) - float(shift[i])  # an equal bound may still hide a smaller id
                take *= 4
            out += [(i, int(a), int(b)) for a, b in zip(best_ids, best, strict=True)]
        return out


def block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of one block for each query."""
    return Cells(ids, x).top_k(q_ids, q, k)


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``v``, the components as floor(scale * x); without rows that hold null or non-finite ones, or whose id or vector is null or empty. Rows that repeat stay, an empty table gives no rows, and other columns aren't in the result, whatever their names."""
    kept = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = kept.where("id is not null and v is not null and size(v) > 0").where(~bad)
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int | None = None) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``queries`` its ``k`` highest scores among ``vectors``, both as from `scaled`.

    Vectors with the query's own id are no candidates. Queries that repeat an id and vector count once; repeated candidates count each. Vectors
    of different lengths aren't compared. Fewer than ``k`` candidates give all. Scores saturate at the ends of long. Empty tables give no rows, and columns other than ``id`` and ``v`` aren't in the result.

    A task takes the candidates of one block after the other, makes its cells once, and then streams all queries past them: it holds about ``block`` candidates, by default `BLOCK` components, and the bounds of some queries.
    """
    vectors = materialize(vectors.withColumn("dim", F.size("v")), "vectors")
    asked = materialize(queries.dropDuplicates().withColumns({"dim": F.size("v"), "print": F.xxhash64("v")}), "asked")
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    block = max(256, BLOCK // dims) if block is None else block
    blocks = max(1, -(-n // block), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)))
    # repeated rows are dealt out too, so the place in the table counts
    own = vectors.select(F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), F.lit(0).alias("asks"), "id", F.lit(0).cast("long").alias("print"), "dim", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), "id", "print", "dim", "v")
    dealt = own.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "asks", "dim")

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column("v")
        return np.asarray(v.flatten(), dtype=float).reshape(len(v), -1)

    def search(it):
        at, held, cells = None, {}, {}  # candidates of the block at hand, by dimension
        for whole in it:
            key = np.stack([np.asarray(whole.column(c)) for c in ("block", "asks", "dim")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                (of, asks, dim), part = key[low].tolist(), whole.slice(low, high - low)
                if of != at:
                    at, held, cells = of, {}, {}
                if not asks:
                    held.setdefault(dim, []).append((np.asarray(part.column("id")), rows_of(part)))
                    continue
                if dim not in held:
                    continue
                if dim not in cells:
                    cells[dim] = Cells(*(np.concatenate(x) for x in zip(*held[dim], strict=True)))
                    held[dim] = ()
                step = max(1, BOUNDS // len(cells[dim].ids))
                for start in range(0, part.num_rows, step):
                    some = part.slice(start, step)
                    found = cells[dim].top_k(np.asarray(some.column("id")), rows_of(some), k)
                    place = pa.array([i for i, _, _ in found], pa.int64())
                    yield pa.record_batch([some.column("id").take(place), some.column("print").take(place), pa.array([a for _, a, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.int64())], ["query_id", "print", "id", "score"])

    found = dealt.mapInArrow(search, "query_id long, print long, id long, score long")
    order = Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
