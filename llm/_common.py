"""What several operators share: the word pattern, shared scratch tables, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def words_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, for local mode only: a cluster must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them again, which cuts the lineage. `discard` deletes such a table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        k = 0
        while (made := f"_{n}{k or ''}").lower() in taken:
            k += 1
        taken.add(made.lower())
        out.append(made)
    return out


def one_of_equals(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the first by all other columns that have an order. Equal keys are thinned out before the shuffle."""
    (nth,) = fresh(docs, "nth")
    ordered = [f.name for f in docs.schema.fields if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(*keys).orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in ordered or keys))
    return docs.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)


_REMEMBERED: dict = {}


def remembered(owner, make=None):
    """What a Python worker keeps between batches for one ``owner``, made when it is first asked for. Workers go on from operator to operator, so what any other owner kept is let go."""
    if _REMEMBERED.get("owner") != owner:
        _REMEMBERED.clear()
        _REMEMBERED.update(owner=owner, kept=make() if make else None)
    return _REMEMBERED["kept"]


#: A key with more than one in `PARTS` of a side's rows is dealt out over several tasks; there are at most `PARTS` such keys.
PARTS = 200


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, counts: DataFrame | None = None, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, all keys of ``left`` that matter, and how many rows of ``left`` have the key.

    Keys with many rows are split by a salt, and their row of ``right`` is repeated for each part. Only these keys and their number of
    parts are broadcast, at most `PARTS` rows. Where ``counts`` is given it has the keys and numbers, and ``right`` is read once; else ``right`` is read
    twice and should be a written table. The column ``count`` isn't in the result. ``how`` is ``inner`` or ``left``.

    The salt is a hash of ``salt``, by default of the row's values, never its place: a task that is run again after its executor was lost deals every row to the part where it went before.
    """
    known = right if counts is None else counts
    own = F.xxhash64(*(F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString())) if salt is None else salt
    total = known.agg(F.sum(count)).first()[0] or 0
    least = max(1000.0, total / PARTS)
    heavy = F.broadcast(known.where(F.col(count) > least).select(*on, F.ceil(F.col(count) / least).cast("int").alias("_parts")))
    dealt = left.join(heavy, on, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(own, F.col("_parts"))).cast("int")).drop("_parts")
    repeated = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", count)
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node: columns ``node`` and ``root``, for long edges ``a``, ``b``.

    Large-star and small-star steps alternate until nothing changes, which takes O(log^2 n) rounds. Each
    step groups with partial aggregation and joins on the minimum, so that a node with very many
    neighbours is never gathered into one group. Self-loops count as nodes. ``rounds`` guards against an endless loop
    and raises; it never cuts a result short.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select("b", "a"))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = both.join(low, "a")
        linked = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("low"))
        kept = linked.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            kept = kept.union(low.where("low != a").select("a", F.col("low").alias("b")))
        return kept.where("a != b").distinct()

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialize(edges.where("a != b").select("a", "b").distinct(), "links")
    print_of = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = now.agg(print_of).first()[0]
    for _ in range(rounds):
        if not seen.n:
            break
        last, now = now, materialize(star(star(now, True), False), "links")
        discard(last)
        was, seen = seen, now.agg(print_of).first()[0]
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
