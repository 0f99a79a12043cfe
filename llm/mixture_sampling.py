"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a budget of words. Budgets follow the sources' weights, but none exceeds a number of epochs of its
source; what is cut off is dealt again by weight. A source's documents are taken whole as often as complete epochs fit the budget.
What is left is filled without replacement: a document gets the key Exp(1) / quality, documents are ordered by key, and the
prefix of that order that comes nearest to the rest is taken.

A hot source is never sorted in one task. Keys fall into buckets; sums over buckets tell which buckets are below the cut, and
only the documents of the one bucket of each source that the cut goes through are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm._common import materialize, words_array

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def text_quality(text: Column) -> Column:
    """0.1 to 1: the share of a text's characters, white space aside, that are none of ``#*$%&|<>!``."""
    bare = F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", ""))
    plain = F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r#*$%&|<>!", ""))
    return F.lit(0.1) + F.lit(0.9) * plain / F.greatest(bare, F.lit(1))


def uniform(ident: Column, seed: int) -> Column:
    """A number above 0 and below 1 from an id, null included, and a seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """``target`` of each source, for one row per source with ``source`` and ``source_size``.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. The targets add up to all sizes. With the sources
    in the order of cap / weight, those before some place are at their cap, and the rest share what is left by weight; the place is
    the first at which no later cap is exceeded.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    heavy = F.sum("_weight").over(Window.partitionBy()) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    levelled = weighed.withColumn("_level", left / heavy)
    free = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    levelled = levelled.withColumn("_share", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_share") * F.col("_weight"), F.col("_cap").cast("double")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 5, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """``id, size, source, source_size, target, copies, taken`` of every row.

    ``copies`` is how often the document is in the mix, at most ``epochs`` times, also if it has no words, and ``taken`` the words that makes.
    ``quality`` is a positive weight, by default `text_quality`. Null and empty texts have size 0 and take part with 0 words. A null source is
    a source of its own, the last. Equal ids get equal keys, ties fall to the smaller id (null first), then the smaller size; repeated rows
    are each a document. An empty table gives no rows. Other columns aren't in the result, whatever their names.
    """
    quality = text_quality(F.col(text_col)) if quality is None else quality
    key = -F.log(uniform(F.col(id_col), seed)) / quality
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_array(F.col(text_col))).cast("long").alias("size"), key.alias("key")
    )
    sized = materialize(sized.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))).cast("int")), "sized")
    of_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(of_source, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    summed = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    prefix = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    cuts = summed.select("source", "bucket", (prefix - F.col("bucket_size")).alias("below"), prefix.alias("upto"))
    cuts = cuts.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    place = F.when(F.col("below") >= F.col("rest"), "none").when(F.col("upto") <= F.col("rest"), "all").otherwise("cut")
    cuts = materialize(cuts.withColumn("place", place), "cuts")
    known = cuts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "below", "place", "source_size", "target", "whole", "rest")
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    done = joined.where("place != 'cut'").withColumn("more", (F.col("place") == "all").cast("int"))
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size")
    upto = F.col("below") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    through = joined.where("place = 'cut'").withColumn("upto", upto)
    nearer = (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")))
    through = through.withColumn("more", nearer.cast("int")).drop("upto")
    copies = F.col("whole") + F.col("more")
    return done.unionByName(through).select(
        "id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
