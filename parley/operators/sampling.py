"""Stratified samples, holdout splits and set operations on ids."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators import windows


def regions(threads: DataFrame, order: str) -> DataFrame:
    """threads with region: the first and second third by position (rounded down), and the rest."""
    third = threads.count() // 3
    place = F.col("_place")
    region = F.when(place < third, "start").when(place < 2 * third, "middle").otherwise("end")
    return windows.position(threads, order, "_place").withColumn("region", region).drop("_place")


def round_robin(threads: DataFrame, shuffle: Column, bucket_order: Column, targets: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Rows drawn in turns from the buckets of each (region, two turns or more), up to its target.

    threads has region, turn_count and bucket. The draw within a bucket follows `shuffle`, the turns
    `bucket_order`; threads of one turn are in no stratum.
    """
    targets = targets or lx.REGION_TARGETS
    kind = F.when(F.col("turn_count") == 2, "2_turn").when(F.col("turn_count") >= 3, "multi_turn")
    rows = threads.withColumn("turn_type", kind).where("turn_type is not null")
    rows = rows.withColumn("_draw", F.row_number().over(Window.partitionBy("region", "turn_type", "bucket").orderBy(shuffle)))
    # More than the target can't be needed from one bucket: that goes before the second shuffle.
    most = max(max(x) for x in targets.values())
    rows = rows.where(F.col("_draw") <= most).withColumn(
        "_turn", F.row_number().over(Window.partitionBy("region", "turn_type").orderBy("_draw", bucket_order, "bucket")),
    )
    wanted = F.lit(0)
    for region, (two, more) in targets.items():
        wanted = F.when(F.col("region") == region, F.when(F.col("turn_type") == "2_turn", two).otherwise(more)).otherwise(wanted)
    return rows.where(F.col("_turn") <= wanted).drop("_draw", "_turn")


def strata(sample: DataFrame) -> DataFrame:
    return sample.groupBy("region", "turn_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


def draw(key: Column, seed: int) -> Column:
    """What a repeatable random order goes by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable random order; null keys come first."""
    return rows.orderBy(draw(F.col(key), seed), key)


def corpus_minus_holdout(threads: DataFrame, holdout: DataFrame, keep_null_ids: bool = False) -> DataFrame:
    """threads whose id is not held out; null and empty ids go, unless they are to be kept."""
    rows = threads if keep_null_ids else threads.where("thread_id is not null and thread_id <> ''")
    return rows.join(holdout.select(F.col("thread_id").alias("_h")), F.col("thread_id") == F.col("_h"), "left_anti")


def leaked(corpus: DataFrame, holdout: DataFrame) -> DataFrame:
    """Ids of the corpus that are held out: there must be none."""
    return corpus.join(holdout.select(F.col("thread_id").alias("_h")), F.col("thread_id") == F.col("_h"), "left_semi").select("thread_id")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "thread_id") -> DataFrame:
    """key and side (`left` or `right`) of the distinct keys in one only."""
    x, y = a.select(F.col(key).alias("_a")).distinct(), b.select(F.col(key).alias("_b")).distinct()
    both = x.join(y, F.col("_a") == F.col("_b"), "full_outer").where("_a is null or _b is null")
    return both.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def duplicates(rows: DataFrame, key: str = "thread_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_order(a: DataFrame, b: DataFrame, position: str = "pos", key: str = "thread_id") -> DataFrame:
    """Positions at which two lists of keys differ."""
    x, y = a.select(F.col(position).alias("_p"), F.col(key).alias("left_id")), b.select(F.col(position).alias("_q"), F.col(key).alias("right_id"))
    both = x.join(y, F.col("_p") == F.col("_q"), "full_outer")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id"))).select(F.coalesce("_p", "_q").alias(position), "left_id", "right_id")
