"""Helpers for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofweave.session import materialize



def hot_keys(counts: DataFrame, keys: list[str], at_least: int, n: str = "n") -> DataFrame:
    """``keys, pieces`` of every key with more than ``at_least`` rows: one piece for every ``at_least`` of them.

    ``counts`` holds exact counts, aggregated map-side before their shuffle. The result is written to the
    shared folder, so that Spark knows its size: joins with it are broadcast while it is small and shuffled
    beyond. It has at most one row for every ``at_least`` rows counted, and no other bound.
    """
    hot = counts.where(F.col(n) > at_least).select(*keys, F.ceil(F.col(n) / max(at_least, 1)).cast("int").alias("pieces"))
    return materialize(hot, "hot")


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], spread: Column, name: str = "salt") -> DataFrame:
    """``rows`` with ``name``: 0 for ordinary keys, a piece chosen by ``spread`` for hot ones."""
    piece = F.pmod(F.xxhash64(spread), F.coalesce("pieces", F.lit(1))).cast("int")
    return rows.join(hot, keys, "left").withColumn(name, piece).drop("pieces")


def repeated(rows: DataFrame, hot: DataFrame, keys: list[str], name: str = "salt") -> DataFrame:
    """The other side of a join with :func:`salted` rows: a row for every piece of its key."""
    every = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
    return rows.join(hot, keys, "left").withColumn(name, F.explode(every)).drop("pieces")


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place (from 1) in a total order, without gathering them: range partitions are
    numbered within and offset by the sizes of those before, one number per partition."""
    spark = rows.sparkSession
    held = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__p"], r["count"]) for r in held.groupBy("__p").count().collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "__p int, __before long")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return held.join(F.broadcast(starts), "__p").withColumn(name, F.col("__before") + within).drop("__p", "__before")
