"""Top N items within every group (hot-cold split).

Exact group counts decide which groups are heavy; there may be any number of them. Heavy groups are
range-sorted over all partitions by (group, score, tie key), salted by the sort itself, and cut to N rows per
partition before the final merge; light groups go through an ordinary window. The two results are united.
Which way a group takes changes only the cost, never the rows. The input is read once: items are folded and
written to the shared folder, from which the counts and both ways read.

Defined results: rows with a null group, a null or empty item, or a null or NaN score do not count; ``0.0``
and ``-0.0`` are equal; an item that occurs more than once in a group counts once, with its highest score;
ties go to the smaller item. Groups without countable rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofweave.operators import skew
from proofweave.session import materialize

#: Rows from which a group is heavy.
HOT_ROWS = 5_000


def countable(rows: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """``group, item, score`` of the rows that count, negative zero made positive."""
    value = F.col(score).cast("double")
    kept = F.col(group).isNotNull() & F.col(item).isNotNull() & (F.col(item) != "") & value.isNotNull() & ~F.isnan(value)
    return rows.where(kept).select(F.col(group).alias("grp"), F.col(item).alias("item"), (value + F.lit(0.0)).alias("score"))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``grp, rank_no, item, score`` for the first ``n`` items of every group."""
    base = countable(rows, group, item, score)
    order = (F.desc("score"), F.asc("item"))
    by_group = Window.partitionBy("grp").orderBy(*order)

    # The pre-aggregation is keyed by group and item, so a heavy group is spread over all partitions.
    best = materialize(base.groupBy("grp", "item").agg(F.max("score").alias("score")), "best")
    hot = skew.hot_keys(best.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), ["grp"], hot_rows).select("grp")

    def first(part: DataFrame) -> DataFrame:
        return part.withColumn("rank_no", F.row_number().over(by_group)).where(F.col("rank_no") <= n)

    # Range partitions hold consecutive stretches of the sort order. The rank filter is applied per partition
    # first (WindowGroupLimit below the exchange), so at most n rows a partition and group move.
    light, heavy = best.join(hot, "grp", "left_anti"), best.join(hot, "grp", "left_semi").repartitionByRange(F.col("grp"), *order)
    ranked = first(light).unionByName(first(heavy))
    return ranked.select("grp", F.col("rank_no").cast("long").alias("rank_no"), "item", "score")
