"""Sinks: flat files, a readable report, statements for a graph database, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofweave.operators.matrix import GATE
from proofweave.session import drop_path

#: Order of the buckets in a report.
REPORT_ORDER = ("MISSING", "undermined", "contested", "supported")


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated text with a header and quoted line breaks."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One line a row, in no particular order."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def report(nested: DataFrame, gate: float = GATE) -> DataFrame:
    """``ord, block``: the matrix as Markdown blocks, worst bucket first. Neutral links are counted, not
    listed; unverified quotes are flagged."""
    links = F.coalesce("links", F.array())
    shown = F.filter(links, lambda x: (x["relation"] != "neutral") & (x["confidence"] >= gate))
    neutral = F.size(F.filter(links, lambda x: x["relation"] == "neutral"))
    flag = lambda x: F.when(F.coalesce(x["quote_ok"], F.lit(True)), "").otherwise(" \u26a0unverified-quote")
    item = lambda x: F.concat(F.lit("- **"), x["relation"], F.lit("** "), x["evidence_id"], F.lit(" ("), x["confidence"].cast("string"), F.lit(") "), F.coalesce(x["rationale"], F.lit("")), flag(x))
    head = F.concat(F.lit("### "), F.col("prop_id"), F.lit(" \u2014 "), F.col("status"), F.lit("\n"), F.coalesce("text", F.lit("")))
    block = F.concat(head, F.lit("\n"), F.array_join(F.transform(shown, item), "\n"), F.lit("\nneutral: "), neutral.cast("string"))
    order = F.array_position(F.array(*[F.lit(s) for s in REPORT_ORDER]), F.col("status"))
    return nested.select(F.struct(order.alias("bucket"), "prop_id").alias("ord"), block.alias("block"))


def write_report(nested: DataFrame, path: str) -> None:
    """The report as text files whose names and lines follow its order (a range sort, no single task)."""
    report(nested).orderBy("ord").select(F.col("block").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def manifest(docs: DataFrame, pages: str | None = None) -> DataFrame:
    """``status, n, pages``: totals of a conversion run; pages are summed from the column named, 0 without one."""
    held = F.coalesce(F.sum(F.col(pages)), F.lit(0)).cast("long") if pages else F.lit(0).cast("long")
    return docs.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"), held.alias("pages"))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a merge that was lost between its two moves; whether there is a table at ``path``."""
    fs, make = _files(spark, path)
    if fs.exists(make(path)):
        return True
    for held in (f"{path}.next", f"{path}.old"):
        if fs.exists(make(f"{held}/_SUCCESS")):
            return fs.rename(make(held), make(path))
    return False


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Merge ``rows`` into the Parquet table at ``path``: the highest ``version`` of a key wins, ties by the
    new rows. Running it again with the same rows changes nothing.

    The merged table is written whole beside the old one, which is then moved away and the new one moved in; data
    that is in use is never overwritten. A merge lost while writing leaves the table as it was, one lost between
    the moves is finished by :func:`recover`, which every merge calls first. One writer at a time.
    """
    path = path.rstrip("/")
    both = rows.withColumn("__new", F.lit(1))
    exists = recover(spark, path)
    if exists:
        both = spark.read.parquet(path).withColumn("__new", F.lit(0)).unionByName(both, allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    merged = both.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k", "__new")
    merged.write.mode("overwrite").parquet(f"{path}.next")
    fs, make = _files(spark, path)
    if exists:
        drop_path(spark, f"{path}.old")
        if not fs.rename(make(path), make(f"{path}.old")):
            raise OSError(f"cannot move {path}")
    if not fs.rename(make(f"{path}.next"), make(path)):
        raise OSError(f"cannot move {path}.next")
    drop_path(spark, f"{path}.old")
    return spark.read.parquet(path)
