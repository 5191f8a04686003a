"""Page text to paragraphs: repeated headers, furniture, reflow and metadata.

Works on ``doc_id, page, pos, line_no, line`` rows. Defined results: blank lines end a paragraph; a document
without lines gives no rows; ties in position are broken by the row's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofweave.functions import text as X

#: Lines at the top of a page among which headers are sought, and their greatest length.
TOP_LINES, LONGEST = 4, 30

# What a line of metadata looks like.
METADATA = (("witness_name", r"(?i)^Witness\s*Name\s*:?\s*(.+)"), ("statement_no", r"(?i)^Statement\s*No\.?\s*:?\s*(.+)"), ("exhibits", r"(?i)^Exhibits?\s*:?\s*(.+)"), ("date", r"(?i)^\s*Date\s*:?\s*(.+)"))


def lines(scans: DataFrame) -> DataFrame:
    """The layout lines of scanned paragraphs, repeated rows once."""
    once = scans.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"), "text").distinct()
    return once.select("doc_id", "page", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def page_headers(rows: DataFrame) -> DataFrame:
    """``doc_id, line, n``: short lines among the first of the pages that come back on at least half of them,
    twice at least. The cut to the top lines is a rank filter, applied before the shuffle."""
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos", "line_no"))).where(F.col("n") <= TOP_LINES)
    stripped = X.strip(F.col("line"))
    counted = top.select("doc_id", stripped.alias("line")).where(F.length("line").between(1, LONGEST)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return counted.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.5))).select("doc_id", "line", "n")


def clean_lines(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``rows`` without headers, page footers and envelope lines, glyphs repaired."""
    bare = rows.withColumn("key", X.strip(F.col("line")))
    kept = bare.join(headers.select("doc_id", F.col("line").alias("key")), ["doc_id", "key"], "left_anti")
    kept = kept.where(~F.col("key").rlike(X.PAGE_FOOTER) & ~F.col("key").rlike(X.ENVELOPE_LINE))
    return kept.withColumn("line", X.fix_glyphs(F.rtrim("line"))).drop("key")


def reflow(text: F.Column) -> F.Column:
    """Paragraphs of a page's text: wrapped lines joined, a hyphen at a line's end joined without a blank;
    a blank line or the start of a list item begins a new one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    close = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc, s):
        joined = F.when(F.endswith(acc["open"], F.lit("-")), F.concat(acc["open"].substr(F.lit(1), F.length(acc["open"]) - 1), s)).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fresh = s.rlike(X.PARAGRAPH_START) & (acc["open"] != "")
        return F.struct(
            F.when((s == "") | fresh, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(s == "", F.lit("")).when((acc["open"] == "") | fresh, s).otherwise(joined).alias("open"),
        )

    return F.aggregate(F.transform(F.split(text, "\n"), X.strip), start, step, close)


def metadata(rows: DataFrame) -> DataFrame:
    """``doc_id, key, value``: the first line of every kind of metadata, and the title line."""
    line = X.strip(F.col("line"))
    found = [F.struct(F.lit(k).alias("key"), X.strip(F.regexp_extract(line, p, 1)).alias("value")) for k, p in METADATA]
    title = F.struct(F.lit("title").alias("key"), F.when(line.rlike("(?i)WITNESS STATEMENT OF"), line).otherwise("").alias("value"))
    every = rows.select("doc_id", "pos", "line_no", F.inline(F.array(*found, title))).where("value <> ''")
    return every.groupBy("doc_id", "key").agg(F.min_by("value", F.struct("pos", "line_no")).alias("value"))
