"""A bundle of Markdown documents with front matter.

Defined results: front matter counts only if the first line is ``---``, and runs to the end if it is never
closed; a page mark sets the page (from 1) and ends a paragraph; a title line (``# ``) is left out without
ending one; files named readme.md are skipped; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofweave.functions import text as X

# The page mark and the front-matter fence.
PAGE_MARK = r"^<!--\s*page\s+(\d+)\s*-->\s*$"
FENCE = "---"


def glob_pattern(glob: str) -> str:
    """A Java pattern for a file-name glob, without regard to case."""
    special = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(special.get(c, c if c.isalnum() else "\\" + c) for c in glob) + "$"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, file, n, line`` of all Markdown files under ``folder``."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value").where(F.lower("file") != "readme.md")
    return named.select("path", "file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def _unquoted(value: Column) -> Column:
    inner = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    double = value.rlike('^".*"$')
    return F.when(double, F.coalesce(inner, F.regexp_replace(value, "^[\"']+|[\"']+$", ""))).when(value.rlike("^'.*'$"), F.regexp_replace(value, "^[\"']+|[\"']+$", "")).otherwise(value)


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents, paragraphs)`` of :func:`read_lines`: ``path, file, doc_id, meta`` and ``doc_id, pos, page,
    label, text``."""
    file = Window.partitionBy("path").orderBy("n")
    bare = X.strip(F.col("line"))
    marked = lines.withColumn("opens", F.first(bare).over(file) == FENCE)
    marked = marked.withColumn("fences", F.sum((F.col("opens") & (bare == FENCE)).cast("int")).over(file))
    head = marked.where("opens and fences = 1 and n > 0").where(F.contains("line", F.lit(":")))
    key, value = X.strip(F.substring_index("line", ":", 1)), X.strip(F.expr("substring(line, instr(line, ':') + 1)"))
    meta = head.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), _unquoted(value).alias("v")))).alias("meta"))
    files = lines.select("path", "file").distinct().join(meta, "path", "left")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    documents = files.select("path", "file", F.coalesce(F.try_element_at("meta", F.lit("doc_id")), stem).alias("doc_id"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))

    closing = F.col("opens") & (bare == FENCE) & (F.col("fences") == 2)
    text = marked.where((~F.col("opens") | (F.col("fences") >= 2)) & ~closing).where(~F.startswith("line", F.lit("# ")) | bare.rlike(PAGE_MARK))
    page = F.when(bare.rlike(PAGE_MARK), F.regexp_extract(bare, PAGE_MARK, 1).cast("int"))
    numbered = text.withColumn("mark", page).withColumn("page", F.coalesce(F.last("mark", True).over(file), F.lit(1)))
    numbered = numbered.withColumn("para", F.sum(((bare == "") | F.col("mark").isNotNull()).cast("int")).over(file)).where((bare != "") & F.col("mark").isNull())
    joined = numbered.groupBy("path", "para").agg(F.max("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", bare.alias("s")))), lambda x: x["s"]), " ").alias("text"))
    placed = joined.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("para")).cast("long") - 1)
    return documents, placed.join(documents.select("path", "doc_id"), "path").select("doc_id", "pos", "page", X.label_of(F.col("text")).alias("label"), "text")


def kinds(documents: DataFrame, paragraphs: DataFrame, pleadings: str | None = None, evidence: str | None = None) -> DataFrame:
    """``doc_id, kind``: by file-name globs, pleadings first, else by the markers of the text."""
    opening = paragraphs.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n"), 1, 4000).alias("opening"))
    joined = documents.join(opening, "doc_id", "left")
    low = F.lower(F.concat_ws(" ", F.coalesce("opening", F.lit("")), F.to_json("meta")))
    kind = X.document_kind(low, F.lower(F.coalesce(F.try_element_at("meta", F.lit("title")), F.lit(""))))
    if evidence:
        kind = F.when(F.col("file").rlike(glob_pattern(evidence)), "witness_statement").otherwise(kind)
    if pleadings:
        kind = F.when(F.col("file").rlike(glob_pattern(pleadings)), "pleading").otherwise(kind)
    return joined.select("doc_id", kind.alias("kind"))


def prompts(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, text``: paragraphs in order with a mark wherever the page changes."""
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("pos"))
    marked = paragraphs.withColumn("s", F.when(before.isNull() | (before != F.col("page")), F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))).otherwise(F.col("text")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n").alias("text"))
