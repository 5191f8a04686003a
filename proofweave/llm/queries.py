"""The ``pN_`` queries of the operators in this subpackage. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofweave.llm import encoding, neardup, packing, replies, residue, scans, splitting, topn, unify
from proofweave.session import materialize
from proofweave.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of evidence records that are near copies."""
    links, members = neardup.class_links(neardup.evidence_text(table(spark, folder, "evidence")), "id", "text")
    return neardup.pairs_of_ids(links, members)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence record with the group of near copies it belongs to."""
    links, members = neardup.class_links(neardup.evidence_text(table(spark, folder, "evidence")), "id", "text")
    return neardup.groups(materialize(links, "links"), members)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective question and reply pairs with their defect."""
    return replies.defective_pairs(table(spark, folder, "chat_cache"))


def quoted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``tbl, row_key, text`` of all quotes and of all paragraphs of case documents."""
    parts = [table(spark, folder, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.col("quote").alias("text")) for name, key in (("evidence", "id"), ("propositions", "id"), ("links", "link_id"))]
    paragraphs = table(spark, folder, "case_docs").select("doc_id", F.posexplode("paragraphs").alias("i", "p"))
    parts.append(paragraphs.select(F.lit("case_docs").alias("tbl"), F.concat_ws("#", "doc_id", F.col("i").cast("string")).alias("row_key"), F.col("p.text").alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written with characters that only look ordinary."""
    return unify.lookalikes(quoted_texts(spark, folder), "text").select("tbl", "row_key").distinct()


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form."""
    return unify.unified(quoted_texts(spark, folder), "text").select("tbl", "row_key", F.col("unified").alias("text")).distinct()


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Texts per table and kind of character."""
    found = unify.lookalikes(quoted_texts(spark, folder), "text").select("tbl", "row_key", F.explode("kinds").alias("kind")).distinct()
    return found.groupBy("tbl", "kind").agg(F.count(F.lit(1)).alias("n"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(splitting.oversized(table(spark, folder, "case_docs")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and documents that had to be cut."""
    return _pieces(spark, folder).where("piece_no = 1").select("doc_id", "pos")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of oversized paragraphs and documents."""
    return _pieces(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five evidence records with the highest confidence of every proposition."""
    top = topn.top_n(table(spark, folder, "links"), "prop_id", "evidence_id", "confidence", 5)
    return top.select(F.col("grp").alias("prop_id"), "rank_no", F.col("item").alias("evidence_id"))


def _scan(spark: SparkSession, folder: str) -> scans.Scan:
    clean = table(spark, folder, "case_docs").select(F.explode("paragraphs").alias("p")).select(F.col("p.text").alias("text"))
    return scans.Scan(table(spark, folder, "scan_paras"), clean)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy lines of scanned pages with their noise."""
    return _scan(spark, folder).noise()


def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned documents as continuous repaired paragraphs."""
    return _scan(spark, folder).paragraphs()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding the ids of a document gives its text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = encoding.decode(encoding.encode(docs)).select("doc_id", F.xxhash64("text").alias("back"), F.length("text").alias("n"))
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("want")).join(back, "doc_id").select("doc_id", (F.col("want") == F.col("back")).alias("same"), F.col("n").cast("long").alias("n_chars"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container of 2,048 tokens."""
    return packing.pack(encoding.encode(table(spark, folder, "documents"), counts_only=True))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, tokens held and the least number of containers possible."""
    return packing.fill(p9_containers(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold open template slots or consist of residue."""
    return residue.residue(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How the models do on hosts the training never saw, against the weak labels."""
    _, report = residue.train(table(spark, folder, "documents"))
    rows = [tuple(x if isinstance(x, str) else int(x) for x in r) for r in report]
    return spark.createDataFrame(rows, "model string, n_train long, n_valid long, true_positive long, false_positive long, false_negative long")


def p10_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Documents named by the models and by the weak labels alone."""
    every = residue.residue(table(spark, folder, "documents"), with_rules=True)
    return every.groupBy((F.col("open_slot") | F.col("residue_page")).alias("by_models"), (F.col("rule_slot") | F.col("rule_page")).alias("by_rules")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p4_found, p4_unified, p4_kinds, p5_found, p5_pieces, p6_found, p7_found, p7_paragraphs, p8_ids, p8_roundtrip, p9_containers, p9_fill, p10_found, p10_validation, p10_agreement)}
