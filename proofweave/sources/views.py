"""The star schema as the operators see it: one row per record, withdrawn records left out.

Repeated deliveries are equal but for their load time, which no view keeps, so a distinct folds them. A distinct
shuffles every column it is given, so a view takes the columns that its reader needs; the key is always kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofweave.sources.tables import table

RELATIONS = ("supportive", "adverse", "neutral")
PLACE = ("witness", "doc_id", "page", "paragraph")


def _kept(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The keys and the wanted columns (all if none is named), once."""
    return (rows.select(*dict.fromkeys((*keys, *columns))) if columns else rows).distinct()


def propositions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``prop_id, prop_type, text, party, responds_to, quote, quote_ok, doc_id, page, paragraph``."""
    rows = table(spark, folder, "propositions").where("deleted_at is null")
    named = rows.select(F.col("id").alias("prop_id"), "prop_type", "text", "party", "responds_to", "quote", "quote_ok", "source.doc_id", "source.page", "source.paragraph")
    return _kept(named, ("prop_id",), columns)


def evidence(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``evidence_id, assertion, witness, quote, quote_ok, doc_id, page, paragraph``."""
    rows = table(spark, folder, "evidence").where("deleted_at is null")
    named = rows.select(F.col("id").alias("evidence_id"), "assertion", "witness", "quote", "quote_ok", "source.doc_id", "source.page", "source.paragraph")
    return _kept(named, ("evidence_id",), columns)


def links(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``link_id, prop_id, evidence_id, relation, confidence, rationale, quote, quote_ok``; a null or NaN
    confidence is 0."""
    rows = table(spark, folder, "links").where(F.col("relation").isin(*RELATIONS))
    sure = F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)
    named = rows.select("link_id", "prop_id", "evidence_id", "relation", sure.alias("confidence"), "rationale", "quote", "quote_ok")
    return _kept(named, ("link_id", "prop_id", "evidence_id"), columns)


def matrix_links(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Links whose proposition and evidence both exist, with the evidence's witness and place."""
    own = tuple(c for c in columns if c not in PLACE)
    place = tuple(c for c in PLACE if not columns or c in columns)
    known = propositions(spark, folder, "prop_id")
    held = evidence(spark, folder, "evidence_id", *place)
    if "witness" in place:
        held = held.withColumn("witness", F.coalesce("witness", F.lit("")))
    return links(spark, folder, *(own or (("link_id",) if columns else ()))).join(held, "evidence_id").join(known, "prop_id", "left_semi")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, pos, page, label, text`` of the case documents."""
    rows = table(spark, folder, "case_docs").select("doc_id", F.posexplode("paragraphs").alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "p.page", F.coalesce("p.label", F.lit("")).alias("label"), F.col("p.text").alias("text")).where(F.col("text").isNotNull()).distinct()


def case_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, path, kind, title, witness_name, meta_json, full_text``; no text for scanned documents."""
    text = F.coalesce(F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n"), F.lit(""))
    rows = table(spark, folder, "case_docs").select("doc_id", "path", "kind", F.try_element_at("meta", F.lit("title")).alias("title"), F.try_element_at("meta", F.lit("witness_name")).alias("witness_name"), F.to_json("meta").alias("meta_json"), text.alias("full_text"))
    return rows.dropDuplicates(["doc_id"])


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """``dep_id, from_id, to_id`` as stored."""
    return table(spark, folder, "dependencies").select("dep_id", "from_id", "to_id").distinct()


def reliances(spark: SparkSession, folder: str) -> DataFrame:
    """``method_id, pos, prop_id``: the propositions a damages method relies on, as stored."""
    rows = table(spark, folder, "quantum").select("method_id", F.posexplode("relies_on").alias("pos", "prop_id"))
    return rows.select("method_id", F.col("pos").cast("long").alias("pos"), "prop_id").where(F.col("prop_id").isNotNull()).distinct()
