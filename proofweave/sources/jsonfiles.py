"""JSON sources: the nested matrix, page records, dependencies, and model output kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = "struct<doc_id:string,page:int,paragraph:string>"
MATRIX = (
    f"proposition struct<id:string,type:string,text:string,party:string,responds_to:string,quote:string,quote_ok:boolean,source:{PLACE}>, status string, n_candidates int,"
    f" links array<struct<evidence_id:string,relation:string,confidence:double,rationale:string,quote:string,quote_ok:boolean,witness:string,evidence_source:{PLACE}>>"
)
PAGES = "doc_id string, page int, text string, used_ocr boolean"
DEPENDENCIES = "dependencies array<struct<`from`:string,`to`:string,rationale:string>>"


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(propositions, links)`` in the shape of the views, from a nested matrix file. Rows without an id are
    skipped; a null quote flag counts as good; places in the file become ``link_id``s per proposition."""
    rows = spark.read.schema(MATRIX).option("multiLine", True).json(path).where("proposition.id is not null")
    p = F.col("proposition")
    props = rows.select(p["id"].alias("prop_id"), p["type"].alias("prop_type"), p["text"].alias("text"), p["party"].alias("party"), p["responds_to"].alias("responds_to"), p["quote"].alias("quote"), F.coalesce(p["quote_ok"], F.lit(True)).alias("quote_ok"), p["source"]["doc_id"].alias("doc_id"), p["source"]["page"].alias("page"), p["source"]["paragraph"].alias("paragraph"))
    flat = rows.select(p["id"].alias("prop_id"), F.posexplode("links").alias("link_id", "l"))
    links = flat.select(F.col("link_id").cast("long").alias("link_id"), "prop_id", "l.evidence_id", "l.relation", F.coalesce("l.confidence", F.lit(0.0)).alias("confidence"), "l.rationale", "l.quote", F.coalesce("l.quote_ok", F.lit(True)).alias("quote_ok"), F.coalesce("l.witness", F.lit("")).alias("witness"), "l.evidence_source.doc_id", "l.evidence_source.page", "l.evidence_source.paragraph")
    return props, links


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records, one JSON object a line."""
    return spark.read.schema(PAGES).json(path)


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """``dep_id, from_id, to_id, rationale``; a file without dependencies gives no rows."""
    rows = spark.read.schema(DEPENDENCIES).option("multiLine", True).json(path).select(F.posexplode("dependencies").alias("dep_id", "d"))
    return rows.select(F.col("dep_id").cast("long").alias("dep_id"), F.col("d.from").alias("from_id"), F.col("d.to").alias("to_id"), "d.rationale")


def citations(claims: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """``claim_id, source_id, quote`` from JSON claims of the shapes ``citations``, ``evidence`` or a single
    ``source_id``/``source`` with ``quote``/``text``/``excerpt``."""
    shape = "array<struct<source_id:string,source:string,id:string,quote:string,text:string,excerpt:string>>"
    field = lambda name: F.get_json_object(payload, f"$.{name}")
    filled = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c], F.lit(""))
    listed = F.from_json(F.coalesce(field("citations"), field("evidence")), shape)
    one = F.when(filled(field("source_id"), field("source")) != "", F.array(F.struct(filled(field("source_id"), field("source")).alias("source_id"), filled(field("quote"), field("text")).alias("quote"))))
    many = F.transform(listed, lambda c: F.struct(filled(c["source_id"], c["source"], c["id"]).alias("source_id"), filled(c["quote"], c["text"], c["excerpt"]).alias("quote")))
    return claims.select(F.col(key).alias("claim_id"), F.inline(F.coalesce(many, one)))


def replay(found: DataFrame, order: str, key: str) -> DataFrame:
    """Recorded search results with repeated keys left out, the first kept; keys compare without case."""
    first = Window.partitionBy(F.lower(key)).orderBy(order)
    return found.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
