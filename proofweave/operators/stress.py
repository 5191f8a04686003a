"""Rule checks over the matrix and the graph, and their score.

Every rule is one aggregate that gives no row, one row or one row per case: ``severity, lens, title, n``. A
robustness score takes off a penalty per finding, at most six findings a severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities with their penalties, worst first.
PENALTY = {"critical": 10, "high": 6, "medium": 3, "low": 1, "info": 0}
MOST_COUNTED = 6


def _one(rows: DataFrame, severity: str, lens: str, title: str, hit: Column, always: bool = False, otherwise: str | None = None) -> DataFrame:
    """One finding with the number of rows that meet ``hit``; ``otherwise`` titles the note if none does."""
    counted = rows.agg(F.count_if(hit).alias("n"))
    if otherwise is not None:
        return counted.select(F.when(F.col("n") > 0, severity).otherwise("info").alias("severity"), F.lit(lens).alias("lens"), F.when(F.col("n") > 0, title).otherwise(otherwise).alias("title"), "n")
    out = counted.select(F.lit(severity).alias("severity"), F.lit(lens).alias("lens"), F.lit(title).alias("title"), "n")
    return out if always else out.where("n > 0")


def findings(props: DataFrame, links: DataFrame, status: DataFrame, contradicted: DataFrame, spof: DataFrame, cut: DataFrame, loops: DataFrame, weak_methods: DataFrame, premises: DataFrame) -> DataFrame:
    """All findings of the deterministic rules."""
    every = F.lit(True)
    false = F.lit(False)
    fragile = links.where("relation <> 'neutral'").groupBy("prop_id").agg(F.bool_and(F.col("confidence") < 0.5).alias("fragile"))
    parts = [
        _one(props, "high", "extraction", "unverified source quotes", ~F.coalesce("quote_ok", F.lit(True))),
        _one(props, "low", "extraction", "denials not linked to an allegation", (F.col("prop_type") == "denial") & (F.coalesce("responds_to", F.lit("")) == "")),
        _one(props, "info", "extraction", "propositions extracted", every, always=True),
        _one(fragile, "medium", "classification", "propositions on low-confidence evidence only", F.coalesce("fragile", false)),
        _one(links, "medium", "classification", "links with an unverified quote", ~F.coalesce("quote_ok", F.lit(True))),
        _one(links, "high", "grounding", "links without a document", F.coalesce("doc_id", F.lit("")) == "", otherwise="every link carries a document"),
        _one(status, "critical", "contradiction", "propositions without evidence", F.col("status") == "MISSING"),
        _one(status, "high", "contradiction", "propositions undermined", F.col("status") == "undermined"),
        _one(contradicted, "high", "contradiction", "propositions with evidence both ways", F.col("contradicted")),
        _one(loops.select("loop").distinct(), "critical", "contradiction", "loops of premises", every, otherwise="no loop of premises"),
        _one(status, "info", "human_review", "propositions for a lawyer's judgement", F.col("status") != "supported", always=True),
    ]
    # One finding per argument and premise: each counts one proposition or its dependents.
    stress = [
        _one(spof.select("evidence_id").distinct(), "high", "stress", "single points of failure", every),
        _one(cut, "medium", "stress", "structural cut points", every),
        weak_methods.groupBy("method_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("high").alias("severity"), F.lit("stress").alias("lens"), F.lit("argument on weak ground").alias("title"), "n"),
        premises.select(F.lit("high").alias("severity"), F.lit("stress").alias("lens"), F.lit("weak premise with dependents").alias("title"), F.col("n_dependents").alias("n")),
    ]
    tail = stress[0]
    for part in stress[1:]:
        tail = tail.unionByName(part)
    nothing = tail.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("info").alias("severity"), F.lit("stress").alias("lens"), F.lit("no single point of failure").alias("title"), F.lit(0).cast("long").alias("n"))
    out = tail.unionByName(nothing)
    for part in parts:
        out = out.unionByName(part)
    return out


def score(found: DataFrame) -> DataFrame:
    """``score, critical, high, medium, low, info``."""
    counts = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in PENALTY])
    lost = F.lit(0)
    for s, p in PENALTY.items():
        lost = lost + F.least(F.col(s), F.lit(MOST_COUNTED)) * p
    return counts.select(F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"), *PENALTY)
