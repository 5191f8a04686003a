"""References to records that are absent, withdrawn or not yet loaded.

The operator keeps *signed counts per key* from change deltas. A record adds ``+1`` existence when it is
loaded and ``-1`` when it is withdrawn; a referring row adds ``+1`` reference when it is loaded. Keys with
positive references and no existence are the current orphans (:func:`orphan_state`). The row-level report
(:func:`orphan_rows`) takes from the same counts the keys that can have been referenced without existing, and
only for their references reads the existence count as of the referring row's own load time.

Defined results for odd input: a null or blank reference is no reference; references are compared
trimmed and upper-cased; repeated deliveries of a row count once, at the earliest load time; an array that
names a key twice yields one reference; null or empty arrays yield none; a record whose ``deleted_at``
lies before its load time is withdrawn from its load on. Empty tables give empty reports. Columns other
than those named here are never read, so extra or clashing ones do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofweave.operators import skew
from proofweave.session import materialize

#: References from which a key is salted, and references of a piece.
HOT_ROWS = 20_000

_LOG = ("tbl", "field", "kind", "row_id", "ref", "loaded_at")


@dataclass(frozen=True)
class Source:
    """A referring column: ``kind`` names the records it points at; ``array`` columns are unnested."""

    rows: DataFrame
    tbl: str
    field: str
    key: str
    kind: str
    array: bool = False


def canonical(ref: Column) -> Column:
    """A reference trimmed of any white space and upper-cased; null if nothing is left."""
    bare = F.upper(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))
    return F.when(bare == "", F.lit(None)).otherwise(bare)


def reference_log(sources: list[Source]) -> DataFrame:
    """One row per delivered reference: ``tbl, field, kind, row_id, ref, loaded_at``."""
    parts = []
    for s in sources:
        raw = F.explode(F.col(s.field)) if s.array else F.col(s.field)
        part = s.rows.select(F.col(s.key).cast("long").alias("row_id"), raw.alias("raw"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))
        parts.append(part.select(F.lit(s.tbl).alias("tbl"), F.lit(s.field).alias("field"), F.lit(s.kind).alias("kind"), "row_id", canonical(F.col("raw")).alias("ref"), "loaded_at"))
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log.where(F.col("ref").isNotNull()).select(*_LOG)


def existence_deltas(records: dict[str, DataFrame]) -> DataFrame:
    """``kind, key, ts, delta``: ``+1`` at the earliest load of a record, ``-1`` when it is withdrawn."""
    parts = []
    for kind, rows in records.items():
        one = (
            rows.select(canonical(F.col("id")).alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
            .where(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.min("loaded_at").alias("loaded_at"), F.min("deleted_at").alias("deleted_at"))
        )
        change = F.array(
            F.struct(F.col("loaded_at").alias("ts"), F.lit(1).alias("delta")),
            F.struct(F.greatest("loaded_at", "deleted_at").alias("ts"), F.when(F.col("deleted_at").isNotNull(), -1).otherwise(0).alias("delta")),
        )
        parts.append(one.select(F.lit(kind).alias("kind"), "key", F.inline(change)).where(F.col("delta") != 0))
    deltas = parts[0]
    for part in parts[1:]:
        deltas = deltas.unionByName(part)
    return deltas


def reference_deltas(log: DataFrame) -> DataFrame:
    """``kind, key, ts, delta``: ``+1`` for every reference, repeated deliveries once."""
    once = log.groupBy("kind", F.col("ref").alias("key"), "tbl", "field", "row_id").agg(F.min("loaded_at").alias("ts"))
    return once.select("kind", "key", "ts", F.lit(1).alias("delta"))


def signed_counts(references: DataFrame, existence: DataFrame) -> DataFrame:
    """State per key: ``kind, key, refs, existing``. Sums are combined map-side before the shuffle."""
    both = references.select("kind", "key", F.col("delta").alias("refs"), F.lit(0).alias("existing")).unionByName(
        existence.select("kind", "key", F.lit(0).alias("refs"), F.col("delta").alias("existing"))
    )
    return both.groupBy("kind", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state after further deltas of the same shape; used by the streaming job."""
    return state.unionByName(deltas).groupBy("kind", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def orphan_state(counts: DataFrame) -> DataFrame:
    """Current orphans: keys with positive references and no existence."""
    return counts.where((F.col("refs") > 0) & (F.col("existing") <= 0))


def suspects(log: DataFrame, existence: DataFrame) -> DataFrame:
    """Keys that can have been referenced while they did not exist: ``kind, ref, refs, changes``.

    These are the keys with references whose existence count is not positive, and those referenced before their
    first existence; ``changes`` are the key's existence deltas in order. References are counted as delivered.
    """
    refs = log.groupBy("kind", "ref").agg(F.count(F.lit(1)).alias("refs"), F.min("loaded_at").alias("first_ref"))
    per_key = existence.groupBy("kind", F.col("key").alias("ref")).agg(
        F.sum("delta").alias("existing"), F.min(F.when(F.col("delta") > 0, F.col("ts"))).alias("born"), F.sort_array(F.collect_list(F.struct("ts", "delta"))).alias("changes")
    )
    doubtful = (F.coalesce("existing", F.lit(0)) <= 0) | (F.col("born") > F.col("first_ref"))
    return refs.join(per_key, ["kind", "ref"], "left").where(doubtful).select("kind", "ref", "refs", "changes")


def orphan_rows(log: DataFrame, existence: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every orphan reference: ``tbl, field, row_id, ref, period, reason``.

    The signed counts name the suspect keys; only their references are joined with the existence deltas, and
    repeated deliveries are folded after that. Keys with more than ``hot_rows`` references are spread over
    pieces in proportion to their exact count, for which their one row of deltas is repeated.
    """
    keys = materialize(suspects(log, existence), "suspects")
    hot = skew.hot_keys(keys, ["kind", "ref"], hot_rows, "refs")
    right = skew.repeated(keys.select("kind", "ref", "changes"), hot, ["kind", "ref"])
    left = skew.salted(log, hot, ["kind", "ref"], F.col("row_id"))
    held = left.join(right, ["kind", "ref", "salt"]).groupBy("kind", "ref", "tbl", "field", "row_id").agg(F.min("loaded_at").alias("w"), F.first("changes").alias("changes"))
    changes = F.col("changes")
    as_of = F.aggregate(F.filter(changes, lambda c: c["ts"] <= F.col("w")), F.lit(0), lambda total, c: total + c["delta"])
    reason = F.when(changes.isNull(), "missing").when(changes[0]["ts"] > F.col("w"), "late").when(as_of <= 0, "deleted")
    return held.select("tbl", "field", "row_id", "ref", F.date_format("w", "yyyy-MM").alias("period"), reason.alias("reason")).where(F.col("reason").isNotNull())


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason: ``n`` references to ``n_refs`` different keys."""
    return orphans.groupBy("tbl", "field", "period", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ref").alias("n_refs"))
