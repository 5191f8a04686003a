"""Queries of the reference checks and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofweave.operators import references as R
from proofweave.sources.tables import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    deps = table(spark, folder, "dependencies")
    return R.reference_log(
        [
            R.Source(table(spark, folder, "links"), "links", "evidence_id", "link_id", "evidence"),
            R.Source(deps, "dependencies", "from_id", "dep_id", "proposition"),
            R.Source(deps, "dependencies", "to_id", "dep_id", "proposition"),
            R.Source(table(spark, folder, "quantum"), "quantum", "relies_on", "method_id", "proposition", array=True),
        ]
    )


def _existence(spark: SparkSession, folder: str) -> DataFrame:
    return R.existence_deltas({"evidence": table(spark, folder, "evidence"), "proposition": table(spark, folder, "propositions")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference to a record that is missing, withdrawn or not yet loaded."""
    return R.orphan_rows(_log(spark, folder), _existence(spark, folder))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    return R.orphan_report(p3_found(spark, folder))


def p3_state(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with references and no existence once all deltas are applied."""
    counts = R.signed_counts(R.reference_deltas(_log(spark, folder)), _existence(spark, folder))
    return R.orphan_state(counts).select("kind", "key", "refs", "existing")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_state)}

_REFS = """refs AS (
  SELECT tbl, field, kind, row_id, upper(trim(raw, E' \\t\\n\\r')) AS ref, min(loaded_at) AS w FROM (
    SELECT 'links' AS tbl, 'evidence_id' AS field, 'evidence' AS kind, link_id AS row_id, evidence_id AS raw, loaded_at FROM links
    UNION ALL SELECT 'dependencies', 'from_id', 'proposition', dep_id, from_id, loaded_at FROM dependencies
    UNION ALL SELECT 'dependencies', 'to_id', 'proposition', dep_id, to_id, loaded_at FROM dependencies
    UNION ALL SELECT 'quantum', 'relies_on', 'proposition', method_id, unnest(relies_on), loaded_at FROM quantum)
  WHERE raw IS NOT NULL AND trim(raw, E' \\t\\n\\r') <> '' GROUP BY ALL),
recs AS (
  SELECT 'evidence' AS kind, id, min(loaded_at) AS born, min(deleted_at) AS gone FROM evidence GROUP BY id
  UNION ALL SELECT 'proposition', id, min(loaded_at), min(deleted_at) FROM propositions GROUP BY id)"""

_FOUND = f"""{_REFS},
found AS (
  SELECT tbl, field, row_id, ref, strftime(w, '%Y-%m') AS period,
    CASE WHEN id IS NULL THEN 'missing' WHEN born > w THEN 'late' WHEN gone <= w THEN 'deleted' END AS reason
  FROM refs LEFT JOIN recs ON refs.kind = recs.kind AND refs.ref = recs.id)"""

ORACLE = {
    "p3_found": f"WITH {_FOUND} SELECT * FROM found WHERE reason IS NOT NULL",
    "p3_report": f"WITH {_FOUND} SELECT tbl, field, period, reason, count(*) AS n, count(DISTINCT ref) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_state": f"""WITH {_REFS}
        SELECT r.kind, r.ref AS key, count(*) AS refs, CAST(coalesce(max(CASE WHEN recs.id IS NULL THEN 0 WHEN gone IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS existing
        FROM refs r LEFT JOIN recs ON r.kind = recs.kind AND r.ref = recs.id
        GROUP BY r.kind, r.ref HAVING max(CASE WHEN recs.id IS NULL THEN 0 WHEN gone IS NULL THEN 1 ELSE 0 END) = 0""",
}
