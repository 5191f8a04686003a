"""SQL twins of the ``pN_`` queries that SQL can express."""

from __future__ import annotations

_QUOTED = """texts AS (
  SELECT 'evidence' AS tbl, id AS row_key, quote AS text FROM evidence
  UNION ALL SELECT 'propositions', id, quote FROM propositions
  UNION ALL SELECT 'links', CAST(link_id AS VARCHAR), quote FROM links
  UNION ALL SELECT 'case_docs', doc_id || '#' || (i - 1), paragraphs[i].text
    FROM (SELECT doc_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM case_docs WHERE paragraphs IS NOT NULL))"""

_KINDS = """kinds AS (
  SELECT tbl, row_key, 'fullwidth' AS kind FROM texts WHERE regexp_matches(text, '[\\x{FF01}-\\x{FF5E}]')
  UNION SELECT tbl, row_key, 'mark' FROM texts WHERE regexp_matches(text, '\\p{M}')
  UNION SELECT tbl, row_key, 'invisible' FROM texts WHERE regexp_matches(text, '[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{3164}\\x{FEFF}\\x{FFA0}]')
  UNION SELECT tbl, row_key, 'space' FROM texts WHERE regexp_matches(text, '[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]')
  UNION SELECT tbl, row_key, 'mixed' FROM texts
    WHERE regexp_matches(text, '[\\p{Greek}\\p{Cyrillic}][\\p{L}\\p{N}\\p{M}]*\\p{Latin}|\\p{Latin}[\\p{L}\\p{N}\\p{M}]*[\\p{Greek}\\p{Cyrillic}]'))"""

_OVERSIZED = """long AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, paragraphs[i].text AS text
    FROM (SELECT doc_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM case_docs WHERE paragraphs IS NOT NULL)
    WHERE length(paragraphs[i].text) > 1200
  UNION SELECT doc_id, CAST(-1 AS BIGINT), array_to_string(list_transform(paragraphs, lambda p: p.text), chr(10)) FROM case_docs
    WHERE length(array_to_string(list_transform(paragraphs, lambda p: p.text), chr(10))) > 15000)"""

ORACLE = {
    "p4_found": f"WITH {_QUOTED}, {_KINDS} SELECT DISTINCT tbl, row_key FROM kinds",
    "p4_kinds": f"WITH {_QUOTED}, {_KINDS} SELECT tbl, kind, count(*) AS n FROM kinds GROUP BY ALL",
    "p5_found": f"WITH {_OVERSIZED} SELECT DISTINCT doc_id, pos FROM long",
    "p6_found": """
        SELECT prop_id, rank_no, evidence_id FROM (
          SELECT prop_id, evidence_id, row_number() OVER (PARTITION BY prop_id ORDER BY confidence DESC, evidence_id) AS rank_no
          FROM (SELECT prop_id, evidence_id, max(confidence + 0.0) AS confidence FROM links
                WHERE prop_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) AND evidence_id IS NOT NULL AND evidence_id <> ''
                GROUP BY ALL))
        WHERE rank_no <= 5""",
}
