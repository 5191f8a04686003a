"""SQL twins of the core queries, for DuckDB."""

from __future__ import annotations

from proofweave.functions.text import CHAT_STOPWORDS, CONCEPTS, EXHIBIT_MARKERS, NAVIGATION_PHRASES, NAVIGATION_VIEWS, PLEADING_MARKERS, STOPWORDS, WITNESS_MARKERS


#: White space of any kind, for trim.
_WS = "E' \\t\\n\\r\\f' || chr(11) || chr(133) || chr(160) || chr(5760) || chr(8239) || chr(8287) || chr(12288) || " + " || ".join(f"chr({c})" for c in (*range(8192, 8203), 8232, 8233))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_BASE = """props AS (SELECT DISTINCT id AS prop_id, prop_type, text, party, responds_to, quote, quote_ok, source.doc_id AS doc_id, source.page AS page, source.paragraph AS paragraph FROM propositions WHERE deleted_at IS NULL),
ev AS (SELECT DISTINCT id AS evidence_id, assertion, witness, quote, quote_ok, source.doc_id AS doc_id, source.page AS page, source.paragraph AS paragraph FROM evidence WHERE deleted_at IS NULL),
lk AS (SELECT DISTINCT link_id, prop_id, evidence_id, relation, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence + 0.0 END AS confidence, rationale, quote, quote_ok FROM links WHERE relation IN ('supportive', 'adverse', 'neutral')),
ml AS (SELECT lk.*, coalesce(ev.witness, '') AS witness, ev.doc_id, ev.page, ev.paragraph FROM lk JOIN ev ON lk.evidence_id = ev.evidence_id WHERE lk.prop_id IN (SELECT prop_id FROM props))"""

_STATUS = f"""{_BASE},
rolled AS (SELECT prop_id, bool_or(confidence >= 0.5 AND relation = 'supportive') AS sup, bool_or(confidence >= 0.5 AND relation = 'adverse') AS adv, count(*) AS n_links, count(*) FILTER (confidence >= 0.5) AS n_strong FROM ml GROUP BY prop_id),
st AS (SELECT prop_id, CASE WHEN sup AND adv THEN 'contested' WHEN sup THEN 'supported' WHEN adv THEN 'undermined' ELSE 'MISSING' END AS status, coalesce(n_links, 0) AS n_links, coalesce(n_strong, 0) AS n_strong FROM props LEFT JOIN rolled USING (prop_id))"""

_SUMMARY = """SELECT count(*) AS total, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'contested') AS contested, count(*) FILTER (status = 'undermined') AS undermined,
  count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status IN ('MISSING', 'undermined')) AS at_risk,
  round((count(*) FILTER (status = 'supported') + 0.5 * count(*) FILTER (status = 'contested')) / greatest(count(*), 1) * 100, 1) AS readiness_pct FROM st"""

_LOAD = "SELECT evidence_id, count(DISTINCT prop_id) AS degree, count(DISTINCT prop_id) FILTER (relation <> 'neutral') AS carries, count(*) FILTER (relation = 'supportive') AS supports, count(*) FILTER (relation = 'adverse') AS undermines, count(*) FILTER (relation = 'neutral') AS neutral FROM ml GROUP BY evidence_id"

_DEPS = """deps AS (SELECT from_id, to_id, min(dep_id) AS dep_id FROM dependencies WHERE from_id <> to_id AND from_id IN (SELECT prop_id FROM props) AND to_id IN (SELECT prop_id FROM props) GROUP BY from_id, to_id)"""
_RELIES = """relies AS (SELECT DISTINCT method_id, CAST(i - 1 AS BIGINT) AS pos, relies_on[i] AS prop_id FROM (SELECT method_id, relies_on, unnest(range(1, len(relies_on) + 1)) AS i FROM quantum) WHERE relies_on[i] IS NOT NULL)"""

_PARTY = """SELECT dim, value, count(*) AS n FROM (SELECT 'party' AS dim, coalesce(nullif(party, ''), 'Unspecified') AS value FROM props UNION ALL SELECT 'type', coalesce(nullif(prop_type, ''), 'proposition') FROM props) GROUP BY ALL"""


def _tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(STOPWORDS)}, t))"


_TEXT = f"""{_BASE},
txt AS (SELECT evidence_id AS doc_id, coalesce(assertion, '') || ' ' || coalesce(quote, '') AS text, quote FROM ev),
asked AS (SELECT prop_id AS query_id, text AS q FROM props WHERE CAST(substring(prop_id, 2) AS BIGINT) % 50 = 0)"""


def _bm25(name: str, column: str, k: int) -> str:
    return f"""w_{name} AS (SELECT doc_id, {_tok(column)} AS w FROM txt),
shape_{name} AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w_{name}),
tf_{name} AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w_{name}) GROUP BY ALL),
df_{name} AS (SELECT term, count(*) AS df FROM tf_{name} GROUP BY term),
qt_{name} AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_tok("q")}) AS term FROM asked) GROUP BY ALL),
sc_{name} AS (SELECT query_id, doc_id, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / mean))), 9) AS score
  FROM qt_{name} JOIN tf_{name} USING (term) JOIN df_{name} USING (term), shape_{name} GROUP BY ALL),
top_{name} AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk, score FROM sc_{name} WHERE score > 0) WHERE rnk <= {k})"""


_PARAS = """paras AS (SELECT DISTINCT doc_id, CAST(i - 1 AS BIGINT) AS pos, paragraphs[i].page AS page, coalesce(paragraphs[i].label, '') AS label, paragraphs[i].text AS text
  FROM (SELECT doc_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS i FROM case_docs) WHERE paragraphs[i].text IS NOT NULL)"""


def _sentences(c: str) -> str:
    # No look-behind in RE2: the places are marked first, then split; short pieces are folded from the left.
    pieces = f"list_filter(list_transform(string_split(regexp_replace({c}, '([.;])\\s+([\"''(A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, {_WS})), lambda s: s <> '')"
    return f"CASE WHEN len({pieces}) = 0 THEN [] ELSE string_split(list_reduce({pieces}, lambda a, b: CASE WHEN length(b) < 20 THEN a || ' ' || b ELSE a || chr(1) || b END), chr(1)) END"


_BARE = "CASE WHEN label <> '' AND starts_with(text, label) THEN trim(substring(text, length(label) + 1), " + _WS + ") ELSE text END"
_SPANS = f"""{_PARAS},
bare AS (SELECT doc_id, pos, page, label, {_BARE} AS text FROM paras),
cut AS (SELECT doc_id, pos, page, label, list_filter({_sentences("text")}, lambda s: length(s) >= 40) AS s FROM bare WHERE length(text) >= 40),
spans AS (SELECT doc_id, pos, page, label, CAST(i - 1 AS BIGINT) AS n, s[i] AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM cut))"""

_DOCS = """docs AS (SELECT doc_id, any_value(kind) AS kind, any_value(meta['title']) AS title, any_value(meta['witness_name']) AS witness_name, any_value(CAST(to_json(meta) AS VARCHAR)) AS meta_json,
  coalesce(any_value(array_to_string(list_transform(paragraphs, lambda p: p.text), chr(10))), '') AS full_text, max(list_max(list_transform(paragraphs, lambda p: p.page))) AS pages FROM case_docs GROUP BY doc_id)"""


def _hits(markers) -> str:
    return " + ".join(f"CAST(contains(opening, '{m}') OR contains(low, '{m}') AS INT)" for m in markers)


_KINDS = f"""{_DOCS},
low AS (SELECT doc_id, lower(substring(full_text, 1, 4000) || ' ' || coalesce(meta_json, '')) AS opening, lower(coalesce(title, '')) AS low FROM docs),
hit AS (SELECT doc_id, {_hits(PLEADING_MARKERS)} AS pl, {_hits(WITNESS_MARKERS)} AS wt, {_hits(EXHIBIT_MARKERS)} AS ex FROM low),
kinds AS (SELECT doc_id, CASE WHEN wt > 0 AND wt >= pl THEN 'witness_statement' WHEN pl > 0 THEN 'pleading' WHEN ex > 0 AND wt = 0 THEN 'exhibit' ELSE 'other' END AS kind FROM hit)"""

_QUOTE = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\"''`‘’“”]', '', 'g'), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1680}}\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"
_CANON = """CASE WHEN regexp_extract(low, '^(?:para\\s*)?0*([0-9]+)$', 1) <> '' THEN 'para:' || regexp_extract(low, '^(?:para\\s*)?0*([0-9]+)$', 1) ELSE regexp_replace(low, '\\s+', '', 'g') END"""
_LOW = "replace(replace(replace(trim(lower({c})), '¶', 'para '), 'paragraph', 'para'), '§', 'para ')"

_CHECKS = f"""{_BASE},
cited AS (SELECT prop_id, CAST(0 AS BIGINT) AS link_id, doc_id, quote, quote_ok FROM props UNION ALL SELECT prop_id, link_id, doc_id, quote, quote_ok FROM ml),
checks AS (SELECT prop_id, link_id, CASE WHEN coalesce(doc_id, '') = '' OR lower(doc_id) NOT IN (SELECT lower(doc_id) FROM case_docs) THEN 'fabricated_src' WHEN trim(coalesce(quote, '')) = '' THEN 'no_quote' WHEN coalesce(quote_ok, false) THEN 'exact' ELSE 'misquote' END AS status FROM cited)"""

_PAIRS = f"""{_BASE}, pairs AS (SELECT DISTINCT least(evidence_id, prop_id) AS a, greatest(evidence_id, prop_id) AS b FROM ml WHERE relation <> 'neutral'),
arcs AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs)"""
_RANK = f"""{_PAIRS}, deg AS (SELECT src, count(*) AS deg FROM arcs GROUP BY src), size AS (SELECT count(*) AS n FROM deg),
pr(it, id, rank) AS (SELECT 0, src, 1.0::DOUBLE / n FROM deg, size UNION ALL SELECT it + 1, dst, 0.15::DOUBLE / any_value(n) + 0.85 * sum(rank / deg) FROM pr JOIN arcs ON pr.id = arcs.src JOIN deg ON deg.src = arcs.src, size WHERE it < 60 GROUP BY it, dst),
ranked AS (SELECT id, round(rank / (SELECT max(rank) FROM pr WHERE it = 60), 4) AS rank FROM pr WHERE it = 60)"""

_LINES = """once AS (SELECT DISTINCT doc_id, CAST(pos AS BIGINT) AS pos, page, text FROM scan_paras),
lines AS (SELECT doc_id, pos, page, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM once WHERE text IS NOT NULL)),
pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id),
headers AS (SELECT doc_id, line, n FROM (SELECT doc_id, trim(line, E' \\t\\n\\r') AS line, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos, line_no) AS k FROM lines) WHERE k <= 4 GROUP BY ALL) JOIN pages USING (doc_id)
  WHERE length(line) BETWEEN 1 AND 30 AND n >= greatest(2, floor(pages * 0.5)))"""

_CHAT_WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z'']{{4,}}')), lambda w: NOT list_contains({_list(CHAT_STOPWORDS)}, w))"
_GOAL_WORDS = "list_filter(list_distinct(string_split(regexp_replace(lower(coalesce(question, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')), lambda w: length(w) > 3)"
_ASKED = "asked AS (SELECT DISTINCT chat_id, question FROM chat_cache WHERE chat_id % 50 = 0)"


def _short(c: str, n: int) -> str:
    flat = f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1680}}\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {n} THEN rtrim(substring({flat}, 1, {n - 1})) || '…' ELSE {flat} END"


def _view() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(low, '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in NAVIGATION_VIEWS)
    return "CASE WHEN NOT (" + " OR ".join(f"contains(low, '{p}')" for p in NAVIGATION_PHRASES) + f") THEN NULL {cases} END"


_QFORM = "regexp_replace(trim(regexp_replace(lower(coalesce(question, '')), '\\s+', ' ', 'g')), '[ ?.!]+$', '')"

ORACLE = {
    "matrix_status": f"WITH {_STATUS} SELECT * FROM st",
    "status_counts": f"WITH {_STATUS} SELECT s.status, count(st.prop_id) AS n FROM (VALUES ('supported'), ('contested'), ('undermined'), ('MISSING')) s(status) LEFT JOIN st USING (status) GROUP BY ALL",
    "trial_readiness": f"WITH {_STATUS} SELECT total, readiness_pct FROM ({_SUMMARY})",
    "case_summary": f"WITH {_STATUS} {_SUMMARY}",
    "party_type_counts": f"WITH {_BASE} {_PARTY}",
    "count_phrases": f"WITH {_BASE} SELECT dim, string_agg(n || ' ' || lower(value), ', ' ORDER BY n DESC, value) AS phrase FROM ({_PARTY}) GROUP BY dim",
    "matrix_csv": f"""WITH {_STATUS}
      SELECT prop_id, coalesce(prop_type, '') AS prop_type, coalesce(party, '') AS party, status, coalesce(text, '') AS proposition, relation, printf('%.2f', confidence) AS confidence, evidence_id, witness, coalesce(ml.doc_id, '') AS evidence_doc,
        coalesce(CAST(ml.page AS VARCHAR), '') AS evidence_page, coalesce(ml.paragraph, '') AS evidence_para, coalesce(rationale, '') AS rationale, coalesce(ml.quote, '') AS quote, coalesce(CAST(ml.quote_ok AS VARCHAR), '') AS quote_ok
      FROM props JOIN st USING (prop_id) JOIN ml USING (prop_id) WHERE confidence >= 0.5
      UNION ALL SELECT prop_id, coalesce(prop_type, ''), coalesce(party, ''), status, coalesce(text, ''), 'MISSING', '', '', '', '', '', '', 'no evidence retrieved', '', '' FROM props JOIN st USING (prop_id) WHERE n_links = 0""",
    "evidence_load": f"WITH {_BASE} {_LOAD}",
    "load_bearing": f"WITH {_BASE} SELECT *, row_number() OVER (ORDER BY carries DESC, supports DESC, evidence_id) AS rnk FROM ({_LOAD}) WHERE carries > 0 ORDER BY rnk LIMIT 10",
    "contradicted": f"WITH {_BASE} SELECT prop_id, count(*) FILTER (relation = 'supportive') AS supports, count(*) FILTER (relation = 'adverse') AS undermines, supports > 0 AND undermines > 0 AS contradicted FROM props LEFT JOIN ml USING (prop_id) GROUP BY prop_id",
    "sole_witness": f"""WITH {_BASE} SELECT prop_id, count(DISTINCT witness) FILTER (witness <> '') AS support_witnesses, CASE WHEN count(DISTINCT witness) FILTER (witness <> '') = 1 THEN max(witness) ELSE '' END AS sole_witness
      FROM ml WHERE relation = 'supportive' GROUP BY prop_id""",
    "spof": f"""WITH {_BASE}, lone AS (SELECT prop_id, min(evidence_id) AS evidence_id FROM ml WHERE relation = 'supportive' GROUP BY prop_id HAVING count(DISTINCT evidence_id) = 1)
      SELECT evidence_id, count(*) OVER (PARTITION BY evidence_id) AS n_props, prop_id FROM lone""",
    "witness_pairs": f"WITH {_BASE}, p AS (SELECT DISTINCT witness, prop_id FROM ml WHERE relation <> 'neutral' AND witness <> '') SELECT * FROM (SELECT witness, count(*) OVER (PARTITION BY witness) AS n_props, prop_id FROM p) WHERE n_props > 1",
    "contradictions": f"""WITH {_BASE}, s AS (SELECT DISTINCT prop_id, relation AS side, evidence_id FROM ml WHERE relation <> 'neutral')
      SELECT * FROM s WHERE prop_id IN (SELECT prop_id FROM s WHERE side = 'supportive') AND prop_id IN (SELECT prop_id FROM s WHERE side = 'adverse')""",
    "case_collapse": f"WITH {_BASE} SELECT prop_id, min(witness) AS witness FROM ml WHERE relation = 'supportive' GROUP BY prop_id HAVING count(DISTINCT witness) = 1",
    "valid_ids": f"WITH {_BASE}, {_RELIES} SELECT * FROM relies WHERE prop_id IN (SELECT prop_id FROM props)",
    "valid_deps": f"WITH {_BASE}, {_DEPS} SELECT * FROM deps",
    "weak_arguments": f"WITH {_STATUS}, {_RELIES} SELECT DISTINCT method_id, prop_id, status FROM relies JOIN st USING (prop_id) WHERE status IN ('MISSING', 'undermined')",
    "weak_premises": f"WITH {_STATUS}, {_DEPS} SELECT to_id AS premise, count(*) AS n_dependents FROM deps JOIN st ON st.prop_id = to_id WHERE status IN ('MISSING', 'undermined') GROUP BY to_id",
    "missing_docs": f"WITH {_BASE} SELECT DISTINCT doc_id FROM case_docs WHERE doc_id NOT IN (SELECT doc_id FROM ev WHERE doc_id IS NOT NULL UNION SELECT doc_id FROM props WHERE doc_id IS NOT NULL)",
    "apply_additions": f"""WITH {_BASE}, {_RELIES}, methods AS (SELECT DISTINCT method_id, confidence, risk_level FROM quantum),
      every AS (SELECT prop_id FROM props UNION SELECT 'U' || lpad(CAST(method_id AS VARCHAR), CAST(greatest(4, length(CAST(method_id AS VARCHAR))) AS INTEGER), '0') FROM methods),
      added AS (SELECT prop_id, CASE risk_level WHEN 'conservative' THEN 'adverse' ELSE 'supportive' END AS relation, coalesce(nullif(confidence, 0), 0.7) AS confidence FROM relies JOIN methods USING (method_id)),
      both_ AS (SELECT prop_id, relation, confidence FROM ml UNION ALL SELECT * FROM added),
      r AS (SELECT prop_id, bool_or(confidence >= 0.5 AND relation = 'supportive') AS sup, bool_or(confidence >= 0.5 AND relation = 'adverse') AS adv, count(*) AS n FROM both_ GROUP BY prop_id)
      SELECT prop_id, CASE WHEN sup AND adv THEN 'contested' WHEN sup THEN 'supported' WHEN adv THEN 'undermined' ELSE 'MISSING' END AS status, coalesce(n, 0) AS n_links FROM every LEFT JOIN r USING (prop_id)""",
    "goal_filter": f"WITH {_BASE}, {_ASKED}, w AS (SELECT DISTINCT chat_id AS goal_id, unnest({_GOAL_WORDS}) AS word FROM asked) SELECT DISTINCT goal_id, prop_id FROM w JOIN props ON contains(lower(concat_ws(' ', text, prop_type, party)), word)",
    "goal_filter_whole": f"""WITH {_BASE}, {_ASKED}, w AS (SELECT DISTINCT chat_id AS goal_id, unnest({_GOAL_WORDS}) AS word FROM asked),
      hay AS (SELECT prop_id, lower(concat_ws(' ', text, prop_type, party, quote)) AS h FROM props UNION ALL SELECT prop_id, lower(concat_ws(' ', witness, rationale, quote)) FROM ml)
      SELECT DISTINCT goal_id, prop_id FROM w JOIN hay ON contains(h, word)""",
    "keyword_topk": f"""WITH {_BASE}, {_ASKED}, w AS (SELECT DISTINCT chat_id AS query_id, unnest({_CHAT_WORDS}) AS word FROM asked),
      s AS (SELECT query_id, prop_id, count(*) AS score FROM w JOIN props ON contains(lower(coalesce(text, '')), word) GROUP BY ALL)
      SELECT * FROM (SELECT query_id, prop_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prop_id) AS rnk FROM s) WHERE rnk <= 3""",
    "matrix_signature": f"""WITH {_STATUS}, h AS (SELECT sha256(prop_id || '|' || coalesce(text, '') || '|' || status) AS h FROM props JOIN st USING (prop_id)),
      b AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY substring(h, 1, 3)) SELECT substring(sha256(string_agg(h, '' ORDER BY h)), 1, 16) AS signature FROM b""",
    "tokens": f"WITH {_TEXT}, w AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM txt) SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL",
    "bm25_stats": f"WITH {_TEXT}, {_bm25('t', 'text', 25)} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df_t, shape_t",
    "bm25_topk": f"WITH {_TEXT}, {_bm25('t', 'text', 25)} SELECT query_id, doc_id, rnk, round(score, 6) AS score FROM top_t",
    "rrf": f"""WITH {_TEXT}, {_bm25('t', 'text', 100)}, {_bm25('q', 'quote', 100)},
      u AS (SELECT query_id, doc_id, rnk AS r0, CAST(NULL AS BIGINT) AS r1 FROM top_t UNION ALL SELECT query_id, doc_id, NULL, rnk FROM top_q),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + coalesce(r0, r1))), 12) AS score, coalesce(min(r0), 1::BIGINT << 40) AS r0, coalesce(min(r1), 1::BIGINT << 40) AS r1 FROM u GROUP BY ALL)
      SELECT query_id, doc_id, rnk, round(score, 9) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, r1, doc_id) AS rnk FROM f) WHERE rnk <= 25""",
    "cosine_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q, v WHERE q.vec_id % 50 = 0)
      SELECT query_id, vec_id, rnk, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rnk FROM s) WHERE rnk <= 25""",
    "sentences": f"WITH {_PARAS}, cut AS (SELECT doc_id, pos, {_sentences('text')} AS s FROM paras) SELECT doc_id, pos, CAST(i - 1 AS BIGINT) AS n, s[i] AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM cut)",
    "atomic_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "heuristic_props": f"""WITH {_SPANS}, {_DOCS}, named AS (SELECT doc_id, lower(coalesce(title, '') || ' ' || doc_id) AS low FROM docs)
      SELECT doc_id, pos, n, CASE WHEN regexp_matches(text, '(?i)\\b(denie[sd]|deny|denying|not admitted|no admission|is denied|are denied|disput\\w+|reject\\w+|refut\\w+)\\b') THEN 'denial' ELSE 'allegation' END AS prop_type,
        CASE WHEN contains(low, 'defence') OR contains(low, 'defendant') OR contains(low, 'counterclaim') THEN 'Defendant' WHEN contains(low, 'claim') OR contains(low, 'particulars') THEN 'Claimant' ELSE '' END AS party, text FROM spans JOIN named USING (doc_id)""",
    "heuristic_evidence": f"WITH {_SPANS}, {_DOCS} SELECT doc_id, pos, n, coalesce(witness_name, '') AS witness, text AS assertion FROM spans JOIN docs USING (doc_id)",
    "classify_docs": f"WITH {_KINDS} SELECT * FROM kinds",
    "kind_counts": f"WITH {_KINDS} SELECT kind, count(*) AS n FROM kinds GROUP BY kind",
    "document_pages": f"WITH {_DOCS} SELECT doc_id, kind, coalesce(witness_name, '') AS witness, CAST(coalesce(pages, 0) AS BIGINT) AS pages FROM docs",
    "verify_quote": f"WITH {_BASE}, {_DOCS} SELECT evidence_id AS id, doc_id, length({_QUOTE.format(c='quote')}) >= 8 AND contains({_QUOTE.format(c='full_text')}, {_QUOTE.format(c='quote')}) AS quote_ok FROM ev JOIN docs USING (doc_id)",
    "canon_id": f"""WITH {_BASE}, raw AS (SELECT DISTINCT unnest([doc_id, paragraph, concat_ws(' ¶', nullif(trim(doc_id), ''), nullif(trim(paragraph), ''))]) AS raw FROM ev),
      l AS (SELECT raw, {_LOW.format(c='raw')} AS low FROM raw WHERE raw IS NOT NULL) SELECT raw, {_CANON} AS canon FROM l""",
    "concepts": f"SELECT doc_id, unnest(list_filter({_list(CONCEPTS)}, lambda c: contains(lower(coalesce(text, '')), c))) AS concept FROM documents",
    "navigation": f"SELECT chat_id, {_QFORM} AS question, {_view()} AS view FROM (SELECT *, lower(coalesce(question, '')) AS low FROM (SELECT DISTINCT chat_id, question FROM chat_cache))",
    "cache_keys": f"SELECT chat_id, substring(sha256(coalesce(signature, '') || '|' || {_QFORM}), 1, 16) AS key FROM (SELECT DISTINCT chat_id, signature, question FROM chat_cache)",
    "page_headers": f"WITH {_LINES} SELECT * FROM headers",
    "clean_pages": f"""WITH {_LINES} SELECT doc_id, pos, line_no, regexp_replace(regexp_replace(translate(rtrim(line), '�‘’“”–— ', '''''''""-- '), '(^|[\\s(])\\|([\\s,.;:)])', '\\1I\\2', 'g'), 'XX', 'XX') AS line FROM lines l
      WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.doc_id = l.doc_id AND h.line = trim(l.line, E' \\t\\n\\r')) AND NOT regexp_matches(trim(line), '(?i)^\\s*Page\\s+\\d+\\s+of\\s+\\d+\\s*$') AND NOT regexp_matches(trim(line), '(?i)^\\s*DocuSign Envelope ID:')""",
    "verify_matrix": f"WITH {_CHECKS} SELECT *, status = 'exact' AS ok FROM checks",
    "verify_summary": f"WITH {_CHECKS} SELECT count(*) AS total, count(*) FILTER (status = 'exact') AS verified, count(*) FILTER (status <> 'exact') AS flagged FROM checks",
    "graph_edges": f"""WITH {_BASE}, {_DEPS} SELECT evidence_id AS source, prop_id AS target, CASE relation WHEN 'supportive' THEN 'SUPPORTS' WHEN 'adverse' THEN 'UNDERMINES' ELSE 'NEUTRAL' END AS relation, CAST(printf('%.3f', confidence) AS DOUBLE) AS confidence FROM ml WHERE evidence_id <> ''
      UNION ALL SELECT from_id, to_id, 'DEPENDS_ON', 1.0 FROM deps""",
    "probative_edges": f"WITH {_PAIRS} SELECT * FROM pairs",
    "pagerank": f"WITH RECURSIVE {_RANK} SELECT * FROM ranked",
    "ego_2hop": f"""WITH {_PAIRS}, c AS (SELECT prop_id AS center FROM props WHERE CAST(substring(prop_id, 2) AS BIGINT) % 50 = 0),
      h1 AS (SELECT DISTINCT center, dst AS id FROM c JOIN arcs ON src = center), h2 AS (SELECT DISTINCT center, dst AS id FROM h1 JOIN arcs ON src = h1.id)
      SELECT center, id, min(hop) AS hop FROM (SELECT center, center AS id, 0::BIGINT AS hop FROM c UNION ALL SELECT center, id, 1 FROM h1 UNION ALL SELECT center, id, 2 FROM h2) GROUP BY ALL""",
    "components": f"""WITH RECURSIVE {_PAIRS}, cc(id, component) USING KEY (id) AS (SELECT src, src FROM arcs GROUP BY src UNION
      SELECT a.dst, min(u.component) FROM cc u JOIN arcs a ON u.id = a.src JOIN recurring.cc c ON c.id = a.dst WHERE u.component < c.component GROUP BY a.dst) SELECT id, component FROM cc""",
    "cycles": f"""WITH RECURSIVE {_BASE}, {_DEPS}, reach(a, b) AS (SELECT from_id, to_id FROM deps UNION SELECT r.a, d.to_id FROM reach r JOIN deps d ON d.from_id = r.b),
      mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) SELECT a AS id, min(b) AS loop FROM mutual GROUP BY a""",
    "human_review": f"""WITH RECURSIVE {_RANK}, {_STATUS[len(_BASE) + 2:]} SELECT prop_id, status, row_number() OVER (ORDER BY CASE status WHEN 'MISSING' THEN 0 WHEN 'undermined' THEN 1 ELSE 2 END, coalesce(rank, 0) DESC, prop_id) AS rnk
      FROM st LEFT JOIN ranked ON ranked.id = prop_id WHERE status <> 'supported' ORDER BY rnk LIMIT 8""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "case_digest": f"WITH {_STATUS} SELECT prop_id, printf('[%s] (%s, %s, status=%s) %s', prop_id, coalesce(prop_type, ''), coalesce(party, ''), status, coalesce(text, '')) AS line FROM props JOIN st USING (prop_id)",
    "strongest_edges": f"WITH {_BASE} SELECT link_id, evidence_id, prop_id, relation, confidence FROM ml WHERE relation <> 'neutral' ORDER BY confidence DESC, link_id LIMIT 300",
    "next_ids": """SELECT 'P' || lpad(CAST(max(CAST(substring(id, 2) AS BIGINT)) + 1 AS VARCHAR), 8, '0') AS next_id FROM propositions
      UNION ALL SELECT 'E' || lpad(CAST(max(CAST(substring(id, 2) AS BIGINT)) + 1 AS VARCHAR), 8, '0') FROM evidence""",
    "fragile": f"WITH {_BASE} SELECT prop_id, count(*) AS n_probative, bool_and(confidence < 0.5) AS fragile FROM ml WHERE relation <> 'neutral' GROUP BY prop_id",
    "priority": f"WITH RECURSIVE {_RANK} SELECT id, rank FROM ranked ORDER BY rank DESC, id LIMIT 10",
    "graph_nodes": f"""WITH {_STATUS}, f AS (SELECT evidence_id, arg_min({{'q': quote, 'r': rationale, 'w': witness, 'd': doc_id}}, {{'c': -confidence, 'l': link_id}}) AS f, count(*) FILTER (relation = 'supportive') AS supports, count(*) FILTER (relation = 'adverse') AS undermines FROM ml GROUP BY evidence_id),
      p AS (SELECT prop_id, count(*) FILTER (relation = 'supportive') AS supports, count(*) FILTER (relation = 'adverse') AS undermines FROM ml GROUP BY prop_id)
      SELECT prop_id AS id, 'proposition' AS kind, {_short('text', 90)} AS label, status, '' AS witness, coalesce(doc_id, '') AS doc_id, coalesce(supports, 0) AS supports, coalesce(undermines, 0) AS undermines FROM props JOIN st USING (prop_id) LEFT JOIN p USING (prop_id)
      UNION ALL SELECT evidence_id, 'evidence', {_short("coalesce(nullif(f.q, ''), nullif(f.r, ''), evidence_id)", 70)}, '', f.w, coalesce(f.d, ''), supports, undermines FROM f""",
}


def _sub(name: str) -> str:
    """Another twin as a table expression."""
    return f"({ORACLE[name]})"


# A vertex is a cut vertex if its component falls apart without it: from one neighbour of every vertex of two or
# more edges all others are sought that can be reached without passing it.
_CUT = f"""{_PAIRS},
cand AS (SELECT src AS v, min(dst) AS start FROM arcs GROUP BY src HAVING count(*) > 1),
walk(v, id) AS (SELECT v, start FROM cand UNION SELECT w.v, a.dst FROM walk w JOIN arcs a ON a.src = w.id WHERE a.dst <> w.v),
cut AS (SELECT DISTINCT a.src AS id FROM arcs a JOIN cand ON cand.v = a.src LEFT JOIN walk w ON w.v = a.src AND w.id = a.dst WHERE w.id IS NULL)"""

ORACLE["articulation"] = f"WITH RECURSIVE {_CUT} SELECT id FROM cut"
ORACLE["best_articulation"] = f"""WITH p AS (SELECT prop_id AS id FROM {_sub("matrix_status")}), r AS {_sub("pagerank")}, c AS {_sub("articulation")}
    SELECT p.id FROM p LEFT JOIN r USING (id) LEFT JOIN c ON c.id = p.id ORDER BY c.id IS NOT NULL DESC, coalesce(r.rank, 0) DESC, p.id LIMIT 1"""
ORACLE["fragments"] = f"""WITH RECURSIVE {_PAIRS}, out AS (SELECT id FROM {_sub("best_articulation")}),
    kept AS (SELECT src, dst FROM arcs WHERE src NOT IN (SELECT id FROM out) AND dst NOT IN (SELECT id FROM out)),
    every AS (SELECT DISTINCT src AS id FROM arcs WHERE src NOT IN (SELECT id FROM out)),
    cc(id, component) USING KEY (id) AS (SELECT id, id FROM every UNION SELECT k.dst, min(c.component) FROM cc c JOIN kept k ON k.src = c.id JOIN recurring.cc r ON r.id = k.dst WHERE c.component < r.component GROUP BY k.dst)
    SELECT count(DISTINCT component) AS n FROM cc"""

_FINDINGS = f"""{_BASE}, st AS {_sub("matrix_status")}, con AS {_sub("contradicted")}, loops AS {_sub("cycles")}, sp AS {_sub("spof")}, cutv AS {_sub("articulation")}, wa AS {_sub("weak_arguments")}, wp AS {_sub("weak_premises")},
frail AS (SELECT prop_id, bool_and(confidence < 0.5) AS fragile FROM ml WHERE relation <> 'neutral' GROUP BY prop_id),
counts AS (
  SELECT 'high' AS severity, 'extraction' AS lens, 'unverified source quotes' AS title, (SELECT count(*) FILTER (NOT coalesce(quote_ok, true)) FROM props) AS n
  UNION ALL SELECT 'low', 'extraction', 'denials not linked to an allegation', (SELECT count(*) FILTER (prop_type = 'denial' AND coalesce(responds_to, '') = '') FROM props)
  UNION ALL SELECT 'medium', 'classification', 'propositions on low-confidence evidence only', (SELECT count(*) FILTER (fragile) FROM frail)
  UNION ALL SELECT 'medium', 'classification', 'links with an unverified quote', (SELECT count(*) FILTER (NOT coalesce(quote_ok, true)) FROM ml)
  UNION ALL SELECT 'critical', 'contradiction', 'propositions without evidence', (SELECT count(*) FILTER (status = 'MISSING') FROM st)
  UNION ALL SELECT 'high', 'contradiction', 'propositions undermined', (SELECT count(*) FILTER (status = 'undermined') FROM st)
  UNION ALL SELECT 'high', 'contradiction', 'propositions with evidence both ways', (SELECT count(*) FILTER (contradicted) FROM con)
  UNION ALL SELECT 'high', 'stress', 'single points of failure', (SELECT count(DISTINCT evidence_id) FROM sp)
  UNION ALL SELECT 'medium', 'stress', 'structural cut points', (SELECT count(*) FROM cutv)
  UNION ALL SELECT 'high', 'stress', 'argument on weak ground', n FROM (SELECT method_id, count(*) AS n FROM wa GROUP BY method_id)
  UNION ALL SELECT 'high', 'stress', 'weak premise with dependents', n_dependents FROM wp),
always AS (
  SELECT 'info' AS severity, 'extraction' AS lens, 'propositions extracted' AS title, (SELECT count(*) FROM props) AS n
  UNION ALL SELECT 'info', 'human_review', 'propositions for a lawyer''s judgement', (SELECT count(*) FROM st WHERE status <> 'supported')
  UNION ALL SELECT CASE WHEN n > 0 THEN 'high' ELSE 'info' END, 'grounding', CASE WHEN n > 0 THEN 'links without a document' ELSE 'every link carries a document' END, n FROM (SELECT count(*) AS n FROM ml WHERE coalesce(doc_id, '') = '')
  UNION ALL SELECT CASE WHEN n > 0 THEN 'critical' ELSE 'info' END, 'contradiction', CASE WHEN n > 0 THEN 'loops of premises' ELSE 'no loop of premises' END, n FROM (SELECT count(DISTINCT loop) AS n FROM loops)),
found AS (SELECT * FROM counts WHERE n > 0 UNION ALL SELECT * FROM always
  UNION ALL SELECT 'info', 'stress', 'no single point of failure', 0 WHERE NOT EXISTS (SELECT 1 FROM counts WHERE lens = 'stress' AND n > 0))"""

ORACLE["stress_findings"] = f"WITH {_FINDINGS} SELECT severity, lens, title, CAST(n AS BIGINT) AS n FROM found"
ORACLE["stress_score"] = f"""WITH {_FINDINGS}, c AS (SELECT {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))} FROM found)
    SELECT CAST(greatest(0, 100 - least(critical, 6) * 10 - least(high, 6) * 6 - least(medium, 6) * 3 - least(low, 6)) AS BIGINT) AS score, * FROM c"""

_START = r"^\s*(\d+\.|\(?[a-z]\)|[a-z]\.|\(?(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)|Question\b|Answer\b)"
ORACLE["reflow"] = f"""WITH once AS (SELECT DISTINCT doc_id, CAST(pos AS BIGINT) AS pos, text FROM scan_paras WHERE text IS NOT NULL),
    folded AS (SELECT doc_id, pos, list_reduce(list_prepend('', list_transform(string_split(text, chr(10)), lambda s: trim(s, {_WS}))), lambda acc, s:
      CASE WHEN s = '' THEN CASE WHEN acc = '' OR ends_with(acc, chr(1)) THEN acc ELSE acc || chr(1) END
           WHEN acc = '' OR ends_with(acc, chr(1)) THEN acc || s
           WHEN regexp_matches(s, '{_START}', 'i') THEN acc || chr(1) || s
           WHEN ends_with(acc, '-') THEN acc[:-2] || s ELSE acc || ' ' || s END) AS f FROM once),
    parts AS (SELECT doc_id, pos, list_filter(string_split(f, chr(1)), lambda x: x <> '') AS p FROM folded)
    SELECT doc_id, pos, CAST(i - 1 AS BIGINT) AS n, p[i] AS text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)"""

_META = {"witness_name": r"^Witness\s*Name\s*:?\s*(.+)", "statement_no": r"^Statement\s*No\.?\s*:?\s*(.+)", "exhibits": r"^Exhibits?\s*:?\s*(.+)", "date": r"^\s*Date\s*:?\s*(.+)"}
_FIELDS = " UNION ALL ".join(f"SELECT doc_id, pos, line_no, '{k}' AS key, trim(regexp_extract(s, '{p}', 1, 'i'), {_WS}) AS value FROM bare" for k, p in _META.items())
ORACLE["scan_metadata"] = f"""WITH {_LINES}, bare AS (SELECT doc_id, pos, line_no, trim(line, {_WS}) AS s FROM lines),
    every AS ({_FIELDS} UNION ALL SELECT doc_id, pos, line_no, 'title', s FROM bare WHERE regexp_matches(s, 'WITNESS STATEMENT OF', 'i'))
    SELECT doc_id, key, arg_min(value, {{'p': pos, 'l': line_no}}) AS value FROM every WHERE value <> '' GROUP BY doc_id, key"""

_LIT = "coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
ORACLE["graph_cypher"] = f"""WITH n AS {_sub("graph_nodes")}, e AS {_sub("graph_edges")}
    SELECT 'MERGE (n:' || CASE kind WHEN 'proposition' THEN 'Proposition' ELSE 'Evidence' END || ' {{id: ' || {_LIT.format(c="id")} || '}}) SET n.label=' || {_LIT.format(c="label")} || ', n.status=' || {_LIT.format(c="status")} || ', n.witness=' || {_LIT.format(c="witness")} || ';' AS statement FROM n
    UNION ALL SELECT 'MATCH (a {{id: ' || {_LIT.format(c="source")} || '}}), (b {{id: ' || {_LIT.format(c="target")} || '}}) MERGE (a)-[r:' || relation || ']->(b) SET r.confidence=' || CAST(confidence AS VARCHAR) || ';' FROM e WHERE relation <> 'DEPENDS_ON'"""

ORACLE["chat_candidates"] = f"""WITH hits AS {_sub("keyword_topk")}, st AS {_sub("matrix_status")},
    risky AS (SELECT prop_id, row_number() OVER (ORDER BY prop_id) AS rnk FROM st WHERE status IN ('MISSING', 'undermined') ORDER BY prop_id LIMIT 3),
    q AS (SELECT DISTINCT chat_id AS query_id FROM chat_cache WHERE chat_id % 50 = 0)
    SELECT * FROM hits UNION ALL SELECT query_id, prop_id, 0::BIGINT AS score, rnk FROM q, risky WHERE query_id NOT IN (SELECT query_id FROM hits)"""

ORACLE["rrf_hybrid"] = f"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
    txt AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM v)),
    asked AS (SELECT doc_id AS query_id, text AS q FROM txt WHERE doc_id % 50 = 0), {_bm25("t", "text", 100)},
    sims AS (SELECT q.doc_id AS query_id, v.doc_id, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q, v WHERE q.doc_id % 50 = 0),
    top_c AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rnk FROM sims) WHERE rnk <= 100),
    u AS (SELECT query_id, doc_id, rnk AS r0, CAST(NULL AS BIGINT) AS r1 FROM top_t UNION ALL SELECT query_id, doc_id, NULL, rnk FROM top_c),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + coalesce(r0, r1))), 12) AS score, coalesce(min(r0), 1::BIGINT << 40) AS r0, coalesce(min(r1), 1::BIGINT << 40) AS r1 FROM u GROUP BY ALL)
    SELECT query_id, doc_id, rnk, round(score, 9) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, r1, doc_id) AS rnk FROM f) WHERE rnk <= 25"""
