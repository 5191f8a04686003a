"""Queries over the proof matrix, texts, ranking and the graph. Every query runs over its whole tables; where
one is a search, its query set is every record whose number is divisible by 50, held against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofweave.functions import text as X
from proofweave.operators import graph as G
from proofweave.operators import grounding as C
from proofweave.operators import layout as L
from proofweave.operators import matrix as M
from proofweave.operators import retrieval as R
from proofweave.operators import stress as T
from proofweave.session import materialize
from proofweave.sources import views as V
from proofweave.sources.tables import table
from proofweave.streaming import jobs as streams

QUERY_EVERY = 50


def _every(column: str, prefix: int = 1) -> F.Column:
    number = F.col(column) if prefix == 0 else F.substring(column, prefix + 1, 20).cast("long")
    return F.pmod(number, F.lit(QUERY_EVERY)) == 0


def _status(spark: SparkSession, d: str) -> DataFrame:
    return M.statuses(V.propositions(spark, d, "prop_id"), V.matrix_links(spark, d, "relation", "confidence"))


def matrix_status(spark, d):
    return _status(spark, d)


def status_counts(spark, d):
    return M.status_counts(_status(spark, d))


def trial_readiness(spark, d):
    return M.summary(_status(spark, d)).select("total", "readiness_pct")


def case_summary(spark, d):
    return M.summary(_status(spark, d))


def party_type_counts(spark, d):
    return M.party_type_counts(V.propositions(spark, d, "prop_id", "party", "prop_type"))


def count_phrases(spark, d):
    return M.phrase(M.party_type_counts(V.propositions(spark, d, "prop_id", "party", "prop_type")))


def matrix_csv(spark, d):
    return M.csv_rows(V.propositions(spark, d), V.matrix_links(spark, d))


def load_bearing(spark, d):
    return M.load_bearing(V.matrix_links(spark, d, "relation"))


def evidence_load(spark, d):
    return M.evidence_load(V.matrix_links(spark, d, "relation"))


def contradicted(spark, d):
    return M.contradicted(V.propositions(spark, d, "prop_id"), V.matrix_links(spark, d, "relation"))


def sole_witness(spark, d):
    return M.sole_witness(V.matrix_links(spark, d, "relation", "witness"))


def spof(spark, d):
    return M.single_points(V.matrix_links(spark, d, "relation"))


def witness_pairs(spark, d):
    return M.witness_groups(V.matrix_links(spark, d, "relation", "witness"))


def contradictions(spark, d):
    return M.contradictions(V.matrix_links(spark, d, "relation"))


def case_collapse(spark, d):
    return M.case_collapse(V.matrix_links(spark, d, "relation", "witness"))


def valid_ids(spark, d):
    return M.valid_reliances(V.reliances(spark, d), V.propositions(spark, d, "prop_id"))


def valid_deps(spark, d):
    return M.valid_dependencies(V.dependencies(spark, d), V.propositions(spark, d, "prop_id"))


def weak_arguments(spark, d):
    return M.weak_reliances(V.reliances(spark, d), _status(spark, d))


def weak_premises(spark, d):
    return M.weak_premises(valid_deps(spark, d), _status(spark, d))


def missing_docs(spark, d):
    used = V.evidence(spark, d, "evidence_id", "doc_id").select("doc_id").unionByName(V.propositions(spark, d, "prop_id", "doc_id").select("doc_id"))
    return M.missing_documents(table(spark, d, "case_docs"), used.where("doc_id is not null"))


def apply_additions(spark, d):
    """Damages methods as user additions: each is a new proposition and, as evidence, a link to every
    proposition it relies on."""
    methods = table(spark, d, "quantum").select("method_id", "confidence", "risk_level").distinct()
    new_props = methods.select(F.format_string("U%04d", "method_id").alias("prop_id"))
    relation = F.when(F.col("risk_level") == "conservative", "adverse").when(F.col("risk_level") == "moderate", "supportive")
    new_links = V.reliances(spark, d).join(methods, "method_id").select("prop_id", F.format_string("UE%04d", "method_id").alias("evidence_id"), relation.alias("relation"), "confidence")
    return M.apply_additions(V.propositions(spark, d, "prop_id"), V.matrix_links(spark, d, "relation", "confidence"), new_props, new_links)


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "chat_cache").where(_every("chat_id", 0)).select(F.col("chat_id").alias("query_id"), "question").distinct()


def goal_filter(spark, d):
    goals = _questions(spark, d).select(F.col("query_id").alias("goal_id"), "question")
    return M.goal_matches(goals, V.propositions(spark, d, "prop_id", "text", "prop_type", "party"), X.goal_words(F.col("question")))


def goal_filter_whole(spark, d):
    """As ``goal_filter``, whose SQL twin fixes the fields it searches, over all fields of the blueprint."""
    goals = _questions(spark, d).select(F.col("query_id").alias("goal_id"), "question")
    props, links = V.propositions(spark, d, "prop_id", "text", "prop_type", "party", "quote"), V.matrix_links(spark, d, "witness", "rationale", "quote")
    return M.goal_matches(goals, props, X.goal_words(F.col("question")), links)


def keyword_topk(spark, d):
    return M.keyword_top(_questions(spark, d), V.propositions(spark, d, "prop_id", "text"), X.chat_words(F.col("question")))


def chat_candidates(spark, d):
    return M.chat_candidates(_questions(spark, d), V.propositions(spark, d, "prop_id", "text"), _status(spark, d), X.chat_words(F.col("question")))


def matrix_signature(spark, d):
    return M.signature(V.propositions(spark, d, "prop_id", "text"), _status(spark, d))


def tokens(spark, d):
    docs = _evidence_text(spark, d)
    return R.term_counts(docs, X.tokens(F.col("text"))).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def _evidence_text(spark, d) -> DataFrame:
    """``doc_id, text``: the retrieval text of every evidence record."""
    return V.evidence(spark, d, "evidence_id", "assertion", "quote").select(F.col("evidence_id").alias("doc_id"), F.concat_ws(" ", F.coalesce("assertion", F.lit("")), F.coalesce("quote", F.lit(""))).alias("text"), "quote")


def bm25_stats(spark, d):
    return R.bm25_stats(_evidence_text(spark, d), X.tokens(F.col("text"))).select("term", "df", F.round("idf", 9).alias("idf"))


def _asked(spark, d) -> DataFrame:
    return V.propositions(spark, d, "prop_id", "text").where(_every("prop_id")).select(F.col("prop_id").alias("query_id"), F.col("text").alias("q"))


def bm25_topk(spark, d):
    return R.bm25_top(_asked(spark, d), _evidence_text(spark, d), X.tokens(F.col("q")), X.tokens(F.col("text"))).select("query_id", "doc_id", "rnk", F.round("score", 6).alias("score"))


def rrf(spark, d):
    """Fusion of two rankings: by the whole record, and by its quote alone."""
    docs, asked, q = _evidence_text(spark, d), _asked(spark, d), X.tokens(F.col("q"))
    whole = R.bm25_top(asked, docs, q, X.tokens(F.col("text")), 100)
    quoted = R.bm25_top(asked, docs, q, X.tokens(F.col("quote")), 100)
    return R.fuse([whole, quoted]).select("query_id", "doc_id", "rnk", F.round("score", 9).alias("score"))


def rrf_hybrid(spark, d):
    """Fusion of a lexical and a dense ranking of the documents that have a vector: BM25 of the texts, asked by a
    document's text, and cosine of the vectors; vectors belong to the document of their number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text").distinct().join(vectors.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = docs.where(_every("doc_id", 0)).select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))
    lexical = R.bm25_top(asked, docs, X.tokens(F.col("q")), X.tokens(F.col("text")), 100)
    wanted = vectors.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    held = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    return R.fuse([lexical, R.cosine_top(wanted, held, 100, "doc_id")]).select("query_id", "doc_id", "rnk", F.round("score", 9).alias("score"))


def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return R.cosine_top(vectors.where(_every("vec_id", 0)), vectors).select("query_id", "vec_id", "rnk", F.round("sim", 6).alias("sim"))


def sentences(spark, d):
    cut = V.paragraphs(spark, d).select("doc_id", "pos", F.posexplode(X.sentences(F.col("text"))).alias("n", "text"))
    return cut.select("doc_id", "pos", F.col("n").cast("long").alias("n"), "text")


def atomic_spans(spark, d):
    cut = V.paragraphs(spark, d).select("doc_id", "pos", "page", "label", F.posexplode(X.spans(F.col("text"), F.col("label"))).alias("n", "text"))
    return cut.select("doc_id", "pos", "page", "label", F.col("n").cast("long").alias("n"), "text")


def heuristic_props(spark, d):
    docs = V.case_docs(spark, d).select("doc_id", X.party_of(F.concat_ws(" ", F.coalesce("title", F.lit("")), "doc_id")).alias("party"))
    return atomic_spans(spark, d).join(docs, "doc_id").select("doc_id", "pos", "n", F.when(X.is_denial(F.col("text")), "denial").otherwise("allegation").alias("prop_type"), "party", "text")


def heuristic_evidence(spark, d):
    docs = V.case_docs(spark, d).select("doc_id", F.coalesce("witness_name", F.lit("")).alias("witness"))
    return atomic_spans(spark, d).join(docs, "doc_id").select("doc_id", "pos", "n", "witness", F.col("text").alias("assertion"))


def classify_docs(spark, d):
    docs = V.case_docs(spark, d)
    opening = F.lower(F.concat(F.substring("full_text", 1, 4000), F.lit(" "), F.coalesce("meta_json", F.lit(""))))
    return docs.select("doc_id", X.document_kind(opening, F.lower(F.coalesce("title", F.lit("")))).alias("kind"))


def kind_counts(spark, d):
    return classify_docs(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def document_pages(spark, d):
    """Kind, witness and last page of every document."""
    pages = table(spark, d, "case_docs").select("doc_id", F.array_max(F.transform("paragraphs", lambda p: p["page"])).alias("pages")).distinct()
    return V.case_docs(spark, d).select("doc_id", "kind", F.coalesce("witness_name", F.lit("")).alias("witness")).join(pages, "doc_id").select("doc_id", "kind", "witness", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


def verify_quote(spark, d):
    quotes = V.evidence(spark, d, "evidence_id", "doc_id", "quote").where("doc_id is not null").select(F.col("evidence_id").alias("id"), "doc_id", "quote")
    return C.quotes_in_sources(quotes, V.case_docs(spark, d))


def canon_id(spark, d):
    raw = V.evidence(spark, d, "evidence_id", "doc_id", "paragraph").select(F.explode(F.array("doc_id", "paragraph", X.citation_label(F.col("doc_id"), F.col("paragraph")))).alias("raw")).where("raw is not null").distinct()
    return raw.select("raw", X.citation_key(F.col("raw")).alias("canon"))


def concepts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.concepts(F.col("text"))).alias("concept"))


def navigation(spark, d):
    asked = table(spark, d, "chat_cache").select("chat_id", "question").distinct()
    return asked.select("chat_id", X.question_form(F.col("question")).alias("question"), X.navigation(F.col("question")).alias("view"))


def cache_keys(spark, d):
    asked = table(spark, d, "chat_cache").select("chat_id", "signature", "question").distinct()
    return asked.select("chat_id", X.cache_key(F.coalesce("signature", F.lit("")), F.col("question")).alias("key"))


def page_headers(spark, d):
    return L.page_headers(L.lines(table(spark, d, "scan_paras")))


def clean_pages(spark, d):
    rows = L.lines(table(spark, d, "scan_paras"))
    return L.clean_lines(rows, L.page_headers(rows)).select("doc_id", "pos", F.col("line_no").cast("long").alias("line_no"), "line")


def reflow(spark, d):
    once = table(spark, d, "scan_paras").select("doc_id", F.col("pos").cast("long").alias("pos"), "text").distinct()
    return once.select("doc_id", "pos", F.posexplode(L.reflow(F.col("text"))).alias("n", "text")).select("doc_id", "pos", F.col("n").cast("long").alias("n"), "text")


def scan_metadata(spark, d):
    return L.metadata(L.lines(table(spark, d, "scan_paras")))


def verify_matrix(spark, d):
    return C.verify_matrix(V.propositions(spark, d, "prop_id", "doc_id", "quote", "quote_ok"), V.matrix_links(spark, d, "quote", "quote_ok", "doc_id"), table(spark, d, "case_docs").select("doc_id"))


def verify_summary(spark, d):
    return C.verify_summary(verify_matrix(spark, d))


def _checks(spark, d) -> DataFrame:
    cited = V.evidence(spark, d, "evidence_id", "doc_id", "quote")
    citations = cited.select(F.col("evidence_id").alias("claim_id"), F.coalesce("doc_id", F.lit("")).alias("source_id"), "quote")
    bundle = V.case_docs(spark, d).where("full_text <> ''").select(F.col("doc_id").alias("source_id"), F.col("full_text").alias("text"))
    return C.verify_citations(citations, bundle)


def verify_citations(spark, d):
    return _checks(spark, d).withColumn("score", F.round("score", 6))


def guard(spark, d):
    return C.guard(_checks(spark, d))


def graph_edges(spark, d):
    e = G.edges(V.matrix_links(spark, d, "relation", "confidence", "rationale", "quote")).unionByName(G.dependency_edges(valid_deps(spark, d)))
    return e.select("source", "target", "relation", "confidence")


def graph_nodes(spark, d):
    props, links = V.propositions(spark, d, "prop_id", "text", "doc_id"), V.matrix_links(spark, d, "relation", "confidence", "rationale", "quote", "witness", "doc_id")
    return G.nodes(props, links, M.statuses(props, links))


def graph_cypher(spark, d):
    return G.cypher(graph_nodes(spark, d), G.edges(V.matrix_links(spark, d, "relation", "confidence", "rationale", "quote")))


def probative_edges(spark, d):
    return G.probative_pairs(V.matrix_links(spark, d, "relation"))


def _pairs(spark, d) -> DataFrame:
    return materialize(probative_edges(spark, d), "probative")


def pagerank(spark, d):
    return G.pagerank(_pairs(spark, d)).select("id", F.round("rank", 4).alias("rank"))


def components(spark, d):
    return G.components(_pairs(spark, d))


def fragments(spark, d):
    """Components left when the highest-ranked proposition that is a cut vertex is removed."""
    pairs = _pairs(spark, d)
    return G.fragments(pairs, [r["id"] for r in best_articulation(spark, d).collect()])


def ego_2hop(spark, d):
    centers = V.propositions(spark, d, "prop_id").where(_every("prop_id")).select(F.col("prop_id").alias("center"))
    return G.ego(_pairs(spark, d), centers, 2)


def communities(spark, d):
    return G.communities(_pairs(spark, d), V.matrix_links(spark, d, "relation", "witness"), V.propositions(spark, d, "prop_id"))


def communities_synchronous(spark, d):
    return G.communities_synchronous(_pairs(spark, d), V.matrix_links(spark, d, "relation", "witness"))


def articulation(spark, d):
    return G.articulation(_pairs(spark, d))


def best_articulation(spark, d):
    pairs = _pairs(spark, d)
    return G.best_articulation(G.articulation(pairs), G.pagerank(pairs), V.propositions(spark, d, "prop_id"))


def cycles(spark, d):
    return G.cycles(valid_deps(spark, d))


def human_review(spark, d):
    rank = G.pagerank(_pairs(spark, d)).select("id", F.round("rank", 4).alias("rank"))
    return M.human_review(_status(spark, d), rank)


def _findings(spark, d) -> DataFrame:
    props = V.propositions(spark, d, "prop_id", "quote_ok", "prop_type", "responds_to")
    links = materialize(V.matrix_links(spark, d, "relation", "confidence", "quote_ok", "doc_id"), "links")
    status = materialize(M.statuses(props, links), "status")
    deps = valid_deps(spark, d)
    return T.findings(props, links, status, M.contradicted(props, links), M.single_points(links), G.articulation(G.probative_pairs(links)), G.cycles(deps), M.weak_reliances(V.reliances(spark, d), status), M.weak_premises(deps, status))


def stress_findings(spark, d):
    return _findings(spark, d)


def stress_score(spark, d):
    return T.score(_findings(spark, d))


def case_digest(spark, d):
    return M.digest(V.propositions(spark, d, "prop_id", "prop_type", "party", "text"), _status(spark, d))


def strongest_edges(spark, d):
    return M.strongest_links(V.matrix_links(spark, d, "relation", "confidence"))


def next_ids(spark, d):
    return M.next_ids(table(spark, d, "propositions"), "id", "P", 8).unionByName(M.next_ids(table(spark, d, "evidence"), "id", "E", 8))


def fragile(spark, d):
    return M.probative_fragility(V.matrix_links(spark, d, "relation", "confidence"))


def priority(spark, d):
    return G.priority(G.pagerank(_pairs(spark, d)).select("id", F.round("rank", 4).alias("rank")))


def community_summary(spark, d):
    pairs = _pairs(spark, d)
    return G.community_summary(G.communities(pairs, V.matrix_links(spark, d, "relation", "witness"), V.propositions(spark, d, "prop_id", "text")), G.pagerank(pairs), V.propositions(spark, d, "prop_id", "text"))


def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        matrix_status, status_counts, trial_readiness, case_summary, party_type_counts, count_phrases, matrix_csv, load_bearing, evidence_load, contradicted, sole_witness, spof, witness_pairs,
        contradictions, case_collapse, valid_ids, valid_deps, weak_arguments, weak_premises, missing_docs, apply_additions, goal_filter, goal_filter_whole, keyword_topk, chat_candidates, matrix_signature, tokens, bm25_stats, bm25_topk,
        rrf, rrf_hybrid, cosine_topk, sentences, atomic_spans, heuristic_props, heuristic_evidence, classify_docs, kind_counts, document_pages, verify_quote, canon_id, concepts, navigation, cache_keys,
        page_headers, clean_pages, reflow, scan_metadata, verify_matrix, verify_summary, verify_citations, guard, graph_edges, graph_nodes, graph_cypher, probative_edges, pagerank, components,
        fragments, ego_2hop, communities, communities_synchronous, articulation, best_articulation, cycles, human_review, stress_findings, stress_score, case_digest, strongest_edges, next_ids, fragile, priority, community_summary, event_windows,
    )
}
