"""The proof matrix: links rolled up per proposition, and what follows from the statuses.

Inputs are the views of :mod:`proofweave.sources.views`. Defined results: a proposition without links is
``MISSING``; null confidences count as 0; an empty matrix gives empty rows, and counts of 0 where a fixed set
of buckets is listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofweave.session import materialize

STATUSES = ("supported", "contested", "undermined", "MISSING")
GATE = 0.5


def status_of(supported: Column, undermined: Column) -> Column:
    """The four-bucket status."""
    return F.when(supported & undermined, "contested").when(supported, "supported").when(undermined, "undermined").otherwise("MISSING")


def statuses(props: DataFrame, links: DataFrame, gate: float = GATE) -> DataFrame:
    """``prop_id, status, n_links, n_strong``. Links are rolled up map-side before the join."""
    strong = F.col("confidence") >= gate
    rolled = links.groupBy("prop_id").agg(
        F.bool_or(strong & (F.col("relation") == "supportive")).alias("sup"),
        F.bool_or(strong & (F.col("relation") == "adverse")).alias("adv"),
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(strong).alias("n_strong"),
    )
    no = F.lit(False)
    joined = props.select("prop_id").join(rolled, "prop_id", "left")
    return joined.select("prop_id", status_of(F.coalesce("sup", no), F.coalesce("adv", no)).alias("status"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_strong", F.lit(0)).alias("n_strong"))


def status_counts(status: DataFrame) -> DataFrame:
    """``status, n`` for all four buckets, zeros included; one row of conditional counts, unpivoted."""
    one = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])))


def summary(status: DataFrame) -> DataFrame:
    """One row: totals, buckets, propositions at risk and trial readiness in percent."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    total = F.count(F.lit(1))
    ready = F.round((n["supported"] + 0.5 * n["contested"]) / F.greatest(total, F.lit(1)) * 100, 1)
    return status.agg(total.alias("total"), n["supported"].alias("supported"), n["contested"].alias("contested"), n["undermined"].alias("undermined"), n["MISSING"].alias("missing"), (n["MISSING"] + n["undermined"]).alias("at_risk"), ready.alias("readiness_pct"))


def party_type_counts(props: DataFrame) -> DataFrame:
    """``dim, value, n``: propositions per party and per type."""
    filled = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))
    both = F.array(F.struct(F.lit("party").alias("dim"), filled("party", "Unspecified").alias("value")), F.struct(F.lit("type").alias("dim"), filled("prop_type", "proposition").alias("value")))
    return props.select(F.inline(both)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def phrase(counts: DataFrame) -> DataFrame:
    """``dim, phrase``: the counts in words, largest first, ties by name."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("value").alias("value"))))
    words = F.transform(order, lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), F.lower(x["value"])))
    return counts.groupBy("dim").agg(F.array_join(words, ", ").alias("phrase"))


def csv_rows(props: DataFrame, links: DataFrame, gate: float = GATE, include_empty: bool = False) -> DataFrame:
    """The flat matrix as text columns. A proposition with links but none at the gate gives no row, unless
    ``include_empty``; one without links gives a ``MISSING`` row."""
    status = statuses(props, links, gate)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    strong = links.where(F.col("confidence") >= gate)
    names = ("relation", "confidence", "evidence_id", "witness", "evidence_doc", "evidence_page", "evidence_para", "rationale", "quote", "quote_ok")
    side = strong.select("prop_id", "relation", F.expr("format_number(confidence, '0.00')").alias("confidence"), "evidence_id", "witness", text("doc_id").alias("evidence_doc"), text("page").alias("evidence_page"), text("paragraph").alias("evidence_para"), text("rationale").alias("rationale"), text("quote").alias("quote"), text("quote_ok").alias("quote_ok"))
    head = props.join(status, "prop_id").select("prop_id", text("prop_type").alias("prop_type"), text("party").alias("party"), "status", text("text").alias("proposition"), "n_links", "n_strong")
    with_links = head.drop("n_links", "n_strong").join(side, "prop_id")
    bare = head.where("n_strong = 0" if include_empty else "n_links = 0").drop("n_links", "n_strong")
    fill = {"relation": "MISSING", "rationale": "no evidence retrieved"}
    return with_links.unionByName(bare.withColumns({n: F.lit(fill.get(n, "")) for n in names}))


def nested(props: DataFrame, links: DataFrame, gate: float = GATE) -> DataFrame:
    """The matrix as one row per proposition with its links as an array, strongest first. A view for the edge
    of the engine: a proposition's links lie in one row, as its readers expect."""
    cell = F.struct((-F.col("confidence")).alias("k"), "evidence_id", "relation", "confidence", "rationale", "quote", "quote_ok", "witness", F.struct("doc_id", "page", "paragraph").alias("evidence_source"))
    packed = links.groupBy("prop_id").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.dropFields("k")).alias("links"))
    return props.join(statuses(props, links, gate), "prop_id").join(packed, "prop_id", "left")


def evidence_load(links: DataFrame) -> DataFrame:
    """``evidence_id, degree, carries, supports, undermines, neutral``."""
    probative = F.col("relation") != "neutral"
    per_pair = links.groupBy("evidence_id", "prop_id").agg(*[F.count_if(F.col("relation") == r).alias(n) for r, n in (("supportive", "s"), ("adverse", "u"), ("neutral", "n"))], F.bool_or(probative).alias("p"))
    return per_pair.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("degree"), F.count_if("p").alias("carries"), F.sum("s").alias("supports"), F.sum("u").alias("undermines"), F.sum("n").alias("neutral"))


def load_bearing(links: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` evidence items that carry most propositions, with their rank."""
    top = evidence_load(links).where("carries > 0").orderBy(F.desc("carries"), F.desc("supports"), "evidence_id").limit(n)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("carries"), F.desc("supports"), "evidence_id")).cast("long"))


def contradicted(props: DataFrame, links: DataFrame) -> DataFrame:
    """``prop_id, supports, undermines, contradicted``, without the confidence gate."""
    rolled = links.groupBy("prop_id").agg(F.count_if(F.col("relation") == "supportive").alias("s"), F.count_if(F.col("relation") == "adverse").alias("u"))
    joined = props.select("prop_id").join(rolled, "prop_id", "left").select("prop_id", F.coalesce("s", F.lit(0)).alias("supports"), F.coalesce("u", F.lit(0)).alias("undermines"))
    return joined.withColumn("contradicted", (F.col("supports") > 0) & (F.col("undermines") > 0))


def sole_witness(links: DataFrame) -> DataFrame:
    """``prop_id, support_witnesses, sole_witness`` of propositions with support; unnamed witnesses do not
    count."""
    pairs = links.where("relation = 'supportive'").groupBy("prop_id", "witness").agg(F.lit(1).alias("x"))
    named = F.col("witness") != ""
    rolled = pairs.groupBy("prop_id").agg(F.count_if(named).alias("support_witnesses"), F.max(F.when(named, F.col("witness"))).alias("w"))
    return rolled.select("prop_id", "support_witnesses", F.when(F.col("support_witnesses") == 1, F.col("w")).otherwise("").alias("sole_witness"))


def single_points(links: DataFrame) -> DataFrame:
    """``evidence_id, n_props, prop_id``: propositions that exactly one evidence item supports."""
    pairs = links.where("relation = 'supportive'").select("prop_id", "evidence_id").distinct()
    lone = pairs.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("evidence_id")).where("n = 1")
    counts = lone.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_props"))
    return lone.join(counts, "evidence_id").select("evidence_id", "n_props", "prop_id")


def witness_groups(links: DataFrame) -> DataFrame:
    """``witness, n_props, prop_id`` of witnesses that tie two or more propositions together: the pairs of
    propositions that share a witness, kept by group so that their number stays linear."""
    pairs = links.where("relation <> 'neutral' and witness <> ''").select("witness", "prop_id").distinct()
    counts = pairs.groupBy("witness").agg(F.count(F.lit(1)).alias("n_props")).where("n_props > 1")
    return pairs.join(counts, "witness").select("witness", "n_props", "prop_id")


def contradictions(links: DataFrame) -> DataFrame:
    """``prop_id, side, evidence_id`` of propositions with both supporting and adverse evidence: every pair
    of opposite items, kept by side so that their number stays linear."""
    sides = links.where("relation <> 'neutral'").select("prop_id", F.col("relation").alias("side"), "evidence_id").distinct()
    both = sides.groupBy("prop_id").agg(F.count_if(F.col("side") == "supportive").alias("s"), F.count_if(F.col("side") == "adverse").alias("u")).where("s > 0 and u > 0").select("prop_id")
    return sides.join(both, "prop_id", "left_semi")


def case_collapse(links: DataFrame) -> DataFrame:
    """``prop_id, witness`` of propositions whose support has one witness value, unnamed ones included."""
    pairs = links.where("relation = 'supportive'").select("prop_id", "witness").distinct()
    return pairs.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n"), F.min("witness").alias("witness")).where("n = 1").select("prop_id", "witness")


def weak_reliances(reliances: DataFrame, status: DataFrame) -> DataFrame:
    """``method_id, prop_id, status`` of reliances on missing or undermined propositions."""
    weak = status.where(F.col("status").isin("MISSING", "undermined")).select("prop_id", "status")
    return reliances.select("method_id", "prop_id").distinct().join(weak, "prop_id").select("method_id", "prop_id", "status")


def valid_reliances(reliances: DataFrame, props: DataFrame) -> DataFrame:
    """Reliances on known propositions, their places kept."""
    return reliances.join(props.select("prop_id"), "prop_id", "left_semi").select("method_id", "pos", "prop_id")


def valid_dependencies(deps: DataFrame, props: DataFrame) -> DataFrame:
    """``from_id, to_id, dep_id``: known ends, no loops on one proposition, every pair once (first wins)."""
    ids = props.select("prop_id")
    known = deps.where("from_id <> to_id").join(ids.withColumnRenamed("prop_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("prop_id", "to_id"), "to_id", "left_semi")
    return known.groupBy("from_id", "to_id").agg(F.min("dep_id").alias("dep_id"))


def weak_premises(deps: DataFrame, status: DataFrame) -> DataFrame:
    """``premise, n_dependents`` of missing or undermined premises that others depend on."""
    weak = status.where(F.col("status").isin("MISSING", "undermined")).select(F.col("prop_id").alias("premise"))
    return deps.groupBy(F.col("to_id").alias("premise")).agg(F.count(F.lit(1)).alias("n_dependents")).join(weak, "premise", "left_semi")


def missing_documents(docs: DataFrame, used: DataFrame) -> DataFrame:
    """``doc_id`` of documents from which no record was extracted."""
    return docs.select("doc_id").distinct().join(used.select("doc_id").distinct(), "doc_id", "left_anti")


def apply_additions(props: DataFrame, links: DataFrame, new_props: DataFrame, new_links: DataFrame, gate: float = GATE, default: float = 0.7) -> DataFrame:
    """``prop_id, status, n_links`` after user additions.

    ``new_links`` holds ``prop_id, evidence_id, relation, confidence``; a null or zero confidence is
    ``default``, a null relation supportive, an empty evidence id or unknown proposition is left out. Only
    the rolled-up flags of touched propositions change, so the fact table is read once.
    """
    fixed = new_links.where(F.coalesce("evidence_id", F.lit("")) != "").select("prop_id", "evidence_id", F.coalesce("relation", F.lit("supportive")).alias("relation"), F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(default)).alias("confidence"))
    every = props.select("prop_id").unionByName(new_props.select("prop_id")).distinct()
    both = links.select("prop_id", "evidence_id", "relation", "confidence").unionByName(fixed)
    return statuses(every, both, gate).select("prop_id", "status", "n_links")


def signature(props: DataFrame, status: DataFrame) -> DataFrame:
    """``signature``: a hash of ids, texts and statuses that changes with any of them.

    Rows are hashed one by one and the row hashes folded per block of the id order and then over the blocks,
    so no task holds the case.
    """
    row = F.sha2(F.concat_ws("|", "prop_id", F.coalesce("text", F.lit("")), "status"), 256)
    hashed = props.join(status, "prop_id").select(row.alias("h"), F.substring(row, 1, 3).alias("block"))
    blocks = hashed.groupBy("block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return blocks.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256), 1, 16).alias("signature"))


def goal_matches(goals: DataFrame, props: DataFrame, words: Column, links: DataFrame | None = None) -> DataFrame:
    """``goal_id, prop_id`` where any word of a goal occurs in the proposition's text, type or party; with
    ``links``, also in its quote or in the witness, rationale or quote of one of its links.

    The goals' different words are a bounded literal that is sought in every proposition once; goals are
    joined back by word. With ``links`` the words go to Python workers (:func:`_words_within`), and the goals of a
    proposition are gathered from its words in one array (:func:`_goals_of`), so that no pair is met twice or shuffled;
    the words must not hold spaces.
    """
    asked = goals.select("goal_id", F.explode(words).alias("word")).distinct()
    hay = F.lower(F.concat_ws(" ", "text", "prop_type", "party", *([] if links is None else ["quote"])))
    own = props.select("prop_id", hay.alias("hay"))
    if links is None:
        return contained_words(own, "hay", asked).join(asked, "word").select("goal_id", "prop_id").distinct()
    known = asked.toArrow().combine_chunks()
    names = pc.unique(known["word"])
    places = pc.index_in(known["word"], names).to_numpy()
    order = np.argsort(places, kind="stable")
    held = props.sparkSession.sparkContext.broadcast((names.to_pylist(), known["goal_id"].to_numpy()[order], np.searchsorted(places[order], np.arange(len(names) + 1))))
    told = links.select("prop_id", F.lower(F.concat_ws(" ", "witness", "rationale", "quote")).alias("hay"))
    found = own.unionByName(told).mapInArrow(lambda batches: _words_within(batches, held.value[0]), "prop_id string, words array<int>")
    merged = found.groupBy("prop_id").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    return merged.mapInArrow(lambda batches: _goals_of(batches, *held.value[1:]), "prop_id string, goals array<bigint>").select(F.explode("goals").alias("goal_id"), "prop_id")


def _words_within(batches, words: list[str]):
    """``prop_id, words``: the places of the ``words`` that occur in the texts of a proposition, for every proposition of a
    batch. A word holds no space, so it is sought in the pieces between spaces, and in equal pieces once."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        out: dict[str, set[int]] = {}
        for prop, text in zip(batch["prop_id"].to_pylist(), batch["hay"].to_pylist(), strict=True):
            inside = out.setdefault(prop, set())
            for piece in text.split():
                hits = seen.get(piece)
                if hits is None:
                    if len(seen) >= 1_000_000:  # a cache: what is dropped is sought again
                        seen.clear()
                    hits = seen[piece] = [k for k, w in enumerate(words) if w in piece]
                inside.update(hits)
        some = {prop: sorted(inside) for prop, inside in out.items() if inside}
        yield pa.RecordBatch.from_pydict({"prop_id": pa.array(list(some), pa.string()), "words": pa.array(list(some.values()), pa.list_(pa.int32()))})


def _goals_of(batches, goals: np.ndarray, bounds: np.ndarray, at_once: int = 1 << 20):
    """``prop_id, goals``: the different goals of the words of every proposition; ``goals`` are those of all words, word
    by word, between ``bounds``."""
    different, place = np.unique(goals, return_inverse=True)
    of = np.split(place, bounds[1:-1]) if len(bounds) > 1 else []
    hit = np.zeros(len(different), bool)
    for batch in batches:
        props, parts, size = [], [], 0
        for prop, words in zip(batch["prop_id"].to_pylist(), batch["words"].to_pylist(), strict=True):
            hit[:] = False
            for w in words:
                hit[of[w]] = True
            props.append(prop)
            parts.append(different[hit])
            size += len(parts[-1])
            if size >= at_once:
                yield _lists(props, parts)
                props, parts, size = [], [], 0
        if props:
            yield _lists(props, parts)


def _lists(props: list[str], parts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.RecordBatch.from_pydict({"prop_id": pa.array(props, pa.string()), "goals": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int64)))})


def contained_words(rows: DataFrame, hay: str, asked: DataFrame, at_once: int = 2_000) -> DataFrame:
    """``rows`` without ``hay``, with every different ``word`` of ``asked`` that occurs in it, taken in blocks
    of ``at_once`` words."""
    words = [r["word"] for r in asked.select("word").distinct().orderBy("word").collect()]
    out = None
    for k in range(0, max(len(words), 1), at_once):
        block = F.array(*[F.lit(w) for w in words[k : k + at_once]]) if words else F.array().cast("array<string>")
        part = rows.withColumn("word", F.explode(F.filter(block, lambda w: F.contains(F.col(hay), w)))).drop(hay)
        out = part if out is None else out.unionByName(part)
    return out


def keyword_top(questions: DataFrame, props: DataFrame, words: Column, n: int = 3) -> DataFrame:
    """``query_id, prop_id, score, rnk``: propositions that hold most of a question's words, ties by id."""
    asked = questions.select("query_id", F.explode(words).alias("word")).distinct()
    found = contained_words(props.select("prop_id", F.lower(F.coalesce("text", F.lit(""))).alias("hay")), "hay", asked)
    scored = found.join(asked, "word").groupBy("query_id", "prop_id").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "prop_id")
    return scored.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= n).select("query_id", "prop_id", "score", "rnk")


def chat_candidates(questions: DataFrame, props: DataFrame, status: DataFrame, words: Column, n: int = 3) -> DataFrame:
    """``query_id, prop_id, score, rnk``: :func:`keyword_top`, and for questions of which no word hits the first ``n``
    MISSING or undermined propositions by id, with score 0."""
    hits = materialize(keyword_top(questions, props, words, n), "hits")
    risky = [r["prop_id"] for r in status.where(F.col("status").isin("MISSING", "undermined")).orderBy("prop_id").limit(n).select("prop_id").collect()]  # n ids
    rest = questions.select("query_id").distinct().join(hits.select("query_id"), "query_id", "left_anti")
    given = rest.select("query_id", F.posexplode(F.array(*[F.lit(i) for i in risky]).cast("array<string>")).alias("k", "prop_id"))
    return hits.unionByName(given.select("query_id", "prop_id", F.lit(0).cast("long").alias("score"), (F.col("k") + 1).cast("long").alias("rnk")))


def human_review(status: DataFrame, rank: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` propositions to judge first: by status, then rank, ties by id."""
    level = F.when(F.col("status") == "MISSING", 0).when(F.col("status") == "undermined", 1).otherwise(2)
    risky = status.where(F.col("status") != "supported").join(rank.select(F.col("id").alias("prop_id"), "rank"), "prop_id", "left")
    keys = (level, F.desc(F.coalesce("rank", F.lit(0.0))), F.col("prop_id"))
    top = risky.orderBy(*keys).limit(n)
    return top.select("prop_id", "status", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("rnk"))


def digest(props: DataFrame, status: DataFrame) -> DataFrame:
    """``prop_id, line``: one line per proposition for a reader or a model."""
    held = props.join(status.select("prop_id", "status"), "prop_id")
    line = F.format_string("[%s] (%s, %s, status=%s) %s", "prop_id", F.coalesce("prop_type", F.lit("")), F.coalesce("party", F.lit("")), "status", F.coalesce("text", F.lit("")))
    return held.select("prop_id", line.alias("line"))


def strongest_links(links: DataFrame, n: int = 300) -> DataFrame:
    """The ``n`` surest supporting or adverse links, ties by link id."""
    return links.where("relation <> 'neutral'").orderBy(F.desc("confidence"), "link_id").limit(n).select("link_id", "evidence_id", "prop_id", "relation", "confidence")


def next_ids(records: DataFrame, key: str, prefix: str, width: int) -> DataFrame:
    """``next_id``: the id after the highest number in use; the first one for an empty table."""
    number = F.coalesce(F.max(F.regexp_extract(key, rf"^{prefix}0*(\d+)$", 1).try_cast("long")), F.lit(0)) + 1
    return records.agg(F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")).alias("next_id"))


def cache_misses(jobs: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Jobs whose content hash has no cached result."""
    return jobs.join(cached.select(key).distinct(), key, "left_anti")


def probative_fragility(links: DataFrame, gate: float = GATE) -> DataFrame:
    """``prop_id, n_probative, fragile``: whether all supporting and adverse links lie below the gate."""
    kept = links.where("relation <> 'neutral'")
    return kept.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n_probative"), F.bool_and(F.col("confidence") < gate).alias("fragile"))
