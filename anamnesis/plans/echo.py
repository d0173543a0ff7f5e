"""The ranked query as one batch plan: many queries at once, scored in the order that the rules prescribe.

Reading is pure. What a query teaches (co-activation of its results, retrieval counts) comes out as event
rows that the caller appends and folds later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import rules as R
from ..functions import scoring as S
from ..functions import text as X
from ..operators import fusion, graph, memories, vectors, views
from ..operators.coactivation import Activity
from ..sources.shared import written


#: Pairs of results that may be broadcast.
MET = 500_000
#: What the ranked query reads of a memory (and triples, where there are some).
COLUMNS = ("id", "content", "source", "labels", "category", "importance", "created_at", "last_echoed", "echo_count", "enriched", "confidence", "parent_id", "subject", "superseded_at")


@dataclass(frozen=True)
class Store:
    """memories(id, content, source, labels, category, importance, created_at, last_echoed, echo_count, enriched, confidence,
    parent_id, subject, superseded_at), vectors(id, v), edges(src, dst, weight, kind, valid_from, valid_until) or the events
    that all edges come from, which are then made where they are met: walks and edges among results."""

    memories: DataFrame
    vectors: DataFrame
    edges: DataFrame | Activity


@dataclass(frozen=True)
class Answer:
    results: DataFrame
    edge_events: DataFrame
    echo_events: DataFrame


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def expanded(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """queries with the answer that a model gave in advance behind the text, where it is longer than ten bytes. answers(query_id, answer)."""
    told = F.when(F.octet_length("answer") > 10, F.concat("text", F.lit(" "), F.col("answer"))).otherwise(F.col("text"))
    return queries.join(answers.select("query_id", "answer"), "query_id", "left").withColumn("text", told).drop("answer")


def topic_matches(child_labels: Column, query_labels: Column, subject: Column, query: Column) -> Column:
    """Whether a child belongs to a query's topic: by labels if both have some, else by subject, else yes."""
    both = (F.size(F.coalesce(query_labels, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(child_labels, F.array().cast("array<string>"))) > 0)
    s, q = F.lower(subject), F.lower(query)
    by_subject = F.contains(q, s) | F.exists(F.split(q, r"\s+"), lambda w: (F.octet_length(w) > 2) & F.contains(s, w))
    return F.when(both, F.arrays_overlap(child_labels, query_labels)).when(subject.isNotNull(), by_subject).otherwise(True)


def base_score(sim: Column, boost: Column, age: Column, row, config: Config) -> Column:
    """(similarity + boost + importance) x decay + recency or activation."""
    half, d = X.category_parameter(row["category"], "half_life_days"), X.category_parameter(row["category"], "actr_d")
    decay = S.power_law(age, half / 1.73) if config.power_law else S.exponential(age, half)
    if config.actr:
        extra = config.activation_weight * S.activation(row["echo_count"], age, row["since_echo"], d)
    else:
        extra = config.recency_weight / (1.0 + age / 86400.0)
    return (sim + boost + config.importance_weight * F.coalesce(row["importance"], F.lit(0.0))) * decay + extra


def adjusted(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows(query, query_labels, sim, score, content, labels, superseded, confidence, superseded_at, parent_id) with the score's corrections."""
    has = lambda label: F.array_contains("labels", label)
    score = F.col("score") + X.co_occurrence(F.col("content"))
    score = score * F.pow(F.lit(1.0 - config.supersedes_demotion), F.coalesce("superseded", F.lit(0)))
    score = F.when(F.col("parent_id").isNotNull() & (F.coalesce("confidence", F.lit(1.0)) < 1), score * F.col("confidence")).otherwise(score)
    score = F.when(F.col("superseded_at").isNotNull(), score * 0.5).otherwise(score)
    score = score + F.when(_says(F.col("query"), R.TEMPORAL_QUERY) & F.exists("labels", lambda x: x.startswith("temporal:")), 0.08).otherwise(0.0)
    special = F.filter("query_labels", lambda q: (q.startswith("topic:tools:") | (q == "action:learning")) & F.array_contains(F.col("labels"), q))
    first = F.get(special, F.lit(0))
    score = score + F.when(first == "action:learning", 0.025).when(first.isNotNull(), 0.06).otherwise(0.0)
    score = F.when(_says(F.col("query"), R.CURRENT_QUERY) & has("memtype:preference_update"), score * 1.05).otherwise(score)
    career = F.array_contains("query_labels", "topic:career") | F.array_contains("query_labels", "domain:work")
    score = score + F.when(career & has("memtype:intro"), -0.10).when(career & (has("topic:career") | has("domain:work")), 0.03).otherwise(0.0)
    return rows.withColumn("score", F.least(score, F.col("sim") + config.score_cap))


def candidates(store: Store, queries: DataFrame, config: Config, depth: int) -> DataFrame:
    """query_id, id, sim of the best rows by similarity, of at least half the threshold; rows with a parent only where children
    may answer themselves."""
    rows = store.vectors
    if config.rescue_only:
        rows = rows.join(store.memories.where("parent_id is not null").select("id"), "id", "left_anti")
    return vectors.knn(rows, queries, depth, config.similarity_threshold / 2, keep_self=True).select("query_id", "id", F.round("sim", 9).alias("sim"))


def with_room(store: Store, asked: DataFrame, near: DataFrame, config: Config) -> DataFrame:
    """The queries that a row from the graph may answer.

    The k best by similarity go on, and what the walk adds to the nearest rows is no nearer than any of them: where k of these
    are memories and reach the threshold, all that a walk finds would be left out again. Where rows with a parent may answer
    themselves, the nearest can still fall out by their topic, so all queries walk.
    """
    if not config.rescue_only:
        return asked
    good = near.where(F.col("sim") >= config.similarity_threshold).join(store.memories.select("id").distinct(), "id", "left_semi")
    full = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.max_results)
    return asked.join(full.select("query_id"), "query_id", "left_anti")


def query_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, name of the known names(name) that stand in a query: pairs of words, and words of two bytes or more. (A word of
    a pair that is met counts as well.)"""
    words = F.filter(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}\s]", " ")), r"\s+"), lambda w: w != "")
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    told = queries.select("query_id", words.alias("w")).select("query_id", F.explode(F.array_distinct(F.concat(pairs, F.filter("w", lambda w: F.octet_length(w) >= 2)))).alias("name"))
    return told.join(names.select("name").distinct(), "name", "left_semi")


def entity_names(store: Store) -> DataFrame:
    """id, name of the entities that rows are labelled with or state something of."""
    tagged = store.memories.select("id", F.explode("labels").alias("l")).where(F.col("l").startswith("entity:")).select("id", F.substring_index("l", ":", -1).alias("name"))
    return tagged.unionByName(views.triple_names(store.memories)).distinct() if "triples" in store.memories.columns else tagged


def graph_candidates(store: Store, queries: DataFrame, ranked: DataFrame, config: Config) -> DataFrame:
    """Rows reached from memories that carry an entity of the query, above half the threshold and not ranked yet."""
    names = entity_names(store)
    anchors = query_entities(queries, names).join(names, "name").select("query_id", "id").distinct()
    if isinstance(store.edges, Activity):
        walked = store.edges.walk(written(anchors.select("id").distinct(), "anchors"), config.graph_hops, config.graph_anchors)
    else:
        walked = graph.traverse(store.edges.select("src", "dst", "weight"), anchors.select("id"), config.graph_hops, config.graph_anchors)
    reached = anchors.withColumnRenamed("id", "anchor").join(walked, "anchor").select("query_id", "id").distinct().join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    sim = S.cosine(F.col("v"), F.col("qv"))
    scored = reached.join(store.vectors.select("id", "v"), "id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    return scored.select("query_id", "id", F.round(sim, 9).alias("sim")).where(F.col("sim") > config.similarity_threshold / 2)


def echo(
    store: Store, queries: DataFrame, now: Column, config: Config = DEFAULT, at_time: Column | None = None, labels: list[str] | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None, summaries: DataFrame | None = None,
) -> Answer:
    """results: query_id, id, rank, sim, score, content, source, labels. queries(query_id, text, v); now in epoch seconds.

    labels: only rows with one of them. rerank: from results(query_id, id, rank, query, content) the order(query_id, id, place)
    of those that a reranker names. summaries(label, summary, v): the best one is added (with a null id) where results are weak.
    """
    k = config.max_results
    if labels:
        store = Store(memories.with_labels(store.memories, labels), store.vectors, store.edges)
        store = Store(store.memories, store.vectors.join(store.memories.select("id"), "id", "left_semi"), store.edges)
    # the few rows of queries and of their best results are written between steps: each step's plan stays small
    asked = written(memories.gate(queries, store.memories).withColumn("query_labels", X.query_labels(F.col("text"))), "asked")
    near = written(candidates(store, asked, config, 4 * k), "near")
    walked = written(graph_candidates(store, written(with_room(store, asked, near, config), "with-room"), near, config), "walked")
    fused = fusion.reciprocal_rank([near, walked], config.rrf_k)
    pool = near.unionByName(walked).join(fused, ["query_id", "id"])

    rows = pool.join(store.memories, "id").join(asked.select("query_id", F.col("text").alias("query"), "query_labels"), "query_id")
    direct = F.col("parent_id").isNull()
    if not config.rescue_only:
        direct = direct | topic_matches(F.col("labels"), F.col("query_labels"), F.col("subject"), F.col("query"))
    direct = rows.where((F.col("sim") >= config.similarity_threshold) & direct)
    rescued = _rescued(store, asked, config)
    seen = direct.select("query_id", "id").distinct()
    first = direct.unionByName(rescued.join(seen, ["query_id", "id"], "left_anti"), allowMissingColumns=True)
    top = written(fusion.top_k(first, k, "sim").drop("rank"), "top")

    learned = _pairs(top)
    known = store.edges
    if isinstance(known, Activity):
        among = known.among(top).select("src", "dst", "weight", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_until"))
        met = written(learned.select("src", "dst").distinct(), "met")  # edges are many more than the pairs of a query's results
        known = written(among.join(F.broadcast(met) if met.count() <= MET else met, ["src", "dst"], "left_semi"), "among")
    edges = known if at_time is None else graph.valid_at(known, at_time)
    mine = learned.select("query_id", "src", "dst", F.col("strength").alias("weight"))
    boosts = graph.boost(top, edges.select("src", "dst", "weight", "kind"))
    fresh = mine.select("query_id", F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("query_id", "id").agg(F.sum("weight").alias("own"))
    scored = top.join(boosts, ["query_id", "id"], "left").join(fresh, ["query_id", "id"], "left").join(superseded_parents(top, store, edges), "id", "left")
    scored = scored.withColumn("superseded", F.coalesce("superseded", F.lit(0)) + F.coalesce("by_child", F.lit(0)))
    boost = F.least(F.coalesce("boost", F.lit(0.0)) + F.coalesce("own", F.lit(0.0)), F.lit(0.4))
    age = F.greatest(now - F.unix_timestamp("created_at"), F.lit(0)).cast("double")
    scored = scored.withColumn("since_echo", (now - F.unix_timestamp("last_echoed")).cast("double"))
    scored = scored.withColumn("score", base_score(F.col("sim"), boost, age, scored, config))
    scored = written(adjusted(scored, config), "scored")

    topic = F.coalesce(F.get(F.filter("labels", lambda x: x.startswith("topic:")), F.lit(0)), F.lit("topic:unknown"))
    spread = scored.withColumns({"topic": topic, "subjects": F.when(F.col("subject").isNotNull(), F.array("subject"))})
    kept = fusion.diverse(spread, config.diversity_cap, 2 * config.diversity_cap)
    if rerank:
        kept = written(fusion.top_k(kept, k), "kept")
        order = rerank(kept.select("query_id", "id", "rank", "query", "content"))
        kept = fusion.reranked_first(kept, order).drop("rank")
    kept = fusion.without_relatives(kept)
    newer = known.where("kind = 'supersedes'").select(F.col("src").alias("newer"), F.col("dst").alias("older"))
    kept = fusion.without_superseded(kept, newer)
    ranked = fusion.top_k(kept.withColumn("_at", -F.col("place")), k, "_at") if rerank else fusion.top_k(kept, k)
    results = ranked.select("query_id", "id", "rank", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"), X.truncated(F.col("content"), 200).alias("content"), "source", "labels")
    if summaries is not None:
        results = _with_summaries(written(results, "results"), asked, summaries, k)
    events = learned.select("src", "dst", "strength", now.cast("double").alias("ts"))
    return Answer(results, events, top.select("id", now.alias("ts")))


def superseded_parents(top: DataFrame, store: Store, edges: DataFrame) -> DataFrame:
    """id, by_child (1) of results that have a child which another row supersedes."""
    older = edges.where("kind = 'supersedes'").select(F.col("dst").alias("child")).distinct()
    kids = store.memories.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("id"))
    return kids.join(top.select("id").distinct(), "id", "left_semi").join(older, "child", "left_semi").select("id").distinct().withColumn("by_child", F.lit(1))


def _with_summaries(results: DataFrame, asked: DataFrame, summaries: DataFrame, k: int) -> DataFrame:
    """Results and, where they are weak, the best summary as a row without an id; the whole by score."""
    found = fallback(results, asked, summaries).join(summaries.select("label", "summary"), "label")
    added = found.select("query_id", F.lit(None).cast("bigint").alias("id"), F.round("sim", 6).alias("sim"), F.round("sim", 6).alias("score"), X.truncated(F.col("summary"), 200).alias("content"), F.lit("community").alias("source"), F.array("label").alias("labels"))
    return fusion.top_k(results.drop("rank").unionByName(added), k).select(*results.columns)


def _rescued(store: Store, asked: DataFrame, config: Config) -> DataFrame:
    """Enriched rows near the threshold whose best child on the query's topic, weighted by its confidence, reaches it; they
    take the child's weighted similarity. All rows of the store are asked, whatever their place."""
    told = asked.select("query_id", F.col("text").alias("query"), "query_labels")
    parents = store.memories.where("enriched and parent_id is null").select("id").join(store.vectors.select("id", "v"), "id")
    weight = F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.01)).alias("weight")
    kids = store.memories.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("id"), weight, F.col("labels").alias("child_labels"), F.col("subject").alias("child_subject"))
    kin = kids.join(parents, "id").join(store.vectors.select(F.col("id").alias("child"), F.col("v").alias("child_v")), "child")
    found = vectors.kin_above(kin, asked, config.similarity_threshold, config.similarity_threshold / 2)
    gated = found.join(kids.select("child", "child_labels", "child_subject"), "child").join(told, "query_id").where(topic_matches(F.col("child_labels"), F.col("query_labels"), F.col("child_subject"), F.col("query")))
    best = gated.groupBy("query_id", "id").agg(F.first("sim").alias("own_sim"), F.max("child_sim").alias("sim"))
    rows = best.join(store.memories, "id").join(told, "query_id")
    aligned = F.when(F.size("query_labels") > 0, F.arrays_overlap("labels", "query_labels")).otherwise(F.col("own_sim") >= 0.4 * config.similarity_threshold)
    return rows.where(aligned).drop("own_sim")


def _pairs(top: DataFrame) -> DataFrame:
    """query_id, src, dst, strength of each two results of a query (at most max_results of them)."""
    a = top.select("query_id", F.col("id").alias("src"), F.col("sim").alias("sa"))
    b = top.select("query_id", F.col("id").alias("dst"), F.col("sim").alias("sb"))
    return a.join(b, "query_id").where("src < dst").select("query_id", "src", "dst", (F.sqrt(F.greatest(F.col("sa") * F.col("sb"), F.lit(0.0))) * 0.1).alias("strength"))


def fallback(results: DataFrame, queries: DataFrame, summaries: DataFrame, weak: float = 0.25, least: float = 0.1) -> DataFrame:
    """query_id, label, sim: the best summary for queries whose best score is weak."""
    top = results.groupBy("query_id").agg(F.max("score").alias("top"))
    poor = queries.join(top, "query_id", "left").where(F.coalesce("top", F.lit(0.0)) < weak)
    ids = summaries.select(F.xxhash64("label").alias("id"), "label", "v")
    found = vectors.knn(ids, poor.select("query_id", "v"), 1, least, strict=True, keep_self=True)
    return found.join(ids.select("id", "label"), "id").select("query_id", "label", "sim")
