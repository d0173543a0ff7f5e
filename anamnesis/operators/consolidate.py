"""Batch maintenance: merging near duplicates, extracting facts, finding what newer facts supersede, clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import rules as R
from ..functions import scoring as S
from ..functions import text as X
from ..sources.shared import written
from . import memories
from .vectors import similar_pairs


def survivors(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, survivor of every row that goes. rows(id, importance), pairs(a, b).

    Of a pair the more important row wins, the smaller id if they are equal. A row that loses to any goes to the best of those
    it loses to, and with that one to whatever it goes to in turn (by pointer jumping over written tables: an order has no rings).
    """
    side = lambda c: rows.select(F.col("id").alias(c), F.coalesce("importance", F.lit(0.0)).alias(f"i{c}"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(side("a"), "a").join(side("b"), "b")
    first = F.col("ia") >= F.col("ib")
    lost = both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.greatest("ia", "ib").alias("w"))
    now = written(lost.groupBy("id").agg(F.max_by("winner", F.struct("w", -F.col("winner"))).alias("survivor")), "survivors")
    while True:
        further = now.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"))
        now, old = written(now.join(further, "survivor", "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")), "survivors"), now
        if not now.where("moved").limit(1).count():
            return old


def merge_duplicates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows that survive, with the retrievals of those that go to them. rows(id, importance, echo_count), pairs(a, b).

    (A walk over pairs in order would let a row that has lost go on absorbing others; chains end differently there.)
    """
    to = survivors(rows, pairs).select("id", "survivor")
    given = to.join(rows.select("id", "echo_count"), "id").groupBy(F.col("survivor").alias("id")).agg(F.sum("echo_count").alias("_more"))
    kept = rows.join(to.select("id"), "id", "left_anti").join(given, "id", "left")
    return kept.withColumn("echo_count", F.col("echo_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def near_duplicates(vectors: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return similar_pairs(vectors, config.duplicate_threshold)


def to_enrich(rows: DataFrame, limit: int = 25) -> DataFrame:
    """Texts to extract facts from: not enriched, fewer than three attempts, no children themselves; most important first."""
    open_ = rows.where(~F.col("enriched") & (F.col("enrichment_attempts") < 3) & F.col("parent_id").isNull() & (F.col("modality") == "text"))
    return open_.orderBy(F.desc("importance"), "id").limit(limit)


def sentences(rows: DataFrame) -> DataFrame:
    """id, n, sentence."""
    cut = F.filter(F.transform(F.split("content", r"[.!?]"), F.trim), lambda s: s != "")
    return rows.select("id", F.posexplode(cut).alias("n", "sentence"))


def facts(rows: DataFrame) -> DataFrame:
    """id, n, fact, subject, predicate, object: the rule-based extractor. Sentences that state a relationship and pass the
    quality gate, as many as the length of the text allows."""
    found = sentences(rows).withColumn("t", X.triple(F.col("sentence"))).where(F.col("t").isNotNull() & X.fact_rejected(F.col("sentence")).isNull())
    allowed = rows.select("id", X.max_facts(F.col("content")).alias("_max"))
    order = Window.partitionBy("id").orderBy("n")
    kept = found.withColumn("_n", F.row_number().over(order)).join(allowed, "id").where("_n <= _max")
    return kept.select("id", "n", F.col("sentence").alias("fact"), "t.subject", "t.predicate", "t.object")


def children(parents: DataFrame, found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Child rows of facts: they take over time and label version, and labels of their own before the parent's."""
    rows = found.join(parents.select("id", "created_at", "label_version", F.col("labels").alias("_labels")), "id")
    own = X.keyword_labels(F.col("fact"))
    return rows.select(
        F.col("id").alias("parent_id"),
        F.col("fact").alias("content"),
        F.lit("enrichment").alias("source"),
        "subject",
        "created_at",
        "label_version",
        F.slice(F.array_distinct(F.concat(own, F.coalesce("_labels", F.array().cast("array<string>")))), 1, config.max_labels).alias("labels"),
        F.array(F.struct("subject", "predicate", "object")).alias("triples"),
        X.entity_id(F.col("subject")).alias("entity_id"),
    )


def without_siblings(made: DataFrame, existing: DataFrame, least: float = 0.95) -> DataFrame:
    """Children whose parent has no child yet that says nearly the same. made and existing have parent_id, content and v.

    Equal texts (in any case) of a subject are the same without a look at vectors; null vectors are like no other.
    """
    told = existing.select(F.col("parent_id").alias("_p"), F.lower("subject").alias("_s"), F.lower("content").alias("_c"), F.col("v").alias("_v"))
    same = F.lower("subject").eqNullSafe(F.col("_s")) & F.lower("content").eqNullSafe(F.col("_c"))
    near = F.coalesce(F.round(S.cosine(F.col("v"), F.col("_v")), 9) > least, F.lit(False))
    return made.join(told, F.col("parent_id").eqNullSafe(F.col("_p")) & (same | near), "left_anti")


def same_subject(made: DataFrame, existing: DataFrame, least: float = 0.75) -> DataFrame:
    """id (of the existing child), content, confidence: the new children that revise a child of their parent and subject.

    Of several children that are similar enough the one with the smallest id is revised, by the new child with the longest
    text (the first in order of equal ones). made(parent_id, subject, content, confidence, v), existing also has id.
    """
    told = existing.select("id", F.col("parent_id").alias("_p"), F.lower("subject").alias("_s"), F.col("v").alias("_v"))
    alike = (F.col("parent_id") == F.col("_p")) & (F.lower("subject") == F.col("_s")) & (F.round(S.cosine(F.col("v"), F.col("_v")), 9) > least)
    rows = made.select("parent_id", "subject", "content", "confidence", "v").join(told, alike)
    one = rows.groupBy("parent_id", F.lower("subject").alias("s"), "content").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"))
    best = F.max_by(F.struct("content", "confidence"), F.struct(F.length("content"), F.expr("-crc32(content)"), "content"))
    return one.groupBy("id").agg(best.alias("b")).select("id", "b.content", "b.confidence")


def revised(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Children with the longer of the two texts, and the new confidence, where changes(id, content, confidence) has them."""
    told = changes.select("id", F.col("content").alias("_content"), F.col("confidence").alias("_confidence"))
    longer = F.octet_length("_content") > F.octet_length("content")
    joined = rows.join(told, "id", "left")
    return joined.withColumns({"content": F.when(longer, F.col("_content")).otherwise(F.col("content")), "confidence": F.coalesce("_confidence", "confidence")}).drop("_content", "_confidence")


def new_children(made: DataFrame, existing: DataFrame) -> DataFrame:
    """Children whose parent has no child of the same subject (in any case) and text yet."""
    told = existing.select(F.col("parent_id").alias("_p"), F.lower("subject").alias("_s"), F.lower("content").alias("_c")).distinct()
    rows = made.withColumns({"_ls": F.lower("subject"), "_lc": F.lower("content")})
    same = F.col("parent_id").eqNullSafe(F.col("_p")) & F.col("_ls").eqNullSafe(F.col("_s")) & F.col("_lc").eqNullSafe(F.col("_c"))
    return rows.join(told, same, "left_anti").drop("_ls", "_lc")


def superseded_sentences(new: DataFrame, texts: DataFrame) -> DataFrame:
    """new_id, old_id, predicate, new_value, old_value: facts against the sentences of texts(id, content, source, ts) that are
    no extracted facts themselves; a fact may replace several. new(id, subject, predicate, object, ts)."""
    rows = sentences(texts.where("source is null or source <> 'enrichment'")).withColumn("t", X.triple(F.col("sentence"))).where("t is not null")
    old = rows.join(texts.select("id", "ts"), "id").select(F.col("id").alias("old_id"), F.lower("t.subject").alias("s"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("old_value"), F.col("ts").alias("old_ts"))
    n = new.where(F.col("predicate").isin(*R.SINGLE_VALUED)).select(F.col("id").alias("new_id"), F.lower("subject").alias("s"), "predicate", F.col("object").alias("new_value"), F.col("ts").alias("new_ts"))
    both = n.join(old, ["s", "predicate"]).where((F.lower("new_value") != F.lower("old_value")) & (F.col("new_id") != F.col("old_id")) & (F.col("old_ts") <= F.col("new_ts")))
    return both.select("new_id", "old_id", "predicate", "new_value", "old_value", "new_ts").distinct()


def superseded(new: DataFrame, old: DataFrame) -> DataFrame:
    """new_id, old_id, predicate, new_value, old_value of facts of one subject whose single-valued relation has changed.

    Both sides (id, subject, predicate, object, ts); of several older values the latest is reported.
    """
    single = F.col("predicate").isin(*R.SINGLE_VALUED)
    n = new.where(single).select(F.col("id").alias("new_id"), F.lower("subject").alias("s"), "predicate", F.col("object").alias("new_value"), F.col("ts").alias("new_ts"))
    o = old.where(single).select(F.col("id").alias("old_id"), F.lower("subject").alias("s"), "predicate", F.col("object").alias("old_value"), F.col("ts").alias("old_ts"))
    both = n.join(o, ["s", "predicate"]).where((F.lower("new_value") != F.lower("old_value")) & (F.col("new_id") != F.col("old_id")) & (F.col("old_ts") <= F.col("new_ts")))
    order = Window.partitionBy("new_id", "s", "predicate", "new_value").orderBy(F.desc("old_ts"), F.desc("old_id"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("new_id", "old_id", "predicate", "new_value", "old_value", "new_ts")


def similar_superseded(pairs: DataFrame, facts_: DataFrame, low: float = 0.70, high: float = 0.95) -> DataFrame:
    """newer, older of pairs(a, b, sim) of one entity that are alike but not the same."""
    side = lambda c: facts_.select(F.col("id").alias(c), F.col("entity_id").alias(f"e{c}"), F.col("ts").alias(f"t{c}"))
    both = pairs.where((F.col("sim") > low) & (F.col("sim") <= high)).join(side("a"), "a").join(side("b"), "b").where("ea = eb")
    later = F.col("tb") >= F.col("ta")
    return both.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("newer"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("older"))


def expire_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Close typed edges whose value a change (predicate, old_value, new_ts) has replaced."""
    told = changes.groupBy(F.col("predicate").alias("kind"), F.lower("old_value").alias("_v")).agg(F.min("new_ts").alias("_end"))
    joined = edges.join(told, (edges.kind == told.kind) & (F.lower(edges.value) == told._v), "left").drop(told.kind)
    return joined.withColumn("valid_until", F.when(F.col("_end").isNotNull() & F.col("valid_until").isNull(), F.col("_end").cast("double")).otherwise(F.col("valid_until"))).drop("_v", "_end")


def supersedes_edges(changes: DataFrame, weight: float = 0.3) -> DataFrame:
    """Directed edges from the newer to the older side."""
    return changes.select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"), F.lit(weight).alias("weight"), F.lit("supersedes").alias("kind"), F.col("new_ts").cast("double").alias("valid_from")).distinct()


def mark_superseded(rows: DataFrame, changes: DataFrame) -> DataFrame:
    told = changes.groupBy(F.col("old_id").alias("id")).agg(F.min("new_ts").alias("_at"))
    return rows.join(told, "id", "left").withColumn("superseded_at", F.coalesce("superseded_at", F.col("_at").cast("timestamp"))).drop("_at")


def attempted(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """One attempt more for tried(id, n_facts); enriched only where facts were found."""
    joined = rows.join(tried, "id", "left")
    return joined.withColumns({"enrichment_attempts": F.col("enrichment_attempts") + F.when(F.col("n_facts").isNotNull(), 1).otherwise(0), "enriched": F.col("enriched") | (F.coalesce("n_facts", F.lit(0)) > 0)}).drop("n_facts")


def clusters(rows: DataFrame, known: DataFrame, least: int = 5, most: int = 5, members: int = 20) -> DataFrame:
    """label, member_count and member texts of labels to summarise: large enough, changed since the last summary, largest first."""
    sizes = rows.select("id", F.explode("labels").alias("label")).groupBy("label").agg(F.countDistinct("id").alias("member_count")).where(F.col("member_count") >= least)
    due = sizes.join(known.select("label", F.col("member_count").alias("_old")), "label", "left").where(~F.col("member_count").eqNullSafe(F.col("_old"))).drop("_old").orderBy(F.desc("member_count"), "label").limit(most)
    order = Window.partitionBy("label").orderBy(F.desc("importance"), "id")
    texts = rows.select("id", "content", "importance", F.explode("labels").alias("label")).join(due, "label").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= members)
    return texts.groupBy("label", "member_count").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda s: s["content"]).alias("texts"))


def upsert_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("label"), "label", "left_anti").unionByName(new, allowMissingColumns=True)


# ---------------------------------------------------------------- one pass of maintenance

#: What a pass counts.
COUNTERS = ("edges_pruned", "duplicates_merged", "counts_decayed", "importance_updated", "texts_enriched", "facts_extracted", "children_added", "children_revised", "facts_superseded", "labels_due")


def consolidated(tables: dict[str, DataFrame], now: Column, config: Config = DEFAULT, embed: Callable[[DataFrame], DataFrame] | None = None, extract: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All steps of maintenance, one after the other over written tables: the new tables, and one row of COUNTERS.

    tables: memories (with novelty_score, importance, importance_computed_at), vectors(id, v), edges(src, dst, weight, kind, value,
    valid_from, valid_until), summaries(label, member_count). embed gives id, v of rows(id, content); without it children have
    no vector and are told apart by their texts. extract gives id, n, fact, subject, predicate, object of rows (by rule as a default).
    """
    told: dict[str, int] = {}
    rows, vecs, edges = tables["memories"], tables["vectors"], tables["edges"]
    kept = written(edges.where(F.col("weight") >= config.prune_below), "edges")
    told["edges_pruned"] = edges.count() - kept.count()

    pairs = near_duplicates(vecs.join(rows.where("parent_id is null").select("id"), "id", "left_semi"), config)
    merged = written(merge_duplicates(rows, pairs.select("a", "b")), "memories")
    told["duplicates_merged"] = rows.count() - merged.count()
    aged = memories.decayed_counts(merged, now)
    told["counts_decayed"] = aged.join(merged.select("id", F.col("echo_count").alias("_was")), "id").where("echo_count <> _was").count()
    fresh = written(memories.importance(aged, now), "memories")
    told["importance_updated"] = fresh.where(F.col("importance_computed_at") == now.cast("timestamp")).count()

    queue = written(to_enrich(fresh), "queue")
    found = written((extract or facts)(queue), "facts")
    made = children(queue, found, config).withColumn("confidence", F.lit(1.0).cast("float"))
    base = fresh.agg(F.max("id")).first()[0]
    # the few facts of a pass are numbered in the order of their texts
    made = written(made.withColumn("id", F.row_number().over(Window.orderBy("parent_id", "content")) + F.lit(base if base is not None else -1)), "made")
    empty = made.select("id", F.lit(None).cast("array<float>").alias("v"))
    vectors_made = written(embed(made.select("id", "content")) if embed else empty, "child-vectors")
    with_v = made.join(vectors_made, "id", "left")
    old = fresh.where(F.col("parent_id").isNotNull()).join(vecs.select("id", "v"), "id", "left")
    changes = written(same_subject(with_v, old), "changes")
    revises = with_v.join(changes.select("content"), "content", "left_semi").select("id")
    new = written(without_siblings(with_v, old).join(revises, "id", "left_anti"), "children")
    told |= {"facts_extracted": found.count(), "children_added": new.count(), "children_revised": changes.count()}

    tried = queue.select("id").join(found.groupBy("id").agg(F.count(F.lit(1)).alias("n_facts")), "id", "left").select("id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))
    told["texts_enriched"] = tried.where("n_facts > 0").count()
    whole = revised(attempted(fresh, tried), changes).unionByName(new.drop("v").withColumns({"enriched": F.lit(True), "enrichment_attempts": F.lit(0), "echo_count": F.lit(0), "modality": F.lit("text"), "sensitivity": F.lit("Public"), "category": F.lit("Fact")}), allowMissingColumns=True)

    triple = lambda r: r.select("id", "parent_id", F.explode("triples").alias("t"), F.unix_timestamp("created_at").cast("double").alias("ts")).select("id", "parent_id", "t.subject", "t.predicate", "t.object", "ts")
    news = written(triple(new), "news")
    before = triple(fresh.where("parent_id is not null and triples is not null")) if "triples" in fresh.columns else news.limit(0)
    texts = fresh.select("id", "content", "source", F.unix_timestamp("created_at").cast("double").alias("ts"))
    by_value = superseded(news, before)
    by_text = superseded_sentences(news, texts.join(queue.select("id"), "id", "left_anti"))
    replaced = written(by_value.select("new_id", "old_id", "predicate", "new_value", "old_value", "new_ts").unionByName(by_text).distinct(), "replaced")
    told["facts_superseded"] = replaced.count()
    parent = news.select(F.col("id").alias("new_id"), F.col("parent_id").alias("newer")).distinct()
    up = supersedes_edges(replaced).unionByName(supersedes_edges(replaced.join(parent, "new_id").select(F.col("newer").alias("new_id"), "old_id", "new_ts").where("new_id <> old_id")))
    edges_out = expire_edges(kept, replaced).unionByName(up, allowMissingColumns=True)
    whole = written(mark_superseded(whole, replaced), "memories")

    due = written(clusters(whole, tables["summaries"]), "due")
    told["labels_due"] = due.count()
    out = {"memories": whole, "vectors": vecs.unionByName(vectors_made.where("v is not null").join(new.select("id"), "id", "left_semi"), allowMissingColumns=True), "edges": edges_out, "due": due}
    return out, rows.sparkSession.createDataFrame([tuple(told[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
