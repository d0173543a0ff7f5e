"""Storing texts and keeping the table of memories: the write chain, entities, labels, forgetting, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scoring as S
from ..functions import text as X
from ..sources.shared import written
from .vectors import knn, novelty

#: Aliases, or words of queries, that may be broadcast; more meet the texts' words through a shuffle.
BROADCAST = 50_000


def stored(texts: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """Rows of the memories table from texts(id, content, source): masked, classified, rewritten, categorised, labelled.
    Further columns stay."""
    # what many rules look at are columns of their own, not expressions repeated in each rule
    masked = F.col("_masked")
    first = texts.select(*texts.columns, X.pii_mask(F.col("content")).alias("_masked"), F.lower("content").alias("_lower"))
    second = first.withColumns({"_masked_lower": F.when(masked == F.col("content"), F.col("_lower")).otherwise(F.lower(masked)), "_phrase": X.temporal_phrase(F.trim(masked))})
    rows = second.withColumns(
        {
            "masked_content": F.when(masked != F.col("content"), masked),
            "sensitivity": X.sensitivity(F.col("content")),
            "reformulated": X.reformulate(masked, F.col("_phrase")),
            "category": X.category(F.col("content"), F.col("_lower")),
            "labels": F.slice(X.keyword_labels(masked, F.col("_masked_lower")), 1, config.max_labels),
            "modality": F.lit("text"),
            "created_at": now,
            "echo_count": F.lit(0),
            "enriched": F.lit(False),
            "enrichment_attempts": F.lit(0),
            "confidence": F.lit(1.0).cast("float"),
            "label_version": F.lit(1),
        }
    )
    return rows.drop("_masked", "_lower", "_masked_lower", "_phrase")


def accepted(texts: DataFrame, existing: int, config: Config = DEFAULT, used_bytes: int = 0) -> DataFrame:
    """The texts that still have room below the capacity, by id; none once the disk quota is used up.

    Where there is room for all nothing is sorted.
    """
    room = max(0, config.max_memories - existing)
    if config.max_bytes and used_bytes >= config.max_bytes:
        return texts.limit(0)
    return texts if texts.count() <= room else texts.orderBy("id").limit(room)


def nearly_full(existing: int, config: Config = DEFAULT, used_bytes: int = 0) -> bool:
    """Whether four fifths of the capacity or of the disk quota are used."""
    return existing >= 0.8 * config.max_memories or bool(config.max_bytes) and used_bytes >= 0.8 * config.max_bytes


def store_chain(texts: DataFrame, now: Column, existing: DataFrame, vectors: DataFrame, alias_rows: DataFrame, embed: Callable[[DataFrame], DataFrame], config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The whole write chain: memories rows and their vectors(id, v) of texts(id, content, source).

    Capacity, rules over the text, the vector of the rewritten or else the original text, novelty against the vectors there
    are and earlier texts of the same call, entity by the longest known alias. embed gives id, v of rows(id, content).
    """
    taken = stored(accepted(texts, existing.count(), config), now, config)
    made = written(embed(taken.select("id", embedding_text(F.col("masked_content"), F.col("reformulated"), F.col("content")).alias("content"))), "new-vectors")
    seen = vectors_novelty(made, vectors)
    whose = resolve(taken.select("id", F.coalesce("masked_content", "content").alias("content")), alias_rows).select("id", "entity_id")
    rows = taken.join(seen.select("id", F.col("novelty").alias("novelty_score")), "id", "left").join(whose, "id", "left")
    return rows.withColumn("novelty_score", F.coalesce("novelty_score", F.lit(1.0))), made


def vectors_novelty(made: DataFrame, known: DataFrame) -> DataFrame:
    """id, novelty of new rows: against all known vectors and new ones of smaller ids."""
    own = novelty(made)
    best = knn(known.select("id", "v"), made.select(F.col("id").alias("query_id"), "v"), 1, -1.0).select(F.col("query_id").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sim"))).alias("old"))
    return own.join(best, "id", "left").select("id", F.least("novelty", F.coalesce("old", F.lit(1.0))).alias("novelty"))


def embedding_text(masked: Column, reformulated: Column, content: Column) -> Column:
    """What is embedded: the rewritten text, else the original."""
    return F.coalesce(reformulated, content)


def shown(content: Column, masked: Column) -> Column:
    return F.coalesce(masked, content)


def summaries(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Listing of memories without vectors, newest ids last."""
    out = rows.select("id", X.truncated(shown(F.col("content"), F.col("masked_content")), 120).alias("content"), "source", "category", "sensitivity", "echo_count", "labels")
    return out if limit is None else out.orderBy("id").limit(limit)


def forgotten(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("id").distinct(), "id", "left_anti")


def got(rows: DataFrame, memory_id: int) -> DataFrame:
    """One memory's full row; raises KeyError if there is none."""
    one = rows.where(F.col("id") == memory_id)
    if not one.limit(1).count():
        raise KeyError(memory_id)
    return one


def stats(rows: DataFrame, dim: int = 384) -> DataFrame:
    """Counts by modality and estimated sizes in bytes, one row."""
    n = lambda m: F.count_if(F.col("modality") == m)
    size = n("text") * (dim * 4 + 300) + n("vision") * (512 * 4 + 100) + n("speech") * (640 * 4 + 100)
    return rows.agg(F.count(F.lit(1)).alias("n"), n("text").alias("n_text"), n("vision").alias("n_vision"), n("speech").alias("n_speech"), size.alias("bytes"))


def with_labels(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows that have any of the labels."""
    return rows.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in sorted(set(labels))])))


def related_by_label(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, other, label: rows that share a label with ids(id)."""
    flat = rows.select("id", F.explode("labels").alias("label"))
    return flat.join(ids.select("id").distinct(), "id").join(flat.withColumnRenamed("id", "other"), "label").where("id <> other").select("id", "other", "label").distinct()


def bootstrap_labels(rows: DataFrame, upto: int = 0, config: Config = DEFAULT) -> DataFrame:
    """Label rows whose labels are of an old version."""
    old = F.coalesce("label_version", F.lit(0)) <= upto
    return rows.withColumns({"labels": F.when(old, F.slice(X.keyword_labels(F.col("content")), 1, config.max_labels)).otherwise(F.col("labels")), "label_version": F.when(old, F.greatest(F.coalesce("label_version", F.lit(0)), F.lit(1))).otherwise(F.col("label_version"))})


def tier2_labels(rows: DataFrame, found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Merge found(id, new_labels) into enriched rows of label version 1."""
    ready = F.col("enriched") & (F.col("label_version") == 1) & F.col("new_labels").isNotNull()
    joined = rows.join(found, "id", "left")
    both = F.slice(F.array_distinct(F.concat(F.coalesce("labels", F.array().cast("array<string>")), "new_labels")), 1, config.max_labels)
    return joined.withColumns({"labels": F.when(ready, both).otherwise(F.col("labels")), "label_version": F.when(ready, 2).otherwise(F.col("label_version"))}).drop("new_labels")


def bloom_size(n: Column, rate: float = 0.01) -> Column:
    """bloom_bytes() as an expression."""
    return F.ceil(F.ceil(-n * F.ln(F.lit(rate)) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))) / 8).cast("long")


def bloom_bytes(n: int, rate: float = 0.01) -> int:
    """Size of a Bloom filter for n items."""
    import math

    return math.ceil(math.ceil(-n * math.log(rate) / math.log(2) ** 2) / 8)


def gate(queries: DataFrame, rows: DataFrame, least_rows: int = 50) -> DataFrame:
    """Queries that have a word or pair of words with the store in common; all pass while the store is small."""
    if rows.limit(least_rows).count() < least_rows:
        return queries
    told, kept = (df.select(*key, X.long_words(F.col(text)).alias("w")) for df, key, text in ((queries, ["query_id"], "text"), (rows, [], "content")))
    asked = told.select("query_id", F.explode(X.word_fingerprints(F.col("w"))).alias("f"))
    spelt = told.select(F.explode("w").alias("f"))
    # who has a pair of words with the store in common has both words, so pairs are met only where a word of either side has the
    # underscore that stands between those of a pair
    linked = lambda w: F.contains(w, F.lit("_"))
    known = _met(kept.select(F.explode(F.array_distinct("w")).alias("f")), spelt)
    known = known.unionByName(_met(kept.select(F.explode(F.array_distinct(F.filter("w", linked))).alias("f")), asked.select("f").where(linked(F.col("f")))))
    odd = written(spelt.where(linked(F.col("f"))).unionByName(asked.select("f").where(F.rlike("f", F.lit("(?s)_.*_")))).distinct(), "odd-words")
    if not odd.isEmpty():
        known = known.unionByName(_met(kept.select(F.explode(X.word_fingerprints(F.col("w"))).alias("f")), odd))
    return queries.join(asked.join(known.distinct(), "f", "left_semi").select("query_id").distinct(), "query_id", "left_semi")


def _met(told: DataFrame, wanted: DataFrame) -> DataFrame:
    """f of told(f) that are among wanted(f). Many times as many are told as wanted, so those go to them while they are few."""
    wanted = written(wanted.distinct(), "fingerprints")
    return told.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "f", "left_semi")


# ---------------------------------------------------------------- entities


def aliases(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.lower(F.trim(a))))).alias("alias"))


def _bare(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def resolve(texts: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """id, entity_id, alias of the longest alias that stands in a text between characters that are no letters or digits.

    Texts are cut into runs of words, as long as the longest alias, and met with the words of aliases by an equi-join; what
    stands between the words is looked at afterwards. Aliases without letters and digits are never found.
    """
    named = alias_rows.select("entity_id", "alias", F.array_join(_bare(F.col("alias")), " ").alias("_words")).where("_words <> ''")
    n, most = named.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("_words", " "))), F.lit(0))).first()
    # the runs of words are many times the texts, which a planner doesn't see: they must never be the side that is broadcast
    named = F.broadcast(named) if n <= BROADCAST else named.hint("merge")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, most))), lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    cut = texts.select("id", F.col("content").alias("_t"), _bare(F.col("content")).alias("w")).select("id", "_t", F.explode(F.array_distinct(runs)).alias("_words"))
    stands = F.rlike(F.lower("_t"), F.concat(F.lit(r"(?s)(?<![\p{L}\p{N}])\Q"), F.col("alias"), F.lit(r"\E(?![\p{L}\p{N}])")))
    order = Window.partitionBy("id").orderBy(F.desc(F.octet_length("alias")), "alias", "entity_id")
    return cut.join(named, "_words").where(stands).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("id", "entity_id", "alias")


def with_aliases(entities: DataFrame, more: DataFrame) -> DataFrame:
    """entities with further aliases from more(entity_id, alias), each once in any case."""
    told = more.groupBy("entity_id").agg(F.sort_array(F.collect_set(F.lower(F.trim("alias")))).alias("_more"))
    have = F.coalesce("aliases", F.array().cast("array<string>"))
    known = F.transform(F.concat(have, F.array("canonical_name")), lambda a: F.lower(F.trim(a)))
    new = F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda a: ~F.array_contains(known, a))
    return entities.join(told, "entity_id", "left").withColumn("aliases", F.concat(have, new)).drop("_more")


def new_entities(names: DataFrame, known: DataFrame) -> DataFrame:
    """entity_id, canonical_name of names(name) not known yet."""
    made = names.select(X.entity_id(F.col("name")).alias("entity_id"), F.col("name").alias("canonical_name"))
    one = made.groupBy("entity_id").agg(F.min("canonical_name").alias("canonical_name"))
    return one.join(known.select("entity_id"), "entity_id", "left_anti")


def speaks_of_self(content: Column) -> Column:
    return F.rlike(content, F.lit(r"(?i)\b(?:i|i'm|my|me|mine|myself)\b"))


# ---------------------------------------------------------------- importance


def importance(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with importance computed anew where it is missing or older than an hour."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("created_at")
    fresh = S.importance(F.coalesce("novelty_score", F.lit(0.0)), X.category_parameter(F.col("category"), "importance"), S.velocity(F.col("echo_count").cast("double"), age.cast("double")), X.source_weight(F.col("source")))
    stale = F.col("importance_computed_at").isNull() | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("importance_computed_at") > 3600)
    return rows.withColumns({"importance": F.when(stale, fresh).otherwise(F.col("importance")), "importance_computed_at": F.when(stale, now.cast("timestamp")).otherwise(F.col("importance_computed_at"))})


def decayed_counts(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One retrieval less for rows that were last retrieved (or made) longer ago."""
    last = F.coalesce("last_echoed", "created_at")
    old = (F.col("echo_count") > 0) & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last) > days * 86400)
    return rows.withColumn("echo_count", F.when(old, F.col("echo_count") - 1).otherwise(F.col("echo_count")))


def counted(rows: DataFrame, echoes: DataFrame) -> DataFrame:
    """Fold retrieval events echoes(id, ts) into echo_count and last_echoed."""
    sums = echoes.groupBy("id").agg(F.count(F.lit(1)).alias("_c"), F.max("ts").alias("_t"))
    joined = rows.join(sums, "id", "left")
    return joined.withColumns({"echo_count": (F.col("echo_count") + F.coalesce("_c", F.lit(0))).cast("int"), "last_echoed": F.greatest("last_echoed", "_t")}).drop("_c", "_t")
