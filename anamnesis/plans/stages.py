"""Registered queries of single steps over whole tables: score corrections, thinning, rescue, consolidation, edges, prompts.

What a table lacks (parents, confidences, times of retrieval) is derived from its ids by the same arithmetic in the query and
in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import consolidate, context, embedding, fusion, graph, memories, multimodal, routing, vectors, views
from . import echo as E
from .queries import _CAT, _CATEGORY, _PAR, _SENSE, COS, MODELS, NOW, _any_sql, _labels_sql, _masked_sql, _query_labels_sql, _typed, asked, embedded, query, quoted, rlist, seconds, table, tagged, typed_users

# ---------------------------------------------------------------- score corrections and gates

_QUERIES = ("what did I do yesterday", "which editor do I use currently", "where is my new job", "which class am I learning kanji in", "nothing here", "when is the deadline")
_EXTRA = (("topic:tools:editor",), ("topic:career",), ("memtype:preference_update", "domain:work"), ("memtype:intro",), ("temporal:past", "action:learning"))


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _choice(key, values):
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, v)
    return out


def own_labels(text: str):
    return F.filter(X.keyword_labels(F.col(text)), lambda x: ~x.startswith("entity:"))


_TWO = lambda words: f"len(list_filter({rlist(words)}, lambda w: contains(lower(text), w))) >= 2"


@query(f"""
WITH d AS (SELECT doc_id AS id, text, lower(text) AS l, {_case('doc_id % 6', map(quoted, _QUERIES))} AS q, {_case('doc_id % 5', map(rlist, _EXTRA))} AS extra,
  (doc_id % 89) / 100.0::DOUBLE AS sim, (doc_id % 89) / 100.0::DOUBLE + (doc_id % 7) / 10.0::DOUBLE AS score FROM documents),
e AS (SELECT *, list_concat(string_split({_labels_sql()}, ','), extra) AS labels FROM d),
f AS (SELECT *, string_split(ql, ',') AS qls FROM (SELECT e.* EXCLUDE (l), e.l AS tl, q.ql FROM e JOIN (SELECT content, {_query_labels_sql()} AS ql FROM (SELECT content, lower(content) AS l FROM (VALUES {', '.join(f'({quoted(t)})' for t in _QUERIES)}) v(content))) q ON q.content = e.q)),
s1 AS (SELECT *, (score + CASE WHEN {_TWO(R.DATABASE_WORDS)} OR {_TWO(R.PROGRAMMING_WORDS)} THEN 0.05::DOUBLE ELSE 0 END) * 0.6::DOUBLE ** (id % 3) AS a FROM f),
s2 AS (SELECT *, CASE WHEN id % 4 = 1 THEN a * 0.8::DOUBLE ELSE a END * CASE WHEN id % 11 = 0 THEN 0.5::DOUBLE ELSE 1 END AS b FROM s1),
s3 AS (SELECT *, b + CASE WHEN {_any_sql('lower(q)', R.TEMPORAL_QUERY)} AND len(list_filter(labels, lambda x: starts_with(x, 'temporal:'))) > 0 THEN 0.08::DOUBLE ELSE 0 END AS c,
  list_filter(qls, lambda x: (starts_with(x, 'topic:tools:') OR x = 'action:learning') AND list_contains(labels, x)) AS sp FROM s2),
s4 AS (SELECT *, (c + CASE WHEN len(sp) = 0 THEN 0 WHEN sp[1] = 'action:learning' THEN 0.025::DOUBLE ELSE 0.06::DOUBLE END) * CASE WHEN {_any_sql('lower(q)', R.CURRENT_QUERY)} AND list_contains(labels, 'memtype:preference_update') THEN 1.05::DOUBLE ELSE 1 END AS d,
  list_contains(qls, 'topic:career') OR list_contains(qls, 'domain:work') AS career FROM s3)
SELECT id, round(least(d + CASE WHEN career AND list_contains(labels, 'memtype:intro') THEN -0.10::DOUBLE WHEN career AND (list_contains(labels, 'topic:career') OR list_contains(labels, 'domain:work')) THEN 0.03::DOUBLE ELSE 0 END, sim + 0.5::DOUBLE), 6) AS score FROM s4""")
def adjusted_scores(spark, sf):
    """The chain of corrections, each document as a result of one of six queries."""
    i = F.col("id")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = rows.withColumns({"query": _choice(i % 6, [F.lit(t) for t in _QUERIES]), "sim": (i % 89) / F.lit(100.0), "superseded": (i % 3).cast("int"), "confidence": F.when(i % 4 == 1, 0.8).otherwise(1.0)})
    rows = rows.withColumns({"query_labels": X.query_labels(F.col("query")), "labels": F.concat(own_labels("content"), _choice(i % 5, [F.array(*map(F.lit, x)) for x in _EXTRA])), "score": F.col("sim") + (i % 7) / F.lit(10.0)})
    rows = rows.withColumns({"parent_id": F.when((i % 4).isin(1, 2), i - 1), "superseded_at": F.when(i % 11 == 0, F.timestamp_seconds(F.lit(NOW)))})
    return E.adjusted(rows).select("id", F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT doc_id AS id, source AS subject, CASE doc_id % 5 WHEN 0 THEN ['topic:a'] WHEN 1 THEN ['topic:b', 'topic:a'] ELSE []::VARCHAR[] END AS cl, CASE doc_id % 3 WHEN 0 THEN ['topic:a'] WHEN 1 THEN ['topic:c'] ELSE []::VARCHAR[] END AS ql,
  CASE doc_id % 4 WHEN 0 THEN 'Notes from ' || source WHEN 1 THEN 'sr' WHEN 2 THEN 'nothing here' ELSE upper(substr(source, 1, 3)) || ' it' END AS q FROM documents),
e AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE subject END AS s FROM d)
SELECT id, CASE WHEN len(cl) > 0 AND len(ql) > 0 THEN list_has_any(cl, ql) WHEN s IS NOT NULL THEN contains(lower(q), lower(s)) OR len(list_filter(string_split(lower(q), ' '), lambda w: strlen(w) > 2 AND contains(lower(s), w))) > 0 ELSE true END AS matches FROM e""")
def topic_gate(spark, sf):
    i, none = F.col("id"), F.array().cast("array<string>")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    d = d.withColumns({
        "cl": _choice(i % 5, [F.array(F.lit("topic:a")), F.array(F.lit("topic:b"), F.lit("topic:a"))]), "ql": _choice(i % 3, [F.array(F.lit("topic:a")), F.array(F.lit("topic:c"))]),
        "q": _choice(i % 4, [F.concat(F.lit("Notes from "), "source"), F.lit("sr"), F.lit("nothing here"), F.concat(F.upper(F.substring("source", 1, 3)), F.lit(" it"))]), "s": F.when(i % 7 != 0, F.col("source")),
    })
    return d.select("id", E.topic_matches(F.coalesce("cl", none), F.coalesce("ql", none), F.col("s"), F.col("q")).alias("matches"))


_PRINTS = "list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i+1])))"


@query(f"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: strlen(x) >= 3) AS w FROM conversations),
d AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: strlen(x) >= 3) AS w FROM documents),
k AS (SELECT DISTINCT unnest({_PRINTS}) AS f FROM d), a AS (SELECT query_id, unnest({_PRINTS}) AS f FROM q)
SELECT DISTINCT query_id FROM a WHERE f IN (SELECT f FROM k)""")
def word_gate(spark, sf):
    """Turns that have a word or pair of words with any document in common."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return memories.gate(turns, table(spark, sf, "documents").select(F.col("text").alias("content"))).select("query_id")


@query(f"""
WITH m AS (SELECT vec_id AS id, embedding, label, CASE WHEN vec_id % 10 = 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM embeddings),
k AS (SELECT q.vec_id AS query_id, p.id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) * c.conf, 9) AS child_sim, q.label AS ql, p.label AS pl, c.label AS cl
  FROM embeddings q JOIN m p ON p.id % 5 = 2 JOIN m c ON c.id = p.id + 1 WHERE q.vec_id % 20 = 0)
SELECT query_id, id, round(max(child_sim), 6) AS sim FROM k WHERE sim >= 0.07 AND sim < 0.14 AND child_sim >= 0.14 AND cl IN (ql, (ql + 1) % 10) AND pl IN (ql, (ql + 1) % 10, (ql + 2) % 10) GROUP BY query_id, id""")
def rescued_parents(spark, sf):
    """Near misses that a child on the query's topic lifts over the threshold: rows 2, 7, 12 … are parents of the next."""
    i, topic = F.col("id"), lambda n: F.concat(F.lit("topic:"), ((F.col("label") + n) % 10).cast("string"))
    rows = embedded(spark, sf)
    own = rows.select("id", F.when(i % 5 == 3, i - 1).alias("parent_id"), (i % 5 == 2).alias("enriched"), F.when(i % 10 == 3, 0.9).otherwise(1.0).alias("confidence"), F.lit(None).cast("string").alias("subject"),
                      F.when(i % 5 == 2, F.array(topic(0), topic(9))).otherwise(F.array(topic(0))).alias("labels"))
    # a parent also carries the label before its own, so that queries of two labels before reach it
    told = rows.where("id % 20 = 0").select(i.alias("query_id"), F.lit("x").alias("text"), "v", F.array(topic(0), topic(1)).alias("query_labels"))
    return E._rescued(E.Store(own, rows.select("id", "v"), None), told, E.DEFAULT).select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(f"""
WITH r AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 40 = 0 THEN 0.2::DOUBLE + (vec_id % 3) / 10.0 END AS top FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT 'L' || vec_id AS label, embedding FROM embeddings WHERE vec_id < 10),
c AS (SELECT a.vec_id AS query_id, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN r ON r.query_id = a.vec_id, s b WHERE coalesce(top, 0) < 0.25)
SELECT query_id, arg_max(label, sim) AS label, round(max(sim), 6) AS sim FROM c GROUP BY query_id HAVING round(max(sim), 9) > 0.1""")
def community_fallback(spark, sf):
    """The best summary (the first ten vectors) for queries that found nothing good."""
    rows = embedded(spark, sf)
    results = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), (0.2 + (F.col("id") % 3) / 10).alias("score"))
    summaries = rows.where("id < 10").select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"), "v")
    return E.fallback(results, asked(rows), summaries).select("query_id", "label", F.round("sim", 6).alias("sim"))


# ---------------------------------------------------------------- thinning out and putting together

_TURNS = "SELECT conv_id AS query_id, conv_id * 1000 + turn AS id, turn, role, (octet_length(encode(coalesce(text, ''))) % 100) / 100.0::DOUBLE + turn / 1000.0::DOUBLE AS score FROM conversations"


def turns_as_results(spark, sf) -> DataFrame:
    score = (F.octet_length(F.coalesce("text", F.lit(""))) % 100) / F.lit(100.0) + F.col("turn") / F.lit(1000.0)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "role", score.alias("score"))


@query(f"""
WITH t AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'topic:unknown' ELSE 'topic:a' END AS topic FROM ({_TURNS}))
SELECT query_id, id FROM t QUALIFY row_number() OVER (PARTITION BY query_id, role, topic ORDER BY score DESC, id) <= CASE WHEN topic = 'topic:unknown' THEN 2 ELSE 1 END""")
def diverse_results(spark, sf):
    rows = turns_as_results(spark, sf).withColumns({"subjects": F.array("role"), "topic": F.when(F.col("turn") % 2 == 0, "topic:unknown").otherwise("topic:a")})
    return fusion.diverse(rows, 1, 2).select("query_id", "id")


@query(f"""
WITH t AS ({_TURNS}), p AS (SELECT *, CASE WHEN role = 'assistant' THEN id - 1 END AS parent_id FROM t),
l AS (SELECT c.query_id, CASE WHEN c.score > p.score THEN p.id ELSE c.id END AS id FROM p c JOIN p ON p.query_id = c.query_id AND c.parent_id = p.id)
SELECT query_id, id FROM p WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM l)""")
def results_without_relatives(spark, sf):
    rows = turns_as_results(spark, sf).withColumn("parent_id", F.when(F.col("role") == "assistant", F.col("id") - 1))
    return fusion.without_relatives(rows).select("query_id", "id")


@query(f"""
WITH t AS ({_TURNS}), g AS (SELECT o.query_id, o.id FROM t o JOIN t n ON n.query_id = o.query_id AND n.id = o.id + 2 AND n.turn % 3 = 2),
c AS (SELECT t.*, g.id IS NOT NULL AS gone FROM t LEFT JOIN g USING (query_id, id))
SELECT query_id, id FROM c QUALIFY NOT gone OR count(*) FILTER (NOT gone) OVER (PARTITION BY query_id) < 3""")
def results_without_superseded(spark, sf):
    rows = turns_as_results(spark, sf)
    newer = rows.where("turn % 3 = 2").select(F.col("id").alias("newer"), (F.col("id") - 2).alias("older"))
    return fusion.without_superseded(rows, newer).select("query_id", "id")


@query("""
WITH a AS (SELECT label AS query_id, vec_id AS id, (vec_id % 17) / 17.0::DOUBLE AS score FROM embeddings UNION ALL SELECT label, vec_id, (vec_id % 13) / 13.0::DOUBLE FROM embeddings WHERE vec_id % 3 <> 0)
SELECT query_id, id, round(max(score), 9) AS score FROM a GROUP BY 1, 2""")
def best_of_modes(spark, sf):
    """Two lists of results put together, the better score of each row."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("id"))
    one = rows.withColumn("score", (F.col("id") % 17) / F.lit(17.0))
    two = rows.where("id % 3 <> 0").withColumn("score", (F.col("id") % 13) / F.lit(13.0))
    return fusion.best_per_id(one, two).select(F.col("query_id").cast("int").alias("query_id"), "id", F.round("score", 9).alias("score"))


@query(f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ({_TURNS}))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN turn % 3 = 1 THEN 100 - turn ELSE 1000000000 + r END, id) AS place FROM t""")
def reranked_results(spark, sf):
    """A reranker that names every third turn, the last first; the rest follows as it was."""
    rows = fusion.top_k(turns_as_results(spark, sf), 1000)
    order = rows.where("turn % 3 = 1").select("query_id", "id", (100 - F.col("turn")).alias("place"))
    return fusion.reranked_first(rows, order).select("query_id", "id", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- consolidation

_FACTS = """WITH f AS (SELECT o_orderkey AS id, 'c' || o_custkey AS s, CASE o_orderkey % 3 WHEN 0 THEN 'works_at' WHEN 1 THEN 'lives_in' ELSE 'prefers' END AS k, o_orderpriority AS v, epoch(o_orderdate)::DOUBLE AS ts FROM orders),
c AS (SELECT n.id AS new_id, o.id AS old_id, n.k AS predicate, n.v AS new_value, o.v AS old_value, n.ts AS new_ts FROM f n JOIN f o ON n.s = o.s AND n.k = o.k AND n.id <> o.id AND lower(n.v) <> lower(o.v) AND o.ts <= n.ts WHERE n.k IN ('works_at', 'lives_in')
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY o.ts DESC, o.id DESC) = 1)
"""


def order_facts(spark, sf) -> DataFrame:
    """Orders as facts of customers: their priority is where someone works, lives or what they prefer."""
    o = table(spark, sf, "orders")
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("subject"), _choice(F.col("o_orderkey") % 3, [F.lit("works_at"), F.lit("lives_in"), F.lit("prefers")]).alias("predicate"), F.col("o_orderpriority").alias("object"), ts.alias("ts"))


def fact_changes(spark, sf) -> DataFrame:
    rows = order_facts(spark, sf)
    return consolidate.superseded(rows, rows)


@query(_FACTS + "SELECT new_id, old_id, predicate, new_value, old_value FROM c")
def changed_facts(spark, sf):
    return fact_changes(spark, sf).select("new_id", "old_id", "predicate", "new_value", "old_value")


@query(_FACTS + "SELECT DISTINCT new_id AS src, old_id AS dst, 0.3::DOUBLE AS weight, 'supersedes' AS kind, new_ts AS valid_from FROM c")
def superseding_edges(spark, sf):
    return consolidate.supersedes_edges(fact_changes(spark, sf))


@query(_FACTS + """, t AS (SELECT predicate, lower(old_value) AS v, min(new_ts) AS e FROM c GROUP BY 1, 2)
SELECT f.id AS src, f.k AS kind, f.v AS value, CASE WHEN t.e IS NOT NULL AND f.id % 4 <> 0 THEN t.e WHEN f.id % 4 = 0 THEN 1.0::DOUBLE END AS valid_until FROM f LEFT JOIN t ON t.predicate = f.k AND t.v = lower(f.v)""")
def expired_edges(spark, sf):
    edges = order_facts(spark, sf).select(F.col("id").alias("src"), F.col("predicate").alias("kind"), F.col("object").alias("value"), F.when(F.col("id") % 4 == 0, 1.0).alias("valid_until"))
    return consolidate.expire_edges(edges, fact_changes(spark, sf)).select("src", "kind", "value", "valid_until")


@query(_FACTS + """, m AS (SELECT old_id, min(new_ts) AS at FROM c GROUP BY 1)
SELECT f.id, CASE WHEN f.id % 5 = 0 THEN 86400.0::DOUBLE ELSE m.at END AS superseded_at FROM f LEFT JOIN m ON m.old_id = f.id""")
def superseded_marks(spark, sf):
    rows = order_facts(spark, sf).select("id", F.when(F.col("id") % 5 == 0, F.timestamp_seconds(F.lit(86400))).alias("superseded_at"))
    return consolidate.mark_superseded(rows, fact_changes(spark, sf)).select("id", F.unix_timestamp("superseded_at").cast("double").alias("superseded_at"))


@query(f"""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.vec_id * 7 % 97 AS ta, b.vec_id * 7 % 97 AS tb FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE round({COS}, 9) > 0.3 AND round({COS}, 9) <= 0.45)
SELECT CASE WHEN tb >= ta THEN b ELSE a END AS newer, CASE WHEN tb >= ta THEN a ELSE b END AS older FROM p""")
def similar_changes(spark, sf):
    """Rows of one entity (label) that are alike but not the same: the later one supersedes."""
    rows = embedded(spark, sf)
    pairs = vectors.similar_pairs(rows, 0.3).withColumn("sim", F.round("sim", 9))
    return consolidate.similar_superseded(pairs, rows.select("id", F.col("label").alias("entity_id"), (F.col("id") * 7 % 97).alias("ts")), 0.3, 0.45)


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey % 50 AS s, CASE o_orderkey % 2 WHEN 0 THEN 'Oslo' ELSE 'Rome' END AS v, epoch(o_orderdate)::DOUBLE AS ts FROM orders WHERE o_orderkey % 20 = 0),
t AS (SELECT s_suppkey + 100000000 AS id, s_suppkey % 50 AS s, CASE s_suppkey % 3 WHEN 0 THEN 'Oslo' ELSE 'Bern' END AS v, (s_suppkey * 100000)::DOUBLE AS ts FROM supplier WHERE s_suppkey % 4 <> 1)
SELECT DISTINCT f.id AS new_id, t.id AS old_id, 'lives_in' AS predicate, f.v AS new_value, t.v AS old_value FROM f JOIN t USING (s) WHERE f.v <> t.v AND t.ts <= f.ts""")
def changed_sentences(spark, sf):
    """Facts against the sentences of texts: suppliers say where they live."""
    o = table(spark, sf, "orders").where("o_orderkey % 20 = 0")
    new = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string")).alias("subject"), F.lit("lives_in").alias("predicate"), F.when(F.col("o_orderkey") % 2 == 0, "Oslo").otherwise("Rome").alias("object"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"))
    k = F.col("s_suppkey")
    said = F.concat(F.lit("It is so. n"), (k % 50).cast("string"), F.lit(" lives in "), F.when(k % 3 == 0, "Oslo").otherwise("Bern"), F.lit("! Nothing more"))
    texts = table(spark, sf, "supplier").select((k + 100000000).alias("id"), said.alias("content"), F.when(k % 4 == 1, "enrichment").otherwise("cli").alias("source"), (k * 100000).cast("double").alias("ts"))
    return consolidate.superseded_sentences(new, texts).select("new_id", "old_id", "predicate", "new_value", "old_value")


@query(f"""
WITH m AS (SELECT vec_id AS id, label AS p, vec_id % 7 AS s, 'text ' || vec_id % 40 AS c, embedding FROM embeddings),
n AS (SELECT * FROM m WHERE id % 2 = 1), e AS (SELECT * FROM m WHERE id % 2 = 0)
SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.p = n.p AND ((e.s = n.s AND e.c = n.c) OR round(list_cosine_similarity(n.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) > 0.35))""")
def new_siblings(spark, sf):
    """Odd rows as new children, even ones as those there are: which say something new to their parent (the label)."""
    rows = _children(spark, sf)
    return consolidate.without_siblings(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), 0.35).select("id")


def _children(spark, sf) -> DataFrame:
    i = F.col("id")
    return embedded(spark, sf).select("id", F.col("label").alias("parent_id"), F.concat(F.lit("S"), (i % 7).cast("string")).alias("subject"), F.concat(F.lit("text "), (i % 40).cast("string")).alias("content"), "v", ((i % 9) / F.lit(10.0)).alias("confidence"))


@query("""
WITH m AS (SELECT vec_id AS id, label AS p, vec_id % 7 AS s, 'text ' || vec_id % 40 AS c, (vec_id % 9) / 10.0::DOUBLE AS f, embedding FROM embeddings),
a AS (SELECT n.p, n.s, n.c, min(e.id) AS id, max(n.f) AS f FROM m n JOIN m e ON n.id % 2 = 1 AND e.id % 2 = 0 AND e.p = n.p AND e.s = n.s AND round(list_cosine_similarity(n.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) > 0.1 GROUP BY n.p, n.s, n.c),
b AS (SELECT id, max(length(c)) AS longest, count(*) AS n FROM a GROUP BY id)
SELECT m.id, length(CASE WHEN b.longest > length(m.c) THEN repeat('x', b.longest::INT) ELSE m.c END)::INT AS n_chars, b.id IS NOT NULL AS changed FROM m LEFT JOIN b USING (id) WHERE m.id % 2 = 0""")
def revised_children(spark, sf):
    """Children whose subject a new child speaks of again: the longer text stays."""
    rows = _children(spark, sf)
    old = rows.where("id % 2 = 0")
    changes = consolidate.same_subject(rows.where("id % 2 = 1"), old, 0.1)
    out = consolidate.revised(old, changes).join(changes.select("id", F.lit(True).alias("changed")), "id", "left")
    return out.select("id", F.length("content").alias("n_chars"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("""
SELECT d.doc_id AS id, array_to_string(CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 3 <> 0 AND l.doc_id IS NOT NULL THEN [source, lang, 'quality:' || quality, 'toxic:' || toxic] ELSE [source, lang] END, ',') AS labels,
  CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 3 <> 0 AND l.doc_id IS NOT NULL THEN 2 WHEN d.doc_id % 3 = 0 THEN 0 ELSE 1 END AS label_version FROM documents d LEFT JOIN labels l USING (doc_id)""")
def second_labels(spark, sf):
    """Labels found later are merged into enriched rows of the first label version."""
    i = F.col("id")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("source", "lang").alias("labels"), (F.col("doc_id") % 2 == 0).alias("enriched"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("label_version"))
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string"))).alias("new_labels"))
    return memories.tier2_labels(rows, found).select(i, F.array_join("labels", ",").alias("labels"), "label_version")


@query(f"""
WITH d AS (SELECT doc_id AS id, lower(text) AS l, source FROM documents)
SELECT id, CASE WHEN id % 2 = 0 THEN {_labels_sql()} ELSE source END AS labels, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS label_version FROM d""")
def first_labels(spark, sf):
    """Rows of no label version are labelled by keywords."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("source").alias("labels"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(2).alias("label_version"))
    out = memories.bootstrap_labels(rows)
    return out.select("id", F.array_join(F.filter("labels", lambda x: ~x.startswith("entity:")), ",").alias("labels"), "label_version")


@query("""
WITH u AS (SELECT DISTINCT user_id, event_type FROM events), i AS (SELECT user_id, sum(value) AS importance FROM events GROUP BY 1), n AS (SELECT event_type, count(*) AS c FROM u GROUP BY 1),
r AS (SELECT event_type, user_id, c, row_number() OVER (PARTITION BY event_type ORDER BY importance DESC, user_id) AS k FROM u JOIN i USING (user_id) JOIN n USING (event_type) WHERE c >= 5 AND event_type <> 'view')
SELECT event_type AS label, any_value(c) AS member_count, string_agg('user ' || user_id, ',' ORDER BY k) AS texts FROM r WHERE k <= 20 GROUP BY event_type""")
def label_clusters(spark, sf):
    """Labels that are due for a summary (that of `view` is up to date), with the texts of their most important members."""
    rows = typed_users(spark, sf).withColumn("content", F.concat(F.lit("user "), F.col("id").cast("string")))
    known = graph.label_counts(rows).where("label = 'view'").select("label", F.col("n_members").alias("member_count"))
    return consolidate.clusters(rows, known).select("label", "member_count", F.array_join("texts", ",").alias("texts"))


@query(f"""
WITH u AS (SELECT user_id AS id, count(*) % 4 AS c, max(ts) AS last, min(ts) AS made FROM events GROUP BY 1)
SELECT id, CASE WHEN c > 0 AND {NOW + 1_200_000} - floor(epoch(CASE WHEN id % 2 = 0 THEN last ELSE made END)) > 30 * 86400 THEN c - 1 ELSE c END AS echo_count FROM u""")
def decayed_counts(spark, sf):
    u = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("made"))
    rows = u.select("id", (F.col("n") % 4).alias("echo_count"), F.when(F.col("id") % 2 == 0, F.col("last").cast("timestamp")).alias("last_echoed"), F.col("made").cast("timestamp").alias("created_at"))
    return memories.decayed_counts(rows, F.timestamp_seconds(F.lit(NOW + 1_200_000))).select("id", "echo_count")


@query(f"""
WITH e AS (SELECT event_id AS id, {_CAT} AS cat, event_id % 5 AS n, floor(epoch(ts)) AS made, (event_id % 10) / 10.0::DOUBLE AS nov, event_id % 3 = 0 AS known FROM events),
f AS (SELECT e.*, p.imp, 2.0::DOUBLE / (1 + exp(-(n / (greatest({NOW} - made, 1) / 86400.0::DOUBLE)))) - 1 AS vel FROM e JOIN {_PAR} ON p.cat = e.cat)
SELECT id, round(CASE WHEN known THEN 0.25 ELSE greatest(0, least(1, 0.41::DOUBLE * nov + 0.29::DOUBLE * imp + 0.24::DOUBLE * vel + 0.06::DOUBLE * CASE id % 2 WHEN 0 THEN 0.5 ELSE 0.3 END)) END, 6) AS importance FROM f""")
def importance_updates(spark, sf):
    """Importance is computed anew but where it was within the last hour."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), _typed().alias("category"), F.col("ts").cast("timestamp").alias("created_at"))
    i, known = F.col("id"), F.col("id") % 3 == 0
    rows = e.withColumns({"echo_count": i % 5, "novelty_score": (i % 10) / F.lit(10.0), "source": F.when(i % 2 == 0, "cli").otherwise("other"), "importance": F.when(i % 2 == 0, 0.25).when(known, 0.25), "importance_computed_at": F.timestamp_seconds(F.lit(NOW) - F.when(known, 60).otherwise(7200))})
    return memories.importance(rows, F.timestamp_seconds(F.lit(NOW))).select("id", F.round("importance", 6).alias("importance"))


@query("""
SELECT d.doc_id AS id, d.doc_id % 3 + CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS enrichment_attempts, d.doc_id % 5 = 0 OR coalesce(quality, 0) > 0 AS enriched FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enrichment_attempts(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("enrichment_attempts"), (F.col("doc_id") % 5 == 0).alias("enriched"))
    tried = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("n_facts"))
    return consolidate.attempted(rows, tried).select("id", "enrichment_attempts", "enriched")


@query("""
SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 < 3 AND doc_id % 7 <> 0 ORDER BY doc_id % 13 DESC, doc_id LIMIT 25""")
def enrichment_queue(spark, sf):
    """The 25 most important texts that facts are to be taken from (the limit is the rule's)."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("id"), (i % 3 == 0).alias("enriched"), (i % 5).alias("enrichment_attempts"), F.when(i % 7 == 0, i).alias("parent_id"), F.lit("text").alias("modality"), (i % 13).alias("importance"))
    return consolidate.to_enrich(rows).select("id")


@query("""
WITH n AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT id, (CASE WHEN n < 30 THEN least(greatest(n // 10, 1), 3) ELSE least(greatest(n // 20, 3), 12) END)::INT AS most FROM n""")
def fact_limits(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.max_facts(F.col("text")).alias("most"))


@query(f"""
WITH n AS (SELECT a.vec_id AS id, 'p' || b.vec_id AS label, {COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id < 10),
g AS (SELECT id, list(label ORDER BY round(sim, 9) DESC, label) AS near FROM n WHERE round(sim, 9) >= 0.2 GROUP BY id),
d AS (SELECT vec_id AS id, coalesce(near, []::VARCHAR[]) AS near, lower(text) AS l FROM embeddings LEFT JOIN g ON g.id = vec_id JOIN documents ON doc_id = vec_id),
e AS (SELECT id, near, {_labels_sql()} AS own FROM d)
SELECT id, array_to_string(list_concat(near, CASE WHEN own = '' THEN []::VARCHAR[] ELSE string_split(own, ',') END)[1:10], ',') AS labels FROM e""")
def first_tier_labels(spark, sf):
    """Labels of documents with a vector: the first ten vectors as prototypes, then keywords (entities left out)."""
    vec = embedded(spark, sf)
    rows = vec.select("id", "v").join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    protos = vec.where("id < 10").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("label"), "v")
    found = embedding.first_tier(rows, protos, 0.2)
    return found.select("id", F.array_join(F.filter("labels", lambda x: ~x.startswith("entity:")), ",").alias("labels"))


# ---------------------------------------------------------------- views of rows


@query(f"""
WITH s AS (SELECT a.vec_id AS id, 'topic:' || a.label AS label, b.vec_id AS other, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS n FROM s)
SELECT id, label, count(*) AS n_connected, string_agg(other::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS top_ids FROM r GROUP BY id, label""")
def memory_graph(spark, sf):
    rows = tagged(spark, sf)
    return views.memory_graph(rows, rows.where("id % 20 = 0").select("id")).select("id", "label", "n_connected", F.array_join("top_ids", ",").alias("top_ids"))


@query("""
WITH l AS (SELECT vec_id AS id, 'a' || label AS l FROM embeddings UNION SELECT vec_id, 'b' || vec_id % 4 FROM embeddings)
SELECT a.id, count(*) AS total, count(DISTINCT b.id) AS n_unique FROM l a JOIN l b ON a.l = b.l AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY a.id""")
def connection_counts(spark, sf):
    rows = embedded(spark, sf).select("id", "v", F.array(F.concat(F.lit("a"), F.col("label").cast("string")), F.concat(F.lit("b"), (F.col("id") % 4).cast("string"))).alias("labels"))
    return views.connected(rows, rows.where("id % 20 = 0").select("id"))


@query(f"""
WITH s AS (SELECT 'Topic ' || a.vec_id AS name, b.vec_id AS id, {COS} AS sim FROM embeddings a JOIN embeddings b ON b.label = a.vec_id WHERE a.vec_id < 10)
SELECT name, id, round(sim, 6) AS sim, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY name ORDER BY round(sim, 9) DESC, id) QUALIFY row_number() OVER w <= 5""")
def entity_search(spark, sf):
    rows = embedded(spark, sf)
    names = rows.where("id < 10").select(F.concat(F.lit("Topic "), F.col("id").cast("string")).alias("name"), "v")
    told = rows.select("id", "v", F.array(F.concat(F.lit(" TOPIC "), F.col("label").cast("string")), F.lit("all")).alias("names"))
    return views.entity_search(names, told, 5).select("name", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT q, id, sim FROM s WHERE round(sim, 9) >= 0.14 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) <= 10)
SELECT x.q AS query_id, x.id AS a, y.id AS b, round(least(x.sim, y.sim), 6) AS weight FROM k x JOIN k y ON x.q = y.q AND x.id < y.id WHERE least(x.sim, y.sim) > 0.3""")
def proximity_edges(spark, sf):
    rows = embedded(spark, sf)
    return views.proximity_edges(vectors.knn(rows, asked(rows), 10, 0.14)).select("query_id", "a", "b", F.round("weight", 6).alias("weight"))


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type IN ('click', 'error')")
def labelled_rows(spark, sf):
    return memories.with_labels(typed_users(spark, sf), ["error", "click", "error"]).select("id")


@query("""
WITH t AS (SELECT p_partkey AS id, p_name || ', ' || p_type || ' of ' || p_brand AS content FROM part),
a AS (SELECT DISTINCT lower(p_name) AS alias, 'n' AS k FROM part UNION SELECT DISTINCT lower(p_brand), 'b' FROM part UNION SELECT DISTINCT lower(p_type) || ' of brand', 't' FROM part)
SELECT id, k || ':' || alias AS entity_id, alias FROM t JOIN a ON contains(' ' || regexp_replace(lower(content), '[,]', ' ', 'g') || ' ', ' ' || alias || ' ') OR (k = 't' AND contains(lower(content), alias))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY strlen(alias) DESC, alias, k) = 1""")
def resolved_entities(spark, sf):
    """The longest known name in a text: part names, brands (with a mark in them), types in a phrase."""
    p = table(spark, sf, "part")
    texts = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(", "), "p_type", F.lit(" of "), "p_brand").alias("content"))
    kinds = (("n", F.col("p_name")), ("b", F.col("p_brand")), ("t", F.concat("p_type", F.lit(" of brand"))))
    names = graph.merged([p.select(F.lower(c).alias("alias")).distinct().select(F.concat(F.lit(f"{k}:"), "alias").alias("entity_id"), "alias") for k, c in kinds])
    return memories.resolve(texts, names)


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(trim({name}))))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || ['8','9','a','b'][(position({h}[17] IN '0123456789abcdef') - 1) % 4 + 1] || {h}[18:20] || '-' || {h}[21:32]"


@query(f"""
WITH n AS (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT ' ' || lower(c_mktsegment) FROM customer UNION ALL SELECT s_name FROM supplier),
m AS (SELECT {_uuid_sql('name')} AS entity_id, min(name) AS canonical_name FROM n GROUP BY 1)
SELECT * FROM m WHERE entity_id NOT IN (SELECT {_uuid_sql('s_name')} FROM supplier WHERE s_suppkey % 2 = 0)""")
def entity_rows(spark, sf):
    """Names become entities once, whatever their case; those known already are left out."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    names = c.select(F.col("c_mktsegment").alias("name")).unionAll(c.select(F.concat(F.lit(" "), F.lower("c_mktsegment")))).unionAll(s.select("s_name"))
    known = s.where("s_suppkey % 2 = 0").select(X.entity_id(F.col("s_name")).alias("entity_id"))
    return memories.new_entities(names, known)


@query("""
SELECT role, count(*) FILTER (regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])(?:i|i''m|my|me|mine|myself)(?:[^\\pL\\pN_]|$)')) AS n FROM conversations GROUP BY 1""")
def self_mentions(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count_if(memories.speaks_of_self(F.col("text"))).alias("n"))


# ---------------------------------------------------------------- edges

_EDGES = """WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, round(sum(l_quantity) / 1000, 6) AS weight, count(*) AS activation_count, CASE (l_suppkey + l_partkey) % 3 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'part_of' END AS kind FROM lineitem GROUP BY l_suppkey, l_partkey)
"""


def supply_edges(spark, sf) -> DataFrame:
    """Suppliers and parts of line items, some edges typed."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity") / 1000, 6).alias("weight"), F.count(F.lit(1)).alias("activation_count"))
    kind = F.when((F.col("l_suppkey") + F.col("l_partkey")) % 3 == 0, "supersedes").when((F.col("l_suppkey") + F.col("l_partkey")) % 3 == 1, "part_of")
    return g.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), "weight", "activation_count", kind.alias("kind"))


@query(_EDGES + "SELECT src, dst, CASE WHEN src % 10 = 0 THEN 'works_at' ELSE kind END AS kind FROM e")
def edge_updates(spark, sf):
    """Kinds of existing edges are overwritten; changes of unknown edges make none."""
    edges = supply_edges(spark, sf)
    changes = edges.where("src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("works_at").alias("kind"))
    unknown = table(spark, sf, "supplier").select((F.col("s_suppkey") + 5000000).alias("src"), F.col("s_suppkey").alias("dst"), F.lit("lost").alias("kind"))
    return graph.set_columns(edges, changes.unionAll(unknown), "kind").select("src", "dst", "kind")


@query(_EDGES + "SELECT src, dst FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND dst NOT IN (SELECT p_partkey + 1000000 FROM part WHERE p_size < 5)")
def edges_without_nodes(spark, sf):
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")).unionAll(table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey") + 1000000))
    return graph.remove_nodes(supply_edges(spark, sf), gone).select("src", "dst")


@query(_EDGES + ", s AS (SELECT src AS id, dst AS other, weight, kind FROM e UNION ALL SELECT dst, src, weight, kind FROM e) SELECT id, other, weight, kind FROM s WHERE id % 20 = 0 AND weight >= 0.03 AND kind IS NOT NULL")
def edge_associations(spark, sf):
    """Typed edges of every 20th node, of some weight."""
    edges = supply_edges(spark, sf)
    ids = graph.symmetric(edges).where("id % 20 = 0").select("id")
    return graph.associations(edges.where("kind is not null"), ids, 0.03).select("id", "other", "weight", "kind")


@query(_EDGES + """, r AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS id FROM lineitem UNION SELECT DISTINCT l_orderkey, l_partkey + 1000000 FROM lineitem),
d AS (SELECT src AS id, dst AS other, weight, kind, true AS newer FROM e UNION ALL SELECT dst, src, weight, kind, false FROM e)
SELECT r.q AS query_id, r.id, round(least(sum(weight + CASE WHEN kind = 'supersedes' AND newer THEN 0.1::DOUBLE WHEN kind = 'part_of' THEN 0.05::DOUBLE ELSE 0 END), 0.4::DOUBLE), 6) AS boost, count(*) FILTER (kind = 'supersedes' AND NOT newer) AS superseded
FROM r JOIN d ON d.id = r.id JOIN r o ON o.q = r.q AND o.id = d.other GROUP BY 1, 2""")
def boosted_results(spark, sf):
    """The suppliers and parts of an order as its results: what their edges among each other add."""
    l_ = table(spark, sf, "lineitem")
    results = l_.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id")).unionAll(l_.select("l_orderkey", F.col("l_partkey") + 1000000)).distinct()
    return graph.boost(results, supply_edges(spark, sf)).select("query_id", "id", F.round("boost", 6).alias("boost"), "superseded")


@query(_EDGES + "SELECT coalesce(kind, 'co_activation') AS kind, count(*) AS n_edges, sum(activation_count)::BIGINT AS n_activations FROM e GROUP BY 1")
def edge_counts(spark, sf):
    return graph.edge_counts(supply_edges(spark, sf))


# ---------------------------------------------------------------- prompts, providers, formats


@query(f"""
WITH d AS (SELECT doc_id, text, {_masked_sql('text')} AS m, {_SENSE} AS s, doc_id % 2 = 0 AS here FROM documents)
SELECT doc_id, md5(CASE WHEN s = 'Public' THEN text WHEN s = 'Private' AND here THEN text WHEN s = 'Private' THEN m END) AS told FROM d""")
def provider_content(spark, sf):
    """What local and other providers get to see."""
    d = table(spark, sf, "documents").select("doc_id", "text", X.pii_mask(F.col("text")).alias("masked"), X.sensitivity(F.col("text")).alias("s"))
    return d.select("doc_id", F.md5(X.content_for_provider(F.col("text"), F.col("masked"), F.col("s"), F.col("doc_id") % 2 == 0)).alias("told"))


_KINDS_SQL = "[" + ", ".join(f"regexp_extract_all(text, {quoted(X._ALL_MASKS)}, {i + 1})" for i in range(len(X._MASKS))) + "]"
_NAMES_SQL = rlist(X._MASKS)


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, {quoted(X._ALL_MASKS)}, 0) AS m, string_split_regex(text, {quoted(X._ALL_MASKS)}) AS p, {_KINDS_SQL} AS k FROM documents),
e AS (SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: {_NAMES_SQL}[list_position(list_transform(k, lambda x: x[i] <> ''), true)] || ':' ||
  (coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0))::BIGINT || ':' ||
  (coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda y: length(y))), 0))::BIGINT) AS s FROM d)
SELECT doc_id, array_to_string(s, ',') AS spans FROM e""")
def pii_spans(spark, sf):
    """Places of personal data, leftmost first."""
    told = F.transform(X.pii_matches(F.col("text")), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(told, ",").alias("spans"))


@query("SELECT conv_id, md5(string_agg('- ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS block FROM conversations GROUP BY 1")
def memory_blocks(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("content"))
    return context.memory_block(rows, "conv_id").select("conv_id", F.md5("block").alias("block"))


@query("""
WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS sys, min(turn) AS first FROM conversations GROUP BY 1)
SELECT conv_id, turn, role, md5(CASE WHEN turn = sys AND conv_id % 2 = 0 THEN concat_ws(chr(10), text, 'B' || conv_id) ELSE text END) AS text FROM conversations JOIN f USING (conv_id)
UNION ALL SELECT conv_id, first - 1, 'system', md5('B' || conv_id) FROM f WHERE sys IS NULL AND conv_id % 2 = 0""")
def injected_messages(spark, sf):
    turns = table(spark, sf, "conversations")
    blocks = turns.where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("block", F.concat(F.lit("B"), F.col("conv_id").cast("string")))
    return context.injected(turns, blocks).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("""
WITH s AS (SELECT conv_id, CASE WHEN role = 'system' THEN 'system' WHEN turn % 4 = 3 THEN 'rag' ELSE 'conversation' END AS kind, turn, ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM conversations),
o AS (SELECT *, CASE kind WHEN 'conversation' THEN 2 WHEN 'rag' THEN 1 ELSE 0 END AS r FROM s),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY r, CASE WHEN kind = 'conversation' THEN -turn ELSE turn END, kind ROWS UNBOUNDED PRECEDING) AS used FROM o)
SELECT conv_id, turn FROM w WHERE r = 0 OR used <= 400""")
def assembled_prompts(spark, sf):
    """What stays of prompts of 400 tokens: the oldest turns go first, then the last documents."""
    kind = F.when(F.col("role") == "system", "system").when(F.col("turn") % 4 == 3, "rag").otherwise("conversation")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("prompt_id"), kind.alias("kind"), F.col("turn").alias("place"), X.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return context.assembled(rows, F.lit(400)).select(F.col("prompt_id").alias("conv_id"), F.col("place").alias("turn"))


@query("""
SELECT event_type AS provider, round(coalesce(sum(value) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-20'), 0), 4) AS today, round(coalesce(sum(value) FILTER (date_trunc('month', ts) = TIMESTAMP '2024-01-01'), 0), 4) AS this_month,
  coalesce(sum(value) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-20'), 0) < 3000 AS within FROM events GROUP BY 1""")
def spend(spark, sf):
    """What providers have cost on a day and in its month, and whether the day's limit is kept."""
    log = table(spark, sf, "events").select(F.col("event_type").alias("provider"), "ts", F.col("value").alias("cost"))
    told = routing.spent(log, F.expr("TIMESTAMP_NTZ'2024-01-20 12:00:00'"))
    return told.select("provider", F.round("today", 4).alias("today"), F.round("this_month", 4).alias("this_month"), routing.within_budget(F.col("today"), F.lit(3000.0)).alias("within"))


@query("SELECT model, arg_min(provider, place) AS provider FROM (VALUES " + ", ".join(f"({m[0]}, '{m[1]}', '{m[4]}')" for m in MODELS) + ", (9, 'late', 'wide'), (8, 'early', 'new')) m(place, provider, model) GROUP BY 1")
def model_providers(spark, sf):
    rows = spark.createDataFrame([(m[0], m[1], m[4]) for m in MODELS] + [(9, "late", "wide"), (8, "early", "new")], "place int, provider string, model string")
    return routing.model_providers(rows)


@query("""
WITH n AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * o_orderkey AS n FROM orders)
SELECT o_orderkey, format('{:,}', n) AS number, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM n""")
def formatted_numbers(spark, sf):
    n = F.floor("o_totalprice").cast("long") * F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", X.formatted_number(n).alias("number"), X.formatted_bytes(n).alias("size"))


# ---------------------------------------------------------------- modes, budgets, filters

_SEEN = f"""WITH q AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0),
k AS (SELECT * FROM q WHERE round(sim, 9) >= 0.14 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) <= 10),
v AS (SELECT query_id, id, sim, (sim + least(CASE WHEN id % 3 = 0 THEN 0.3::DOUBLE WHEN id % 3 = 1 THEN 0.5::DOUBLE ELSE 0 END, 0.4::DOUBLE) + 0.05::DOUBLE / (1 + (id % 30) / 1.0::DOUBLE)) * exp(-ln(2) * (id % 30) / CASE WHEN id % 2 = 0 THEN 30.0::DOUBLE ELSE 3.0::DOUBLE END) AS score FROM k)
"""


def seen_rows(spark, sf) -> DataFrame:
    """Answers of image vectors: rows up to a month old, of two categories, some with a boost."""
    vec, i = embedded(spark, sf), F.col("id")
    rows = vec.select("id", F.when(i % 2 == 0, "Fact").otherwise("Conversation").alias("category"), F.timestamp_seconds(F.lit(NOW) - (i % 30) * 86400).alias("created_at"))
    boosts = vec.where("id % 20 = 0").select(i.alias("query_id")).join(vec.where("id % 3 < 2").select("id", F.when(i % 3 == 0, 0.3).otherwise(0.5).alias("boost")))
    return multimodal.vision_answers(rows, vec.select("id", "v"), asked(vec), F.lit(NOW), boosts=boosts)


@query(_SEEN + "SELECT query_id, id, round(sim, 6) AS sim, round(score, 6) AS score FROM v")
def vision_results(spark, sf):
    return seen_rows(spark, sf).select("query_id", "id", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"))


@query(_SEEN + """, t AS (SELECT query_id, id, sim * 0.9::DOUBLE AS score FROM k WHERE id % 2 = 1), u AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM v UNION ALL SELECT * FROM t) GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def auto_results(spark, sf):
    """Texts and images together: the better score of each row, the best five."""
    images = seen_rows(spark, sf)
    texts = images.where("id % 2 = 1").select("query_id", "id", (F.col("sim") * 0.9).alias("score"))
    return multimodal.answers("auto", texts, images, 5).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""
WITH s AS (SELECT doc_id, {_SENSE} AS s FROM documents WHERE doc_id % 3 <> 0)
SELECT l.doc_id AS id, l.doc_id % 2 = 0 AS here FROM labels l LEFT JOIN s USING (doc_id) WHERE coalesce(s, 'Public') = 'Public' OR (s = 'Private' AND l.doc_id % 2 = 0)""")
def results_for_provider(spark, sf):
    """Results that a provider may see; rows whose sensitivity is not known count as public."""
    known = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), X.sensitivity(F.col("text")).alias("sensitivity"))
    results = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("here"))
    return context.filtered_for_provider(results, known, F.col("here")).select("id", "here")


@query("""
WITH t AS (SELECT conv_id, 1000 + conv_id * 7 AS total FROM conversations GROUP BY 1)
SELECT conv_id, greatest(total - total * 5 // 100 - total * 15 // 100 - total * 20 // 100 - total * 25 // 100, 0)::BIGINT AS budget FROM t""")
def conversation_budgets(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id").distinct()
    return t.select("conv_id", context.conversation_budget(1000 + F.col("conv_id") * 7).cast("long").alias("budget"))


@query("""
SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 3 END AS priority FROM conversations""")
def segment_priorities(spark, sf):
    kind = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "echo").otherwise("conversation")
    return table(spark, sf, "conversations").select("conv_id", "turn", context.priority(kind).alias("priority"))


@query("SELECT source, ceil(ceil(-count(*) * ln(0.01) / ln(2) ** 2) / 8)::BIGINT AS n_bytes FROM documents GROUP BY 1")
def bloom_sizes(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(memories.bloom_size(F.count(F.lit(1))).alias("n_bytes"))


@query("""
WITH n AS (SELECT event_type AS label, 'new' AS summary, count(*) AS member_count FROM events WHERE event_type <> 'view' GROUP BY 1), o AS (SELECT event_type AS label, 'old' AS summary, 1 AS member_count FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE label NOT IN (SELECT label FROM n)""")
def summary_upserts(spark, sf):
    e = table(spark, sf, "events")
    new = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("member_count")).select("label", F.lit("new").alias("summary"), "member_count")
    old = e.where("event_type <> 'click'").select(F.col("event_type").alias("label")).distinct().select("label", F.lit("old").alias("summary"), F.lit(1).cast("long").alias("member_count"))
    return consolidate.upsert_summaries(old, new)
