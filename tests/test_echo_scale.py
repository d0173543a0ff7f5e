"""The ranked query where there is much: what is left undone changes no result."""

import random

import pytest
from pyspark.sql import functions as F

from anamnesis.config import DEFAULT
from anamnesis.operators import memories
from anamnesis.operators.coactivation import Activity
from anamnesis.plans import echo as E
from anamnesis.plans import queries

SF = "/root/testdata/sf0.001"


def printed(text: str) -> set[str]:
    w = [x for x in text.lower().split() if len(x.encode()) >= 3]
    return {*w, *("_".join(x) for x in zip(w, w[1:], strict=False))}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_gate_by_definition(spark, monkeypatch, bound):
    """Words and pairs of words, also where an underscore makes one look like another."""
    monkeypatch.setattr(memories, "BROADCAST", bound)
    r, parts = random.Random(3), ["abc", "def", "ghi", "abc_def", "def_ghi", "abc_def_ghi", "xyz", "no"]
    texts = [" ".join(r.choice(parts[:6] if i < 3 else ["river", "no", "stone"]) for _ in range(3)) for i in range(55)]
    texts[:3] = ["abc_def ghi", "klm nop", "abc def"]
    asked = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(60)] + ["klm_nop", "klm xyz", "nop_klm", "abc def_ghi", "xyz", "no", "abc_def_ghi"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {x.query_id for x in memories.gate(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), rows).collect()}
    known = set().union(*map(printed, texts))
    want = {i for i, t in enumerate(asked) if printed(t) & known}
    assert got == want and 0 < len(want) < len(asked)


def test_the_gate_makes_no_pairs_of_the_stores_words(spark, monkeypatch):
    made, fingerprints = [], memories.X.word_fingerprints
    monkeypatch.setattr(memories.X, "word_fingerprints", lambda w: made.append(w) or fingerprints(w))
    rows = spark.createDataFrame([(i, f"plain words of text{i}") for i in range(60)], "id long, content string")
    assert memories.gate(spark.createDataFrame([(1, "plain words")], "query_id long, text string"), rows).count() == 1
    assert len(made) == 1  # those of the queries


def test_only_queries_with_room_walk(spark, monkeypatch):
    """Results are those of walks for all, whether queries have k rows near them or not."""
    store = queries.store(spark, SF)
    tagged = E.Store(store.memories.withColumn("labels", F.array_append("labels", F.lit("entity:plain"))), store.vectors, store.edges)
    dim = len(store.vectors.first().v)
    lone = spark.createDataFrame([(10**6, "plain words", [0.0] * (dim - 1) + [-1.0])], "query_id long, text string, v array<float>")
    asked = store.vectors.where("id % 40 = 0").join(store.memories, "id").select(F.col("id").alias("query_id"), F.concat("content", F.lit(" plain")).alias("text"), "v").unionByName(lone)
    out = lambda: sorted(map(tuple, E.echo(tagged, asked, F.lit(queries.NOW)).results.select("query_id", "id", "rank", "sim", "score").collect()))
    walkers, room = [], E.with_room
    monkeypatch.setattr(E, "with_room", lambda s, a, n, c: walkers.append(room(s, a, n, c).count()) or room(s, a, n, c))
    got = out()
    monkeypatch.setattr(E, "with_room", lambda s, a, n, c: a)
    assert got == out() and got and walkers[0] < asked.count()


def test_rows_of_a_small_file_are_spread(spark):
    """One file is read by one task, but its texts are looked at by all cores; only columns that are read are made."""
    rows = queries.store(spark, SF).memories
    assert rows.columns == list(E.COLUMNS) and rows.select(F.input_file_name().alias("f")).distinct().count() > 1
    assert isinstance(queries.store(spark, SF).edges, Activity) and DEFAULT.rescue_only


@pytest.mark.parametrize("bound", [500_000, 0])
def test_only_edges_between_results_of_one_query_are_kept(spark, monkeypatch, bound):
    monkeypatch.setattr(E, "MET", bound)
    kept, write = {}, E.written
    monkeypatch.setattr(E, "written", lambda df, what: kept.setdefault(what, write(df, what)))
    store = queries.store(spark, SF)
    asked = store.vectors.where("id % 40 = 0").join(store.memories, "id").select(F.col("id").alias("query_id"), F.col("content").alias("text"), "v")
    assert E.echo(store, asked, F.lit(queries.NOW)).results.count()
    pairs = {(r.src, r.dst) for r in E._pairs(kept["top"]).collect()}
    met = {(r.src, r.dst): r.weight for r in kept["among"].collect()}
    every = {(r.src, r.dst): r.weight for r in store.edges.among(kept["top"]).collect()}
    assert met == pytest.approx({k: w for k, w in every.items() if k in pairs}) and 0 < len(met) < len(every)
