import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as X
from anamnesis.operators import consolidate, context, fusion, graph, memories, vectors
from anamnesis.plans import echo as E
from anamnesis.plans import queries as Q
from anamnesis.sources import snapshots


def test_lsh_recall_against_the_exact_scan(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, 32))
    data = [(i, (centres[i % 20] + 0.25 * r.standard_normal(32)).tolist()) for i in range(600)]
    rows = spark.createDataFrame(data, "id long, v array<float>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    p = vectors.planes(32)
    found = {(r.query_id, r.id) for r in vectors.lsh_candidates(vectors.lsh_index(rows, p), asked, p).collect()}
    exact = {(r.query_id, r.id) for r in vectors.knn(rows, asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_lsh_recall_on_the_embeddings_table(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = Q.embedded(spark, f"/root/testdata/{sf}")
        found = {(r.query_id, r.id) for r in Q.lsh_candidates(spark, f"/root/testdata/{sf}").collect()}
        for k in (10, 100_000):
            exact = {(r.query_id, r.id) for r in vectors.knn(rows, Q.asked(rows), k, 0.14).collect()}
            print(sf, k, len(exact & found) / len(exact))
            assert len(exact & found) >= 0.9 * len(exact)


def test_odd_vectors_match_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0])], "id long, v array<float>")
    got = vectors.knn(rows, rows.select(F.col("id").alias("query_id"), "v"), 5, 0.5).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 6), (1, 7), (6, 1), (6, 7), (7, 1), (7, 6)}
    assert [(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, block=2).orderBy("a", "b").collect()] == [(1, 6), (1, 7), (6, 7)]
    assert vectors.knn(rows, rows.select(F.col("id").alias("query_id"), "v").limit(0), 5).count() == 0


def test_fold_is_the_sequential_rule(spark):
    r = np.random.default_rng(2)
    events = [(1, 2, float(s), float(t)) for s, t in zip(r.random(20), np.sort(r.random(20)) * 1e6, strict=True)]
    now, w, last = 1.2e6, 0.0, 0.0
    for _, _, s, t in events:
        w, last = w * 0.5 ** ((t - last) / 604800) + s, t
    w *= 0.5 ** ((now - last) / 604800)
    df = spark.createDataFrame(events, "src long, dst long, strength double, ts double")
    row = graph.fold(df, F.lit(now)).first()
    assert abs(row.weight - w) < 1e-9 and row.activation_count == 20 and row.last_activated == last
    early, late = df.where("ts < 500000"), df.where("ts >= 500000")
    again = graph.refold(graph.fold(early, F.lit(6e5)), late, F.lit(now), F.lit(6e5)).first()
    assert abs(again.weight - w) < 1e-9


def test_validity_is_inclusive_and_open(spark):
    rows = spark.createDataFrame([(1, 2, None, None), (1, 3, 5.0, None), (1, 4, None, 5.0), (1, 5, 6.0, 9.0)], "src long, dst long, valid_from double, valid_until double")
    assert sorted(r.dst for r in graph.valid_at(rows, F.lit(5.0)).collect()) == [2, 3, 4]


def test_diversity_counts_kept_rows_only(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, ["a"] if i != 3 else ["a", "b"], "topic:x") for i in range(6)] + [(1, 9, 0.1, ["b"], "topic:x")], "query_id long, id long, score double, subjects array<string>, topic string")
    assert sorted(r.id for r in fusion.diverse(rows, 3).collect()) == [0, 1, 2, 9]


def test_relatives_and_superseded(spark):
    rows = spark.createDataFrame([(1, 1, None, 0.9), (1, 2, 1, 0.8), (1, 3, None, 0.5), (1, 4, 3, 0.7), (1, 5, None, 0.4)], "query_id long, id long, parent_id long, score double")
    assert sorted(r.id for r in fusion.without_relatives(rows).collect()) == [1, 4, 5]
    newer = spark.createDataFrame([(1, 5)], "newer long, older long")
    assert sorted(r.id for r in fusion.without_superseded(rows, newer).collect()) == [1, 2, 3, 4]
    assert fusion.without_superseded(rows.where("id in (1, 5, 3)"), newer).count() == 3


def test_masks(spark):
    texts = ["card 1234 5678 9012 3456 end", "mail a.b@c.org and 555-123-4567", "ssn 123-45-6789", "password: hunter2 x", "sk-proj-" + "a" * 24, "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [r.m for r in rows.select("id", X.pii_mask(F.col("t")).alias("m")).orderBy("id").collect()]
    assert got == ["card [MASKED:credit_card] end", "mail [MASKED:email] and [MASKED:phone]", "ssn [MASKED:ssn]", "[MASKED:password] x", "[MASKED:api_key]", "nothing"]
    again = rows.select("id", X.pii_mask(X.pii_mask(F.col("t"))).alias("m")).orderBy("id").collect()
    assert [r.m for r in again] == got


def test_formulas(spark):
    r = spark.range(1).select(
        S.power_law(F.lit(86400.0), F.lit(1.0)).alias("one"), S.power_law(F.lit(1.0), F.lit(0.0)).alias("none"), S.exponential(F.lit(86400.0 * 3), F.lit(3.0)).alias("half"),
        S.importance(F.lit(9.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("top"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), S.activation(F.lit(0), F.lit(1e12), F.lit(None).cast("double"), F.lit(0.5)).alias("low"),
    ).first()
    assert abs(r.one - 0.9) < 1e-12 and r.none == 0 and abs(r.half - 0.5) < 1e-12 and r.top == 1 and r.zero == 0 and r.low == -6


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.versions() == [] and store.load("vectors").count() == 0
    v = spark.createDataFrame([(1, "text", [1.0, 2.0])], "id long, modality string, v array<float>")
    store.save({"vectors": v, "memories": spark.createDataFrame([(1, "hello")], "id long, content string")}, model="m")
    assert store.append("vectors", v.selectExpr("id + 1 as id", "modality", "v")) == 1
    assert store.versions() == [0, 1] and store.load("vectors").count() == 2 and store.load("vectors", 0).count() == 1 and store.model() == "m"
    # a writer that comes second builds on the first one's snapshot, and nothing is copied
    other = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    real, met = other.versions, []
    other.versions = lambda: real() if met else (met.append(1), real()[:-1])[1]
    assert other.append("vectors", v.selectExpr("id + 9 as id", "modality", "v")) == 2 and sorted(r.id for r in store.load("vectors").collect()) == [1, 2, 10]
    assert len(list((tmp_path / "s" / "data").glob("memories-*"))) == 1
    assert store.compact("vectors") == 3 and store.load("vectors").count() == 3 and store.load("vectors", 1).count() == 2
    row = store.load("memories").first()
    assert row.content == "hello" and row.confidence == 1.0 and row.echo_count == 0
    import pytest

    with pytest.raises(ValueError):
        store.load("vectors", dim=3)
    snapshots.write_markdown(store.load("memories"), f"file://{tmp_path}/md")
    assert "hello" in spark.read.text(f"file://{tmp_path}/md").agg(F.concat_ws("|", F.collect_list("value"))).first()[0]


def test_storing_and_consolidating(spark):
    texts = spark.createDataFrame([(1, "Mia lives in Oslo. It is cold there", "cli"), (2, "I prefer tea", "cli"), (3, "Mia moved to Bergen last year", "cli")], "id long, content string, source string")
    rows = memories.stored(texts, F.lit("2024-01-01").cast("timestamp")).withColumn("importance", F.lit(0.5))
    assert {r.id: r.category for r in rows.collect()} == {1: "Conversation", 2: "Preference", 3: "Conversation"}
    found = consolidate.facts(rows)
    told = {r.id: (r.subject, r.predicate, r.object) for r in found.collect()}
    assert told == {1: ("Mia", "lives_in", "Oslo"), 3: ("Mia", "lives_in", "Bergen last year")}
    side = found.select("id", "subject", "predicate", "object", F.col("id").alias("ts"))
    change = consolidate.superseded(side, side).first()
    assert (change.new_id, change.old_id) == (3, 1)
    kids = consolidate.children(rows, found)
    assert kids.count() == 2 and consolidate.new_children(kids, kids).count() == 0
    assert memories.accepted(texts, 999_999).count() == 1
    names = memories.aliases(spark.createDataFrame([("e1", "Mia", ["Mia of Oslo"]), ("e2", "Oslo", None)], "entity_id string, canonical_name string, aliases array<string>"))
    assert {r.id: r.entity_id for r in memories.resolve(texts, names).collect()} == {1: "e2", 3: "e1"}


def test_messages(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "hi"), (2, 5, "user", "yo")], "conv_id long, turn long, role string, text string")
    blocks = spark.createDataFrame([(1, "- a"), (2, "- b")], "conv_id long, block string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in context.injected(turns, blocks).collect()}
    assert got == {(1, 0): ("system", "Be kind.\n- a"), (1, 1): ("user", "hi"), (2, 4): ("system", "- b"), (2, 5): ("user", "yo")}


def test_parents_are_rescued_beyond_the_nearest_rows(spark):
    """60 rows and 60 children above the threshold come before a near-miss parent and its child."""

    def at(sim, axis):
        v = [0.0] * 8
        v[0], v[axis] = sim, (1 - sim * sim) ** 0.5
        return v

    # id, parent, enriched, confidence, sim
    data = [(i, None, False, 1.0, 0.2 + i / 1000) for i in range(60)] + [(100 + i, 1, False, 1.0, 0.9 + i / 10000) for i in range(60)]
    data += [(200, None, True, 1.0, 0.1), (201, 200, False, 1.0, 0.85), (202, None, True, 1.0, 0.1), (203, 202, False, 0.1, 0.95), (204, None, True, 1.0, 0.05), (205, 204, False, 1.0, 0.95)]
    columns = "id long, parent_id long, enriched boolean, confidence double, sim double, v array<float>"
    rows = spark.createDataFrame([(*d, at(d[4], 1 + d[0] % 7)) for d in data], columns)
    full = rows.selectExpr("id", "concat('word ', id) as content", "'x' as source", "cast(array() as array<string>) as labels", "'Conversation' as category", "0.5D as importance", "timestamp'2024-01-01' as created_at", "cast(null as timestamp) as last_echoed", "0 as echo_count", "enriched", "confidence", "parent_id", "cast(null as string) as subject", "cast(null as timestamp) as superseded_at")
    edges = spark.createDataFrame([], "src long, dst long, weight double, kind string, valid_from double, valid_until double")
    asked = spark.createDataFrame([(1, "word", at(1.0, 1))], "query_id long, text string, v array<float>")
    got = {r.id: r.sim for r in E.echo(E.Store(full, rows.select("id", "v"), edges), asked, F.lit(1_706_659_200)).results.collect()}
    assert abs(got.pop(200) - 0.85) < 1e-6
    assert got and set(got) <= set(range(51, 60))


def test_json_markdown_and_replayed_logs(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "content": "hello", "labels": ["x"], "parent_id": None}, {"id": 2, "content": "é", "echo_count": 3}]))
    rows = snapshots.read_json(spark, f"{tmp_path}/a.json")
    got = {r.id: r for r in rows.collect()}
    assert got[2].echo_count == 3 and got[1].echo_count == 0 and got[1].labels == ["x"] and got[2].confidence == 1.0
    snapshots.write_json(rows, f"{tmp_path}/out")
    assert {r.content for r in spark.read.json(f"{tmp_path}/out").collect()} == {"hello", "é"}
    log = [{"topic": "t", "msg_type": "Pose", "payload": json.dumps({"x": 1, "y": 2.555, "z": -3, "frame": "map"})}, {"topic": "t", "msg_type": "String", "payload": json.dumps({"data": "hi"})}, {"topic": "t", "msg_type": "String", "payload": "bare"}, {"topic": "t", "msg_type": "Image", "label": "a cat"}, {"topic": "t", "msg_type": "Audio"}]
    (tmp_path / "log.json").write_text(json.dumps(log))
    told = [r.content for r in snapshots.read_replay(spark, f"{tmp_path}/log.json").collect()]
    assert told[0].startswith("position: x=1.00 y=2.5") and told[0].endswith("z=-3.00 (frame: map)") and told[1:] == ["hi", "bare", "a cat", "[audio]"]


@pytest.mark.parametrize("bound", [0, 50_000])
def test_runs_of_words_are_never_broadcast(spark, monkeypatch, bound):
    from anamnesis.operators import memories

    texts = spark.createDataFrame([(i, f"the red kite {i} of Brand#1") for i in range(20)], "id bigint, content string")
    names = spark.createDataFrame([(f"e{i}", a) for i, a in enumerate(["red kite", "kite", "brand#1"] + [f"none {i}" for i in range(200)])], "entity_id string, alias string")
    monkeypatch.setattr(memories, "BROADCAST", bound, raising=False)
    got = memories.resolve(texts, names)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert ("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan) if bound == 0 else "BuildRight" in plan
    assert {(r.id, r.alias) for r in got.collect()} == {(i, "red kite") for i in range(20)}
