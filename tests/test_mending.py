"""Merges, vectors of mixed lengths, masking, aliases, breakers, legacy files, sounds, the maintenance pass and the ranked query's rules."""

import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.config import DEFAULT, model_dim
from anamnesis.functions import audio, rules
from anamnesis.functions import text as X
from anamnesis.operators import consolidate, graph, memories, multimodal, routing, vectors, views
from anamnesis.plans import echo as E
from anamnesis.sources import legacy


def test_merging_chains_keeps_all_counts(spark):
    r = random.Random(1)
    for n in (3, 40):
        rows = [(i, float(r.randint(0, 3)) if n > 3 else float(-i), i + 1) for i in range(1, n + 1)]
        pairs = [(1, 2, 0.9), (2, 3, 0.9)] if n == 3 else [(i, j, 0.9) for i, j in (sorted(r.sample(range(1, n + 1), 2)) for _ in range(30))]
        out = consolidate.merge_duplicates(spark.createDataFrame(rows, "id long, importance double, echo_count long"), spark.createDataFrame(pairs, "a long, b long, sim double")).collect()
        assert sum(x.echo_count for x in out) == sum(c for *_, c in rows)
        beats = {i: (-imp, i) for i, imp, _ in rows}
        lost: dict = {}
        for a, b, _ in pairs:
            win, lose = sorted((a, b), key=beats.get)
            lost[lose] = min(lost.get(lose, win), win, key=beats.get)
        want = {i: c for i, _, c in rows if i not in lost}
        for i, _, c in rows:
            to = i
            while to in lost:
                to = lost[to]
            if to != i:
                want[to] += c
        assert {x.id: x.echo_count for x in out} == want
    assert n == 40 and len(lost) > 10


def test_vectors_of_mixed_lengths_do_not_depend_on_partitions(spark):
    data = [(1, [1.0, 0.1]), (2, [1.0]), (3, [0.5]), (4, [1.0, 0.0]), (5, [-1.0])]
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [2.0])], "query_id long, v array<float>")
    for parts in (1, 5):
        rows = spark.createDataFrame(data, "id long, v array<float>").repartition(parts)
        assert {(r.query_id, r.id) for r in vectors.knn(rows, asked, 5, 0.5).collect()} == {(9, 1), (9, 4), (8, 2), (8, 3)}
        assert {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.5, block=2).collect()} == {(1, 4), (2, 3)}
        assert {r.id: round(r.novelty, 2) for r in vectors.novelty(rows, block=2).collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}


def leftmost(text: str) -> list[tuple]:
    out, at = [], 0
    while True:
        hits = [(m.start(), k, m) for k, (p, _) in enumerate(rules.PII_PATTERNS) if (m := re.compile(p, re.ASCII).search(text, at))]
        if not hits:
            return out
        start, k, m = min(hits, key=lambda h: h[:2])
        out.append((rules.PII_PATTERNS[k][1], start, m.end()))
        at = m.end()


def test_masking_is_leftmost_first(spark):
    r = random.Random(4)
    bits = ["sk-" + "a" * 22, "a.", "@x.org", " ", "1234", "-", "555-123-4567", "123-45-6789", "password: ", "pwd=x", "hunter2", "4111 1111 1111 1111", "AKIA" + "B" * 16, "\n", "ghp_" + "c" * 36, "plain", "."]
    texts = ["a.sk-" + "b" * 24 + "@x.org", "password: 4111 1111 1111 1111", ""] + ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for x in rows.select("id", X.pii_mask(F.col("t")).alias("m"), X.pii_matches(F.col("t")).alias("s")).collect():
        spans, out, at = leftmost(texts[x.id]), "", 0
        assert [(s.kind, s.start, s.end) for s in x.s] == spans, texts[x.id]
        for kind, s, e in spans:
            out, at = out + texts[x.id][at:s] + f"[MASKED:{kind}]", e
        assert x.m == out + texts[x.id][at:]
    assert rows.limit(1).select(X.pii_mask(F.lit(None).cast("string")).alias("m")).first().m is None


def test_aliases_of_any_length_and_marks(spark):
    names = memories.aliases(spark.createDataFrame([("e1", "The Long House of Seven Very Old Gables", None), ("e2", "O'Brien & Sons", ["C++ club"]), ("e3", "house", [" "])], "entity_id string, canonical_name string, aliases array<string>"))
    texts = spark.createDataFrame([(1, "in the long house of seven very old gables, we"), (2, "ask o'brien & sons."), (3, "o brien sons"), (4, "the C++ club"), (5, "housed"), (6, "HOUSE"), (7, None)], "id long, content string")
    assert {r.id: r.entity_id for r in memories.resolve(texts, names).collect()} == {1: "e1", 2: "e2", 4: "e2", 6: "e3"}
    more = memories.with_aliases(spark.createDataFrame([("e1", "A", ["b"]), ("e2", "C", None)], "entity_id string, canonical_name string, aliases array<string>"), spark.createDataFrame([("e1", " B "), ("e1", "New"), ("e2", "c")], "entity_id string, alias string"))
    assert {r.entity_id: r.aliases for r in more.collect()} == {"e1": ["b", "new"], "e2": []}


def made_file(rows: list[dict], text: np.ndarray, seen: dict[int, list], version: int) -> bytes:
    told = json.dumps(rows).encode()
    raw = text.astype("<f4").tobytes()
    if version == 1:
        head = b"SHRM" + struct.pack("<IIIQQI", 1, text.shape[1], 0, len(rows), 64 + len(raw), zlib.crc32(raw))
        return head.ljust(64, b"\0") + raw + told
    head = b"SHRM" + struct.pack("<BBHHHI", 2, 1, text.shape[1], 3, 0, len(rows))
    bits = np.packbits([i in seen for i in range(len(rows))], bitorder="little").tobytes()
    some = bits + np.array([seen[i] for i in sorted(seen)], "<f4").tobytes()
    crc = lambda b: struct.pack("<I", zlib.crc32(b))
    return head + struct.pack("<I", len(told)) + told + crc(head + told) + raw + crc(raw) + some + crc(some)


def test_legacy_files(spark, tmp_path):
    rows = [{"id": f"u{i}", "content": f"text {i}", "source": "cli", "created_at": "2024-01-01T00:00:00Z", "parent_id": "u0" if i == 2 else None, "labels": ["a"], "new_field": 1} for i in range(11)]
    text = np.arange(44, dtype=np.float32).reshape(11, 4)
    seen = {1: [1.0, 2.0, 3.0], 9: [4.0, 5.0, 6.0]}
    one, two = made_file(rows, text, {}, 1), made_file(rows, text, seen, 2)
    assert legacy.problem(one) is None and legacy.problem(two) is None
    for data in (one, two):  # every cut and every flipped byte of what a checksum covers is seen
        assert all(legacy.problem(data[:n]) for n in range(0, len(data) - 1, 7))
        start = 64 if data is one else 0
        for at in range(start, start + 44 * 4 if data is one else len(data), 5):
            bad = bytearray(data)
            bad[at] ^= 0x40
            assert legacy.problem(bytes(bad)), at
    assert legacy.problem(b"SHRM\x07" + bytes(60)) and legacy.problem(b"nope")
    (tmp_path / "a.bin").write_bytes(two)
    (tmp_path / "b.json").write_text(json.dumps([{**r, "embedding": v.tolist()} for r, v in zip(rows, text, strict=True)]))
    got = {r.place: r for r in legacy.load(spark, f"{tmp_path}/a.bin").collect()}
    assert len(got) == 11 and got[9].vision_v == [4.0, 5.0, 6.0] and got[0].vision_v is None and got[3].text_v == text[3].tolist()
    beside = legacy.load(spark, f"{tmp_path}/b.bin")
    assert {r.place: r.text_v for r in beside.collect()} == {i: v.tolist() for i, v in enumerate(text)}
    assert legacy.load(spark, f"{tmp_path}/none.bin").count() == 0
    table = {r.id: r for r in legacy.memories_of(beside).collect()}
    assert table[2].parent_id == 0 and table[1].parent_id is None and table[5].content == "text 5" and table[5].created_at is not None and table[5].confidence == 1.0
    (tmp_path / "c.bin").write_bytes(two[:-3])
    told = {r.path.rsplit("/", 1)[1]: (r.layout, r.problem) for r in legacy.checked(spark, f"{tmp_path}").collect()}
    assert told["a.bin"] == ("binary", None) and told["b.json"] == ("json", None) and told["c.bin"][1]


def test_sound_features_by_definition():
    r = np.random.default_rng(0)
    pcm = r.standard_normal(1000).astype(np.float32)
    frame = pcm[160:560] * [0.5 * (1 - math.cos(2 * math.pi * i / 399)) for i in range(400)]
    power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(400) / 400))) ** 2 for k in range(201)]
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    at = [int((401 * 700 * (10 ** (mel(8000) * i / 81 / 2595) - 1)) / 16000) for i in range(82)]
    want = []
    for m in range(80):
        a, b, c = at[m : m + 3]
        s = sum((k - a) / (b - a) * power[k] for k in range(a, b)) + sum((c - k) / (c - b) * power[k] for k in range(b, min(c, 201)))
        want.append(math.log10(max(s, 1e-10)))
    bank = audio.filter_bank(pcm)
    assert bank.shape == (4, 80) and np.allclose(bank[1], want, atol=1e-4)
    assert audio.filter_bank(pcm[:10]).shape == (1, 80)
    whole = audio.log_mel(pcm)
    assert whole.shape == (80, 3000) and abs(whole.max() - whole.min() - 1.0) < 1e-5
    assert np.allclose(audio.resampled(np.array([0.0, 1.0, 2.0]), 8000), [0, 0.5, 1, 1.5, 2, 2]) and len(audio.resampled(np.zeros(0), 8000)) == 0
    v = audio.speech_vector(r.standard_normal((1, 300)), r.standard_normal((1, 7, 384)))
    assert len(v) == 640 and abs(np.linalg.norm(v) - math.sqrt(2)) < 1e-5 and not audio.unit(np.zeros(3)).any()


def test_images_and_sounds_as_memories(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    look = lambda images: np.array([[len(i), 1.0] for i in images])
    images = spark.createDataFrame([(1, bytearray(b"x" * 5), "cam", "I prefer tea"), (2, bytearray(b"y"), "cam", None), (3, bytearray(), "cam", "empty"), (4, None, "cam", "none")], "id long, image binary, source string, description string")
    rows, v = multimodal.stored_images(images, now, look)
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {1, 2} and got[2].content == "[image]" and got[1].labels[0] == "memtype:image" and got[1].category == "Preference" and got[1].modality == "vision"
    assert {r.id: r.v for r in v.collect()} == {1: [5.0, 1.0], 2: [1.0, 1.0]}
    sounds = spark.createDataFrame([(5, [0.1] * 900, 8000, "mic", None), (6, [], 8000, "mic", None)], "id long, pcm array<float>, rate int, source string, description string")
    heard, hv = multimodal.stored_sounds(sounds, now)
    assert [r.content for r in heard.collect()] == ["[audio]"] and len(hv.first().v) == 160
    both = images.select("id", F.lit("hello").alias("content"), "source", "image").withColumns({"pcm": F.when(F.col("id") == 1, F.array(F.lit(0.5).cast("float"))), "rate": F.lit(16000)})
    rows, v = multimodal.stored_together(both, now, look)
    assert {r.id: r.labels for r in rows.collect()}[1] == ["memtype:image", "memtype:audio"] and sorted((r.id, r.modality) for r in v.collect()) == [(1, "speech"), (1, "vision"), (2, "vision")]
    asked = spark.createDataFrame([(7, [5.0, 1.0])], "query_id long, v array<float>")
    stored = got_rows = multimodal.stored_images(images, now, look)
    seen = multimodal.vision_answers(stored[0], got_rows[1], asked, F.lit(1704067200 + 86400)).collect()
    want = {1: (1.0 + 0.05 / 2) * 0.5 ** (1 / 60), 2: (6 / math.sqrt(52) + 0.05 / 2) * 0.5 ** (1 / 3)}
    assert [r.id for r in seen] == [1, 2] and all(abs(r.score - want[r.id]) < 1e-6 for r in seen)
    texts = spark.createDataFrame([(7, 1, 0.2), (7, 3, 0.95)], "query_id long, id long, score double")
    images_ = spark.createDataFrame([(7, 1, 0.9)], "query_id long, id long, score double")
    assert [(r.id, r.score) for r in multimodal.answers("auto", texts, images_).orderBy("rank").collect()] == [(3, 0.95), (1, 0.9)]
    assert multimodal.answers("vision", texts, images_).count() == 1


def unit(*x):
    return (np.array(x) / np.linalg.norm(x)).tolist()


def test_a_pass_of_maintenance(spark):
    texts = [(1, "Mia lives in Oslo. It is cold there", "cli"), (2, "Mia moved to Bergen last year", "cli"), (3, "Sam prefers oat milk", "cli"), (4, "Sam prefers oat milk", "cli"), (9, "no facts in here", "cli")]
    df = spark.createDataFrame(texts, "id long, content string, source string")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    rows = memories.stored(df, when).withColumns({"importance": F.when(F.col("id") == 4, 0.9).otherwise(0.1), "novelty_score": F.lit(0.5), "importance_computed_at": F.lit(None).cast("timestamp"), "last_echoed": F.lit(None).cast("timestamp"), "superseded_at": F.lit(None).cast("timestamp"), "echo_count": F.lit(2), "parent_id": F.lit(None).cast("bigint"), "subject": F.lit(None).cast("string")})
    rows = rows.withColumn("triples", F.lit(None).cast("array<struct<subject:string,predicate:string,object:string>>"))
    vecs = spark.createDataFrame([(1, unit(1, 0, 0)), (2, unit(0, 1, 0)), (3, unit(0, 0, 1)), (4, unit(0, 0.01, 1))], "id long, v array<float>")
    edges = spark.createDataFrame([(1, 2, 0.5, None, None, None, None), (1, 3, 0.001, None, None, None, None), (1, 5, 0.2, "lives_in", "Oslo", None, None)], "src long, dst long, weight double, kind string, value string, valid_from double, valid_until double")
    tables = {"memories": rows, "vectors": vecs, "edges": edges, "summaries": spark.createDataFrame([], "label string, member_count long")}
    out, counts = consolidate.consolidated(tables, F.lit(1_700_000_000 + 40 * 86400))
    c = counts.first()
    assert (c.edges_pruned, c.duplicates_merged, c.counts_decayed, c.importance_updated) == (1, 1, 4, 4)
    assert (c.facts_extracted, c.children_added, c.children_revised, c.texts_enriched) == (3, 3, 0, 3)
    got = {r.id: r for r in out["memories"].collect()}
    assert 3 not in got and got[4].echo_count == 3 and got[9].enrichment_attempts == 1 and not got[9].enriched and got[4].enriched
    kids = {r.content: r for r in got.values() if r.parent_id is not None}
    assert {k.subject for k in kids.values()} == {"Mia", "Sam"} and all(k.source == "enrichment" and k.id > 9 for k in kids.values())
    assert c.facts_superseded == 0  # both facts are new in this pass: it compares them with older ones only
    again, counts = consolidate.consolidated({**out, "summaries": tables["summaries"]} | {"memories": out["memories"].withColumn("importance", F.lit(0.5))}, F.lit(1_700_000_000 + 41 * 86400))
    c = counts.first()
    assert c.children_added == 0 and c.facts_extracted == 0 and again["memories"].count() == out["memories"].count()


def plain_store(spark, rows: list[dict], edges: list[tuple]) -> E.Store:
    """id, v, and whatever differs from an ordinary row."""
    base = {"content": "plain words", "source": "cli", "labels": [], "category": "Fact", "importance": 0.5, "created_at": 1_700_000_000, "last_echoed": None, "echo_count": 0, "enriched": False, "confidence": 1.0, "parent_id": None, "subject": None, "superseded_at": None}
    kinds = "id long, content string, source string, labels array<string>, category string, importance double, created_at long, last_echoed timestamp, echo_count int, enriched boolean, confidence double, parent_id long, subject string, superseded_at timestamp"
    names = [x.split()[0] for x in kinds.split(", ")]
    df = spark.createDataFrame([tuple(({**base, **r})[n] for n in names) for r in rows], kinds).withColumn("created_at", F.timestamp_seconds("created_at"))
    return E.Store(df, spark.createDataFrame([(r["id"], r["v"]) for r in rows], "id long, v array<float>"), spark.createDataFrame(edges, "src long, dst long, weight double, kind string, valid_from double, valid_until double"))


def at(sim: float, axis: int) -> list[float]:
    v = [0.0] * 12
    v[0], v[axis] = sim, math.sqrt(1 - sim * sim)
    return v


NOW = 1_700_000_000 + 86400
#: What a plain row of similarity s scores a day later: (s + importance) x decay + recency.
DECAY = (1 + 19 / 81 / (30 / 1.73)) ** -0.5
score = lambda s, boost=0.0: (s + boost + 0.25 * 0.5) * DECAY + 0.05 / 2


def test_the_ranked_query_by_hand(spark):
    """Rescue by a child, boosts of typed and superseding edges, a superseded child's parent, superseded and related rows."""
    rows = [
        {"id": 1, "v": at(0.9, 1)}, {"id": 2, "v": at(0.8, 2)}, {"id": 3, "v": at(0.7, 3)}, {"id": 4, "v": at(0.6, 4), "enriched": True},
        {"id": 5, "v": at(0.1, 5), "enriched": True}, {"id": 6, "v": at(0.85, 6), "parent_id": 5, "confidence": 0.8}, {"id": 7, "v": at(0.3, 7), "parent_id": 4}, {"id": 8, "v": at(0.05, 8)},
    ]
    edges = [(1, 2, 0.2, "part_of", None, None), (3, 2, 0.3, "supersedes", None, None), (8, 7, 0.3, "supersedes", None, None), (1, 3, 0.9, None, 0.0, 5.0)]
    store = plain_store(spark, rows, edges)
    asked = spark.createDataFrame([(50, "plain question", at(1.0, 1))], "query_id long, text string, v array<float>")
    out = E.echo(store, asked, F.lit(NOW), at_time=F.lit(10.0))
    sims = {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.6, 5: 0.68}
    co = {i: sum(math.sqrt(sims[i] * s) * 0.1 for j, s in sims.items() if j != i) for i in sims}
    cap = lambda x: min(x, 0.4)
    want = {
        1: score(0.9, cap(0.2 + 0.05 + co[1])), 2: score(0.8, cap(min(0.2 + 0.05 + 0.3, 0.4) + co[2])) * 0.6, 3: score(0.7, cap(min(0.3 + 0.1, 0.4) + co[3])),
        4: score(0.6, cap(co[4])) * 0.6, 5: score(0.68, cap(co[5])),
    }
    got = {r.id: r for r in out.results.collect()}
    # 3 supersedes 2, and at least three rows remain without it
    assert set(got) == {1, 3, 4, 5}
    for i in got:
        assert abs(got[i].score - min(want[i], sims[i] + 0.5)) < 1e-5, i
    assert [r.id for r in sorted(got.values(), key=lambda r: r["rank"])] == sorted(got, key=lambda i: -got[i].score)
    assert sorted(r.id for r in out.echo_events.collect()) == [1, 2, 3, 4, 5]
    events = {(r.src, r.dst): r.strength for r in out.edge_events.collect()}
    assert len(events) == 10 and all(abs(v - 0.1 * math.sqrt(sims[a] * sims[b])) < 1e-6 for (a, b), v in events.items())


def test_children_may_answer_and_rerankers_and_summaries(spark):
    rows = [{"id": 1, "v": at(0.2, 1)}, {"id": 2, "v": at(0.5, 2), "parent_id": 1, "content": "the child"}, {"id": 3, "v": at(0.4, 3)}]
    store = plain_store(spark, rows, [])
    asked = spark.createDataFrame([(50, "plain", at(1.0, 1)), (51, "plain", at(-1.0, 1))], "query_id long, text string, v array<float>")
    from dataclasses import replace

    ids = lambda out: [r.id for r in out.results.where("query_id = 50").orderBy("rank").collect()]
    assert ids(E.echo(store, asked, F.lit(NOW))) == [3, 1]
    assert ids(E.echo(store, asked, F.lit(NOW), replace(DEFAULT, rescue_only=False))) == [2, 3]  # the child is better than its parent
    first = lambda r: r.where("id = 1").select("query_id", "id", F.lit(1).alias("place"))
    assert ids(E.echo(store, asked, F.lit(NOW), rerank=first)) == [1, 3]
    summaries = spark.createDataFrame([("topic:x", "all about x", at(-0.9, 5)), ("topic:y", "y", at(0.3, 6))], "label string, summary string, v array<float>")
    told = {r.query_id: r for r in E.echo(store, asked, F.lit(NOW), summaries=summaries).results.where("source = 'community'").collect()}
    assert set(told) == {51} and told[51].content == "all about x" and told[51].id is None and abs(told[51].score - 0.9) < 1e-6
    tagged = plain_store(spark, [{**rows[0], "labels": ["a"]}, {**rows[2], "labels": ["b"]}], [])
    assert ids(E.echo(tagged, asked, F.lit(NOW), labels=["a"])) == [1]


def test_entities_of_queries(spark):
    names = spark.createDataFrame([("new york",), ("york",), ("q",), ("é",), ("rust",)], "name string")
    asked = spark.createDataFrame([(1, "New York, q and É or rusty"), (2, None), (3, "york")], "query_id long, text string")
    assert {(r.query_id, r.name) for r in E.query_entities(asked, names).collect()} == {(1, "new york"), (1, "york"), (1, "é"), (3, "york")}


def test_communities_and_edges(spark):
    cliques = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1), (14, 20, 0.1)]
    got = {r.id: r.community for r in views.communities(spark.createDataFrame(cliques, "src long, dst long, weight double")).collect()}
    assert {g: len({got[i] for i in range(g, g + 5)}) for g in (0, 10, 20)} == {0: 1, 10: 1, 20: 1} and len(set(got.values())) == 3
    edges = spark.createDataFrame([(1, 2, 0.5), (3, 1, 0.2)], "src long, dst long, weight double")
    assert graph.edge(edges, 1, 3).first().weight == 0.2 and graph.edge(edges, 2, 3).count() == 0


def test_providers(spark):
    m = spark.createDataFrame([(0, "a", False, True, "x"), (1, "b", True, True, "y"), (2, "c", False, False, "z")], "place int, provider string, is_local boolean, enabled boolean, model string")
    more = routing.with_provider(m, spark.createDataFrame([(0, "a", False, True, "x2"), (1, "a", False, True, "x3")], m.schema))
    assert [(r.provider, r.model) for r in more.orderBy("place").collect()] == [("b", "y"), ("c", "z"), ("a", "x2"), ("a", "x3")]
    assert [r.provider for r in routing.fallback_chain(m).orderBy("place").collect()] == ["b", "a"] and routing.without_provider(m, "a").count() == 2
    assert model_dim("BAAI/bge-small-en") == 384 and model_dim("text-embedding-3-large") == 3072 and model_dim("unknown") == DEFAULT.embedding_dim


def test_the_write_chain(spark):
    from anamnesis.operators.embedding import embedded, hashing_embedder

    texts = spark.createDataFrame([(1, "I prefer tea at the Harbour Cafe", "cli"), (2, "I prefer tea at the Harbour Cafe", "cli"), (3, "mail me at a@b.org", "cli")], "id long, content string, source string")
    known = spark.createDataFrame([(0, hashing_embedder(64)(["mail me at a@b.org"])[0].tolist())], "id long, v array<float>")
    names = spark.createDataFrame([("e1", "harbour cafe")], "entity_id string, alias string")
    rows, made = memories.store_chain(texts, F.lit("2024-01-01").cast("timestamp"), known, known, names, lambda d: embedded(d, "id", hashing_embedder(64), "content"))
    got = {r.id: r for r in rows.collect()}
    assert got[1].entity_id == "e1" and got[3].entity_id is None and got[3].masked_content == "mail me at [MASKED:email]"
    assert got[1].novelty_score > 0.3 and got[2].novelty_score < 1e-6 and got[3].novelty_score < 1e-6 and made.count() == 3
    from dataclasses import replace

    full = replace(DEFAULT, max_memories=10, max_bytes=100)
    assert memories.accepted(texts, 8, full).count() == 2 and memories.accepted(texts, 0, full, used_bytes=100).count() == 0
    assert memories.nearly_full(8, full) and memories.nearly_full(0, full, 80) and not memories.nearly_full(1, full, 1)


@pytest.mark.parametrize("ok,want", [
    ([(1.0, False), (2.0, False), (10.0, False), (13.0, True), (14.0, False), (20.0, True)], [("closed", "closed"), ("closed", "open"), ("half-open", "open"), ("open", "closed"), ("closed", "closed"), ("closed", "closed")]),
])
def test_breaker_stream(spark, tmp_path, ok, want):
    from anamnesis.streaming import twins

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"provider": "p", "ts": t, "ok": o}) for t, o in ok))
    calls = spark.readStream.schema("provider string, ts double, ok boolean").json(f"{tmp_path}/in")
    q = twins.breaker(calls, 2, 5.0).writeStream.format("memory").queryName("breaker_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.before, r.state) for r in spark.table("breaker_out").orderBy("ts").collect()] == want
    ran: list = []
    p = twins.periodic(spark.readStream.schema("provider string").json(f"{tmp_path}/in"), ran.append, f"{tmp_path}/c2", available_now=True)
    p.awaitTermination()
    assert ran == [0]
