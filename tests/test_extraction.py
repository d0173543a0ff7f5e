from pyspark.sql import functions as F

from anamnesis import config
from anamnesis.functions import extraction as E
from anamnesis.operators import context


def test_subjects():
    cases = [("Mia", "Mia works at Globex", "Mia"), ("the user", "The user switched from Vim to Helix", "Helix"), ("I", "I started at Globex Labs, then left", "Globex Labs"), ("user", "today Nora left early", "Nora"), ("it", "it is cold", "it"), ("they", "they like the cello", "they")]
    for subject, fact, want in cases:
        assert E.repaired_subject(subject, fact) == want


def test_json_and_facts():
    assert E.repaired_json('[{"text": "a b"}, {"text": "c') == '[{"text": "a b"}]'
    assert E.repaired_json('{"facts": ["one, two", "thr') == '{"facts": ["one, two"]}'
    assert E.repaired_json("nothing") is None and E.repaired_json(None) is None and E.repaired_json("[1]") == "[1]"
    assert E.parsed_facts('Here: {"facts": [{"text": "Mia likes tea", "subject": "Mia"}, "short", "a plain fact"]}') == [{"text": "Mia likes tea", "subject": "Mia"}, {"text": "a plain fact", "subject": None}]
    assert [x["text"] for x in E.parsed_facts("- first fact\n* second fact\nno")] == ["first fact", "second fact"]
    assert len(E.parsed_facts('["fact one", "fact two", "fact three", "fact f', 4)) == 2


def test_on_columns(spark):
    rows = spark.createDataFrame([("the user", "She moved to Bergen", '["a fact here", "an', '{"data": [{"id": "m1"}]}'), (None, None, None, '{"models": [{"name": "m2"}]}')], "s string, f string, j string, b string")
    got = rows.select(E.repair_subject("s", "f").alias("s"), E.repair_json("j").alias("j"), F.size(E.parse_facts("j")).alias("n"), F.array_join(E.model_names(F.col("b")), ",").alias("m")).collect()
    assert [(r.s, r.j, r.n, r.m) for r in got] == [("Bergen", '["a fact here"]', 1, "m1"), (None, None, 0, "m2")]


def test_assembly_and_config(spark, tmp_path):
    parts = spark.createDataFrame([(1, "system", 0, 50), (1, "rag", 0, 30), (1, "rag", 1, 30), (1, "conversation", 0, 20), (1, "conversation", 1, 20), (1, "query", 9, 10)], "prompt_id int, kind string, place int, tokens int")
    keep = lambda b: sorted((r.kind, r.place) for r in context.assembled(parts, F.lit(b)).collect() if r.kind in ("rag", "conversation"))
    assert keep(160) == [("conversation", 0), ("conversation", 1), ("rag", 0), ("rag", 1)]
    assert keep(145) == [("conversation", 1), ("rag", 0), ("rag", 1)] and keep(100) == [("rag", 0)] and keep(10) == []
    (tmp_path / "c.toml").write_text("max_results = 3\npower_law = false\nother = 1\n")
    c = config.loaded(str(tmp_path / "c.toml"), {"ANAMNESIS_MAX_RESULTS": "4"})
    assert (c.max_results, c.power_law, c.rrf_k) == (4, False, 60)
