import re
import zlib

import duckdb
import numpy as np
from test_quality import plain as measures
from test_secrets import plain as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline
from anamnesis.llm.tokens import tokenizer_file

SF = "/root/testdata/sf0.001"


#: The rules of the default policy, by name of measurement.
FAILS = (lambda n, w, s, x, d, r: n < 10, lambda n, w, s, x, d, r: 100 * r > 20 * n, lambda n, w, s, x, d, r: 10 * s > n, lambda n, w, s, x, d, r: 2 * d > x, lambda n, w, s, x, d, r: w < 2 * n, lambda n, w, s, x, d, r: w > 25 * n)


def words(text: str) -> list[str]:
    """Words of a text in folded case and without marks."""
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c for c in text.casefold() if c not in ".,;:!?\"'()[]{}*#&%$|<>")) if w]


def without_secrets(text: str) -> str:
    out, at = "", 0
    for kind, s, e in secret_spans(text):
        if s >= at:
            out += text[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + text[at:]


def plain() -> dict[int, np.ndarray]:
    """doc_id -> ids of what is packed, one step after the other over lists, by rules written here and in the other tests."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = [(i, t) for i, t in rows if not any(f(*measures(t)) for f in FAILS)]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i, _ in rows}
    while True:
        old = dict(label)
        for a in label:
            for b in label:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = [words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]

    def leaks(t):
        w = words(t)
        return any(w[k : k + len(x)] == x for x in items for k in range(len(w) - len(x) + 1))

    rows = [(i, t) for i, t in rows if not leaks(t)]
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return {i: np.array([*tok.encode(without_secrets(t), add_special_tokens=False).ids, 1], "<u4") for i, t in rows}


def test_stages_equal_a_plain_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_masking", "packing"]
    want = plain()
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and zlib.crc32(want[i][at : at + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(want[i])
            at += p.length
        assert at == len(want[i])


def test_stages_bear_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "word " * 5, "en", "s", 25), (3, "word " * 5, "en", "s", 25), (4, " ".join(f"w{i}" for i in range(9000)) + " token = abcdef1234", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0), docs.selectExpr("*", "1 as n", "2 as component_id", "'x' as _row", "doc_id as _h", "text as row", "3 as n_words", "'y' as masked", "false as clean", "4 as key")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
    kept = corpus_pipeline.secret_masking(spark, docs, SF).where("doc_id = 4").first()
    assert kept.text.endswith("[assign]") and kept.n_chars == len(kept.text)
