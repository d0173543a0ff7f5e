import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anamnesis.llm.packing import pack, pieces_of
from anamnesis.llm.token_store import ShardReader, read_tokens, write_tokens
from anamnesis.llm.tokens import Encoder, tokenizer_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {f: Encoder(tokenizer_file(f), 1) for f in FILES}
PLAIN = {f: Tokenizer.from_file(tokenizer_file(f)) for f in FILES}
for t in PLAIN.values():
    t.encode_special_tokens = True
TEXT = st.text(alphabet=st.sampled_from(" \n\t'sa.É́é1  ſK漢<|>"), max_size=24) | st.text(max_size=30)


def direct(name: str, text: str | None) -> list[int]:
    return [*PLAIN[name].encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_chunks_give_the_ids_of_the_whole_text(name, texts):
    assert [x.tolist() for x in ENCODERS[name].encode(texts)] == [direct(name, t) for t in texts]


ROWS = [(7, "One two  three\n\n end. "), (3, None), (None, "no id"), (3, "again, again"), (9, ""), (12, "long words " * 3000), (4, "a" * 9000), (5, "<|endoftext|> it's")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as start").repartition(3)


def test_packing_is_lossless_and_gapless(spark, docs):
    seqs = pack(docs, tokenizer_file(FILES[0]), size=256, windows=4, min_cut=8)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in seqs.collect()}
    pieces = pieces_of(seqs).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        cut = ids[p.sequence_id][p.offset : p.offset + p.length]
        assert zlib.crc32(cut.tobytes()) == p.ids_crc32 and len(cut) == p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, cut))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    want = sorted((str(d), direct(FILES[0], t)) for d, t in ROWS)
    got = sorted((str(d), np.concatenate([c for _, c in sorted(v, key=lambda x: x[0])]).tolist()) for (d, _), v in by_doc.items())
    assert got == want
    for s, v in by_seq.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == len(ids[s]) <= 256
    assert sum(256 - len(x) for x in ids.values()) < 256 + 8 * len(ids)
    assert pieces_of(pack(docs.limit(0), tokenizer_file(FILES[0]))).count() == 0


def test_token_store_round_trip(spark, docs):
    manifest = write_tokens(docs, tokenizer_file(FILES[1]), shards=3)
    got = read_tokens(manifest).orderBy("start").collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}  # equal ids are ordered by the hash of the text
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1] is not None, r[1] or ""))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(d, direct(FILES[1], t)) for d, t in order]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    few = read_tokens(manifest, [3, 12]).collect()
    assert sorted(r.doc_id for r in few) == [3, 3, 12]
    assert read_tokens(write_tokens(docs.limit(0), tokenizer_file(FILES[1]))).count() == 0


def test_damage_is_found(spark, docs):
    uri = write_tokens(docs, tokenizer_file(FILES[1]), shards=1).first().uri.removeprefix("file://")
    data = bytearray(open(uri, "rb").read())
    data[20] ^= 255
    open(uri, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  the codec or the checksum, whichever sees it first
        list(ShardReader(uri))


def test_whole_documents_and_a_small_memory(monkeypatch):
    import duckdb

    from anamnesis.llm import tokens

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 3000)
    monkeypatch.setattr(tokens, "_CHARS_AT_ONCE", 20_000)
    for name in FILES:
        assert [x.tolist() for x in Encoder(tokenizer_file(name), 1).encode(texts)] == [direct(name, t) for t in texts]


@pytest.mark.parametrize("end", [None, 1])
def test_counts_are_those_of_the_ids(end, monkeypatch):
    import duckdb

    from anamnesis.llm import tokens

    texts = [None, "", "a  b\n\n\nc", "x\x1fy", *[r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 3000)
    monkeypatch.setattr(tokens, "_CHARS_AT_ONCE", 20_000)
    for name in FILES:
        e = Encoder(tokenizer_file(name), end)
        assert e.count(texts) == [len(direct(name, t)) - (end is None) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_chunks_that_are_met_again_are_not_forgotten(name, monkeypatch):
    from anamnesis.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 30)
    e, learned = Encoder(tokenizer_file(name), None), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda chunks: learned.extend(chunks) or learn(chunks))
    for i in range(8):
        text = "the same words " + " ".join(f"new{chr(97 + i)}{chr(97 + j)}x" for j in range(9))
        assert e.encode([text])[0].tolist() == direct(name, text)[:-1]
    assert learned.count("same") == 1
