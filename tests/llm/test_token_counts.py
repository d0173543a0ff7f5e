import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anamnesis.llm import token_counts as C
from anamnesis.llm.common import shared_dir
from anamnesis.llm.tokens import tokenizer_file

COLS = "change string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def test_ledger_equals_a_plain_store(spark):
    ledger = C.Ledger(spark, shared_dir(spark, "ledger-test"))
    batches = {
        "a": [("insert", 1, "s", "en", "v", 10), ("insert", 2, "s", None, "v", 5), ("insert", 2, "s", None, "w", 6), ("insert", None, None, None, "v", 1), ("insert", 9, "t", "en", "v", 3), ("insert", 9, "t", "en", "v", 3)],
        "b": [("revise", 1, "s2", "en", "v", 12), ("delete", 2, None, None, "w", None), ("delete", 77, None, None, "v", None), ("revise", 5, "n", "fr", "v", 8)],
        "c": [],
        "d": [("insert", 1, "s2", "en", "v", 13), ("delete", None, None, None, "v", None), ("delete", 9, None, None, "v", None)],
    }
    plain: dict = defaultdict(list)
    for name, rows in batches.items():
        for kind, doc, source, lang, version, n in rows:
            plain[doc, version] = []
        for kind, doc, source, lang, version, n in rows:
            if kind != "delete":
                plain[doc, version].append((source, lang, version, n))
        df = spark.createDataFrame(rows, COLS).withColumn("extra", F.lit(1))
        assert ledger.commit(name, df) and not ledger.commit(name, df)
        want: Counter = Counter()
        for held in plain.values():
            for s, g, v, n in held:
                want[s, g, v, "docs"] += 1
                want[s, g, v, "tokens"] += n
        got = {}
        for r in ledger.totals().collect():
            got[r.source, r.lang, r.tokenizer_version, "docs"], got[r.source, r.lang, r.tokenizer_version, "tokens"] = r.n_docs, r.n_tokens
        assert got == dict(want)
    assert ledger.batches() == ["a", "b", "c", "d"]


def totals(ledger) -> dict:
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def test_an_unfinished_batch_is_not_seen(spark):
    ledger = C.Ledger(spark, shared_dir(spark, "ledger-test"))
    spark.createDataFrame([("s", "en", "v", 1, 1)], C._SUMS).write.parquet(f"{ledger.path}/data/late-1/sums")
    assert ledger.batches() == [] and ledger.totals().count() == 0


def test_a_batch_that_comes_second_sees_the_first(spark):
    """Two writers start from the same log; the second one's work is done anew, so nothing is taken back twice."""
    path = shared_dir(spark, "ledger-test")
    one, two = C.Ledger(spark, path), C.Ledger(spark, path)
    row = lambda kind, n: spark.createDataFrame([(kind, 1, "s", "en", "v", n)], COLS)
    assert one.commit("load", row("insert", 10))
    real, met = one._publish, []

    def late(number, entry):
        if not met:
            met.append(two.commit("other", row("revise", 20)))
        return real(number, entry)

    one._publish = late
    assert one.commit("mine", row("revise", 30)) and met == [True]
    assert totals(one) == totals(two) == {("s", "en", "v"): (1, 30)}
    assert one.batches() == ["load", "mine", "other"] and not two.commit("mine", row("revise", 99))


def test_compaction_changes_nothing(spark):
    ledger = C.Ledger(spark, shared_dir(spark, "ledger-test"))
    rows = lambda kind, *n: spark.createDataFrame([(kind, i, "s", None, "v", x) for i, x in enumerate(n)], COLS)
    assert ledger.compact() and ledger.commit("a", rows("insert", 1, 2, 3)) and ledger.commit("b", rows("delete", 0))
    before = totals(ledger)
    assert ledger.compact() and totals(ledger) == before == {("s", None, "v"): (2, 5)}
    assert not ledger.commit("a", rows("insert", 9)) and ledger.contributions().count() == 2
    assert ledger.commit("c", rows("revise", 7, 7)) and totals(ledger) == {("s", None, "v"): (3, 17)}


def test_registered_query_by_brute_force(spark, tmp_path):
    """Totals of a small table under both tokenizers, the revised one with end ids, exact copies gone."""
    r = random.Random(3)
    words = ["one", "über", "data", "12", "***", "naïve", "\n", "x" * 40]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[1], texts[0], None, "", None, "word " * 20000]
    rows = [(i, t, r.choice(["en", None]), r.choice(["s", "t"]), i) for i, t in enumerate(texts)]
    rows = [rows[k] for k in r.sample(range(len(rows)), len(rows))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    want: Counter = Counter()
    first: dict = {}
    for i, t, *_ in sorted(rows):
        first.setdefault(t or "", i)
    for version, file in C.VERSIONS.items():
        tok = Tokenizer.from_file(tokenizer_file(file))
        tok.encode_special_tokens = True
        for i, t, lang, source, _ in rows:
            if first[t or ""] == i:
                want[source, lang, version, "docs"] += 1
                want[source, lang, version, "tokens"] += len(tok.encode(t or "", add_special_tokens=False).ids) + (version == "word_bpe_49k")
    got = {}
    for x in C.op8_token_counts(spark, f"file://{tmp_path}").collect():
        got[x.source, x.lang, x.tokenizer_version, "docs"], got[x.source, x.lang, x.tokenizer_version, "tokens"] = x.n_docs, x.n_tokens
    assert got == dict(want)


def test_counts(spark):
    rows = [(1, "One two,  three\n", "s", "en"), (2, None, "s", None), (None, "", None, "en"), (4, "*** é2 *", "s", "fr"), (5, "word " * 20000, "s", "en"), (5, "word", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "0 as n_tokens", "'x' as tokenizer_version")
    assert C.counts(docs, "v", F.octet_length("text").cast("long")).where("doc_id = 4").first().n_tokens == 9
    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = Counter((x.doc_id, x.source, x.lang, x.tokenizer_version, x.n_tokens) for x in C.bpe_counts(docs, {"v": path}).collect())
    assert got == Counter((d, s, g, "v", len(tok.encode(t or "").ids)) for d, t, s, g in rows)
    assert C.bpe_counts(docs.limit(0), {"v": path}).count() == 0
