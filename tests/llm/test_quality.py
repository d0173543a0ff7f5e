import random
from collections import Counter

import duckdb

from anamnesis.llm import quality as Q

ROWS = [
    (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \n\t "), (5, "a b c d e a b c d e a b c d e"), (5, "a b c d e a b c d e a b c d e"),
    (6, "same line here\nsame line here\nother line of more words than ten in all\n\n"), (7, "# $ % & words | < > and * more words to be kept here now"),
    (None, "x " * 20000), (8, " ".join(f"w{i}" for i in range(20000))), (9, "y" * 300), (10, "É\u00a0é\u2003 z"), (11, "a\x0bb\x0cc\rd\te f g h i j k"), (12, "one two three four five six seven eight nine"),
]


def plain(text):
    """The measurements by their definition, window by window."""
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] if now else words, ""
        else:
            now += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(places))


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'s' as n_words", "1 as fail_bits", "doc_id as row", "2 as n_lines_").repartition(3)


def test_measurements_by_definition(spark):
    assert all(Q.measure(t) == plain(t) for _, t in ROWS if t is None or len(t) < 50_000)
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", " ", "\n", "a b ", "#", "é"]) for _ in range(r.randint(0, 120)))
        assert Q.measure(t) == plain(t)
    got = Counter((x.doc_id, *(x[m] for m in Q.MEASURES)) for x in Q.ledger(table(spark)).collect())
    assert got == Counter((i, *Q.measure(t)) for i, t in ROWS)


def test_policies_and_ablations_read_the_written_bits_only(spark, tmp_path):
    docs = table(spark)
    Q.row_ledger(docs).write.parquet(f"{tmp_path}/ledger")
    led = spark.read.parquet(f"{tmp_path}/ledger")
    strict = Q.Policy("strict-2", ("few_words", "symbol_density", "long_words"))
    fails = {r.name: [i for i, (_, t) in enumerate(ROWS) if eval(r.fails, {}, dict(zip(Q.MEASURES, plain(t), strict=True)))] for r in Q.RULES}
    for policy in (Q.BASE, Q.DEFAULT, strict):
        gone = {i for name in policy.rules for i in fails[name]}
        told = Q.verdicts(led, policy)
        assert Counter(x.row.doc_id for x in told.where("kept").collect()) == Counter(d for i, (d, _) in enumerate(ROWS) if i not in gone)
        assert {x.policy_version for x in told.collect()} == {policy.version}
        ablated = Q.ablation(led, policy)
        scan = ablated._jdf.queryExecution().toString().split("ReadSchema")[-1]
        assert "fail_bits" in scan and "text" not in scan
        for x in ablated.collect():
            only = [i for i in fails[x.rule] if not any(i in fails[n] for n in policy.rules if n != x.rule)]
            assert (x.n_failed, x.n_only, x.n_removed, x.n_removed_without, x.n_rows) == (len(fails[x.rule]), len(only), len(gone), len(gone) - len(only), len(ROWS))
        assert {x.rule for x in ablated.collect()} == set(policy.rules)
        kept = Q.keep_good(docs, policy)
        assert kept.columns == docs.columns and Counter((x.doc_id, x.text, x.row) for x in kept.collect()) == Counter((d, t, d) for i, (d, t) in enumerate(ROWS) if i not in gone)


def test_ablation_equals_sql(spark):
    led = Q.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = duckdb.connect()
    rows.register("led", led.toPandas())
    one = rows.execute("SELECT count(*), count(*) FILTER (fail_bits <> 0) FROM led").fetchone()
    for x in Q.ablation(led).collect():
        bit = {r.name: r.mask for r in Q.RULES}[x.rule]
        failed, only = rows.execute(f"SELECT count(*) FILTER (fail_bits & {bit} <> 0), count(*) FILTER (fail_bits = {bit}) FROM led").fetchone()
        assert (x.n_failed, x.n_only, x.n_removed, x.n_rows) == (failed, only, one[1], one[0])
    total = Q.union_of_failures(led).first()
    assert (total.any_bits, total.all_bits, total.n_rows) == rows.execute("SELECT bit_or(fail_bits), bit_and(fail_bits), count(*) FROM led").fetchone()


def test_empty_tables(spark):
    docs = table(spark).limit(0)
    assert Q.ledger(docs).count() == 0 and Q.keep_good(docs).count() == 0
    assert {x.n_rows for x in Q.ablation(Q.ledger(docs)).collect()} == {0}
