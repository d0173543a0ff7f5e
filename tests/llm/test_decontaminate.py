import math
import random
from collections import Counter

from anamnesis.llm import decontaminate as D

random.seed(3)
WORDS = ["the", "of", "and", "in"] * 6 + [f"w{i}" for i in range(300)]


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(i, f"{sentence(random.randint(4, 30))} {sentence(random.randint(2, 12))}") for i in range(90)] + [(90, "Single short one."), (91, ""), (92, None), (7, sentence(12))]


def brute(words, index):
    """Scores of all items for all windows from the definition."""
    out = {}
    for a in range(0, max(1, len(words)), index.longest):
        held = set(words[a : a + 2 * index.longest])
        for k in range(len(index.items)):
            s = math.fsum(p.weights[p.items.index(k)] for t, p in index.lists.items() if t in held and k in p.items)
            if s >= index.threshold:
                out.setdefault(k, []).append((a, s))
    return out


def test_wand_retrieves_all_above_the_threshold(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    [indexes] = D.build_indexes(items, threshold=0.3)
    assert sum(len(x.items) for x in indexes) == 92
    for index in indexes:
        for _ in range(40):
            k = random.randrange(len(index.items))
            base = index.items[k][1] + index.items[k][2]
            words = D.words_of(sentence(random.randint(0, 90))) + base[: random.randint(1, len(base))] + D.words_of(sentence(random.randint(1, 60)))
            for a in range(0, len(words), index.longest):
                part = set(words[a : a + 2 * index.longest])
                want = {i: round(s, 9) for i, x in brute(words, index).items() for b, s in x if b == a}
                assert {i: round(s, 9) for i, s in index.retrieve(part)} == want
            kept = {a for a, _ in index.passages(words)}
            assert {a for x in brute(words, index).values() for a, _ in x} <= kept


def test_matches_and_removal(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = lambda n: " ".join(f"x{random.randint(0, 999)}" for _ in range(n))
    rows = [(1, f"{filler(500)} {ITEMS[3][1]} {filler(40)}"), (2, filler(50)), (3, None), (4, ""), (None, ITEMS[5][1].upper()), (6, filler(9) + " " + ITEMS[8][1].replace(" ", "\n")), (2, filler(70)), (8, " ".join(ITEMS[9][1].split()[:3]) + filler(30)), (9, filler(30_000) + " " + ITEMS[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as item_id", "'k' as score")
    want = {(1, 3), (None, 5), (6, 8), (9, 0)}
    for block in (1000, 40):
        got = D.find_matches(docs, items, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.score > 0.99 and r.question_overlap == 1 for r in got)
        left = D.remove_contaminated(docs, items, block=block)
        assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter([2, 3, 4, 2, 8])
    assert D.find_matches(docs.limit(0), items).count() == 0
    assert D.find_matches(docs, items.limit(0)).count() == 0
    assert D.remove_contaminated(docs, items.limit(0)).count() == len(rows)


def test_capitals_beyond_ascii_match(spark):
    item = "La canción de la niña se oyó allí, según Íñigo, en la estación más fría. El año próximo será más cálido."
    german = "Die Straße führt größtenteils über weiße Flüsse und heiße Äcker. Der süße Gruß ließ mich außen stehen."
    items = spark.createDataFrame([(0, item), (1, german), (2, "Another item of quite other words. It has an answer.")], "item_id long, text string")
    texts = [item.upper(), "x y z " + german.upper() + " x", item, german, "nada de eso"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = D.find_matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert all(r.score > 0.99 and r.question_overlap == 1 and r.answer_overlap == 1 for r in got)
    assert [r.doc_id for r in D.remove_contaminated(docs, items).collect()] == [4]
