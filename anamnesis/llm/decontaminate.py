"""Benchmark decontamination by BM25 with block-max WAND over test items (operator 10).

The index holds the test items; every passage of every training document is a query. A posting's weight
is the item's BM25 impact divided by the item's score against itself, so that a passage that holds the
whole item scores 1 and one threshold serves items of any length. All items above the threshold are
retrieved and then verified: enough of the question's word triples and of the answer's words must be in
the passage. A passage is twice as long as the longest item of its index and passages overlap by half,
so an item in a text always lies within one passage.

Items are indexed in blocks of a bounded number, by length class; the index sent to the workers never
exceeds that bound, and further blocks are further passes. Most passages are settled by a bound on what
an item can score: all its common words together, and those of its rare words that the passage has.

Defined cases: items without words match nothing; null and empty texts have no passages; null ids pass
through; repeated documents give repeated rows, repeated items a row each; an item found in several
passages of a document is reported once, at its best passage (the first of equals); other columns are
ignored by find_matches() and kept by remove_contaminated().
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_add, arrow_map, documents, unused

#: Share of an item's own BM25 score from which a passage is retrieved.
THRESHOLD = 0.6
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
#: Items in one index: the bound of what is broadcast at once.
INDEX_ITEMS = 20_000
BLOCK = 32
K1, B = 1.2, 0.75
_MARKS = b".,;:!?\"'()[]{}*#&%$|<>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def words_of(text: str | None) -> list[bytes]:
    """Words with case folded as Unicode (É as é, ß as ss) and without marks."""
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last sentence is the answer; of a single sentence, its last quarter."""
    parts = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) - max(1, len(words) // 4)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _triples(words: list[bytes]) -> set:
    return set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}


class Postings:
    """A term's items in ascending order with weights, and the largest weight of each block of them."""

    __slots__ = ("items", "weights", "tops", "top")

    def __init__(self, items: list[int], weights: list[float]) -> None:
        self.items, self.weights = items, weights
        self.tops = [max(weights[i : i + BLOCK]) for i in range(0, len(weights), BLOCK)]
        self.top = max(self.tops)


class Index:
    """Items of one length class."""

    def __init__(self, items: list[tuple], idf: dict[bytes, float], average: float, threshold: float) -> None:
        self.items = [(item, *split_item(text)) for item, text in items]
        words = [q + a for _, q, a in self.items]
        self.longest, self.threshold = max(map(len, words)), threshold - 1e-9
        lists: dict[bytes, tuple[list, list]] = {}
        for k, w in enumerate(words):
            norm = K1 * (1 - B + B * len(w) / average)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            own = math.fsum(impact.values())
            for t, x in impact.items():
                got = lists.setdefault(t, ([], []))
                got[0].append(k)
                got[1].append(x / own)
        self.lists = {t: Postings(*x) for t, x in lists.items()}
        # common words are those of more than a twentieth of the items; shares: what they can give each item at most
        most = max(2, len(words) // 20)
        common = {t for t, p in self.lists.items() if len(p.items) > most}
        self.shares = [0.0] * len(words)
        for t in common:
            for k, x in zip(self.lists[t].items, self.lists[t].weights, strict=True):
                self.shares[k] += x
        self.rest = max(self.shares)
        self.rare = {t: list(zip(p.items, p.weights, strict=True)) for t, p in self.lists.items() if t not in common}

    def passages(self, words: list[bytes], hits: list[tuple[int, bytes]] | None = None):
        """(start, end) of the passages whose rare words could lift an item to the threshold. hits: places of words that
        include all rare ones."""
        step, need = self.longest, self.threshold - self.rest
        n, rare = len(words), self.rare
        if need > 0:
            held: dict[int, dict[int, float]] = {}
            seen: set[tuple[int, bytes]] = set()
            for k, w in enumerate(words) if hits is None else hits:
                if w in rare and (key := (k // step, w)) not in seen:
                    seen.add(key)
                    sums = held.setdefault(key[0], {})
                    for item, x in rare[w]:
                        sums[item] = sums.get(item, 0.0) + x
            blocks, none = [], {}
            for b in sorted({c for b in held for c in (b - 1, b) if c >= 0}):
                one, two = held.get(b, none), held.get(b + 1, none)
                if any(x + two.get(i, 0.0) + self.shares[i] >= self.threshold for i, x in one.items()) or any(x + one.get(i, 0.0) + self.shares[i] >= self.threshold for i, x in two.items()):
                    blocks.append(b)
        else:
            blocks = range(max(1, -(-n // step)))
        for b in blocks:
            yield b * step, min(n, (b + 2) * step)

    def retrieve(self, terms: set[bytes]) -> list[tuple[int, float]]:
        """All items of at least the threshold, by block-max WAND."""
        at = [[p.items[0], 0, p] for t in terms if (p := self.lists.get(t))]
        out, need = [], self.threshold
        while at:
            at.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(at):
                total += c[2].top
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == doc:
                pivot += 1
            bound, edge = 0.0, at[pivot + 1][0] if pivot + 1 < len(at) else len(self.items)
            for c in at[: pivot + 1]:
                p = c[2]
                k = bisect_left(p.items, doc, c[1])
                if k < len(p.items):
                    bound += p.tops[k // BLOCK]
                    last = min((k // BLOCK + 1) * BLOCK, len(p.items)) - 1
                    edge = min(edge, p.items[last] + 1)
            if bound < need:
                to, score = max(edge, doc + 1), None
            else:
                to, score = doc, 0.0
                if at[0][0] == doc:
                    score = math.fsum(c[2].weights[c[1]] for c in at[: pivot + 1])
                    if score >= need:
                        out.append((doc, score))
                    to = doc + 1
            moved = []
            for i, c in enumerate(at):
                if i <= pivot and c[0] < to:
                    c[1] = bisect_left(c[2].items, to, c[1])
                    if c[1] == len(c[2].items):
                        continue
                    c[0] = c[2].items[c[1]]
                moved.append(c)
            at = moved
        return out

    def matches(self, words: list[bytes], hits: list[tuple[int, bytes]] | None = None) -> dict[int, tuple]:
        """item number -> (score, question overlap, answer overlap, first word of the passage) of verified items."""
        best: dict[int, tuple] = {}
        for a, b in self.passages(words, hits):
            part = words[a:b]
            held = set(part)
            got = self.retrieve(held)
            if not got:
                continue
            triples = _triples(part)
            for k, score in got:
                _, question, answer = self.items[k]
                q = _triples(question)
                # a question of fewer than three words is held against the words themselves
                overlap = sum(t in triples for t in q) / len(q) if len(question) > 2 else sum(w in held for w in question) / len(question)
                of = sum(w in held for w in answer) / len(answer) if answer else 1.0
                if overlap >= QUESTION_OVERLAP and of >= ANSWER_OVERLAP and (k not in best or (score, overlap, of) > best[k][:3]):
                    best[k] = (score, overlap, of, a)
        return best


def rare_words(indexes: list[Index]) -> frozenset[bytes]:
    """The rare words of any of the indexes: one look at each word of a text serves them all."""
    return frozenset().union(*(x.rare for x in indexes))


def build_indexes(items: DataFrame, threshold: float = THRESHOLD, block: int = INDEX_ITEMS):
    """Lists of indexes (one per length class), a list for each block of at most `block` items(item_id, text).

    Document frequencies are counted over all items; a block's items come to the driver, no more.
    """
    numbered = items.select("item_id", "text").where("text is not null")
    n = numbered.count()
    # the text is in the order too, so that items with equal or null ids are split alike each time
    for start in range(0, n, block):
        rows = [(r.item_id, r.text) for r in numbered.orderBy("item_id", "text").offset(start).limit(block).collect()]
        if start == 0 and n <= block:
            texts = [t for _, t in rows]
            seen: Counter = Counter(w for t in texts for w in set(words_of(t)))
            lengths = [k for t in texts if (k := len(words_of(t)))]
            average, total = (sum(lengths) / len(lengths) if lengths else 1.0), len(lengths)
        elif start == 0:
            bags = arrow_map(numbered.select("text"), "words array<binary>, n long", lambda r: {"words": [list(set(words_of(t))) for t in r["text"]], "n": [len(words_of(t)) for t in r["text"]]})
            one = bags.where("n > 0").agg(F.avg("n").alias("a"), F.count(F.lit(1)).alias("c")).first()
            average, total = one.a or 1.0, one.c
            frequencies = bags.select(F.explode("words").alias("w")).groupBy("w").count()
        if n > block:
            mine = {w for _, t in rows for w in words_of(t)}
            wanted = items.sparkSession.createDataFrame([(bytearray(w),) for w in mine], "w binary")
            seen = Counter({bytes(r.w): r["count"] for r in frequencies.join(wanted, "w").collect()})
        idf = {w: math.log(1 + (total - c + 0.5) / (c + 0.5)) for w, c in seen.items()}
        classes: dict[int, list] = {}
        for item, text in rows:
            if k := len(words_of(text)):
                classes.setdefault(k.bit_length(), []).append((item, text))
        yield [Index(classes[c], idf, average, threshold) for c in sorted(classes)]


def find_matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = INDEX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage_word of each verified pair."""
    spark = docs.sparkSession
    item_kind, doc_kind = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, passage_word long"
    names = [x.split()[0] for x in schema.split(", ")]
    out = spark.createDataFrame([], schema)
    for indexes in build_indexes(items, threshold, block):
        held = spark.sparkContext.broadcast((indexes, rare_words(indexes)))

        def run(rows: dict[str, list], held=held) -> dict[str, list]:
            got: list[tuple] = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                words, (all_indexes, rare) = words_of(text), held.value
                hits = [(k, w) for k, w in enumerate(words) if w in rare]
                for index in all_indexes:
                    got += [(doc, index.items[k][0], *m) for k, m in sorted(index.matches(words, hits).items())]
            return dict(zip(names, zip(*got, strict=True) if got else [[]] * len(names), strict=True))

        out = out.unionByName(arrow_map(docs.select("doc_id", "text"), schema, run))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = INDEX_ITEMS) -> DataFrame:
    """The rows of docs in which no item is verified, all columns as they were; decided row by row, without a join."""
    spark, names, out = docs.sparkSession, docs.columns, docs
    name = unused("clean", names)
    for indexes in build_indexes(items, threshold, block):
        held = spark.sparkContext.broadcast((indexes, rare_words(indexes)))

        def run(texts: list, held=held) -> list[list]:
            good, (all_indexes, rare) = [], held.value
            for t in texts:
                words = words_of(t)
                hits = [(k, w) for k, w in enumerate(words) if w in rare]
                good.append(not any(x.matches(words, hits) for x in all_indexes))
            return [good]

        out = arrow_add(out, "text", f"{name} boolean", run).where(F.col(name)).select(*[F.col(f"`{c}`") for c in names])
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
