"""Language identification by rank-order n-gram profiles (operator 7).

A language's profile is its most frequent character n-grams in order. A document's own profile is
compared with each: the out-of-place distance sums how far each n-gram of the document is from its
place in the language's list, n-grams that are not in the list counting as the list's length.

Counting is exact over all training rows: each task counts words, then the n-grams of distinct words,
and sends sums by (language, n-gram); a profile is the head of that table. Only profiles
(languages x profile length, checked) reach the driver.

Defined cases: texts without a letter or null are `und` with score 0, as is every text when nothing was
learned; rows with a null language or text train nothing; equal counts are ordered by n-gram and equal
distances by language name; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_map, documents, fold_of, saved

PROFILE = 400
DOC_PROFILE = 300
MAX_N = 3
#: More languages than this cannot be: profiles must fit a worker.
MAX_LANGUAGES = 2000
#: Distinct n-grams that a task holds before it sends their sums on.
_FLUSH = 2_000_000
_PAD = ord("_")
_WORD = regex.compile(r"\p{L}+")


def grams(word: str, max_n: int = MAX_N) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, max_n + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def codes(texts: list[str | None]) -> np.ndarray:
    """The n-grams (up to three characters) of texts as integers, 21 bits a character, which order as the n-grams do."""
    words = [w for t in texts for w in _WORD.findall((t or "").lower())]
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(f"_{'__'.join(words)}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two, three = (c[:-1] << 42) | (c[1:] << 21), (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    apart = (c[:-1] == _PAD) & (c[1:] == _PAD)  # between words
    return np.concatenate([c[c != _PAD] << 42, two[~apart], three[~(apart[:-1] | apart[1:])]])


def spelled(code: int) -> str:
    return "".join(chr(x) for k in (42, 21, 0) if (x := code >> k & 0x1FFFFF))


def train(labelled: DataFrame, profile: int = PROFILE) -> dict[str, list[str]]:
    """lang -> its n-grams by rank, from labelled(text, lang)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams_, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams_, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams_)).astype(np.int64)

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], schema=schema)
            held.clear()

        for b in batches:
            for i in range(0, b.num_rows, SLICE_ROWS):
                rows, texts = b.slice(i, SLICE_ROWS).to_pydict(), {}
                for text, lang in zip(rows["text"], rows["lang"], strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, t in texts.items():
                    held.setdefault(lang, []).append(np.unique(codes(t), return_counts=True))
                    if len(held[lang]) >= 64:
                        held[lang] = [summed(held[lang])]
                if sum(len(g) for parts in held.values() for g, _ in parts) > _FLUSH:
                    yield from sums()
        yield from sums()

    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = saved(sums.withColumn("place", place).where(F.col("place") <= profile), "profiles")
    if (n := top.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES} profiles can be sent to every worker")
    out: dict[str, list[str]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.place)):  # languages x profile rows
        out.setdefault(r.lang, []).append(spelled(r.gram))
    return out


class Classifier:
    """Distances of one text to all profiles: a matrix of the places of every profile's n-grams."""

    def __init__(self, profiles: dict[str, list[str]], profile: int = PROFILE, doc_profile: int = DOC_PROFILE) -> None:
        self.langs, self.profile, self.doc_profile = sorted(profiles), profile, doc_profile
        code = lambda g: sum(ord(c) << k for c, k in zip(g, (42, 21, 0), strict=False))
        self.grams = np.array(sorted({code(g) for p in profiles.values() for g in p}), np.int64)
        self.places = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array([code(g) for g in profiles[lang]], np.int64))
            self.places[at, k] = np.arange(len(at))

    def __call__(self, text: str | None) -> tuple[str, float]:
        mine, counts = np.unique(codes([text]), return_counts=True)
        if not len(mine) or not len(self.grams):
            return "und", 0.0
        mine = mine[np.lexsort((mine, -counts))[: self.doc_profile]]
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == mine)[:, None], self.places[at], -1)
        off = np.where(theirs < 0, self.profile, np.abs(theirs - np.arange(len(mine))[:, None]))
        away = off.sum(0)
        best = int(away.argmin())  # the first of equals: by name
        return self.langs[best], float(1.0 - away[best] / (len(mine) * self.profile))


def classify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""
    made: list[Classifier] = []

    def run(rows: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Classifier(profiles))
        got = [made[0](t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double", run)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = train(docs.where(fold_of() != 1))
    return classify(docs, profiles).select("doc_id", (fold_of() == 1).alias("held_out"), "lang_pred", "score")


def _oracle() -> str:
    return rf"""
WITH RECURSIVE bits AS (SELECT 0 AS i), d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text, lower(coalesce(text, '')) AS t, coalesce(doc_id::VARCHAR, '') AS s FROM documents
), crc AS (
  SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
     lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda c, j: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) AS c
  FROM (SELECT DISTINCT s FROM d)
), f AS (SELECT d.*, c % 3 = 1 AS held_out FROM d JOIN crc USING (s)
), w AS (
  SELECT rid, '_' || w || '_' AS w, count(*) AS c FROM (SELECT rid, unnest(regexp_extract_all(t, '\p{{L}}+')) AS w FROM f) GROUP BY ALL
), g AS (
  SELECT rid, g, sum(c)::BIGINT AS c FROM (
    SELECT rid, c, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) AS g FROM w, range(1, {MAX_N + 1}) r(n) WHERE length(w) >= n)
  WHERE g <> '_' GROUP BY ALL
), p AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) - 1 AS place
  FROM g JOIN f USING (rid) WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, g
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) <= {PROFILE}
), m AS (
  SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY c DESC, g) - 1 AS place FROM g
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY c DESC, g) <= {DOC_PROFILE}
), n AS (SELECT rid, count(*) AS n FROM m GROUP BY rid
), a AS (
  SELECT rid, lang, n, n * {PROFILE} - coalesce(sum({PROFILE} - abs(p.place - m.place)), 0) AS away
  FROM n CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN m USING (rid) LEFT JOIN p USING (lang, g) GROUP BY rid, lang, n
), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY rid ORDER BY away, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - away::DOUBLE / (n * {PROFILE}), 0)::DOUBLE AS score
FROM f LEFT JOIN b USING (rid)
"""


QUERIES = {"op7_language_id": op7_language_id}
ORACLES = {"op7_language_id": _oracle().replace("RECURSIVE bits AS (SELECT 0 AS i), ", "")}
