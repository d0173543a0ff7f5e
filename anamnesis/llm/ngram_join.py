"""Exact self-join of documents on the Jaccard similarity of their word n-grams, and its components (operator 1).

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Rows with equal sets are one
set from the start. The order of tokens is that of their hashes, and a prefix is a fixed share of the hash
range, so that a token's place needs no global statistics.

* Rare tokens (held by at most RARE sets) are indexed singly: the sets of such a token are candidates. A
  set with more rare tokens in its prefix than may be missing from a linked one is settled by them.
* The others, made of frequent tokens or very short, are indexed by combinations of tokens. The prefix is
  extended until its tokens can be dealt, by ranges of the token order, into more groups than two linked
  sets can differ in: one group then holds the same tokens in both. Those tokens, three or four of them,
  are the combination; groups with a rare token of the prefix need none. The number of groups belongs to a
  class of sizes, and a set is indexed for its own class and the one below.
* All sets of a combination are verified with the one that has the fewest rare tokens. In a crowd of near
  copies that is the text they were made from, and the crowd is joined by as many verifications as it has
  sets. Only where a combination still holds sets of several components do those outside the first set's
  component meet all others: pair by pair in small combinations, else in blocks of bounded size, where a
  matrix product counts common tokens.

Candidates are verified on whole sets. Links become components by contraction over
written tables. Groups stay bounded: a token leaves a task with at most RARE + 1 sets, a
block has at most BLOCK sets, and each block emits only a spanning forest of its links.

Defined cases: null and empty texts have an empty set, link with nothing and are their own component;
texts of fewer than five words are one shingle; rows with a null id take part as copies of others but
have no id to be reached by (component_id is the smallest id with the same set, or null); rows that
share an id are one node, all their texts are indexed, and their components are one; an empty table gives
an empty result; other columns are ignored by join() and kept, whatever their names, by keep_one().
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, discard, documents, saved, slices, temporary, unused

WIDTH = 5
THRESHOLD = 80  # per cent
RARE = 16
BLOCK = 1024
#: Sets of a combination up to which its open pairs are verified one by one.
FEW = 32
#: Share of the hash range that is indexed: more than the mismatches allowed (20 %) with room for chance.
SHARE = 0.35
#: Ids or tokens of which so many may be broadcast (8 bytes each); more go through a join or in slices.
BROADCAST = 2_000_000
#: Tokens of one merge task, and of one block of a scan.
_PART_TOKENS, _SCAN_TOKENS = 2_000_000, 1_000_000
#: Tokens of one side of a block.
_BLOCK_TOKENS = 300_000
_K = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mixed(a: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit integers."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. ASCII letters are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(len(h), width)):
        acc = acc * _K + h[i : i + n]
    return np.unique(_mixed(acc))


def slack(n: int, threshold: int) -> int:
    """How many of n tokens may be missing from a linked set."""
    return n - -(-threshold * n // 100)


def indexed(tokens: np.ndarray, share: float) -> np.ndarray:
    """The prefix of tokens by which a set is indexed singly: those in the first part of the hash range."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(share * 2**64)))]


@cache
def _starts(threshold: int) -> list[int]:
    return [1]


def size_class(n: int, threshold: int) -> int:
    """Class of a set's size: linked sets lie in one class or in two next to each other."""
    starts = _starts(threshold)
    while starts[-1] <= n:
        starts.append(100 * starts[-1] // threshold + 1)
    return bisect_right(starts, n) - 1


def dealt(level: int, threshold: int) -> tuple[int, int]:
    """By how many tokens linked sets of a class, or of it and the next, differ at most; and the number of their groups."""
    starts = _starts(threshold)
    while len(starts) <= level + 1:
        starts.append(100 * starts[-1] // threshold + 1)
    most = starts[level + 1] - 1
    apart = (most + 100 * most // threshold) * (100 - threshold) // (100 + threshold)
    return apart, apart + 1 + max(1, -(-apart // 8))


def combinations(tokens: np.ndarray, rare: np.ndarray, threshold: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, need, hashes) of the token combinations by which a set is indexed, for its class and the one below.

    Of a class's groups at most `apart` differ in linked sets; the others are equal, and of those no more are empty than the set
    has empty groups. So linked sets that share no rare token share at least `need` combinations of a class. Where that would
    be none, both sets have so many empty groups that they are indexed by that.
    """
    own, out = size_class(len(tokens), threshold), []
    for level in (own, own - 1):
        if level < 0:
            continue
        apart, groups = dealt(level, threshold)
        if not apart:  # only equal sets are linked, and those are one set
            continue
        place = lambda t: (t >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)  # noqa: B023, E731
        group = place(tokens)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        salt = np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
        held = np.add.reduceat(_mixed(tokens), heads) + (group[heads] + np.uint64(1)) * _K + salt
        keys, need = _mixed(held[~np.isin(group[heads], place(rare))]), len(heads) - apart
        if need <= 0:
            keys, need = np.append(keys, _mixed(np.array([salt], np.uint64))), 1
        out.append((level, need, keys.view(np.int64)))
    return out


# ---------------------------------------------------------------- scans


def _texts(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for part in slices(b):
            yield from zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)


def _sets(docs: DataFrame, width: int, share: float) -> DataFrame:
    """doc_id, n, digest (of the whole set) and prefix (the tokens indexed singly) of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.binary())])

    def run(batches):
        for b in batches:
            for part in map(pa.RecordBatch.to_pydict, slices(b)):
                sets = [shingles(t, width) for t in part["text"]]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = (part["doc_id"], [len(s) for s in sets], digests, [indexed(s, share).tobytes() for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, prefix binary")


def _squeeze(a: np.ndarray) -> bytes:
    """64-bit integers as zstandard over the byte planes of their differences."""
    planes = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _postings(sets: DataFrame, parts: int, rare: int) -> DataFrame:
    """part, toks, ids: sorted tokens with the sets that hold them, a row per part and block of a scan.

    Of a token that more than `rare` sets of the block hold, rare + 1 sets are told: enough to know it for frequent.
    """
    out = pa.schema([("part", pa.int64()), ("toks", pa.binary()), ("ids", pa.binary())])

    def block(toks: list, ids: list) -> pa.RecordBatch:
        t, i = np.concatenate(toks), np.concatenate(ids)
        part = t % np.uint64(parts)
        order = np.lexsort((t, part))
        t, i, part = t[order], i[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        rank = np.arange(len(t)) - np.repeat(first, np.diff(first, append=len(t)))
        few = rank <= rare
        t, i, part = t[few], i[few], part[few]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = [(int(part[a]), _squeeze(t[a:b]), _squeeze(i[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def run(batches):
        toks, ids, held = [], [], 0
        for part in (x for b in batches for x in slices(b, 4 * SLICE_ROWS)):
            sizes = np.array([len(x) // 8 for x in part["prefix"].to_pylist()], np.int64)
            if sizes.any():
                toks.append(np.frombuffer(b"".join(part["prefix"].to_pylist()), np.uint64))
                ids.append(np.repeat(part["doc_id"].to_numpy(zero_copy_only=False), sizes))
                held += len(toks[-1])
            if held >= _SCAN_TOKENS:
                yield block(toks, ids)
                toks, ids, held = [], [], 0
        if held:
            yield block(toks, ids)

    return sets.select("doc_id", "prefix").mapInArrow(run, "part long, toks binary, ids binary")


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's distinct (token, set) pairs by token, and where each token begins and how many sets hold it."""
    t = np.concatenate([_unsqueeze(x, np.uint64) for x in table["toks"].to_pylist()])
    i = np.concatenate([_unsqueeze(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((i, t))
    t, i = t[order], i[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])])
    t, i = t[new], i[new]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    return t, i, first, np.diff(first, append=len(t))


def _merged(postings: DataFrame, rare: int) -> DataFrame:
    """a, b: sets with a rare token in common; frequent: the frequent tokens of a part (one row each)."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("frequent", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        t, i, first, size = _in_order(table)
        pairs = [np.empty((0, 2), np.int64)]
        for c in range(2, rare + 1):
            at = first[size == c]
            if len(at):
                lists = np.unique(i[at[:, None] + np.arange(c)], axis=0)  # copies with few changes have few lists
                pairs += [lists[:, [x, y]] for x in range(c) for y in range(x + 1, c)]
        found = np.unique(np.concatenate(pairs), axis=0)
        frequent = t[first[size > rare]]
        rows = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.binary())]
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([frequent.tobytes()], pa.binary())]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=out) for x in (rows, last)])

    return postings.groupBy("part").applyInArrow(run, "a long, b long, frequent binary")


def _rare_counts(postings: DataFrame, rare: int) -> DataFrame:
    """uid, c: how many rare tokens sets have, over all parts."""
    out = pa.schema([("uid", pa.int64()), ("c", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        _, i, _, size = _in_order(table)
        uid, c = np.unique(i[np.repeat(size <= rare, size)], return_counts=True)
        return pa.Table.from_arrays([pa.array(uid, pa.int64()), pa.array(c, pa.int64())], schema=out)

    return postings.groupBy("part").applyInArrow(run, "uid long, c long").groupBy("uid").agg(F.sum("c").alias("c"))


def _crowded(sets: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """uid, c and rare (number and list of rare tokens in the prefix) of sets that have too few of them."""
    held = sets.sparkSession.sparkContext.broadcast(frequent)
    out = pa.schema([("uid", pa.int64()), ("c", pa.int64()), ("rare", pa.binary())])

    def run(batches):
        for part in (x for b in batches for x in slices(b)):
            rows = []
            for doc, n, prefix in zip(part["doc_id"].to_pylist(), part["n"].to_pylist(), part["prefix"].to_pylist(), strict=True):
                mine = np.frombuffer(prefix, np.uint64)
                if len(held.value) and len(mine):
                    at = np.minimum(np.searchsorted(held.value, mine), len(held.value) - 1)
                    mine = mine[held.value[at] != mine]
                if len(mine) <= slack(n, threshold):
                    rows.append((doc, len(mine), mine.tobytes()))
            cols = zip(*rows, strict=True) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return sets.where("n > 0").select("doc_id", "n", "prefix").mapInArrow(run, "uid long, c long, rare binary")


def _combined(docs: DataFrame, crowded: DataFrame, width: int, threshold: int) -> DataFrame:
    """uid, class (of its size), toks, place (few rare tokens first) and, for each class it is indexed for, level, need and keys
    (hashes of combinations) of crowded(uid, c, rare)."""
    kind = "uid long, class long, toks binary, place long, sides array<struct<level: long, need: long, keys: array<long>>>"
    out = to_arrow_schema(T._parse_datatype_string(kind))
    texts = _only(docs, crowded.select(F.col("uid").alias("doc_id")), "left_semi", crowded.count())
    given = texts.join(crowded, F.col("doc_id") == F.col("uid")).select("uid", "c", "rare", "text")

    def run(batches):
        for part, rows in ((x.to_pydict(), []) for b in batches for x in slices(b)):
            for uid, c, rare, text in zip(part["uid"], part["c"], part["rare"], part["text"], strict=True):
                toks = shingles(text, width)
                if len(toks):
                    sides = [{"level": k, "need": need, "keys": keys} for k, need, keys in combinations(toks, np.frombuffer(rare, np.uint64), threshold)]
                    rows.append((uid, size_class(len(toks), threshold), toks.tobytes(), (c << 40) + (hash(uid) * 0x9E3779B1 & 0xFFFFFFFFFF), sides))
            cols = zip(*rows, strict=True) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return given.mapInArrow(run, kind)


# ---------------------------------------------------------------- links


def _only(docs: DataFrame, ids: DataFrame, how: str, n: int) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or is not (left_anti) in ids(doc_id), which has n rows."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST else ids, "doc_id", how)


def _linked(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs a, b whose sets reach the threshold."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = _only(docs, ids, "left_semi", ids.count())
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        kept: tuple = (None, None)
        for batch in batches:
            for part, good in ((x.to_pydict(), []) for x in slices(batch)):
                for a, b, x, y in zip(part["a"], part["b"], part["text_a"], part["text_b"], strict=True):
                    if kept[0] != (b, y):
                        kept = ((b, y), shingles(y, width))
                    s, t = shingles(x, width), kept[1]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= threshold * (len(s) + len(t) - common):
                        good.append((a, b))
                cols = zip(*good, strict=True) if good else [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, crowded: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs(a, b) of crowded sets that reach the threshold. pairs must be a written table: one set may be in many."""
    left = pairs.join(crowded.select(F.col("uid").alias("a"), F.col("toks").alias("toks_a")), "a")
    both = left.join(crowded.select(F.col("uid").alias("b"), F.col("toks").alias("toks_b")), "b").select("a", "b", "toks_a", "toks_b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            for part, good in ((p.to_pydict(), []) for p in slices(b)):
                for x, y, s, t in zip(part["a"], part["b"], part["toks_a"], part["toks_b"], strict=True):
                    common = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                    if 100 * common >= threshold * ((len(s) + len(t)) // 8 - common):
                        good.append((x, y))
                cols = zip(*good, strict=True) if good else [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    return both.mapInArrow(run, "a long, b long")


def _block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two bounded lists of (id, set)."""
    both = left + right
    sizes = np.fromiter((len(s) for _, s in both), np.int64, len(both))
    _, column, seen = np.unique(np.concatenate([s for _, s in both]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = seen[column] > 1
    row, (_, column) = row[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(left)
    common = np.zeros((n, len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(both), 4096), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        common += m[:n] @ m[n:].T
    linked = 100 * common >= threshold * (sizes[:n, None] + sizes[None, n:] - common)
    label = np.arange(n)
    while True:
        theirs = np.where(linked, label[:, None], n).min(0)
        low = np.minimum(label, np.where(linked, theirs[None, :], n).min(1))
        if (low == label).all():
            break
        label = low
    links = [(left[k][0], left[i][0]) for i, k in enumerate(label) if k != i]
    return links + [(left[k][0], right[j][0]) for j, k in enumerate(theirs) if k < n and left[k][0] != right[j][0]]


def _open_links(members: DataFrame, mixed: DataFrame, crowded: DataFrame, threshold: int, block: int) -> DataFrame:
    """a, b: links between the sets outside a combination's first component and all its sets, as spanning forests of blocks.

    members(uid, key, label), mixed(key, top, main). Combinations with sets in common are joined once, as one region.
    """
    told = saved(members.join(mixed, "key").select("uid", "top", (F.col("label") != F.col("main")).alias("out")).groupBy("uid", "top").agg(F.max("out").alias("out")), "open")
    region = components(saved(told.where("uid <> top").select(F.col("top").alias("a"), F.col("uid").alias("b")), "ties"))
    sides = told.groupBy("uid").agg(F.max("out").alias("out")).join(region.select(F.col("id").alias("uid"), "component"), "uid").join(crowded.select("uid", "class", (F.octet_length("toks") / 8).alias("n")), "uid")
    # linked sizes lie in one class or in two next to each other: a set goes to the group of its class and to the one below
    sides = saved(sides.select("uid", "n", "out", F.col("component").alias("region"), F.explode(F.array("class", F.col("class") - 1)).alias("g")), "sides")
    # a side of a block has a bounded number of sets and of tokens
    need = lambda n, size: F.ceil(F.greatest(n / F.lit(block / 2), size / F.lit(_BLOCK_TOKENS))).cast("int")
    counted = sides.groupBy("region", "g").agg(need(F.count_if("out"), F.sum(F.when(F.col("out"), F.col("n")))).alias("k_out"), need(F.count(F.lit(1)), F.sum("n")).alias("k_all")).where("k_out > 0")
    cells = sides.join(saved(counted, "counted"), ["region", "g"])
    deal = lambda k: F.pmod(F.xxhash64("uid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    inner = cells.select("uid", "region", "g", F.lit(False).alias("out"), every("k_out").alias("i"), deal("k_all").alias("j"))
    outer = cells.where("out").select("uid", "region", "g", "out", deal("k_out").alias("i"), every("k_all").alias("j"))
    full = saved(inner.unionByName(outer), "cells").join(crowded.select("uid", "toks"), "uid")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for uid, out, toks in zip(table["uid"].to_pylist(), table["out"].to_pylist(), table["toks"].to_pylist(), strict=True):
            sides[0 if out else 1].append((uid, np.frombuffer(toks, np.uint64)))
        links = _block_links(*sides, threshold) if sides[0] and sides[1] else []
        return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

    return full.groupBy("region", "g", "i", "j").applyInArrow(run, "a long, b long")


def _crowd_links(crowded: DataFrame, threshold: int, block: int, few: int) -> DataFrame:
    """a, b: links that join all linked sets that share a combination, directly or by way of others."""
    each = lambda df, *cols: df.select(*cols, F.explode("sides").alias("s")).select(*cols, "s.level", "s.need", F.explode("s.keys").alias("key"))
    flat = each(crowded, "uid", "place")
    tops = saved(flat.groupBy("key").agg(F.min_by("uid", "place").alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1"), "tops")
    stars = saved(flat.join(tops.where(F.col("c") > few), "key").where("uid <> top").select(F.col("top").alias("a"), F.col("uid").alias("b")).distinct(), "stars")
    links = saved(_verified(stars, crowded, threshold), "star-links")
    label = components(links).select(F.col("id").alias("uid"), "component")
    labelled = saved(crowded.join(label, "uid", "left").select("uid", "sides", F.coalesce("component", "uid").alias("label")), "labelled")
    members = each(labelled, "uid", "label")
    main = labelled.select(F.col("uid").alias("top"), F.col("label").alias("main"))
    spread = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    mixed = saved(tops.join(spread, "key").join(main, "top"), "mixed")
    small = members.join(mixed.where(F.col("c") <= few).select("key"), "key")
    side = lambda x: small.select("key", "level", F.col("uid").alias(x), F.col("label").alias(f"l{x}"), F.col("need").alias(f"n{x}"))
    pairs = side("a").join(side("b"), ["key", "level"]).where("a < b and la <> lb")
    # linked sets of different components share enough combinations of few sets, or one of more, which the blocks below see to
    pairs = pairs.groupBy("a", "b", "level").agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest("na", "nb")).alias("need")).where(F.col("c") >= F.col("need")).select("a", "b").distinct()
    links = links.unionAll(_verified(saved(pairs, "few"), crowded, threshold))
    large = mixed.where(F.col("c") > few)
    if large.limit(1).count():
        links = links.unionAll(_open_links(members, large.select("key", "top", "main"), crowded, threshold, block))
    return links


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links(a, b), which must be a written table. A written table.

    Every node goes to its smallest neighbour, if that is smaller, and on to wherever that one goes; then the links are those
    between what the nodes have become. At least half of the nodes of every round are gone in the next.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("up")), "up")
        to = lambda up, further: first.select(F.col("id").alias(up), F.col("up").alias(further))  # noqa: B023, E731
        rounds.append(saved(first.join(to("up", "far"), "up").join(to("far", "top"), "far").select("id", F.col("top").alias("up")), "jumped"))
        became = lambda x: rounds[-1].select(F.col("id").alias(x), F.col("up").alias(f"{x}_up"))
        left = edges.join(became("a"), "a").join(became("b"), "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        left, old = saved(left, "edges"), edges
        discard(first, old)
        edges = left
    out = rounds[0]
    for further in rounds[1:]:
        out = out.join(further.select(F.col("id").alias("up"), F.col("up").alias("next")), "up", "left").select("id", F.coalesce("next", "up").alias("up"))
    out = saved(out.select("id", F.col("up").alias("component")), "components")
    discard(edges, *rounds)
    return out


def join(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, rare: int = RARE, block: int = BLOCK, share: float = SHARE, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with temporary() as keep:
        sets = saved(_sets(docs, width, share), "sets")
        # joins on keys that copies make hot: the other side is a written table, so that Spark can split the hot side
        first = saved(sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("uid"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("digest").alias("_d"), "uid"), "first")
        worded = sets.where("n > 0").join(first, F.col("digest") == F.col("_d"), "left").select("doc_id", "n", F.coalesce("uid", "doc_id").alias("node"))
        rows = keep(saved(worded.unionAll(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("node"))), "rows"))
        own = F.max((F.col("doc_id") == F.col("node")).cast("int")).alias("own")
        ids = saved(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("node").alias("one"), F.max("node").alias("other"), own), "by-id")
        copies = ids.where("own = 0").select("doc_id")
        own_sets = _only(sets.where("doc_id is not null").select("doc_id", "n", "prefix"), copies, "left_anti", copies.count())

        total = rows.agg(F.sum("n")).first()[0] or 0
        parts = max(1, -(-int(total * share) // _PART_TOKENS))
        postings = _postings(own_sets, parts, rare)
        merged = saved(_merged(postings, rare), "merged")
        near = merged.where("a is not null").select("a", "b").distinct()
        near = near.join(ids.selectExpr("doc_id as a", "low as la", "high as ha"), "a").join(ids.selectExpr("doc_id as b", "low as lb", "high as hb"), "b")
        near = near.where(f"100 * hb >= {threshold} * la and 100 * ha >= {threshold} * lb").select("a", "b")
        links = _linked(saved(near, "candidates"), docs, width, threshold)

        lists = merged.where("frequent is not null and octet_length(frequent) > 0").select("frequent")
        n_frequent = lists.agg(F.sum(F.octet_length("frequent") / 8)).first()[0] or 0
        if n_frequent <= BROADCAST:
            tokens = np.sort(np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r.frequent, np.uint64) for r in lists.collect()]]))
            crowded = _crowded(own_sets, tokens, threshold)
        else:  # rare tokens are counted by set instead; no combination is left out for having one
            counts = own_sets.where("n > 0").select(F.col("doc_id").alias("uid"), "n").join(_rare_counts(postings, rare), "uid", "left").select("uid", "n", F.coalesce("c", F.lit(0)).alias("c"))
            crowded = counts.where(F.col("c") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100)).select("uid", F.col("c").cast("long").alias("c"), F.lit(b"").alias("rare"))
        crowds = saved(_combined(docs, saved(crowded, "crowded"), width, threshold), "crowds")
        links = links.unionAll(_crowd_links(crowds, threshold, block, few))
        tied = ids.where("one < other").select("doc_id", "one")
        if tied.limit(1).count():  # ids on rows with different texts
            links = links.unionAll(rows.join(tied, "doc_id").where("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b")).distinct())
        found = keep(components(saved(links, "links")))

    # copies of a set, and ids that share a row with another set, meet at the set's first id
    placed = rows.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of each group of near duplicates, all columns as they were: that with the smallest id (a null one only where
    no row of the group has an id), of rows with that id and different texts that with the smallest hash.

    Groups are formed over texts: rows that share an id but not a group are judged apart. Of rows with equal ids and texts
    one stays, the first in the order of all columns. Rows without words are no one's duplicates and stay.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    name = unused("key", docs.columns)
    if not odd:  # an id is a row: the smallest id of a group is its component
        with temporary() as keep:
            found = join(docs, threshold, width)
            gone = keep(saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)), "gone"))
        return _without(docs, gone, F.col("doc_id").cast("long") == F.col(name))
    key = F.xxhash64("doc_id", "text")
    with temporary() as keep:
        rows = saved(join(docs.select(key.alias("doc_id"), "text"), threshold, width).where("n_shingles > 0").select(F.col("doc_id").alias("k"), F.col("component_id").alias("c")), "grouped")
        nodes = rows.distinct()
        members = saved(nodes.join(saved(nodes.where("k <> c").select("c").distinct(), "groups"), "c"), "members")
        ids = docs.select(key.alias("k"), F.col("doc_id").alias("id")).join(members, "k")
        stay = saved(ids.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first")).select("c", F.col("first.k").alias("stay")), "stay")
        gone = keep(saved(members.join(stay, "c").where("k <> stay").select(F.col("k").alias(name)), "gone"))
        again = keep(saved(rows.groupBy("k").count().where("count > 1").select(F.col("k").alias(name)), "again"))
    left = _without(docs, gone, key == F.col(name))
    single, many = left.join(again, key == F.col(name), "left_anti"), left.join(again, key == F.col(name), "left_semi")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    one = many.groupBy(key.alias(name)).agg(F.min_by(F.struct(*cols), order).alias("row")).select("row.*")
    return single.unionByName(one)


def _without(docs: DataFrame, gone: DataFrame, same) -> DataFrame:
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, same, "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) < 5 THEN [1::BIGINT] ELSE range(1, len(w) - 3) END) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS m FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(m) FROM r WHERE r.id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
}
