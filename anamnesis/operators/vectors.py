"""Vector search: exact scans, all-pairs joins in blocks, hyperplane hashing, novelty.

Vectors are array<float> columns. Scans send the queries to the rows (checked for size; more queries than
that go in blocks) and keep each task's best rows only, so that a shuffle carries k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Queries sent to every task at once.
QUERY_BLOCK = 4096
#: Vectors of one side of a block in an all-pairs join.
PAIR_BLOCK = 2048
#: Buckets of a table that a query looks into, and the bits in which they may differ from its own.
PROBES, FLIPS = 80, 3


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a float64 matrix with unit rows (zero rows stay zero), and which rows are vectors of that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = np.asarray(column.value_lengths().fill_null(0)) == dim
    flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.nan_to_num(flat.reshape(-1, dim))
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), good


def _blocks(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries in blocks, each as (matrix, ids) for every length of vectors in it."""
    rows = queries.select("query_id", "v").where("v is not null and size(v) > 0")
    count = rows.count()
    for start in range(0, max(count, 1), QUERY_BLOCK):
        block = rows if count <= QUERY_BLOCK else rows.orderBy("query_id").offset(start).limit(QUERY_BLOCK)
        got, out = block.toArrow() if count else None, []
        if got is not None:
            lengths = np.asarray(got["v"].combine_chunks().value_lengths())
            for dim in np.unique(lengths).tolist():
                m, good = _matrix(got["v"], dim)
                out.append((m, np.asarray(got["query_id"])[good]))
        yield out


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, strict: bool = False, keep_self: bool = False) -> DataFrame:
    """query_id, id, sim, rank of the k most similar rows of at least the threshold. rows(id, v), queries(query_id, v).

    Thresholds and order look at 9 places, ties go by id. A query meets the rows whose vectors are as long as its own; null
    and empty vectors match nothing.
    """
    out = None
    for block in _blocks(queries):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in held.value]
            for b in batches:
                for mine, (q, ids) in zip(best, held.value, strict=True):
                    m, ok = _matrix(b.column(1), q.shape[1])
                    if not len(m):
                        continue
                    own = b.column(0).to_numpy(zero_copy_only=False)[ok]
                    sims = q @ m.T
                    near = np.round(sims, 9)
                    hit = near > threshold if strict else near >= threshold
                    if not keep_self:
                        hit &= ids[:, None] != own[None, :]
                    at, row = np.nonzero(hit)
                    if len(at):
                        mine.append((at, sims[at, row], own[row]))
                    if sum(len(x[0]) for x in mine) > 2_000_000:
                        mine[:] = [_head(mine, k)]
            for mine, (_, ids) in zip(best, held.value, strict=True):
                if mine:
                    at, sim, row = _head(mine, k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[at], pa.int64()), "id": pa.array(row, pa.int64()), "sim": pa.array(sim, pa.float64())})

        part = rows.select(F.col("id").cast("long").alias("id"), "v").where("v is not null").mapInArrow(run, "query_id long, id long, sim double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def kin_above(kin: DataFrame, queries: DataFrame, threshold: float, near: float) -> DataFrame:
    """query_id, id, child, sim, child_sim of every child whose similarity times weight reaches the threshold while its
    parent's lies in [near, threshold). kin(id, child, weight, v, child_v), queries(query_id, v); child_sim is weighted."""
    out = None
    for block in _blocks(queries):
        held = kin.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, PAIR_BLOCK) for whole in batches for i in range(0, whole.num_rows, PAIR_BLOCK)):
                for q, ids in held.value:
                    (m, ok), (c, child_ok) = _matrix(b.column(3), q.shape[1]), _matrix(b.column(4), q.shape[1])
                    both = ok & child_ok
                    if not both.any():
                        continue
                    own, child, weight = (b.column(i).to_numpy(zero_copy_only=False)[both] for i in range(3))
                    sims, child_sims = np.round(q @ m[both[ok]].T, 9), np.round((q @ c[both[child_ok]].T) * weight[None, :], 9)
                    at, row = np.nonzero((sims >= near) & (sims < threshold) & (child_sims >= threshold))
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[at], pa.int64()), "id": pa.array(own[row], pa.int64()), "child": pa.array(child[row], pa.int64()), "sim": pa.array(sims[at, row], pa.float64()), "child_sim": pa.array(child_sims[at, row], pa.float64())})

        part = kin.select(F.col("id").cast("long").alias("id"), F.col("child").cast("long").alias("child"), F.col("weight").cast("double").alias("weight"), "v", "child_v").where("v is not null and child_v is not null").mapInArrow(run, "query_id long, id long, child long, sim double, child_sim double")
        out = part if out is None else out.unionByName(part)
    return out


def _head(best: list[tuple], k: int) -> tuple:
    at, sim, row = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((row, -np.round(sim, 9), at))
    at, sim, row = at[order], sim[order], row[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[place < k], sim[place < k], row[place < k]


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Each row (id, v) with its block `own` and its length `dim`, once for each pair of blocks i <= j that it takes part in.
    Vectors of different lengths never meet."""
    blocks = max(1, -(-rows.count() // block))
    placed = rows.select(F.col("id").cast("long").alias("id"), "v").where("v is not null and size(v) > 0").withColumn("dim", F.size("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def similar_pairs(rows: DataFrame, threshold: float, block: int = PAIR_BLOCK) -> DataFrame:
    """a < b, sim of all pairs above the threshold; rows(id, v) in blocks of bounded size, each pair of blocks one task's group."""
    cells = _cells(rows, block)

    def run(table: pa.Table) -> pa.Table:
        m, good = _matrix(table["v"], table["dim"][0].as_py())
        ids, own = np.asarray(table["id"])[good], np.asarray(table["own"])[good]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        sims = m[left] @ m[right].T
        x, y = np.nonzero(np.round(sims, 9) > threshold)
        a, b, s = ids[left][x], ids[right][y], sims[x, y]
        ok = (a < b) if i == j else (a != b)
        return pa.table({"a": pa.array(np.minimum(a, b)[ok], pa.int64()), "b": pa.array(np.maximum(a, b)[ok], pa.int64()), "sim": pa.array(s[ok], pa.float64())})

    return cells.groupBy("dim", "i", "j").applyInArrow(run, "a long, b long, sim double")


def novelty(rows: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """id, novelty: one minus the largest similarity to a row with a smaller id; 1 for the first. A pair of blocks tells
    one number for each row, never its pairs."""

    def run(table: pa.Table) -> pa.Table:
        m, good = _matrix(table["v"], table["dim"][0].as_py())
        ids = np.asarray(table["id"])[good]
        best = np.where(ids[:, None] < ids[None, :], m @ m.T, -np.inf).max(0)
        some = np.isfinite(best)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "best": pa.array(best[some], pa.float64())})

    best = _cells(rows, block).groupBy("dim", "i", "j").applyInArrow(run, "id long, best double").groupBy("id").agg(F.max("best").alias("best"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("best"))), F.lit(1.0)).alias("novelty"))


# ---------------------------------------------------------------- hyperplane hashing


def planes(dim: int, tables: int = 16, bits: int = 10, seed: int = 42) -> np.ndarray:
    p = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    return p / np.linalg.norm(p, axis=2, keepdims=True)


def _flips(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of up to FLIPS bits, the empty set and single bits first: as numbers, and as rows of zeros and ones."""
    sets = [x for n in range(min(FLIPS, bits) + 1) for x in combinations(range(bits), n)]
    return np.array([sum(1 << i for i in x) for x in sets]), np.array([[i in x for i in range(bits)] for x in sets], np.float64)


def _hashed(rows: DataFrame, key: str, p: np.ndarray, probe: bool) -> DataFrame:
    """Buckets of rows. A probing row has its own bucket, all that differ by a bit, and of those that differ by more the ones
    whose planes it is nearest to (the smallest sums of squared distances), PROBES of a table in all."""
    held = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        tables, bits, dim = p.shape
        weights = 1 << np.arange(bits)
        for b in batches:
            m, ok = _matrix(b.column(1), dim)
            if not len(m):
                continue
            far = np.einsum("nd,tbd->ntb", m, p)
            code = (far >= 0) @ weights
            codes = code[:, :, None]
            if probe:
                masks, flipped = _flips(bits)
                cost = (far * far) @ flipped.T
                cost[:, :, : bits + 1] = -1.0
                nearest = np.argsort(cost, axis=2, kind="stable")[:, :, : max(PROBES, bits + 1)]
                codes = codes ^ masks[nearest]
            ids = b.column(0).to_numpy(zero_copy_only=False)[ok]
            n, _, c = codes.shape
            yield pa.RecordBatch.from_pydict({key: pa.array(np.repeat(ids, tables * c), pa.int64()), "table_id": pa.array(np.tile(np.repeat(np.arange(tables), c), n), pa.int32()), "bucket": pa.array(codes.ravel(), pa.int64())})

    return rows.select(F.col(key).cast("long").alias(key), "v").where("v is not null").mapInArrow(run, f"{key} long, table_id int, bucket long")


def lsh_index(rows: DataFrame, p: np.ndarray) -> DataFrame:
    """id, table_id, bucket of every row."""
    return _hashed(rows, "id", p, probe=False)


def lsh_candidates(index: DataFrame, queries: DataFrame, p: np.ndarray) -> DataFrame:
    """query_id, id of rows in a query's buckets or in one that it probes."""
    probes = _hashed(queries, "query_id", p, probe=True)
    return probes.join(index, ["table_id", "bucket"]).select("query_id", "id").distinct()


def candidates(index: DataFrame, rows: DataFrame, queries: DataFrame, p: np.ndarray, labelled: DataFrame | None = None, least: int = 5) -> DataFrame:
    """LSH and label candidates; the queries with fewer than `least` get every row, in blocks of queries."""
    found = lsh_candidates(index, queries, p)
    if labelled is not None:
        found = found.unionByName(labelled.select("query_id", "id")).distinct()
    found = written(found, "candidates")
    few = written(queries.select("query_id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")), "query_id", "left").where(F.coalesce("c", F.lit(0)) < least).select("query_id"), "few")
    out, count = found, few.count()
    for start in range(0, count, QUERY_BLOCK):
        ids = [r.query_id for r in few.orderBy("query_id").offset(start).limit(QUERY_BLOCK).collect()]  # a block of queries' ids
        out = out.unionByName(rows.select(F.explode(F.lit(ids).cast("array<bigint>")).alias("query_id"), F.col("id").cast("long").alias("id")))
    return out.distinct() if count else out


def mean_vector(rows: DataFrame, latest: int = 50) -> DataFrame:
    """mean of the vectors with the largest ids."""
    last = rows.where("v is not null and size(v) > 0").orderBy(F.desc("id")).limit(latest)
    flat = last.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
