"""The co-activation graph: folding events into decaying edges, validity, neighbours, walks, views.

Edge events are (src, dst, strength, ts); edges (src, dst, weight, activation_count, last_activated). A
batch of events folds in closed form, so the order of events does not matter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import half_life
from ..sources.shared import written


def fold(events: DataFrame, now: Column, half_life_secs: float = 604_800.0) -> DataFrame:
    """Edges at a time: each event's strength decayed to it, summed."""
    lost = F.exp((now - F.col("ts")) * F.lit(-math.log(2) / half_life_secs))
    ends = events.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("strength") * lost).alias("w"), "ts")
    return ends.groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("activation_count"), F.max("ts").alias("last_activated"))


def refold(edges: DataFrame, events: DataFrame, now: Column, then: Column, half_life_secs: float = 604_800.0) -> DataFrame:
    """Edges known at `then` and events since, at `now`."""
    aged = edges.select("src", "dst", half_life(F.col("weight"), now - then, half_life_secs).alias("weight"), "activation_count", "last_activated")
    both = aged.unionByName(fold(events, now, half_life_secs))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("activation_count").alias("activation_count"), F.max("last_activated").alias("last_activated"))


def pruned(edges: DataFrame, least: float = 0.01) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: id, other, and the edge's further columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    one = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), *rest)
    return one.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), *rest))


def valid_at(edges: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Edges valid at a time: both ends of the interval count, null is open."""
    return edges.where((F.col(start).isNull() | (at >= F.col(start))) & (F.col(end).isNull() | (at <= F.col(end))))


def associations(edges: DataFrame, ids: DataFrame, least: float = 0.0) -> DataFrame:
    """id, other, weight of the edges of ids(id) of at least a weight."""
    return symmetric(edges).where(F.col("weight") >= least).join(ids.select("id").distinct(), "id")


def neighbors(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "other")
    return associations(edges, ids).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def traverse(edges: DataFrame, anchors: DataFrame, hops: int = 2, k: int = 20) -> DataFrame:
    """anchor, id, hop, weight: the k nodes within some hops with the largest product of weights at their first hop; anchors weigh 1.

    Weights are not negative. A node is walked on from only where the heaviest edge could still lead to one of the k best.
    """
    links = symmetric(edges).select("id", "other", "weight")
    most = F.lit(edges.agg(F.max("weight")).first()[0] or 0.0)
    seen = anchors.select(F.col("id").alias("anchor"), F.col("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("weight")).distinct()
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("weight"), "id"))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1)
        if hop > 1:
            least = seen.withColumn("rank", best).where(F.col("rank") == k).select("anchor", F.col("weight").alias("least"))
            front = front.join(least, "anchor", "left").where(F.col("least").isNull() | (F.col("weight") * most >= F.col("least")))
        step = front.select("anchor", "id", F.col("weight").alias("w")).join(links, "id")
        found = step.groupBy("anchor", F.col("other").alias("id")).agg(F.max(F.col("w") * F.col("weight")).alias("weight"))
        new = found.join(seen.select("anchor", "id"), ["anchor", "id"], "left_anti").select("anchor", "id", F.lit(hop).alias("hop"), "weight")
        seen = written(seen.unionByName(new), "walk")
    return seen.withColumn("rank", best).where(F.col("rank") <= k)


def subgraph(edges: DataFrame, ids: DataFrame, least: float = 0.0, with_neighbors: bool = False) -> DataFrame:
    """Edges heavier than a weight with both ends in ids, or in ids and their neighbours."""
    nodes = ids.select("id").distinct()
    if with_neighbors:
        nodes = nodes.unionByName(associations(edges, ids, least).select(F.col("other").alias("id"))).distinct()
    heavy = edges.where(F.col("weight") > least)
    return heavy.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")


def remove_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def set_columns(edges: DataFrame, changes: DataFrame, *names: str) -> DataFrame:
    """Overwrite columns (relationship, validity) of existing edges by changes(src, dst, names...); unknown edges are left out."""
    told = changes.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_set"))
    joined = edges.join(told, ["src", "dst"], "left")
    cols = [F.when(F.col("_set"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) if n in names else F.col(n) for n in edges.columns]
    return joined.select(*cols)


def edge_counts(edges: DataFrame) -> DataFrame:
    """kind, n_edges, n_activations; edges without a kind are of co-activation."""
    return edges.groupBy(F.coalesce("kind", F.lit("co_activation")).alias("kind")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("activation_count").alias("n_activations"))


def edge(edges: DataFrame, a: int, b: int) -> DataFrame:
    """The edge between two nodes, whichever comes first; no row if there is none."""
    return edges.where((F.least("src", "dst") == min(a, b)) & (F.greatest("src", "dst") == max(a, b)))


def boost(results: DataFrame, edges: DataFrame, cap: float = 0.4) -> DataFrame:
    """query_id, id, boost, superseded: weights of edges to other results of the query, typed edges more, superseding ones counted.

    results(query_id, id); edges have kind (null, supersedes or another type) and, for supersedes, src is the newer side.
    """
    directed = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight", "kind", F.lit(True).alias("newer")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "weight", "kind", F.lit(False).alias("newer"))
    )
    # pairs are made among a query's few results and then looked up, so that a node with many edges is not told to every query
    pairs = results.select("query_id", "id").join(results.select("query_id", F.col("id").alias("other")), "query_id").where("id <> other")
    mine = pairs.join(directed, ["id", "other"])
    extra = F.when((F.col("kind") == "supersedes") & F.col("newer"), 0.1).when(F.col("kind").isNotNull() & (F.col("kind") != "supersedes"), 0.05).otherwise(0.0)
    older = F.count_if((F.col("kind") == "supersedes") & ~F.col("newer"))
    return mine.groupBy("query_id", "id").agg(F.least(F.sum(F.col("weight") + extra), F.lit(cap)).alias("boost"), older.alias("superseded"))


# ---------------------------------------------------------------- label views


def label_counts(rows: DataFrame, least: int = 1) -> DataFrame:
    """label, n_members from rows(id, labels)."""
    return rows.select("id", F.explode("labels").alias("label")).groupBy("label").agg(F.countDistinct("id").alias("n_members")).where(F.col("n_members") >= least)


def shared_members(rows: DataFrame, least: int = 1) -> DataFrame:
    """label_a < label_b, n_shared: ids that carry both. Pairs are made within a row's own few labels, never within a label."""
    pairs = rows.select("id", F.explode("labels").alias("label_a"), "labels").select("id", "label_a", F.explode("labels").alias("label_b")).where("label_a < label_b").distinct()
    return pairs.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= least)


def overview(rows: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """label, n_members and the ids of its most important members; rows(id, labels, importance)."""
    flat = rows.select("id", "importance", F.explode("labels").alias("label"))
    order = Window.partitionBy("label").orderBy(F.desc("importance"), "id")
    best = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    members = best.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("top_ids"))
    return label_counts(rows, least).join(members, "label")


def merged(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
