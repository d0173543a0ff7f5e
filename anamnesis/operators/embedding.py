"""Embedders as plug-ins, a deterministic one without a model, and labels by prototypes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import rules as R
from ..functions import text as X
from .vectors import knn


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """Words and pairs of words hashed into a unit vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = (text or "").lower().split()
            for w in [*words, *map("_".join, zip(words, words[1:], strict=False))]:
                h = xxhash.xxh3_64_intdigest(w)
                row[h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embedded(texts: DataFrame, key: str, embed: Callable[[list[str]], np.ndarray], text: str = "text", rows: int = 512) -> DataFrame:
    """key, v of texts by an embedder that takes a list of texts; null texts have no vector."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                given = part.column(1).to_pylist()
                made = embed([t or "" for t in given])
                v = [None if t is None else x for t, x in zip(given, made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v, pa.list_(pa.float32()))], names=[key, "v"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, v array<float>")


def prototype_labels(rows: DataFrame, prototypes: DataFrame, threshold: float = 0.55, most: int = 10) -> DataFrame:
    """id, labels of rows(id, v): labels of prototypes(label, v) that are similar enough, the most similar first.

    The prototypes are the rows that are searched and the texts the queries, so that neither side is crossed with the other.
    """
    named = prototypes.select(F.xxhash64("label").alias("id"), "label", "v")
    found = knn(named, rows.select(F.col("id").alias("query_id"), "v"), most, threshold, keep_self=True).join(named.select("id", "label"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "label")
    placed = found.withColumn("n", F.row_number().over(order))
    return placed.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))


def prototypes(spark, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """label, v of the known prototypes under an embedder."""
    made = embed([words for _, words in R.PROTOTYPES])
    return spark.createDataFrame([(label, v.tolist()) for (label, _), v in zip(R.PROTOTYPES, made, strict=True)], "label string, v array<float>")


def first_tier(rows: DataFrame, protos: DataFrame, threshold: float = 0.55, config: Config = DEFAULT) -> DataFrame:
    """id, labels of rows(id, content, v): similar prototypes, the most similar first, then labels by keywords."""
    found = prototype_labels(rows.where("v is not null").select("id", "v"), protos, threshold, config.max_labels).select("id", F.col("labels").alias("_near"))
    own = F.coalesce(X.keyword_labels(F.col("content")), F.array().cast("array<string>"))
    both = F.array_distinct(F.concat(F.coalesce("_near", F.array().cast("array<string>")), own))
    return rows.select("id", "content").join(found, "id", "left").select("id", F.slice(both, 1, config.max_labels).alias("labels"))


def labels_of_queries(queries: DataFrame, protos: DataFrame, threshold: float = 0.50, config: Config = DEFAULT) -> DataFrame:
    """query_id, labels of queries(query_id, text, v): by keywords, and only where they tell nothing by prototypes."""
    told = queries.select("query_id", F.coalesce(X.query_labels(F.col("text")), F.array().cast("array<string>")).alias("_own"))
    mute = queries.join(told.where(F.size("_own") == 0).select("query_id"), "query_id", "left_semi").where("v is not null")
    found = prototype_labels(mute.select(F.col("query_id").alias("id"), "v"), protos, threshold, config.max_labels).select(F.col("id").alias("query_id"), F.col("labels").alias("_near"))
    return told.join(found, "query_id", "left").select("query_id", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_near", F.col("_own"))).alias("labels"))
