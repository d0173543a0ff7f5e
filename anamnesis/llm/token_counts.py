"""Delta-maintained token totals by source, language and tokenizer version (operator 8).

A batch of changes (inserts, deletes, revised counts) becomes signed contributions: a change of a
document that the ledger knows first takes back what the ledger holds of it. The contributions and their
sums by source, language and version are written to a folder of their own and count from the moment that
the next number of the log names them. A number is given out once: a writer that comes second computes its
batch anew, against a ledger that has the first one's, so that nothing is taken back twice. A batch whose
name is in the log does nothing. Totals are sums of the batches' sums: no document is read for them.
compact() replaces the batches so far by what they come to.

The log needs a store that refuses to move a file onto one that is there (HDFS does, and a local disk by
way of links). On stores that cannot, one writer at a time must be seen to from outside.

Defined cases: inserting a document that is known revises it; deleting or revising an unknown one:
deleting does nothing, revising inserts; of several changes of one document and version in a batch,
inserts and revisions are added up and a delete is outweighed by them; null sources, languages, texts and
ids are groups, empty texts and ids like others; an empty batch is committed empty; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ENCODED, documents, saved, shared_dir, slices
from .tokens import encoder, tokenizer_file

KEYS = ("source", "lang", "tokenizer_version")
_CONTRIBUTION = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
_SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: The versions that the registered query keeps: names of public tokenizers' files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "word_bpe_49k": "word_bpe_49k.json"}


def counts(docs: DataFrame, version: str, n_tokens: Column) -> DataFrame:
    """doc_id, source, lang, tokenizer_version and n_tokens from docs by an expression over its columns."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), n_tokens.alias("n_tokens"))


def bpe_counts(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """The same under each of tokenizers (version -> file of the tokenizers library), from one pass over docs."""
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer_version", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        for b in batches:
            for part in slices(b, ENCODED):
                texts = part["text"].to_pylist()
                for version, path in tokenizers.items():
                    n = pa.array(encoder(path, None).count(texts), pa.int64())
                    yield pa.RecordBatch.from_arrays([part["doc_id"], part["source"], part["lang"], pa.array([version] * len(texts)), n], schema=out)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return given.mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


class Ledger:
    """Committed batches below one folder of a shared store: log/<number> names batches and the folder of their rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._as_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._as_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def _log(self) -> list[dict]:
        root = self._as_path(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        for n in sorted(int(x) for x in names if x.isdigit()):
            if n not in self._known:  # an entry never changes
                stream = self._fs.open(self._as_path(f"{self.path}/log/{n:09d}"))
                self._known[n] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
        return [self._known[n] for n in sorted(self._known)]

    def _publish(self, number: int, entry: dict) -> bool:
        """Give the entry its number; False if another has it."""
        aside, final = f"{self.path}/log/_{uuid.uuid4().hex}", f"{self.path}/log/{number:09d}"
        out = self._fs.create(self._as_path(aside), False)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                plain = lambda p: self._as_path(p).toUri().getPath()
                try:
                    os.link(plain(aside), plain(final))
                    return True
                except FileExistsError:
                    return False
            return self._fs.rename(self._as_path(aside), self._as_path(final))
        finally:
            if self._fs.exists(self._as_path(aside)):
                self._fs.delete(self._as_path(aside), False)

    def batches(self) -> list[str]:
        return sorted(b for e in self._log() for b in e["batches"])

    def _parts(self, log: list[dict], part: str, schema: str) -> DataFrame:
        last = max((i for i, e in enumerate(log) if e["base"]), default=0)
        paths = [f"{self.path}/{e['data']}/{part}" for e in log[last:]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def contributions(self) -> DataFrame:
        return self._parts(self._log(), "contributions", _CONTRIBUTION)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and version; groups that have come down to nothing are left out."""
        return _net(self._parts(self._log(), "sums", _SUMS), *KEYS)

    def _write(self, name: str, rows: DataFrame) -> str:
        data = f"data/{name}-{uuid.uuid4().hex[:8]}"
        rows.select("doc_id", *KEYS, "n_docs", "n_tokens").write.option("compression", "zstd").parquet(f"{self.path}/{data}/contributions")
        wrote = self.spark.read.schema(_CONTRIBUTION).parquet(f"{self.path}/{data}/contributions")
        wrote.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{self.path}/{data}/sums")
        return data

    def _drop(self, data: str) -> None:
        self._fs.delete(self._as_path(f"{self.path}/{data}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes(change, doc_id, source, lang, tokenizer_version, n_tokens), change being insert, revise or
        delete (whose counts are ignored). False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        changes = changes.select("change", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "tokenizer_version", F.col("n_tokens").cast("long").alias("n_tokens"))
        while True:
            log = self._log()
            if any(batch in e["batches"] for e in log):
                return False
            data = self._write(batch, self._signed(changes, log))
            if self._publish(len(log), {"batches": [batch], "data": data, "base": False}):
                return True
            self._drop(data)  # another batch came first: what it told must be seen

    def _signed(self, changes: DataFrame, log: list[dict]) -> DataFrame:
        key = ["doc_id", "tokenizer_version"]
        rows = changes.where("change <> 'delete'").groupBy(*key, "source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        plus = rows.select("doc_id", *KEYS, "n_docs", "n_tokens")
        if not log:
            return plus
        # only what the batch touches is read on and summed up
        touched = changes.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
        before = self._parts(log, "contributions", _CONTRIBUTION)
        same = before.doc_id.eqNullSafe(touched._doc_id) & before.tokenizer_version.eqNullSafe(touched._tokenizer_version)
        held = _net(before.join(touched, same, "left_semi"), "doc_id", *KEYS)
        return plus.unionByName(held.select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))

    def compact(self) -> bool:
        """Put what all batches come to in their place, so that later commits and totals read one. False if a batch came between."""
        log = self._log()
        if not log:
            return True
        data = self._write("base", _net(self._parts(log, "contributions", _CONTRIBUTION), "doc_id", *KEYS))
        if not self._publish(len(log), {"batches": [], "data": data, "base": True}):
            self._drop(data)
            return False
        return True


def _net(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def changed(kind: str, rows: DataFrame) -> DataFrame:
    return rows.withColumn("change", F.lit(kind))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of documents with the text of one with a smaller id (null texts are empty; a null id is no one's first)."""
    hashed = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    # a written table beside the hot hashes: Spark can split the join
    first = saved(hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first"), "first-texts")
    return hashed.join(first, "h").where("doc_id <> first").select("doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizers, revise one's counts to those with an end id, delete exact copies, replay a batch."""
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark, shared_dir(spark, "token-ledger"))
    told = saved(bpe_counts(docs, {v: tokenizer_file(f) for v, f in VERSIONS.items()}), "token-counts")
    ledger.commit("1-load", changed("insert", told))
    ended = told.where(F.col("tokenizer_version") == "word_bpe_49k").withColumn("n_tokens", F.col("n_tokens") + 1)
    ledger.commit("2-end-ids", changed("revise", ended))
    versions = F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("tokenizer_version")
    none = F.lit(None).cast("string")
    gone = copies(docs).select("doc_id", none.alias("source"), none.alias("lang"), versions, F.lit(0).alias("n_tokens"))
    for _ in range(2):  # the second commit of a batch changes nothing
        ledger.commit("3-copies", changed("delete", gone))
    return ledger.totals()


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
