"""Token-id shards of independent zstandard frames with a trailing seek table (operator 6).

A shard holds the ids of a range of documents in ascending doc_id order as little-endian unsigned
32-bit integers: data frames, then a skippable frame with the document index, then the seek table of
the public seekable format with a checksum (low half of XXH64) for each frame. A reader takes the seek
table from the end of the file, the index, and then only the frames of the documents it is asked for.

Defined cases: null ids come first; equal ids are ordered by a hash of the text, then the text; a null text is empty and is only its
end id; an empty table gives an empty store; a document longer than a frame has a frame of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, shuffle_parts, slices
from .tokens import ENCODE_ROWS, encoder, tokenizer_file

#: Ids after which a frame ends.
FRAME_IDS = 1 << 16
#: Bytes of text of a shard.
SHARD_BYTES = 1 << 30
_SKIPPABLE, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


def opened(uri: str):
    """The file system and the path of a URI, whatever store it names."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    def __init__(self, uri: str) -> None:
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        # each attempt writes a file of its own; the last to end gives the shard its name
        self.temp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out, self.codec = self.fs.open_output_stream(self.temp), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []
        self.noted: list[tuple] = []
        self.wait: list[bytes] = []
        self.waiting, self.n_tokens = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.waiting and self.waiting + len(ids) > FRAME_IDS:
            self._frame()
        self.noted.append((doc_id or 0, doc_id is None, len(self.frames), self.waiting, len(ids)))
        if len(self.noted) >= 4096:
            self._index()
        self.wait.append(ids.astype("<u4", copy=False).tobytes())
        self.waiting, self.n_tokens = self.waiting + len(ids), self.n_tokens + len(ids)

    def _frame(self) -> None:
        raw = b"".join(self.wait)
        data = self.codec.compress(raw)
        self.out.write(data)
        self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.wait, self.waiting = [], 0

    def _index(self) -> None:
        self.index.append(np.array(self.noted, _INDEX))
        self.noted = []

    def close(self) -> int:
        if self.wait:
            self._frame()
        self._index()
        index = self.codec.compress(np.concatenate(self.index).tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _FOOTER)
        self.out.write(struct.pack("<II", _TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.n_tokens


class ShardReader:
    """Random access to one shard by ranged reads."""

    def __init__(self, uri: str) -> None:
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _FOOTER or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        rows = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", rows))
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype(int)
        self.codec = zstandard.ZstdDecompressor()
        blob = self.file.read_at(self.frames[-1][0] - 8, int(self.starts[n - 1]) + 8)
        self._held(blob, n - 1)
        self.index = np.frombuffer(self.codec.decompress(blob), _INDEX)
        self.now: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _held(self, data: bytes, k: int) -> None:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k}: checksum differs")

    def frame(self, k: int) -> np.ndarray:
        if self.now[0] != k:
            size, raw, _ = self.frames[k]
            data = self.codec.decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=raw)
            self._held(data, k)
            self.now = (k, np.frombuffer(data, "<u4"))
        return self.now[1]

    def ids(self, row) -> np.ndarray:
        return self.frame(int(row["frame"]))[int(row["at"]) : int(row["at"]) + int(row["n"])]

    def __iter__(self):
        for row in self.index:
            yield (None if row["is_null"] else int(row["doc_id"])), self.ids(row)

    def find(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The given documents' ids; only their frames are read."""
        real = self.index[self.index["is_null"] == 0]
        for row in real[np.isin(real["doc_id"], np.fromiter(wanted, np.int64))]:
            yield int(row["doc_id"]), self.ids(row)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, out: str | None = None, shards: int | None = None) -> DataFrame:
    """Write docs(doc_id, text) as shards in ascending doc_id order.

    Returns the manifest, a row per shard: shard, uri, n_docs, n_tokens, start (ids in the shards before).
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, enc, n = TaskContext.get().partitionId(), None, encoder(tokenizer, end_id), 0
        uri = f"{out}/shard-{part:06d}.zst"
        for b in batches:
            for x in slices(b, ENCODE_ROWS):
                rows = x.to_pydict()
                writer = writer or ShardWriter(uri)
                for doc, ids in zip(rows["doc_id"], enc.encode(rows["text"]), strict=True):
                    writer.add(doc, ids)
                    n += 1
        if writer:
            yield pa.RecordBatch.from_pydict({"shard": [part], "uri": [uri], "n_docs": [n], "n_tokens": [writer.close()]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # the hash parts rows of one id, should it be on very many
    ordered = rows.repartitionByRange(shards or shard_count(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    # a row per shard comes to the driver, not per document
    told = sorted(ordered.mapInArrow(run, "shard long, uri string, n_docs long, n_tokens long").collect())
    rows, start = [], 0
    for r in told:
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "shard long, uri string, n_docs long, n_tokens long, start long")


def shard_count(docs: DataFrame) -> int:
    """Shards of bounded size, and no fewer than there are shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), -(-size // SHARD_BYTES))


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents of the shards, or of a few."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                reader, rows, held = ShardReader(row["uri"]), [], 0
                before = row["start"] + np.concatenate([[0], np.cumsum(reader.index["n"], dtype=np.int64)])
                pick = np.arange(len(reader.index))
                if doc_ids is not None:
                    pick = pick[(reader.index["is_null"] == 0) & np.isin(reader.index["doc_id"], np.array(doc_ids, np.int64))]
                for k in pick:
                    x = reader.index[k]
                    ids = reader.ids(x).tobytes()
                    rows.append((None if x["is_null"] else int(x["doc_id"]), int(before[k]), int(x["n"]), ids))
                    held += len(ids)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    n = max(1, min(manifest.count(), 4096))
    return manifest.select("uri", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_store": op6_token_store}
ORACLES: dict[str, str] = {}
