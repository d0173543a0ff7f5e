"""Bounded-space online packing of token ids into sequences of one length (operator 2).

Each partition keeps a fixed number of open windows. A piece goes where it leaves the least room; where
it fits nowhere and all windows are open, the fullest is emitted, topped up with the head of the piece
if at least min_cut ids have room there. A partition's last open windows are run together into whole
sequences; what remains, less than one sequence a partition, is merged in a final step, so that padding
is left only in gaps below min_cut and in one sequence for every MERGE_PARTS partitions.

Defined cases: a null text is empty and is only its end id; null ids pass through; repeated rows are
packed each; an empty table gives no sequence; texts of any length are cut into as many pieces as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, saved, slices
from .tokens import ENCODE_ROWS, encoder, tokenizer_file

SEQUENCE = 2048
OPEN_WINDOWS = 64
MIN_CUT = 16
#: Partitions whose last incomplete sequences one task of the final merge takes.
MERGE_PARTS = 1024
_MERGED = 1 << 30


class Packer:
    """The open windows of one partition. close() gets (pieces, ids) of each sequence that is complete."""

    def __init__(self, size: int, windows: int, min_cut: int) -> None:
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.open: list[list] = []  # [room, pieces, ids]
        self.done: list[tuple[list, list]] = []

    def _put(self, window: list, piece: tuple) -> None:
        doc, start, ids, total = piece
        window[1].append((doc, start, len(ids), self.size - window[0], total))
        window[2].append(ids)
        window[0] -= len(ids)
        if window[0] == 0:
            self._emit(window)

    def _emit(self, window: list) -> None:
        for i, w in enumerate(self.open):
            if w is window:
                del self.open[i]
                break
        self.done.append((window[1], window[2]))

    def _fresh(self) -> list:
        self.open.append([self.size, [], []])
        return self.open[-1]

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            n = len(ids)
            if n >= self.size:  # a whole sequence of its own
                self.done.append(([(doc, start, self.size, 0, total)], [ids[: self.size]]))
                start, ids = start + self.size, ids[self.size :]
                continue
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                return self._put(min(fits, key=lambda w: w[0]), (doc, start, ids, total))
            if len(self.open) < self.windows:
                return self._put(self._fresh(), (doc, start, ids, total))
            fullest = min(self.open, key=lambda w: w[0])
            room = fullest[0]
            if room >= self.min_cut:
                self._put(fullest, (doc, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            else:
                self._emit(fullest)

    def add(self, doc, ids: np.ndarray) -> None:
        self.place(doc, 0, ids, len(ids))

    def finish(self) -> tuple[list, list]:
        """Run the open windows together into whole sequences; the incomplete last one is returned."""
        rest = [(doc, start, ids, total) for _, pieces, parts in self.open for (doc, start, _, _, total), ids in zip(pieces, parts, strict=True)]
        self.open = []
        return fill(rest, self.size, self.done)


def fill(pieces: list[tuple], size: int, done: list) -> tuple[list, list]:
    """Lay pieces (doc, start, ids, doc's ids) end to end, cut at every size-th id."""
    told, parts, room = [], [], size
    for doc, start, ids, total in pieces:
        while len(ids):
            n = min(room, len(ids))
            told.append((doc, start, n, size - room, total))
            parts.append(ids[:n])
            start, ids, room = start + n, ids[n:], room - n
            if room == 0:
                done.append((told, parts))
                told, parts, room = [], [], size
    return told, parts


def _schema(kind: str) -> str:
    return f"sequence_id long, n_tokens long, pieces array<struct<doc_id: {kind}, start: long, length: long, offset: long, doc_tokens: long>>, ids binary, rest_ids binary, part long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE, windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """Sequences: sequence_id, n_tokens, pieces and ids (little-endian unsigned 32-bit), written to the shared folder.

    docs has doc_id and text; tokenizer is the path of a file of the tokenizers library.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = _schema(kind)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    names = ("doc_id", "start", "length", "offset", "doc_tokens")

    def batch(rows: list[tuple], part: int, at: int, whole: bool = True) -> pa.RecordBatch:
        blobs = [b"".join(x.tobytes() for x in parts) for _, parts in rows]
        none = [None] * len(rows)
        cols = [
            [(part << 32) + at + i for i in range(len(rows))],
            [len(b) // 4 for b in blobs],
            [[dict(zip(names, p, strict=True)) for p in pieces] for pieces, _ in rows],
            blobs if whole else none,
            none if whole else blobs,
            [part] * len(rows),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, p, enc = TaskContext.get().partitionId(), 0, Packer(size, windows, min_cut), encoder(tokenizer, end_id)
        for b in batches:
            for x in slices(b, ENCODE_ROWS):
                rows = x.to_pydict()
                for doc, ids in zip(rows["doc_id"], enc.encode(rows["text"]), strict=True):
                    p.add(doc, ids)
                    if len(p.done) >= 128:
                        yield batch(p.done, part, at)
                        at, p.done = at + len(p.done), []
        rest = p.finish()
        if p.done:
            yield batch(p.done, part, at)
        if rest[0]:
            yield batch([rest], part, at + len(p.done), whole=False)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rest, at = None, ([], []), 0
        for b in batches:
            done: list = []
            for row in b.to_pylist():
                group = row["part"] // MERGE_PARTS
                ids, pieces = np.frombuffer(row["rest_ids"], "<u4"), []
                for x in row["pieces"]:
                    pieces.append((x["doc_id"], x["start"], ids[x["offset"] : x["offset"] + x["length"]], x["doc_tokens"]))
                before = [(d, s, i, t) for (d, s, _, _, t), i in zip(*rest, strict=True)]
                rest = fill(before + pieces, size, done)
            if done:
                yield batch(done, _MERGED + group, at)
                at += len(done)
        if rest[0]:
            yield batch([rest], _MERGED + group, at)

    out = saved(docs.select("doc_id", "text").mapInArrow(packed, schema), "packed")
    left = out.where("rest_ids is not null").select("sequence_id", "n_tokens", "pieces", F.lit(None).cast("binary").alias("ids"), "rest_ids", "part")
    # one task for each MERGE_PARTS partitions: a row is at most one sequence, of which a partition leaves one
    last = left.groupBy(F.expr(f"part div {MERGE_PARTS}").alias("g")).applyInArrow(_grouped(merged, arrow), schema)
    cols = ("sequence_id", "n_tokens", "pieces", "ids")
    return out.where("rest_ids is null").select(*cols).unionByName(last.select(*cols))


def _grouped(fn, arrow):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(fn(iter(table.sort_by("part").combine_chunks().to_batches()))), schema=arrow)

    return run


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row per piece with the CRC-32 of its ids."""
    told = F.expr(
        "transform(pieces, p -> struct(p.doc_id as doc_id, p.start as start, p.length as length,"
        " crc32(substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))) as ids_crc32,"
        " p.doc_tokens as doc_tokens, p.offset as offset))"
    )
    flat = sequences.select("sequence_id", told.alias("ps")).select("sequence_id", F.explode("ps").alias("p"))
    return flat.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pieces_of(pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
