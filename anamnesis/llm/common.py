"""What the operators of this subpackage share: Arrow mapping, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that Python turns into objects at once, and bytes of their texts (a single longer text goes alone).
SLICE_ROWS = 128
SLICE_BYTES = 2_000_000
#: Rows where a slice goes to a tokenizer, which gains from repeated words.
ENCODED = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share.

    Where the setting is empty a temporary folder of this machine becomes the setting, but only if the executors are
    threads of the driver (local tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='anamnesis-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


_SCOPES: list[list[DataFrame]] = []


def saved(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that saved() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "saved_at", None):
            df.saved_at = None
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary():
    """Tables saved within go at its end, but for those that are handed to the function it gives."""
    mine: list[DataFrame] = []
    stay: list[DataFrame] = []
    _SCOPES.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        stay.append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPES.pop()
        discard(*[t for t in mine if not any(t is s for s in stay)])
        if _SCOPES:
            _SCOPES[-1].extend(stay)


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name like `name` that is not among those taken, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of its strings; a longer row goes alone."""
    weight = [0] * batch.num_rows
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            weight = [a + (b or 0) for a, b in zip(weight, pc.binary_length(c).to_pylist(), strict=True)]
    start = held = 0
    for i, w in enumerate(weight):
        if i > start and (i - start >= rows or held + w > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += w
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over slices of bounded rows and bytes: fn takes and returns a dict of column lists."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                got = fn(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def arrow_add(df: DataFrame, read: str, added: str, fn: Callable[[list], list[list]], rows: int = SLICE_ROWS) -> DataFrame:
    """df with further columns that fn makes from the values of the column `read`; the other columns never become Python objects."""
    kind = T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)
    out, at = to_arrow_schema(kind), df.columns.index(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                made = fn(part.column(at).to_pylist())
                cols = [c if c.type == f.type else c.cast(f.type) for c, f in zip(part.columns, out, strict=False)]
                cols += [pa.array(x, f.type) for x, f in zip(made, list(out)[len(cols) :], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, kind)


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
