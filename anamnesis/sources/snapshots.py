"""Stores as folders of Parquet tables in numbered snapshots, and older and foreign forms of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .shared import published, small_text


class SnapshotStore:
    """Snapshots 0, 1, 2 … of all tables. A snapshot is a small file that names the folders of each table, so that it takes over
    what has not changed and an append writes the new rows only. A number is given out once: of two writers the second one
    builds on the first one's snapshot."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def versions(self) -> list[int]:
        root = self._path(f"{self.path}/snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _snapshot(self, version: int) -> dict:
        if version not in self._known:  # a snapshot never changes
            self._known[version] = json.loads(small_text(self.spark, f"{self.path}/snapshots/{version:09d}"))
        return self._known[version]

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        folders = {}
        for name, df in tables.items():
            if name not in schema.TABLES:
                raise KeyError(name)
            folders[name] = f"data/{name}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.path}/{folders[name]}")
        return folders

    def _commit(self, folders: dict[str, str], keep: bool, model: str | None) -> int:
        while True:
            have = self.versions()
            last = self._snapshot(have[-1]) if have else {"tables": {}, "model": ""}
            told = {name: [*(last["tables"].get(name, []) if keep or name not in folders else []), *([folders[name]] if name in folders else [])] for name in schema.TABLES}
            version = have[-1] + 1 if have else 0
            if published(self.spark, json.dumps({"tables": told, "model": last["model"] if model is None else model}), f"{self.path}/snapshots/{version:09d}"):
                return version

    def save(self, tables: dict[str, DataFrame], model: str | None = None) -> int:
        """The next snapshot; tables (and the model's name) that are not given are those of the last one."""
        return self._commit(self._write(tables), False, model)

    def append(self, table: str, rows: DataFrame) -> int:
        """A snapshot with more rows in one table."""
        return self._commit(self._write({table: rows}), True, None)

    def load(self, table: str, version: int | None = None, dim: int | None = None) -> DataFrame:
        """A table of a snapshot (the last by default); columns that it lacks are filled. With dim, vectors of another length raise."""
        have = self.versions()
        folders = self._snapshot(have[-1] if version is None else version)["tables"].get(table, []) if have else []
        if not folders:
            return self.spark.createDataFrame([], schema.TABLES[table])
        df = self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*[f"{self.path}/{f}" for f in folders])
        df = filled(df, schema.TABLES[table])
        if dim is not None and table == "vectors":
            odd = df.where(F.col("v").isNotNull() & (F.size("v") != dim)).limit(1).count()
            if odd:
                raise ValueError(f"vectors are not of length {dim}: the store was made with another embedder")
        return df

    def compact(self, table: str) -> int:
        """A snapshot whose table is in one folder."""
        return self.save({table: self.load(table)})

    def model(self) -> str | None:
        have = self.versions()
        return self._snapshot(have[-1])["model"] if have else None


def filled(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of a table: missing ones by default, nulls of defaulted ones too."""
    from pyspark.sql.types import _parse_datatype_string

    cols = []
    for f in _parse_datatype_string(ddl).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in schema.DEFAULTS:
            c = F.coalesce(c, F.lit(schema.DEFAULTS[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Memories from a file with a JSON array of objects."""
    return filled(spark.read.option("multiLine", True).json(path), schema.MEMORIES)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    """One text per memory with its fields in front, a folder for each id."""
    head = F.concat_ws("\n", F.lit("---"), F.format_string("id: %s", F.col("id").cast("string")), F.format_string("source: %s", "source"), F.format_string("category: %s", "category"), F.concat(F.lit("labels: ["), F.array_join("labels", ", "), F.lit("]")), F.lit("---"), F.lit(""), F.coalesce("masked_content", "content"))
    rows.select("id", head.alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a recorded log: a JSON array of {topic, msg_type, label, payload}; poses become sentences."""
    raw = spark.read.schema("topic string, msg_type string, label string, payload string").option("multiLine", True).json(path)
    pose = F.from_json("payload", "x double, y double, z double, frame string")
    other = F.when(F.col("msg_type") == "Image", "[image]").when(F.col("msg_type") == "Audio", "[audio]")
    text = F.when(F.col("msg_type") == "Pose", pose_text(pose["x"], pose["y"], pose["z"], pose["frame"])).when(F.col("msg_type") == "String", F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload"))).otherwise(F.coalesce("label", other))
    return raw.select("topic", "msg_type", text.alias("content"))


def pose_text(x, y, z, frame):
    return F.format_string("position: x=%.2f y=%.2f z=%.2f (frame: %s)", x, y, z, frame)
