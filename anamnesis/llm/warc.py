"""WARC archives in ZIP packages, read by range without extraction (operator 3).

write_packages() puts a gzip member per record into archive/data.warc.gz and a line per record (offset,
length, record id) into indexes/index.cdxj; both members are stored, so that a record's bytes lie in the
ZIP file as they are. The reader parses the end-of-directory record (and its ZIP64 form), the central
directory with ZIP64 extra fields and the local header, loads the index and reads single records.

Equal payloads of at least min_bytes have one response record, that of the largest page_id; the others
are revisit records without the payload. Defined cases: null html is empty; a null page_id is smaller
than any other and such a row is a response only where no row of the group has an id, or where the
payload is small; rows that repeat a page_id and a payload are treated alike; an empty table gives no package.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, slices
from .token_store import opened

MIN_REVISIT_BYTES = 1000
#: A package ends at so many bytes or records, which bounds its index, too.
PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 30, 250_000
#: Repeated digests (20 bytes and an id each) of which so many may be broadcast; more go through a join.
BROADCAST = 500_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_ID = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP


class StoredZip:
    """Writes stored members one after the other to a stream; sizes are ZIP64, so no member is too large."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # sizes and checksum follow the data (flag bit 3); the extra field announces their 64-bit form
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 33, 0, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        m = self.members[-1]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._write(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._write(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 33, crc, _FULL32, _FULL32, len(raw), len(extra), 0, 0, 0, 0, _FULL32) + raw + extra)
        n, size, end = len(self.members), self.at - start, self.at
        self._write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._write(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._write(_END + struct.pack("<HHHHIIH", 0, 0, min(n, _FULL16), min(n, _FULL16), _FULL32, _FULL32, 0))


class ZipDirectory:
    """Where the members of a ZIP file lie. file has size() and read_at(n, offset)."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail_at = max(0, size - 22 - _FULL16 - 20)
        tail = file.read_at(size - tail_at, tail_at)
        at = self._end(tail)
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR64:
            (end64,) = struct.unpack_from("<Q", tail, at - 12)
            head = file.read_at(56, end64)
            if head[:4] != _END64:
                raise ValueError("the ZIP64 end record is not where its locator says")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
        elif n == _FULL16 or start == _FULL32 or length == _FULL32:
            raise ValueError("a ZIP64 directory without locator")
        self.members: dict[str, dict] = {}
        raw, p = file.read_at(length, start), 0
        for _ in range(n):
            if raw[p : p + 4] != _CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method, _, _, crc, packed, plain, a, b, c, _, _, _, at = struct.unpack_from("<HHHHIIIHHHHHII", raw, p + 8)
            name = raw[p + 46 : p + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
            plain, packed, at = self._wide(raw[p + 46 + a : p + 46 + a + b], plain, packed, at)
            self.members[name] = {"method": method, "crc": crc, "size": plain, "packed": packed, "header": at}
            p += 46 + a + b + c

    @staticmethod
    def _end(tail: bytes) -> int:
        at = tail.rfind(_END)
        while at >= 0:
            if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return at
            at = tail.rfind(_END, 0, at)
        raise ValueError("not a ZIP file: no end record")

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, at: int) -> tuple[int, int, int]:
        p = 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                q, got = p + 4, []
                for v in (plain, packed, at):
                    if v == _FULL32:
                        (v,) = struct.unpack_from("<Q", extra, q)
                        q += 8
                    got.append(v)
                return tuple(got)
            p += 4 + n
        return plain, packed, at

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes in the file."""
        m = self.members[name]
        if m["method"] != 0:
            raise ValueError(f"{name} is compressed: its records cannot be read by range")
        head = self.file.read_at(30, m["header"])
        if head[:4] != _LOCAL:
            raise ValueError(f"{name}: no local header")
        a, b = struct.unpack_from("<HH", head, 26)
        return m["header"] + 30 + a + b, m["size"]


# ---------------------------------------------------------------- WARC


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. HTTP headers are not known, so the block is the payload itself (a resource in all but name)."""
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:n]


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_type, refers_to.

    The largest id of each repeated payload is counted by digest and written. It goes to the pages, so that no payload is
    shuffled; only where there are too many repeated payloads for that, the pages of at least min_bytes are joined by digest,
    which Spark can split where a payload is hot.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    narrow = pages.select("page_id", F.unhex(F.sha1(body)).alias("_d"), F.octet_length(body).alias("_n")).where(F.col("_n") >= min_bytes)
    first = saved(narrow.groupBy("_d").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_d", "_first"), "warc-first")
    same = F.unhex("digest") == F.col("_d")
    if first.count() <= BROADCAST:
        joined = rows.join(F.broadcast(first), same, "left")
    else:
        joined = rows.where(F.col("payload_bytes") >= min_bytes).join(first, same, "left").unionByName(rows.where(F.col("payload_bytes") < min_bytes), allowMissingColumns=True)
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


class PackageWriter:
    def __init__(self, uri: str) -> None:
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        # each attempt writes a file of its own; the last to end gives the package its name
        self.temp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.uri, self.zip, self.index, self.n = uri, StoredZip(self.fs.open_output_stream(self.temp)), bytearray(), 0
        self.zip.begin(DATA)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index += json.dumps({"offset": self.zip.members[0][3], "length": len(raw), "id": page_id}).encode() + b"\n"
        self.zip.add(raw)
        self.n += 1

    def full(self) -> bool:
        return self.n >= PACKAGE_RECORDS or self.zip.at >= PACKAGE_BYTES

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.add(bytes(self.index))
        self.zip.end()
        self.zip.close()
        self.zip.out.close()
        self.fs.move(self.temp, self.path)
        return self.uri, self.n


def write_packages(pages: DataFrame, out: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as ZIP packages; returns package, uri and n_records of each."""
    out = out or shared_dir(pages.sparkSession, "warc")
    schema = pa.schema([("package", pa.int64()), ("uri", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, now = TaskContext.get().partitionId(), 0, None

        def told(w: PackageWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(((part << 20) + k, *w.close()), schema, strict=True)], schema=schema)

        for b in batches:
            for x in slices(b):
                for r in x.to_pylist():
                    now = now or PackageWriter(f"{out}/package-{part:06d}-{k:04d}.wacz")
                    payload = b"" if r["record_type"] == "revisit" else r["payload"]
                    now.add(r["page_id"], gzip.compress(record(r["record_type"], r["page_id"], r["url"], payload, r["digest"], r["payload_bytes"], r["refers_to"]), 6, mtime=0))
                    if now.full():
                        yield told(now)
                        now, k = None, k + 1
        if now:
            yield told(now)

    told = marked(pages, min_bytes).mapInArrow(run, "package long, uri string, n_records long").collect()  # a row per package
    return pages.sparkSession.createDataFrame(sorted(told), "package long, uri string, n_records long")


class PackageReader:
    def __init__(self, uri: str) -> None:
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        self.zip = ZipDirectory(self.file)
        self.data, self.data_size = self.zip.locate(DATA)

    def index(self) -> Iterator[dict]:
        """The lines of the index member, read in parts."""
        at, size = self.zip.locate(INDEX)
        crc, rest, end = 0, b"", at + size
        while at < end:
            part = self.file.read_at(min(1 << 20, end - at), at)
            crc, at = zlib.crc32(part, crc), at + len(part)
            *lines, rest = (rest + part).split(b"\n")
            yield from map(json.loads, lines)
        if crc != self.zip.members[INDEX]["crc"]:
            raise ValueError("the index member's checksum differs")

    def record(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        if offset + length > self.data_size:
            raise ValueError("an index line points beyond its member")
        return parse(gzip.decompress(self.file.read_at(length, self.data + offset)))


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(digits) if digits else None


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and block of every record, by range reads."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                reader, rows, held = PackageReader(uri), [], 0
                for line in reader.index():
                    h, block = reader.record(line["offset"], line["length"])
                    rows.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-bytes"]), block))
                    held += len(block) + 200
                    if held >= 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, min(packages.count(), 4096))
    kinds = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, block binary"
    return packages.select("uri").repartition(n).mapInArrow(run, kinds)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_packages(write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    # a response's size and digest are taken from its block, a revisit's from its headers
    own = F.col("record_type") == "response"
    size = F.when(own, F.octet_length("block").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select("page_id", size.alias("payload_bytes"), F.when(own, F.sha1("block")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d, n) END AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM q
"""
}
