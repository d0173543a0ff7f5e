import hashlib
import io
import zipfile

import pytest

from anamnesis.llm.warc import DATA, PackageReader, StoredZip, ZipDirectory, read_packages, write_packages

BIG = "<p>é</p>" * 200


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_our_zip_is_readable_by_others_and_theirs_by_us():
    out = io.BytesIO()
    z = StoredZip(out)
    for name in ("a", "dir/é"):
        z.begin(name)
        z.add(b"xy")
        z.add(name.encode())
        z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.testzip() is None and other.read("dir/é") == b"xy" + "dir/é".encode()
    for comment, method in ((b"", zipfile.ZIP_STORED), (b"PK\x05\x06" + b"x" * 30, zipfile.ZIP_STORED)):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", method) as other:
            other.comment = comment
            other.writestr("m", b"hello")
            with other.open("wide", "w", force_zip64=True) as f:
                f.write(b"abc")
            other.writestr("deflated", b"x" * 99, zipfile.ZIP_DEFLATED)
        file = Bytes(made.getvalue())
        d = ZipDirectory(file)
        for name, want in (("m", b"hello"), ("wide", b"abc")):
            at, n = d.locate(name)
            assert file.read_at(n, at) == want
        with pytest.raises(ValueError):
            d.locate("deflated")
    with pytest.raises(ValueError):
        ZipDirectory(Bytes(b"no zip" * 99))


def test_many_members_need_the_64_bit_directory():
    out = io.BytesIO()
    z = StoredZip(out)
    for i in range(70_000):
        z.begin(str(i))
        z.add(b"1")
        z.end()
    z.close()
    d = ZipDirectory(Bytes(out.getvalue()))
    assert len(d.members) == 70_000
    at, n = d.locate("69999")
    assert (n, out.getvalue()[at : at + 1]) == (1, b"1")


def test_records_round_trip(spark):
    rows = [(1, "http://a/\r\nX", BIG), (2, None, BIG), (3, "u", "small"), (4, "u", "small"), (None, "u", BIG), (5, "u", None), (6, "u", ""), (2, "again", BIG), (7, "ü", BIG + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload", "3 as _d").repartition(2)
    packages = write_packages(pages)
    got = read_packages(packages).collect()
    assert len(got) == len(rows)
    told = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and html == BIG and i != 2
        want.append((str(i), "revisit" if again else "response", 2 if again else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert told == sorted(want)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.block).hexdigest() == r.payload_digest
    reader = PackageReader(packages.first().uri)
    line = list(reader.index())[-1]
    headers, _ = reader.record(line["offset"], line["length"])
    assert headers["warc-record-id"] == f"<urn:page:{'' if line['id'] is None else line['id']}>"
    assert reader.zip.locate(DATA)[1] > 0
    assert read_packages(write_packages(pages.limit(0))).count() == 0
