"""WARC archives: round trips, revisits, damaged files, and the query against SQL."""

import gzip
import io
import zlib
from base64 import b32encode
from hashlib import sha1

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, warc

LONG = "<p>" + "é日𝔘" * 500
PAGES = [(1, "http://a/x", LONG), (9, None, LONG), (4, "http://a/ b\r\n\x00", LONG), (2, "u", None), (3, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", "z" * 1200), (None, "u", "z" * 1200), (10, "u", "a\r\n\r\nWARC/1.1\r\n\x00" * 90000), (10, "u", LONG[:1100]), (10, "u", LONG[:1100])]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "WARC", 1, "k") for p in PAGES], "page_id long, url string, html string, payload string, keeper int, key string").repartition(3)


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def test_records_come_back_as_sql_has_them(spark, pages):
    got = warc.archived_and_read(pages)
    c = duckdb.connect()
    c.register("pages", pa.Table.from_pylist([{"page_id": a, "url": b, "html": h} for a, b, h in PAGES], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])))
    assert rows(got) == sorted(c.sql(warc.SQL).fetchall(), key=str)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {r[0]: (r[3], r[4]) for r in got.collect() if r[0] in (1, 4, 9, 5, 6)}
    assert kinds == {1: ("revisit", 9), 4: ("revisit", 9), 9: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert warc.archived_and_read(pages.limit(0)).count() == 0


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert rows(queries.op13_warc(spark, sf)) == sorted(c.sql(warc.SQL).fetchall(), key=str)


def test_text_ids_uris_and_payloads(spark, pages, tmp_path):
    named = pages.withColumn("page_id", F.concat(F.lit("é/<"), "page_id"))
    files = warc.write(named, f"file://{tmp_path}/more", file_bytes=600)
    assert files.count() > 4 and files.agg(F.sum("records")).first()[0] == len(PAGES)
    found = warc.read(files, payloads=True).where("record_type <> 'warcinfo'")
    whole = warc.resolved(found)
    got = rows(whole.select(warc.row_id(F.col("record_id")), "uri", F.col("payload").cast("string")))
    want = [(None if a is None else f"é/<{a}", b and b.replace(" ", "%20").replace("\r\n\x00", "%0D%0A%00"), h or "") for a, b, h in PAGES]
    assert got == sorted(want, key=str)
    assert whole.where("error IS NOT NULL").count() == 0
    assert warc.resolved(found.where("record_type = 'revisit'")).where("error IS NULL OR payload IS NOT NULL").count() == 0


def archive(*members: bytes) -> list[dict]:
    return list(warc.Reader(pa.BufferReader(b"".join(members)), "f"))


def test_members_are_ordinary_gzip():
    member = warc.page_record(5, "http://a/", b"body", 7, False)
    text = gzip.decompress(member)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nbody\r\n\r\n")
    assert f"WARC-Payload-Digest: sha1:{b32encode(sha1(b'body').digest()).decode()}\r\n".encode() in text
    assert b"Refers-To: <urn:row:7>" in gzip.decompress(warc.page_record(5, "u", b"body", 7, True))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_block_sizes_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    got = archive(*(warc.page_record(k, "u", b"%d\r\n\r\n" % k * k) for k in range(5)))
    assert [(r["record_id"], r["payload"], r["error"]) for r in got] == [(f"urn:row:{k}", b"%d\r\n\r\n" % k * k, None) for k in range(5)]
    assert [r["offset"] for r in got][1:] == [sum(r["member_bytes"] for r in got[:k]) for k in range(1, 5)]


def test_damage_is_named_and_passed_over():
    good = warc.page_record(1, "u", b"one")
    text = gzip.decompress(good)

    def packed(t: bytes) -> bytes:
        m = zlib.compressobj(6, zlib.DEFLATED, 31)
        return m.compress(t) + m.flush()

    bad = {
        "another digest": packed(text.replace(b"one\r\n", b"two\r\n")),
        "shorter": packed(text.replace(b"Content-Length: ", b"Content-Length: 9", 1)),
        "doesn't end": packed(text[:-4] + b"more\r\n\r\n"),
        "no content-length": packed(b"WARC/1.0\r\nA: b\r\n\r\n"),
        "no WARC header": packed(b"hello\r\n\r\n"),
        "header has no end": packed(b"WARC/1.0\r\n"),
        "HTTP header": packed(b"WARC/1.0\r\nContent-Type: application/http\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"),
        "invalid": good[:20] + b"\xff" * 12 + good[32:],
        "": b"not gzip" + warc.MAGIC + b"nor this",
    }
    for said, member in bad.items():
        got = archive(good, member, good)
        assert [r["error"] is None for r in got] == [True, False, True], said
        assert said in got[1]["error"] and got[2]["payload"] == b"one"
    cut = archive(good, good[:-9])
    assert cut[0]["error"] is None and "ends within" in cut[1]["error"] and len(cut) == 2
    assert archive() == []


def test_other_writers_records():
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: SHA1:" + sha1(b"abc").hexdigest().upper().encode() + b"\r\nWARC-Block-Digest: md5:x\r\nLong: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", filename="x") as f:
        f.write(text)
    got = archive(out.getvalue())
    assert got[0]["error"] is None and (got[0]["payload"], got[0]["record_id"], got[0]["payload_digest"]) == (b"abc", "urn:uuid:1", sha1(b"abc").hexdigest())


def test_a_file_that_grows_in_memory_is_read_in_steps(monkeypatch):
    """A payload that compresses a thousandfold passes in pieces of a block."""
    sizes = []
    plain = warc.Reader._member
    monkeypatch.setattr(warc.Reader, "_member", lambda self: (sizes.append(len(p)) or p for p in plain(self)))
    member = warc.page_record(1, "u", bytes(20_000_000))
    got = list(warc.Reader(pa.BufferReader(member), "f", payloads=False))
    assert got[0]["payload_bytes"] == 20_000_000 and got[0]["payload"] is None and max(sizes) <= warc.BLOCK
