import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from logweave.llm import warc
from logweave.llm.warc import Damaged, archive_pages, mark_revisits, page_of, read_records, read_warc, record, record_urn, write_warc

DATE = "2024-05-06T07:08:09Z"
SHAPE = "page_id long, url string, html string, Payload string, same int"


def test_page_ids_come_back_from_record_ids():
    for i in (None, 0, 1, -1, 12345, (1 << 62) - 1, 1 << 62, (1 << 63) - 1, -(1 << 63)):
        assert page_of(record_urn(i)) == i


def test_records_follow_the_format():
    raw = record(7, "http://x/a b\r\nX: y", b"hello", None, False, DATE) + record(9, None, b"hello", 7, True, DATE)
    plain = gzip.decompress(raw)
    first, _, rest = plain.partition(b"\r\n\r\n")
    lines = first.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and "WARC-Target-URI: http://x/a%20b%0D%0AX:%20y" in lines
    sha = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    assert f"WARC-Payload-Digest: sha1:{sha}" in lines and plain.count(b"hello") == 1
    one, two = read_records(io.BytesIO(raw))
    assert (one["type"], one["payload"], one["payload_bytes"], one["date"]) == ("response", b"hello", 5, DATE)
    assert (two["type"], two["payload"], two["payload_bytes"], two["payload_digest"]) == ("revisit", None, 5, sha)
    assert page_of(two["refers_to"]) == 7 and raw[two["place"] :][:2] == b"\x1f\x8b"


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 20])
def test_reader_takes_any_block_size(monkeypatch, step):
    monkeypatch.setattr(warc, "READ_BYTES", step)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n" * 50, bytes(range(256)) * 9]
    raw = b"".join(record(i, "u", p, None, False, DATE) for i, p in enumerate(payloads))
    assert [r["payload"] for r in read_records(io.BytesIO(raw))] == payloads
    assert list(read_records(io.BytesIO(b""))) == []


def _packed(plain):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def test_damage_is_found():
    whole = record(1, "u", b"payload", None, False, DATE)
    plain = gzip.decompress(whole)
    bad = [
        whole[:-9],
        _packed(plain.replace(b"payload\r", b"pazload\r")),
        _packed(plain.replace(b"Content-Length: 7", b"Content-Length: 8")),
        _packed(plain[:-6]),
        _packed(plain + b"more"),
        _packed(b"HTTP/1.1 200 OK\r\n\r\n"),
        b"no gzip at all",
    ]
    for raw in bad:
        with pytest.raises(Damaged):
            list(read_records(io.BytesIO(raw)))


def test_round_trip_of_odd_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    long = "läng" * 300_000
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u", long),
            (8, "u", long), (None, "u", "same"), (None, "u", "lone"), (6, "u", "twice"), (6, "u", "twice"), (7, "u", "ünï")]
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], SHAPE).repartition(3)
    folder = f"file://{tmp_path}/w"
    files = write_warc(df, folder)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(rows)
    got = read_warc(files, folder).collect()
    first = {"same": 3, "": 1, long: 4}
    want = []
    for i, _, html in rows:
        html = html or ""
        data, other = html.encode(), first.get(html) if first.get(html) != i else None
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((str(i), len(data), sha, "revisit" if other else "response", other, None if other else data))
    seen = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in got]
    key = lambda x: (x[0], x[2], x[3])
    assert sorted(((*a[:5], a[5] or b"") for a in seen), key=key) == sorted(((*a[:5], a[5] or b"") for a in want), key=key)
    less = archive_pages(df, least_bytes=5).filter("record_type = 'revisit'").select("page_id").collect()
    assert sorted(r[0] for r in less) == [8]


def test_groups_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i % 50}", "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SHAPE)
    one = sorted(tuple(r) for r in mark_revisits(df).drop("payload").collect())
    monkeypatch.setattr(warc, "small_side", lambda _: None)
    assert sorted(tuple(r) for r in mark_revisits(df).drop("payload").collect()) == one


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SHAPE)).collect() == []
