import base64
import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathlore.llm import warc
from pathlore.llm.queries import op9_warc

SF = "/root/testdata/sf0.001"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    low = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        low.setdefault(r.html, r.page_id)
    want = set()
    for r in pages:
        b = r.html.encode()
        to = low[r.html] if len(b) >= 100 and low[r.html] != r.page_id else None
        want.add((r.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    assert {tuple(r) for r in op9_warc(spark, SF).collect()} == want


def test_edges(spark, tmp_path):
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10
    rows = [(3, None, "é" * 20000, 1), (1, "http://x\r\ny z/é", "é" * 20000, 2), (1, "u", "é" * 20000, 3), (4, "u", None, 4), (5, "u", "", 5), (None, "u", "a" * 100, 6), (7, "u", "a" * 100, 7), (8, "u", "b" * 99, 8), (9, "u", "b" * 99, 9), (10, "u", tricky, 10), (11, "u", tricky, 11)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    warc.write_archive(df, str(tmp_path / "a"), 1001)
    back = warc.read_archive(spark, str(tmp_path / "a"))
    payloads = [(r.page_id, r.payload.decode()) for r in back.collect() if r.record_type == "response"]
    assert sorted(payloads, key=str) == sorted([(1, "é" * 20000), (1, "é" * 20000), (4, ""), (5, ""), (7, "a" * 100), (8, "b" * 99), (9, "b" * 99), (10, tricky)], key=str)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.error) for r in warc.digests(back).collect()}
    assert got == {(3, 40000, "revisit", 1, None), (1, 40000, "response", None, None), (4, 0, "response", None, None), (5, 0, "response", None, None), (None, 100, "revisit", 7, None), (7, 100, "response", None, None), (8, 99, "response", None, None), (9, 99, "response", None, None), (10, len(tricky), "response", None, None), (11, len(tricky), "revisit", 10, None)}
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.digests(warc.read_archive(spark, str(tmp_path / "b"))).count() == 0


@given(st.binary(max_size=300), st.integers(1, 40), st.integers(1, 40))
def test_round_trip(payload, segment, chunk):
    assert warc.dechunked(warc.chunked(payload, chunk)) == payload
    digest = hashlib.sha256(payload).hexdigest()
    raw = b"".join(r + warc.END for r in warc.records("x", "u", payload, digest, None, segment))
    parts = [(int(h.get("warc-segment-number", 1)), b, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None) for h, b in warc.parse(raw)]
    digest = f"sha256:{digest}"
    assert warc.payload_of(parts[::-1], digest) == payload
    if len(parts) > 1:
        for broken in (parts[1:], parts[:-1], [*parts, parts[-1]]):
            with pytest.raises(ValueError):
                warc.payload_of(broken, digest)


def record(kind, rid, block, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + warc.END


def test_foreign_and_broken_archives(spark, tmp_path):
    body = b"hello"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    head = "Content-Type: application/http; msgtype=response\r\n"
    good = [record("warcinfo", "urn:uuid:1", b"software: x\r\n"), record("response", "urn:uuid:2", http, f"{head}WARC-Payload-Digest: sha1:{sha1}\r\n"), record("response", "urn:uuid:3", http, f"{head}WARC-Payload-Digest: sha1:{'A' * 32}\r\n"), record("metadata", "urn:pathlore:page:x:1", b"m")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, good)))  # a member for each record
    (tmp_path / "b.warc").write_bytes(good[0].replace(b"uuid:1", b"uuid:9") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"no archive"))
    (tmp_path / "d.gz").write_bytes(gzip.compress(good[1].replace(b"uuid:2", b"uuid:8"))[:-30])
    (tmp_path / "e.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got["urn:uuid:1"].payload == b"software: x\r\n" and got["urn:uuid:1"].record_type == "warcinfo"
    assert got["urn:uuid:2"].payload == body and got["urn:uuid:2"].payload_digest == hashlib.sha256(body).hexdigest() and got["urn:uuid:2"].page_id is None
    assert got["urn:uuid:3"].error == "digest differs" and got["urn:pathlore:page:x:1"].page_id is None and "urn:uuid:9" in got
    wrong = [r.error for k, r in got.items() if k.endswith("#rest")]
    assert len(wrong) == 3 and all(wrong)


def test_revisits_refer_to_records_that_are_there(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 200) for i in (4, 2, 9)], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("*.gz"))
    heads = [h for h, _ in warc.parse(raw)]
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == 3 and [h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit"] == [True, True]


def test_pieces_of_any_size(monkeypatch):
    """Records come out alike however the file is packed and cut into pieces, and as far as a broken one goes."""
    import gzip
    import random

    rng = random.Random(4)
    heads = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d" % n for n in (0, 5, 4000, 70_000)]
    blocks = [b"", b"\r\n\r\nx", rng.randbytes(4000), b"ab" * 35_000]
    whole = [h + warc.END + b + warc.END for h, b in zip(heads, blocks, strict=True)]
    plain = b"".join(whole)
    for piece in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        for packed in (plain, gzip.compress(plain), b"".join(map(gzip.compress, whole)), gzip.compress(whole[0] + whole[1]) + whole[2] + whole[3]):
            if piece == 1 and packed is plain:
                packed = packed[: len(whole[0]) + len(whole[1])]
            data = warc.Inflated(packed)
            got = [b for _, b in warc.parse(data)]
            assert got == blocks[: len(got)] and len(got) == (2 if len(packed) < 4000 and packed[:4] == b"WARC" else 4) and data.error is None
        for cut, error in ((gzip.compress(plain)[:-3000], "gzip data is cut short"), (gzip.compress(plain)[:-8] + b"12345678", "gzip data is damaged")):
            data, got = warc.Inflated(cut), []
            try:
                for _, b in warc.parse(data):
                    got.append(b)
            except ValueError:
                pass
            assert data.error == error and got == blocks[: len(got)] and (len(got) >= 2 or piece > 1000)


def test_ids_that_are_no_numbers(spark):
    pages = spark.createDataFrame([("7", "u", "a" * 200), ("x", "u", "b" * 200), (None, None, "a" * 200)], "page_id string, url string, html string")
    path = warc.archive_path(spark)
    warc.write_archive(pages, path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.digests(warc.read_archive(spark, path)).collect())
    assert got == [(0, "response", None), (0, "revisit", 7), (7, "response", None)]
