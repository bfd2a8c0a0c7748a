import gzip
import hashlib
import io

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark.llm.common import key_in_table, key_table
from flowspark.llm.warc import RECORD, digest_chunks, mark_revisits, read_records, read_warc, record_head, warc_records, write_warc
from flowspark.sources.pcap import put_in_place
from tests.oracle import connect, same

PAYLOADS = [(1, b"a" * 100), (2, b"a" * 100), (2, b"a" * 100), (0, b"a" * 99), (9, b"a" * 99), (3, None), (4, b""), (None, b"a" * 100), (5, b"\r\n\r\nWARC/1.1\r\n" * 9), (6, bytes(range(256)) * 9000), (None, b"b" * 200), (None, b"b" * 200)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, p, "http://x/\r\ny", "clash") for i, p in PAYLOADS], "page_id long, payload binary, target_uri string, refers_to string")
    marked = warc_records(df, "page_id", "payload", chunk_bytes=1000)
    rows = marked.selectExpr("concat('urn:page:', coalesce(string(page_id), 'null')) record_id", "record_type", "target_uri", "'urn:page:' || refers_to refers_to", "payload_bytes", "payload_digest", "chunk_no", "data")
    write_warc(rows, str(tmp_path))
    got = {}
    for r in sorted(read_warc(spark, str(tmp_path)).collect(), key=lambda r: (r.record_id, r.record_type, r.payload_bytes, r.chunk_no)):
        got.setdefault((r.record_id, r.record_type), []).append(r)
    assert {k for k in got if k[1] == "revisit"} == {("urn:page:2", "revisit"), ("urn:page:null", "revisit")}
    assert all(r.refers_to == "urn:page:1" for r in got["urn:page:2", "revisit"]) and len(got["urn:page:2", "revisit"]) == 2
    assert got["urn:page:2", "revisit"][0].payload_bytes == 100
    for i, p in PAYLOADS:
        last = [r for r in got.get((f"urn:page:{i}", "response"), []) if r.is_last]
        if i is not None and i != 2:
            assert b"".join(r.data for r in got[f"urn:page:{i}", "response"]) == (p or b"")
            assert (last[0].payload_digest, last[0].payload_bytes) == (hashlib.sha256(p or b"").hexdigest(), len(p or b""))
    assert len([r for r in got["urn:page:null", "response"] if r.is_last]) == 2
    lengths = read_warc(spark, str(tmp_path), with_data=False).where("is_last").selectExpr("sum(payload_bytes)").first()[0]
    assert lengths == sum(len(p or b"") for _, p in PAYLOADS)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("*.warc.gz"))
    assert raw.count(b"WARC-Record-ID: <urn:") == len(PAYLOADS) and not list(tmp_path.glob("_attempt*"))


def test_jobs_add_or_replace(spark, tmp_path):
    records = lambda names: warc_records(spark.createDataFrame([(n, b"x" * n, None) for n in names], "page_id long, payload binary, target_uri string"), "page_id", "payload").selectExpr("string(page_id) record_id", "record_type", "target_uri", "string(refers_to) refers_to", "payload_bytes", "payload_digest", "chunk_no", "data")
    count = lambda: read_warc(spark, str(tmp_path)).where("is_last").count()
    write_warc(records([1, 2]), str(tmp_path))
    write_warc(records([3]), str(tmp_path))
    assert count() == 3
    write_warc(records([7, 8]), str(tmp_path), "overwrite")
    assert sorted(r.payload_bytes for r in read_warc(spark, str(tmp_path)).where("is_last").collect()) == [7, 8]
    with pytest.raises(Exception, match="digest"):
        write_warc(records([5]).withColumn("payload_digest", F.lit("0")), str(tmp_path))
    assert count() == 2


def test_moves_are_undone(tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    with pytest.raises(OSError):
        put_in_place(fs.LocalFileSystem(), str(tmp_path), [(f"{tmp_path}/a", f"{tmp_path}/part-1"), (f"{tmp_path}/none", f"{tmp_path}/part-2")], True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_digests_of_chunks(spark):
    rows = [(f"r{k}", n, bytes([k]) * (k if n else 3)) for k in range(1, 40) for n in range(k % 4 + 1)] + [("empty", 0, None)]
    got = {r.record_id: (r.payload_bytes, r.payload_digest) for r in digest_chunks(spark.createDataFrame(rows[::-1], "record_id string, chunk_no long, data binary")).collect()}
    whole = {}
    for name, _, data in rows:
        whole[name] = whole.get(name, b"") + (data or b"")
    assert got == {name: (len(d), hashlib.sha256(d).hexdigest()) for name, d in whole.items()}


def test_empty_and_broken(spark, tmp_path):
    empty = spark.createDataFrame([], RECORD)
    write_warc(empty, str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).count() == 0
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    whole = record_head("response", "urn:page:1", None, None, 10, None) + b"0123456789\r\n\r\n"
    assert [r[7] for r in read_records(io.BytesIO(whole * 2), 4)] == [b"0123", b"4567", b"89"] * 2
    with pytest.raises(EOFError):
        list(read_records(io.BytesIO(whole[:-8]), 4))


def test_query_matches_sql(spark, sf_dir):
    same(entry.queries()["op6_warc"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op6_warc"])


def record(kind, block, uri="http://a/", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "WARC-Target-URI": uri, "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def payloads(data, chunk_bytes=4):
    out = {}
    for name, kind, _, refers, size, digest, number, part, last in read_records(io.BytesIO(data), chunk_bytes):
        rows = out.setdefault((name, kind), [])
        assert number == len(rows) and (kind == "revisit" or size == sum(map(len, rows)) + len(part))
        rows.append(part)
        if last:
            assert kind == "revisit" or digest == hashlib.sha256(b"".join(rows)).hexdigest()
            out[name, kind] = (b"".join(rows), size, refers)
    return out


def test_archives_of_public_form():
    """What crawlers write: a warcinfo first, requests and metadata between, HTTP lengths that lie, chunked encoding, Latin-1."""
    html = b"<html>\xe9</html>"
    parts = b"6\r\n<html>\r\n8;x=y\r\n\xe9</html>\r\n0\r\nTrailer: x\r\n\r\n"
    http = lambda head, body: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body
    archive = record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields") + record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
    cases = {
        "lying": (http(b"Content-Length: 3\r\nX: \xe9\r\n", html), html), "none": (http(b"", html), html), "empty": (http(b"Content-Length: 0\r\n", b""), b""),
        "parts": (http(b"Transfer-Encoding: chunked\r\n", parts), b"<html>\xe9</html>"), "no parts": (http(b"Transfer-Encoding: chunked\r\n", html), html),
        "cut parts": (http(b"Transfer-Encoding: Chunked\r\n", b"ff\r\nabc"), b"abc"), "folded": (http(b"A: b\r\n c\r\n", b"1234"), b"1234"),
    }
    for name, (block, _) in cases.items():
        archive += record("response", block, WARC_Record_ID=f"<{name}>", Content_Type="application/http; msgtype=response") + record("metadata", b"fetchTimeMs: 1")
    archive += record("response", b"a. 1 IN A 1.2.3.4", "dns:a", WARC_Record_ID="<dns>", Content_Type="text/dns") + record("resource", b"\0\1bytes", WARC_Record_ID="<res>")
    archive += record("revisit", http(b"", b""), WARC_Record_ID="<again>", WARC_Refers_To="<none>", WARC_Payload_Digest="sha1:ABC", WARC_Profile="x") + record("conversion", b"text", WARC_Record_ID="<conv>")
    for chunk_bytes in (1, 4, 1 << 20):
        got = payloads(archive, chunk_bytes)
        assert {k: v[0] for k, v in got.items() if k[1] == "response"} == {(n, "response"): p for n, (_, p) in cases.items()} | {("dns", "response"): b"a. 1 IN A 1.2.3.4"}
        assert got["res", "resource"][0] == b"\0\1bytes" and got["conv", "conversion"][0] == b"text" and got["again", "revisit"] == (b"", 0, "none") and len(got) == len(cases) + 4
    with pytest.raises(EOFError):
        payloads(record("response", http(b"", html))[:-9])
    with pytest.raises(ValueError, match="no WARC"):
        payloads(b"<html>")


def test_names_of_other_columns(spark):
    rows = [(1, b"x" * 200, "a", "b", 1, "c", "d", "e"), (2, b"x" * 200, None, "b", 2, "c", "d", "e"), (3, b"y" * 200, "a", "b", 3, "c", "d", "e"), (4, None, "a", "b", 4, "c", "d", "e")]
    df = spark.createDataFrame(rows, "page_id long, payload binary, whole string, group_key string, `digest of row` long, id string, row string, `a.b` string")
    got = {r.page_id: r for r in warc_records(df, "page_id", "payload").collect()}
    assert set(warc_records(df, "page_id", "payload").columns) == {*df.columns, "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", "data"} - {"payload"}
    assert [(got[k].record_type, got[k].refers_to, got[k].payload_bytes, len(got[k].data)) for k in (1, 2, 3, 4)] == [("response", None, 200, 200), ("revisit", 1, 200, 0), ("response", None, 200, 200), ("response", None, 0, 0)]
    for k, *_, in rows:
        assert tuple(got[k][c] for c in df.columns if c != "payload") == tuple(v for c, v in zip(df.columns, rows[k - 1], strict=True) if c != "payload")
    marked = mark_revisits(df, "page_id", "payload")
    assert {(r.page_id, r.record_type, r["digest of row"], r.group_key, r["a.b"]) for r in marked.collect()} == {(1, "response", 1, "b", "e"), (2, "revisit", 2, "b", "e"), (3, "response", 3, "b", "e"), (4, "response", 4, "b", "e")}


def test_long_payloads_meet_or_stay(spark, tmp_path):
    """Payloads of several real chunks, shared ones and others; only those that may be shared are shuffled."""
    big = {k: hashlib.sha256(bytes([k])).digest() * 80_000 for k in range(4)}
    rows = [(k, big[k % 4 if k < 6 else 3]) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, payload binary").withColumn("target_uri", F.lit("http://x/"))
    marked = warc_records(df, "page_id", "payload").selectExpr("string(page_id) record_id", "record_type", "target_uri", "string(refers_to) refers_to", "payload_bytes", "payload_digest", "chunk_no", "data")
    write_warc(marked, str(tmp_path))
    got = {}
    for r in sorted(read_warc(spark, str(tmp_path)).collect(), key=lambda r: (r.record_id, r.chunk_no)):
        got.setdefault((int(r.record_id), r.record_type, r.refers_to and int(r.refers_to)), []).append(bytes(r.data))
    assert {k: b"".join(v) for k, v in got.items() if k[1] == "response"} == {(k, "response", None): big[k] for k in range(4)}
    assert all(len(v) == 3 for k, v in got.items() if k[1] == "response")
    assert {k for k in got if k[1] == "revisit"} == {(4, "revisit", 0), (5, "revisit", 1), *((k, "revisit", 3) for k in (6, 7, 8))}


@pytest.mark.parametrize("count", [1, 5000, 10**9])
def test_key_tables(spark, count):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    probed = key_in_table(spark.range(20_000), F.xxhash64("id"), *key_table(keys, count), "found")
    assert probed.where("id < 5000 and not found").count() == 0
    assert probed.where("id >= 5000 and found").count() < (2500 if count == 1 else 1500)
    assert key_in_table(spark.range(5), F.xxhash64("id"), *key_table(keys.limit(0), 0), "found").where("found").count() == 0
