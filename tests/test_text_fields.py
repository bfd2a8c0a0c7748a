import pytest
from pyspark.sql import functions as F

from flowspark.functions.anonymize import FTP_COMMANDS, HTTP_NAMES, in_text_field, text_field
from flowspark.plans import flow as api
from flowspark.sources.pcap import decode
from tests.packets import ethernet, ipv4, stream, tcp

ONE = b"GET /first HTTP/1.1\r\nHost: a\r\nCookie: one\r\nX: Cookie: kept\r\n\r\n"
TWO = b"POST /second?x HTTP/1.0\r\nCOOKIE:   two; three\r\nContent-Length: 4\r\n\r\nbody\r\nwith lines"
REPLY = b"HTTP/1.1 200 OK\r\nSet-Cookie: s\r\n\r\n\xff\x00page"
CASES = [
    ("HTTP", "COOKIE", ONE + TWO, ONE.replace(b"one", b"#") + TWO.replace(b"two; three", b"#")),
    ("HTTP", "URI", ONE + TWO, ONE.replace(b"/first", b"#") + TWO.replace(b"/second?x", b"#")),
    ("HTTP", "METHOD", ONE + TWO, ONE.replace(b"GET", b"#") + TWO.replace(b"POST", b"#")),
    ("HTTP", "HTTP_VERSION", ONE + REPLY, (ONE + REPLY).replace(b"HTTP/1.1", b"#")),
    ("HTTP", "HTTP_PAYLOAD", ONE + TWO, ONE + TWO.replace(b"body\r\nwith lines", b"#")),
    ("HTTP", "HTTP_PAYLOAD", TWO + ONE, TWO.replace(b"body\r\nwith lines", b"#") + ONE),
    ("HTTP", "HTTP_PAYLOAD", REPLY + REPLY, REPLY.replace(b"\xff\x00page", b"#") * 2),
    ("HTTP", "RESPONSE_CODE", REPLY + REPLY, (REPLY * 2).replace(b"200", b"#")),
    ("HTTP", "RESP_CODE_DESCR", REPLY, REPLY.replace(b" OK", b" #")),
    ("HTTP", "SET_COOKIE", REPLY, REPLY.replace(b"Cookie: s", b"Cookie: #")),
    ("HTTP", "REFERRER", ONE + TWO, ONE + TWO),
    ("FTP", "USER", b"USER me\r\nPASS secret\r\nuser  you\r\n", b"USER #\r\nPASS secret\r\nuser  #\r\n"),
    ("FTP", "FTP_RESPONSE_CODE", b"220-hi\r\n220 there\r\n", b"#-hi\r\n# there\r\n"),
    ("FTP", "FTP_RESPONSE_ARG", b"220-hi\r\n220 there\r\n", b"220-#\r\n220 #\r\n"),
]


def test_every_place_of_a_field(spark):
    df = spark.createDataFrame([(k, data) for k, (_, _, data, _) in enumerate(CASES)], "k int, data binary")
    for k, (proto, name, _, want) in enumerate(CASES):
        got = df.where(F.col("k") == k).select(in_text_field(F.col("data"), proto, name, lambda c: F.lit("#")).alias("x")).first().x
        assert bytes(got) == want, (proto, name, bytes(got))


def test_changes_of_length_empty_values_and_null(spark):
    data = b"\r\nCookie: a\r\nCookie:\r\nCookie: ccc\r\n"
    df = spark.createDataFrame([(data,), (None,), (b"",)], "data binary")
    got = [r.x for r in df.select(in_text_field(F.col("data"), "HTTP", "COOKIE", lambda c: F.concat(c, c)).alias("x")).collect()]
    assert bytes(got[0]) == b"\r\nCookie: aa\r\nCookie:\r\nCookie: cccccc\r\n" and got[1] is None and bytes(got[2]) == b""


def test_all_fields_have_a_pattern(spark):
    df = spark.createDataFrame([(ONE,)], "data binary")
    fields = [("HTTP", n) for n in HTTP_NAMES] + [("FTP", n) for n in FTP_COMMANDS]
    assert all(text_field(*f) for f in fields) and text_field("HTTP", "NONE") is None
    for at in range(0, len(fields), 30):
        df.select(*(in_text_field(F.col("data"), p, n, lambda c: c).alias(f"{p}_{n}") for p, n in fields[at : at + 30])).collect()


@pytest.mark.parametrize("how", ["RANDOM", "FILENAME_RANDOM", "HASHED,SHA_2", "STRIP,2", "ZERO", "PATTERN_FILL,STR,ab"])
def test_nothing_of_the_values_is_left(spark, how):
    packets = decode(stream(spark, [(0, ethernet(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1024, 80, ONE + TWO))))]))
    flow = api.create_flow(packets)
    flow.apply("ANONYMIZE", f"HTTP,COOKIE,{how}")
    flow.connect()
    out = flow.packets_left()
    assert out.columns == packets.columns
    payload = bytes(out.first().pkt)[54:]
    assert b"one\r" not in payload and b"three" not in payload and payload.count(b"ookie: ") == 2 and b"GET /first" in payload and b"COOKIE:   " in payload


def test_fields_are_found_in_one_pass(spark):
    """The text is searched once for each field, not once to test, once to extract and once to split."""
    df = spark.createDataFrame([(ONE,)], "data binary").select(in_text_field(F.col("data"), "HTTP", "COOKIE", lambda c: F.lit("#")).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("cookie:") == 1


def test_values_are_found_from_a_near_look_back(spark):
    """Long payloads without the field; blanks up to 64 before a value count, and no more."""
    rows = [(b"x" * 20_000,), (b"\r\nCookie:" + b" " * 64 + b"a",), (b"\r\nCookie:" + b" " * 65 + b"a",), (b"\r\nCookie:a b",), (b"a /x HTTP/1.1, GET /y HTTP/1.1",)]
    df = spark.createDataFrame(rows, "data binary").coalesce(1)
    cookies = [bytes(r.x) for r in df.select(in_text_field(F.col("data"), "HTTP", "COOKIE", lambda c: F.lit("#")).alias("x")).collect()]
    assert cookies == [rows[0][0], rows[1][0][:-1] + b"#", rows[2][0], b"\r\nCookie:#", rows[4][0]]
    uris = [bytes(r.x) for r in df.select(in_text_field(F.col("data"), "HTTP", "URI", lambda c: F.lit("#")).alias("x")).collect()]
    assert uris == [*(r[0] for r in rows[:4]), b"a /x HTTP/1.1, GET # HTTP/1.1"]
