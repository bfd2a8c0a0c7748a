import hashlib

import pytest
from pyspark.sql import functions as F

from flowspark.operators import reassembly
from flowspark.plans import flow as api
from flowspark.plans.errors import FlowError
from flowspark.sources.pcap import checksum, decode, write_packets
from tests.packets import ethernet, ipv4, stream, tcp, udp


@pytest.fixture(scope="module")
def packets(spark):
    frames = []
    for k in range(60):
        if k % 3:
            body = ipv4(f"10.0.0.{k % 5 + 1}", "10.1.0.1", 6, tcp(1000 + k % 5, 80, b"GET www HTTP/1.1 OK" if k % 20 == 1 else b"x" * k))
        else:
            body = ipv4("10.0.0.9", "10.1.0.2", 17, udp(53, 53, b"q" * k))
        frames.append((k * 100_000, ethernet(body)))
    return decode(stream(spark, frames)).cache()


def code(f, *args):
    with pytest.raises(FlowError) as e:
        f(*args)
    return int(e.value.code)


def test_counters_before_and_after_a_filter(packets):
    flow = api.create_flow(packets)
    first = flow.apply("PKT_COUNTER")
    flow.apply("BPF_FILTER", "tcp")
    second = flow.apply("PKT_COUNTER")
    size = flow.apply("PKTINFO", 1)
    stats = flow.apply("STATS", flow.fd, size, "0")
    total = flow.apply("BYTE_COUNTER")
    flow.connect()
    assert [flow.read(k).first()["value"] for k in (first, second)] == [60, 40]
    r = flow.read(stats).first()
    assert (r["count"], r["sum"]) == (40, flow.read(total).first()["value"])
    assert {r.name: r.pkts for r in flow.function_counts().collect()}["STATS"] == 40
    assert flow.info()["num_functions"] == 6 and flow.function_info(2)["name"] == "BPF_FILTER"
    flow.close()
    assert code(flow.read, first) == 6145


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([("SAMPLE", 20, 2)], 3), ([("STR_SEARCH", "www", 0, 1500)], 2), ([("REGEXP", "HTTP.*OK")], 2), ([("STR_SEARCH", "w|77|w||nothing", 54, 0)], 2), ([("STARTSTOP", "+1s", "+2s")], 11),
        ([("HASHSAMP", 1024, 0)], 60), ([("TRACK_WEB",)], 40), ([("TRACK_IPOVERIP",)], 0), ([("BPF_FILTER", "udp"), ("SAMPLE", 5, 2)], 4), ([("SYNC", "1")], 60), ([("SAMPLE", 100, 3)], 60), ([("std:BPF_FILTER", "port 53")], 20),
    ],
)
def test_filters(packets, steps, want):
    flow = api.create_flow(packets)
    for step in steps:
        flow.apply(*step)
    fid = flow.apply("PKT_COUNTER")
    flow.connect()
    assert flow.read(fid).first()["value"] == want


def test_results(packets, tmp_path, spark):
    flow = api.create_flow(packets)
    count, size, gap, hashed = flow.apply("PKT_COUNTER"), flow.apply("PKTINFO", 1), flow.apply("GAP"), flow.apply("HASH", 3)
    bucket = flow.apply("BUCKET", flow.fd, count, "1s", 1)
    dist = flow.apply("DIST", flow.fd, size, "0", "200", "50")
    top = flow.apply("TOP", 2, "IP", "src_ip", 1, 0)
    expired = flow.apply("EXPIRED_FLOWS", 0, 0, 1)
    report = flow.apply("FLOW_REPORT", "IPFIX", "rows", "", "packets0, packets1, tcp_flags, end_reason")
    text = flow.apply("RES2FILE", "1,1", f"{count}@{flow.fd},{size}@{flow.fd}", "TEST", str(tmp_path / "out"), "1s", 1)
    binop = flow.apply("BINOP", 1, flow.fd, count, flow.fd, count)
    over = flow.apply("THRESHOLD", 0, flow.fd, size, 100, 1, 0, 1, 3)
    burst = flow.apply("BURST", 0, 1000, 100, 0, 1000, 1000, 100)
    file = flow.apply("TO_FILE", 0, str(tmp_path / "pcap"), 50)
    flow.connect()
    assert [r.value for r in flow.read(bucket).orderBy("bucket").collect()] == [10, 10, 10, 10, 10]
    assert sum(r["count"] for r in flow.read(dist).collect()) == 60
    assert [(r.value, r.packets) for r in flow.read(top).collect()] == [("10.0.0.9", 20), ("10.0.0.1", 8)]
    assert sum(r.packets for r in flow.read(expired).collect()) == 60
    reports = flow.read(report).collect()
    assert sum(r.packets0 + r.packets1 for r in reports) == 60 and {r.end_reason for r in reports} == {4}
    lines = [r.line for r in flow.read(text).orderBy("bucket").collect()]
    assert lines[0] == "TEST" and all(line.split()[0] == "10" for line in lines[1:]) and len(lines) == 7
    assert len((next((tmp_path / "out").glob("part-*.txt"))).read_text().splitlines()) == 7
    assert flow.read(binop).first()["value"] == 0 and flow.read(over).count() == 3 and flow.read(gap).first()["value"] == 100_000
    assert flow.read(hashed).first()["value"] == (59 + 59 * ord("x")) % 500009
    assert sum(r.packets for r in flow.read(burst).collect()) == 60
    flow.read(file)
    again = api.create_offline_flow(spark, str(tmp_path / "pcap"))
    again.apply("TO_BUFFER", 0)
    again.connect()
    seen = []
    assert again.loop(-1, seen.append) == 50 and again.loop(20, seen.append) == 20
    assert [r.pkt_no for r in seen[:50]] == sorted(r.pkt_no for r in seen[:50])


def test_error_numbers(packets, spark):
    flow = api.create_flow(packets)
    assert code(flow.apply, "NO_SUCH") == 6144
    assert code(flow.apply, "BPF_FILTER", "tcp and") == 1025
    assert code(flow.apply, "BPF_FILTER", "") == 7001
    assert code(flow.apply, "BPF_FILTER") == 7000
    assert code(flow.apply, "REGEXP", "(") == 7000
    assert code(flow.apply, "STR_SEARCH", "abc", 0, 2) == 3504
    assert code(flow.apply, "STR_SEARCH", "a|41", 0, 0) == 3503
    assert code(flow.apply, "TOP", 1001, "IP", "src_ip", 1, 0) == 7001
    assert code(flow.apply, "TOP", 5, "IP", "sport", 1, 0) == 7003
    assert code(flow.apply, "STATS", flow.fd, 99, "0") == 6147
    assert code(flow.apply, "INTERFACE", -1) == 7000
    fid = flow.apply("PKT_COUNTER")
    assert code(flow.read, fid) == 6143
    flow.connect()
    assert code(flow.read, 7) == 6147 and code(flow.apply, "PKT_COUNTER") == 3081 and code(flow.next_packets) == 6147
    assert code(api.create_offline_flow, spark, "x", "nothing") == 3200
    assert api.next_flow_info(flow.fd - 1)["fd"] == flow.fd
    assert "PKT_COUNTER" in api.libraries()["std"]


@pytest.mark.parametrize("how", ["UNCHANGED", "MAP", "ZERO", "PREFIX_PRESERVING", "PREFIX_PRESERVING_MAP", "PATTERN_FILL,STR,TEST", "REPLACE,TEST", "HASHED,MD5", "STRIP,2", "RANDOM"])
@pytest.mark.parametrize(("proto", "field", "column"), [("IP", "SRC_IP", "src_ip"), ("TCP", "SRC_PORT", "sport"), ("IP", "TTL", "ip_ttl"), ("TCP", "PAYLOAD", "l4_payload")])
def test_anonymize(packets, proto, field, column, how):
    flow = api.create_flow(packets)
    step = f"{proto},{field},{how}"
    if how.startswith("PREFIX_PRESERVING") and column != "src_ip" or how.startswith("REPLACE") and column != "l4_payload":
        with pytest.raises(FlowError):
            flow.apply("ANONYMIZE", step)
        return
    flow.apply("ANONYMIZE", step)
    flow.connect()
    before = {r.pkt_no: r[column] for r in packets.collect()}
    of = {r.pkt_no for r in packets.collect() if proto == "IP" or r.ip_proto == 6}
    pairs = {}
    for r in flow.packets_left().select("pkt_no", column).collect():
        if r.pkt_no not in of or how == "UNCHANGED":
            assert r[column] == before[r.pkt_no]
        elif how == "MAP" or how.startswith("PREFIX_PRESERVING"):
            key, value = (bytes(x) if isinstance(x, bytearray) else x for x in (before[r.pkt_no], r[column]))
            assert pairs.setdefault(key, value) == value
        elif how == "ZERO":
            assert not str(r[column] if column != "l4_payload" else sum(r[column])).strip("0.")


def test_fixed_width_fields_take_bytes(spark):
    from flowspark.functions.anonymize import on_bytes

    flow = lambda how: [tuple(r) for r in api._anonymized(api._anonymized(rows, f"IP,SRC_IP,{how}"), f"TCP,SRC_PORT,{how}").select("src_ip", "sport").orderBy("k").collect()]
    rows = spark.createDataFrame([(0, "1.2.3.4", 6, 258), (1, "0001:0000:0000:0000:0000:0000:0000:00ff", 6, 80), (2, "1.2.3.4", 17, 258), (3, None, 6, None)], "k int, src_ip string, ip_proto int, sport int").select("*", F.lit(None).cast("string").alias("dst_ip"), F.lit(None).cast("int").alias("dport"), F.col("k").cast("long").alias("pkt_no"))
    text = "54455354" * 4
    six = ":".join(text[k : k + 4] for k in range(0, 32, 4))
    assert flow("PATTERN_FILL,STR,TEST") == [("84.69.83.84", 0x5445), (six, 0x5445), ("84.69.83.84", 258), (None, None)]
    assert flow("PATTERN_FILL,INTEGER,1") == [("1.1.1.1", 257), ("0101:" * 7 + "0101", 257), ("1.1.1.1", 258), (None, None)]
    with pytest.raises(FlowError):
        flow("REPLACE,AB")
    assert flow("MAP")[:2] == [("0.0.0.1", 1), ("2001:0db8:0000:0000:0000:0000:0000:0002", 2)]
    assert flow("STRIP,1")[:2] == [("1.0.0.0", 256), ("0000:" * 7 + "0000", 0)]
    digest = hashlib.md5(bytes([1, 2, 3, 4])).digest()
    assert flow("HASHED,MD5")[0] == (".".join(map(str, digest[:4])), int.from_bytes(hashlib.md5(bytes([1, 2])).digest()[:2]))
    assert spark.range(1).select(on_bytes(F.lit(65535), 2, lambda d: d)).first()[0] == 65535


def test_prefix_preserving_keeps_common_prefixes(spark):
    from flowspark.functions.anonymize import ipv4_number, prefix_preserving

    ips = ["10.0.0.1", "10.0.0.2", "10.0.128.1", "11.0.0.1", "192.168.1.1", "192.168.1.129"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", ipv4_number(F.col("ip")).alias("n"), ipv4_number(prefix_preserving(F.col("ip"), bytes(range(32)))).alias("m")).collect()
    same = lambda a, b: 32 - (a ^ b).bit_length()
    assert all(same(a.n, b.n) == same(a.m, b.m) for a in rows for b in rows) and any(a.n != a.m for a in rows)
    # A published sample of the scheme: key bytes 21 34 23 141 ..., 128.11.68.132 becomes 135.242.180.132.
    key = bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2])
    assert spark.range(1).select(prefix_preserving(F.lit("128.11.68.132"), key)).first()[0] == "135.242.180.132"


def test_cooking(spark, tmp_path):
    def seg(seq, data=b"", flags=16, back=False, us=0):
        ends = ("2.2.2.2", "1.1.1.1", 80, 1000) if back else ("1.1.1.1", "2.2.2.2", 1000, 80)
        return (us, ethernet(ipv4(ends[0], ends[1], 6, tcp(ends[2], ends[3], data, flags, seq % 2**32))))

    start = 2**32 - 6  # the sequence numbers wrap
    frames = [seg(start - 1, flags=2), seg(499, flags=18, back=True, us=1), seg(start, b"hello ", us=2), seg(start + 11, b" again", us=3), seg(500, b"reply", back=True, us=4), seg(start + 6, b"world", us=5), seg(start + 6, b"world again", us=6), seg(start + 17, b"!", 17, us=7)]
    frames.append((8, ethernet(ipv4("1.1.1.1", "2.2.2.2", 17, udp(1, 2, b"datagram")))))
    df = decode(stream(spark, frames))
    rows = sorted(reassembly.cook(df, 10).collect(), key=lambda r: (r.sport, r.chunk_no or 0))
    client = [bytes(r.payload) for r in rows if r.sport == 1000]
    assert client == [b"hello worl", b"d again!"] and [bytes(r.payload) for r in rows if r.sport == 80] == [b"reply"]
    assert [bytes(r.payload) for r in rows if r.chunk_no is None] == [b"datagram"]
    assert b"".join(bytes(r.payload) for r in reassembly.cook(df, 32000, collect=reassembly.SERVER).where("ip_proto = 6").collect()) == b"reply"
    assert [bytes(r.payload) for r in reassembly.cook(df, 4, once=True, collect=reassembly.CLIENT).where("ip_proto = 6").collect()] == [b"hell"]
    cooked = reassembly.cook(df, 10).cache()
    assert {r.pkt_no for r in reassembly.uncook(cooked, df).collect()} >= {2, 3, 4, 5, 7, 8}
    write_packets(df, str(tmp_path / "c"))
    flow = api.create_offline_flow(spark, str(tmp_path / "c"))
    flow.apply("COOKING", 10, 60, 0, 3)
    fid = flow.apply("PKT_COUNTER")
    flow.connect()
    assert flow.read(fid).first()["value"] == 4


def test_anonymised_packets_are_written(spark, tmp_path):
    request = b"GET /secret?q=1 HTTP/1.1\r\nHost: a.example\r\nCookie: id=42\r\n\r\nbody"
    frames = [(0, ethernet(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1000, 80, request)))), (1, ethernet(ipv4("10.0.0.1", "10.0.0.2", 17, udp(53, 53, b"q")))), (2, ethernet(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1000, 21, b"USER anna\r\n"))))]
    flow = api.create_flow(decode(stream(spark, frames)))
    for step in ("HTTP,COOKIE,REPLACE,none", "HTTP,URI,PATTERN_FILL,STR,x", "HTTP,METHOD,HASHED,MD5", "FTP,USER,REPLACE,bob", "IP,SRC_IP,MAP", "TCP,DST_PORT,ZERO", "IP,CHECKSUM,CHECKSUM_ADJUST"):
        flow.apply("ANONYMIZE", step)
    assert code(flow.apply, "ANONYMIZE", "IP,SRC_IP") == 7000
    file = flow.apply("TO_FILE", 0, str(tmp_path / "out"), 0)
    flow.connect()
    flow.read(file).collect()
    again = api.create_offline_flow(spark, str(tmp_path / "out"))
    again.connect()
    rows = {r.us: r for r in again.packets_left().collect()}
    text = bytes(rows[0].pkt)[54:]  # lengths in headers stay as they were
    assert text.startswith(hashlib.md5(b"GET").hexdigest().encode() + b" xxxxxxxxxxx HTTP/1.1\r\nHost: a.example\r\nCookie: none\r\n\r\n")
    assert (rows[0].src_ip, rows[0].dst_ip, rows[0].dport, rows[2].dport) == ("0.0.0.1", "10.0.0.2", 0, 0)
    assert bytes(rows[2].pkt)[54:] == b"USER bob\r\n" and bytes(rows[1].l4_payload) == b"q" and rows[1].dport == 53
    for r in rows.values():
        head = bytes(r.pkt)[14:34]
        assert checksum(head) == 0
    assert code(lambda: api._anonymized(flow.packets, "HTTP,NOTHING,ZERO")) == 7000


def test_prefix_preserving_takes_ipv6(spark):
    import ipaddress

    from flowspark.functions.anonymize import anonymize_ip

    texts = ["2001:db8::1", "2001:db8::2", "2001:db8:0:1::", "2001:0db8:0000:0000:0000:0000:8000:0001", "fe80::1", "::", "::ffff:1.2.3.4", "FFFF:FFFF:FFFF:FFFF:FFFF:FFFF:FFFF:FFFF", "2001:db8:1:2:3:4:5:6"]
    rows = [(t, "128.11.68.132") for t in texts] + [(None, "2001:db8::1"), ("10.0.0.1", None)]
    key = bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2])
    df = spark.createDataFrame([(*r, *r) for r in rows], "src_ip string, dst_ip string, a string, b string")
    got = anonymize_ip(df, key).collect()
    assert len(got) == len(rows) and {r.dst_ip for r in got if r.b == "128.11.68.132"} == {"135.242.180.132"}
    made = {r.a: r.src_ip for r in got} | {r.b: r.dst_ip for r in got}
    number = lambda x: int(ipaddress.IPv6Address(x))
    assert made[None] is None and all(len(made[t]) == 39 and number(made[t]) != number(t) for t in texts)
    shared = lambda x, y: 128 - (number(x) ^ number(y)).bit_length()
    assert all(shared(x, y) == shared(made[x], made[y]) for x in texts for y in texts)


def test_prefix_preserving_of_ipv6_is_the_plain_construction(spark):
    import ipaddress

    from flowspark.functions.anonymize import prefix_preserving

    key, address = bytes(range(32)), "2001:db8::ff00:42:8329"
    number = int(ipaddress.IPv6Address(address))
    encrypt = lambda blocks: [int.from_bytes(r[0][:16], "big") for r in spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blocks)], "k int, b binary").orderBy("k").select(F.aes_encrypt("b", F.lit(key[:16]), F.lit("ECB"))).collect()]
    (pad,) = encrypt([key[16:]])
    heads = [((number >> (128 - i) << (128 - i)) | (pad & ((1 << (128 - i)) - 1))).to_bytes(16, "big") for i in range(128)]
    want = number ^ sum((x >> 127) << (127 - i) for i, x in enumerate(encrypt(heads)))
    got = spark.range(1).select(prefix_preserving(F.lit(address), key)).first()[0]
    assert got == ipaddress.IPv6Address(want).exploded


def test_missing_segment_may_come_after_much_data():
    many, size = 3000, 1460
    for first in (1000, 2**32 - 5000):
        sent = [((first + 1 + k * size) % 2**32, bytes([k % 251]) * size, k) for k in range(many)]
        side = reassembly.Side(("a", "b", 1, 2), 32000, False)
        rows = list(side.take(first, b"", reassembly.SYN, -1, 0))
        for seq, data, k in [*sent[1:], sent[5], sent[0]]:  # 4 MB early, one segment twice, then the missing one
            rows += side.take(seq, data, 0, k, k)
        rows += side.finish()
        assert b"".join(r[9] for r in rows) == b"".join(d for _, d, _ in sent)
        assert {n for r in rows for n in r[10]} == set(range(many))
