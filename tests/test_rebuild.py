import random

import pytest
from pyspark.sql import functions as F

from flowspark.plans import flow as api
from flowspark.sources.pcap import decode, encode, rebuild
from tests.packets import ethernet, icmp, ipv4, ipv6, mpls, stream, tcp, udp
from tests.test_packets import FRAMES


def frames():
    r = random.Random(1)
    more = [ethernet(r.choice([lambda p: ipv4("1.2.3.4", "5.6.7.8", 6, p), lambda p: ipv4("1.2.3.4", "5.6.7.8", 6, p, options=bytes(8))])(tcp(1, 2, bytes(r.randrange(60))))) for _ in range(20)]
    return [*FRAMES, *more, ethernet(ipv4("1.2.3.4", "5.6.7.8", 17, udp(1, 2, b"padded"))) + bytes(10), ethernet(ipv6("2001:db8::1", "2001:db8::2", 58, icmp(128, 0, b"ping"))), b"\0" * 3, ethernet(mpls(ipv4("9.9.9.9", "8.8.8.8", 6, tcp(3, 4, b"in mpls"))), 0x8847)]


def test_batches_are_rebuilt_as_single_packets(spark):
    """Fields of all kinds changed, payloads of other lengths, packets without headers."""
    rows = decode(stream(spark, [(k, f) for k, f in enumerate(frames())]))
    changed = rows.withColumns({
        "src_ip": F.when(F.col("ip_version") == 4, F.lit("250.1.2.3")).when(F.col("ip_version") == 6, F.lit("fe80:0000:0000:0000:0000:0000:0000:00ff")), "ip_ttl": F.lit(300), "ip_id": F.col("pkt_no").cast("int"), "sport": F.col("sport") + 1,
        "tcp_seq": F.lit(2**32 - 2).cast("long"), "udp_csum": F.lit(None).cast("int"), "icmp_code": F.col("icmp_code") + 7, "l4_payload": F.when(F.col("pkt_no") % 3 == 0, F.col("l4_payload")).when(F.col("pkt_no") % 3 == 1, F.concat("l4_payload", F.lit(b"more"))).otherwise(F.lit(None)),
    })
    want = {r.pkt_no: rebuild(r.asDict()) for r in changed.collect()}
    got = {r.pkt_no: (bytes(r.pkt), r.caplen) for r in encode(changed).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert encode(changed.where("false")).count() == 0
    with pytest.raises(Exception, match="doesn't fit"):
        encode(rows.withColumn("dst_ip", F.lit("2001:0db8:0000:0000:0000:0000:0000:0001"))).collect()


def test_changes_in_a_row_are_written_once(spark):
    rows = decode(stream(spark, [(k, f) for k, f in enumerate(frames())]))
    steps = ["IP,SRC_IP,ZERO", "TCP,DST_PORT,ZERO", "IP,CHECKSUM,CHECKSUM_ADJUST", "IP,TTL,ZERO", "TCP,PAYLOAD,UNCHANGED"]
    flow, single = api.create_flow(rows), rows
    for step in steps:
        flow.apply("ANONYMIZE", step)
        one = api.create_flow(single)
        one.apply("ANONYMIZE", step)
        one.connect()
        single = one.packets_left()
    flow.connect()
    assert {r.pkt_no: bytes(r.pkt) for r in flow.packets_left().collect()} == {r.pkt_no: bytes(r.pkt) for r in single.collect()}
    plan = flow.packets_left()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # decoding, up to the checksums, and after them
