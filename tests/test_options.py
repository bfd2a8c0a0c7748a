"""Options of headers, scaled windows and bit rates of flow reports."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from flowspark.functions.options import with_options
from flowspark.operators.flows import flow_report, packet_sides
from flowspark.plans import flow as api
from flowspark.sources.pcap import decode
from tests.packets import ethernet, icmp, ipv4, ipv6, stream, tcp, udp


def segment(options, flags=16, window=100, sport=1, dport=2, body=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, (5 + len(options) // 4) << 4, flags, window, 0, 0) + options + body


SCALE = lambda n: bytes([3, 3, n, 0])
LISTS = {
    b"": 0, b"\x01\x01\x08\x0a" + bytes(8): 1 << 1 | 1 << 8, b"\x02\x04\x05\xb4": 1 << 2, b"\x04\x02\x00\x08": 1 << 4 | 1, SCALE(7): 1 << 3 | 1,
    b"\x1e\x00\x02\x04": 1 << 30, b"\x02\x28\x05\xb4": 1 << 2, b"\xfd\x04\x01\x02": 1 << 62, b"\x01\x01\x01\x08": 1 << 1 | 1 << 8,
}


def test_option_bits(spark):
    frames = [(k, ethernet(ipv4("1.1.1.1", "2.2.2.2", 6, segment(x)))) for k, x in enumerate(LISTS)]
    rows = with_options(decode(stream(spark, frames))).orderBy("pkt_no").collect()
    assert [r.tcp_options for r in rows] == list(LISTS.values())
    assert all(r.ip_options == 0 and r.tcp_scale is None for r in rows)


def test_ip_options_and_headers_without(spark):
    frames = [ipv4("1.1.1.1", "2.2.2.2", 17, udp(1, 2), options=b"\x94\x04\0\0"), ipv4("1.1.1.1", "2.2.2.2", 6, segment(SCALE(2), 2), options=b"\x01\x00\x94\x04"), icmp(3)]
    frames = [(k, ethernet(f)) for k, f in enumerate(frames)] + [(3, ethernet(ipv6("::1", "::2", 6, segment(SCALE(20), 18)), 0x86DD)), (4, b""), (5, ethernet(b"\0" * 40, 0x0806))]
    rows = with_options(decode(stream(spark, frames))).orderBy("pkt_no").collect()
    assert [r.ip_options for r in rows] == [1 << 20, 3, None, None, None, None]
    assert [r.tcp_options for r in rows] == [None, 9, None, 9, None, None]
    assert [r.tcp_scale for r in rows] == [None, 2, None, 14, None, None]


def report(spark, frames, **how):
    rows = with_options(decode(stream(spark, frames))).withColumn("g", F.lit(1))
    return flow_report(rows, ["g"], F.col("sport") == 1, tcp=True, sides=packet_sides(), **how).orderBy("start_us").collect()


def test_scale_of_a_syn_goes_on_in_later_records(spark):
    packets = [(0, b"", 16, 7), (1, SCALE(3), 2, 10), (2, b"", 16, 5), (3, SCALE(9), 16, 5), (250_000_000, b"", 16, 6), (260_000_000, SCALE(1), 2, 6)]
    frames = [(us, ethernet(ipv4("1.1.1.1", "2.2.2.2", 6, segment(o, flags, win)))) for us, o, flags, win in packets]
    frames.append((270_000_000, ethernet(ipv4("2.2.2.2", "1.1.1.1", 6, segment(b"", 16, 9, 2, 1)))))
    got = report(spark, frames, idle="1h")
    assert [(r.min_window0, r.max_window0, r.min_window1, r.max_window1) for r in got] == [(7, 80, None, None), (12, 48, 9, 9)]
    assert [r.tcp_options0 for r in got] == [9, 9]


def expected_rates(packets, width):
    """(lowest, highest) of one direction: bytes of the ten slots up to each slot that has packets."""
    slots = {}
    for us, size in packets:
        slots[us // width] = slots.get(us // width, 0) + size
    have = sorted(slots)
    sums = {s: sum(slots.get(s - k, 0) for k in range(10)) for s in have}
    count = [v for s, v in sums.items() if s - have[0] >= 9 or s == have[-1]]
    silent = any(b - a >= 10 for a, b in zip(have, have[1:], strict=False))
    rate = lambda v: v * 8_000_000 // (width * 10)
    return (0 if silent else rate(min(count))), rate(max(count))


@pytest.mark.parametrize("gaps", [[30_000] * 60, [5_000] * 90, [7, 900, 150_000, 20, 1_000_000] * 8, [400_000, 90_000] * 20, [0, 0, 0]])
def test_bit_rates(spark, gaps):
    at, packets = 0, []
    for k, gap in enumerate(gaps):
        packets.append((at, 60 + 7 * k % 50))
        at += gap
    frames = [(us, ethernet(ipv4("1.1.1.1", "2.2.2.2", 17, udp(1, 2, bytes(size - 42))))) for us, size in packets]
    (row,) = report(spark, frames, idle="1h", periods=("1s", "100ms", "10ms"))
    for name, width in (("1s", 100_000), ("100ms", 10_000), ("10ms", 1_000)):
        assert (row[f"min_rate0_{name}"], row[f"max_rate0_{name}"]) == expected_rates(packets, width), name
        assert row[f"min_rate1_{name}"] is None


def test_report_of_a_flow(spark):
    frames = [(k * 1000, ethernet(ipv4("1.1.1.1", "2.2.2.2", 1, icmp(kind)))) for k, kind in enumerate((8, 0, 255))]
    frames += [(9000, ethernet(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(5, 6, b"abc"))))]
    flow = api.create_flow(decode(stream(spark, frames)))
    some = flow.apply("FLOW_REPORT", "", "", "", "ip_proto,icmp_types0,icmp_types1,ip_options0,max_rate0_1s")
    flow.connect()
    got = {r.ip_proto: r for r in flow.read(some).collect()}
    assert (got[1].icmp_types0, got[1].icmp_types1, got[1].ip_options0, got[1].max_rate0_1s) == (1 << 8 | 1, None, 0, 180 * 8)
    assert (got[6].icmp_types0, got[6].max_rate0_1s) == (None, 60 * 8)
