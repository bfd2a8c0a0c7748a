import random
import struct

import pytest

from flowspark.operators import reassembly
from flowspark.operators.defragment import FIRST, LAST, defragment
from flowspark.plans import flow as api
from flowspark.plans.errors import FlowError
from flowspark.sources.pcap import checksum, decode
from tests.packets import ethernet, ipv4, ipv6, stream, tcp, udp


def four(ident, start, data, more, src="10.0.0.1", proto=17, options=b""):
    return ethernet(ipv4(src, "10.0.0.2", proto, data, ident=ident, frag=start // 8 | (0x2000 if more else 0), options=options))


def six(ident, start, data, more, before=b"", nxt=17):
    head = struct.pack(">BBHI", nxt, 0, start | more, ident)
    return ethernet(ipv6("2001:db8::1", "2001:db8::2", 0 if before else 44, before + head + data), 0x86DD)


def run(spark, frames, *args):
    df = decode(stream(spark, frames)).repartition(5)
    out = defragment(df, *args)
    assert out.columns == df.columns
    return sorted(out.collect(), key=lambda r: (r.pkt_no, r.ip_frag))


def test_both_versions_out_of_order_with_options_and_headers_before(spark):
    body = udp(53, 1000, bytes(range(200)))
    hop = bytes([44, 0, 1, 4, 0, 0, 0, 0])  # hop-by-hop options, then the fragment header
    frames = [(3, four(7, 96, body[96:], False, options=b"\1\1\1\0")), (1, four(7, 0, body[:48], True, options=b"\1\1\1\0")), (2, four(7, 48, body[48:96], True, options=b"\1\1\1\0"))]
    frames += [(k + 10, six(9, a, body[a : a + 80], a + 80 < len(body), hop)) for k, a in enumerate((160, 0, 80))]
    frames += [(50, ethernet(ipv4("10.0.0.1", "10.0.0.2", 17, udp(5, 6, b"whole"))))]
    got = run(spark, frames)
    assert len(got) == 3 and [r.us for r in got] == [3, 12, 50]
    for r in got[:2]:
        assert (r.sport, r.dport, bytes(r.l4_payload), r.ip_more, r.ip_frag) == (53, 1000, bytes(range(200)), False, 0)
    head = bytes(got[0].pkt)[14:38]
    assert checksum(head) == 0 and struct.unpack_from(">H", head, 2)[0] == 24 + len(body) and got[0].wlen == 14 + 24 + len(body)
    assert bytes(got[1].pkt) == ethernet(ipv6("2001:db8::1", "2001:db8::2", 0, bytes([17, 0]) + hop[2:] + body), 0x86DD)


@pytest.mark.parametrize("policy", [FIRST, LAST])
def test_overlaps_against_single_bytes(spark, policy):
    """Random overlapping fragments with conflicting bytes: each byte is that of its first or last fragment."""
    r = random.Random(5)
    frames, want = [], {}
    for ident in range(40):
        size = r.randrange(40, 200)
        cells, pieces = {}, [(8 * k, min(size, 8 * k + 8)) for k in range(-(-size // 8))]
        pieces += [(8 * a, min(size, 8 * a + 8 * r.randrange(1, 6))) for a in (r.randrange(size // 8) for _ in range(12))]
        r.shuffle(pieces)
        done = False
        for n, (a, b) in enumerate(pieces):
            if done:
                break
            data = bytes(r.randrange(256) for _ in range(b - a))
            frames.append((ident * 10_000 + n, four(ident, a, data, b < size, src=f"10.0.1.{ident}", proto=99)))
            for k in range(a, b):
                if policy == LAST or k not in cells:
                    cells[k] = data[k - a]
            if len(cells) == size:
                want[ident], done = bytes(cells[k] for k in range(size)), True
    got = {r.frag_id: bytes(r.l4_payload) for r in run(spark, frames, "30s", policy) if r.ip_frag == 0 and not r.ip_more}
    assert {k: v for k, v in got.items() if k in want} == want and len(want) == 40


def test_what_is_not_whole_stays(spark):
    part = bytes(16)
    frames = [(0, four(1, 0, part, True)), (10, four(2, 8, part, True)), (20, four(2, 0, part, True)), (31_000_000, four(1, 16, part, False))]
    frames += [(32_000_000, four(3, 0, b"123", True)), (33_000_000, four(4, 65_528, part, False)), (34_000_000, six(5, 0, part, 1))]
    got = run(spark, frames)
    assert [r.pkt_no for r in got] == [0, 1, 2, 3, 4, 5, 6] and [bytes(r.pkt) for r in got] == [f for _, f in frames]


def test_an_identification_used_again(spark):
    pieces = [(four(1, 0, b"a" * 8, True), four(1, 8, b"b" * 4, False)), (four(1, 0, b"c" * 8, True), four(1, 8, b"d" * 8, False))]
    frames = [(k * 10 + n, f) for k, pair in enumerate(pieces) for n, f in enumerate(pair)]
    assert [bytes(r.pkt)[34:] for r in run(spark, frames)] == [b"a" * 8 + b"b" * 4, b"c" * 8 + b"d" * 8]


def test_cooking_sees_fragmented_segments(spark):
    body = tcp(1000, 80, b"GET / HTTP/1.1 and more of it", seq=1)
    frames = [(k, four(5, a, body[a : a + 16], a + 16 < len(body), proto=6)) for k, a in enumerate((32, 0, 16, 48))]
    cooked = reassembly.cooked_packets(decode(stream(spark, frames))).collect()
    assert [bytes(r.payload) for r in cooked] == [b"GET / HTTP/1.1 and more of it"]
    flow = api.create_flow(decode(stream(spark, frames)))
    flow.apply("COOKING", 32000, 60, 0, reassembly.BOTH)
    flow.apply("STR_SEARCH", "HTTP/1.1 and", 0, 0)
    flow.connect()
    assert flow.packets_left().count() == 1


def test_no_fragments_and_bad_policy(spark):
    empty = decode(stream(spark, [(0, ethernet(ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2))))]))
    assert defragment(empty.limit(0)).count() == 0 and defragment(empty).count() == 1
    with pytest.raises(FlowError):
        defragment(empty, policy="middle")
