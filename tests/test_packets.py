import pytest
from pyspark.sql import functions as F

from flowspark.functions.bpf import compile_filter
from flowspark.operators import trackers
from flowspark.plans.errors import FlowError
from flowspark.sources.pcap import decode, read_packets, write_packets
from tests.packets import ethernet, icmp, ipv4, ipv6, mpls, stream, tcp, udp

FRAMES = [
    ethernet(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(40000, 80, b"GET / HTTP/1.0"))),  # 0
    ethernet(ipv4("10.0.0.2", "10.0.0.1", 6, tcp(80, 40000, b"HTTP/1.1 200 OK", 18))),  # 1
    ethernet(ipv4("195.113.1.1", "147.251.2.2", 17, udp(53, 53, b"dns"))),  # 2
    ethernet(ipv4("10.0.0.1", "10.0.0.9", 17, udp(5000, 53, b"x")), vlan=5),  # 3
    ethernet(mpls(ipv4("10.9.0.1", "10.0.0.9", 6, tcp(554, 1024))), 0x8847),  # 4
    ethernet(ipv6("2001:db8::1", "2001:db8::2", 17, udp(1, 2, b"six")), 0x86DD),  # 5
    ethernet(b"\0\1\x08\0\6\4\0\1" + bytes(20), 0x0806),  # 6: arp
    ethernet(ipv4("10.0.0.1", "224.0.0.1", 2, b"igmp"), dst=b"\x01\0\x5e\0\0\1"),  # 7
    ethernet(ipv4("1.2.3.4", "5.6.7.8", 1, icmp(8))),  # 8
    ethernet(ipv4("1.2.3.4", "5.6.7.8", 17, b"later fragment", frag=100)),  # 9
    ethernet(ipv4("1.2.3.4", "5.6.7.8", 4, ipv4("9.9.9.9", "8.8.8.8", 17, b""))),  # 10: ip in ip
    b"\xff" * 6 + bytes(6) + b"\0\x26\x42\x42\x03" + bytes(35),  # 11: stp
    b"",  # 12
    ethernet(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(40001, 22, flags=2), options=b"\1\1\1\0")),  # 13
]
FILTERS = {
    "tcp": {0, 1, 4, 13}, "udp": {2, 3, 5, 9}, "ip": {0, 1, 2, 3, 4, 7, 8, 9, 10, 13}, "ip6": {5}, "arp": {6}, "icmp": {8}, "igmp": {7}, "stp": {11}, "proto 4": {10}, "ip proto 2": {7},
    "tcp and dst port 80": {0}, "port 53 or port 80": {0, 1, 2, 3}, "port 80 or 53": {0, 1, 2, 3}, "port 554 and not port 80": {4}, "not ip": {5, 6, 11, 12},
    "ip src net 195.113.0.0/16 and ip dst net 147.251.0.0/16": {2}, "udp and src net 10.0": {3}, "src host 10.0.0.2": {1}, "host 10.0.0.2": {0, 1, 13}, "net 10.0.0.0 mask 255.255.255.0 and udp": {3},
    "(ip and (tcp or udp)) or (vlan and (tcp or udp))": {0, 1, 2, 3, 4, 9, 13}, "vlan": {3}, "vlan 5": {3}, "vlan 6": set(), "mpls": {4}, "portrange 20-60": {2, 3, 13}, "tcp src portrange 500-600": {4},
    "ip[9] == 4": {10}, "tcp[tcpflags] & (tcp-syn) != 0": {1, 13}, "tcp[13] & 2 != 0 and not tcp[13] & 16 != 0": {13}, "icmp[icmptype] == icmp-echo": {8}, "ip[16:4] == 0x0a000002": {0, 13},
    "src and dst port 53": {2}, "ether broadcast": {11}, "ether multicast": {7, 11}, "ip multicast": {7}, "len > 65": {0, 1, 10, 5} , "ip6 host 2001:db8::1": {5}, "net 2001:db8::/32": {5}, "net 2001:db8::/30": {5}, "net 2002::/31": set(),
    "tcp dst port http": {0}, "ether dst 01:00:5e:00:00:01": {7}, "ether proto 0x86dd": {5}, "src host 10.0.0.1 && ! tcp": {3, 7}, "proto eigrp": set(), "udp port 513": set(), "sctp || rarp": set(), "(ip[0] & 0xf) > 5": {13},
}


@pytest.fixture(scope="module")
def packets(spark):
    return decode(stream(spark, [(k * 1000, f) for k, f in enumerate(FRAMES)])).cache()


def test_filters(packets):
    tests = {f"f{k}": compile_filter(text) for k, text in enumerate(FILTERS)}
    rows = packets.select("pkt_no", "wlen", *[c.alias(n) for n, c in tests.items()]).collect()
    for k, (text, want) in enumerate(FILTERS.items()):
        assert all(r[f"f{k}"] is not None for r in rows), text
        got = {r.pkt_no for r in rows if r[f"f{k}"]}
        assert got == want or text == "len > 65" and got == {r.pkt_no for r in rows if r.wlen > 65}, text


@pytest.mark.parametrize("text", ["", "tcp and", "port", "port 99999", "(tcp", "foo", "host 1.2.3.4.5.6", "tcp[", "net 10.0.0.0/99", "portrange 5", "tcp )"])
def test_bad_filters(spark, text):
    with pytest.raises(FlowError) as e:
        compile_filter(text)
    assert int(e.value.code) in (1025, 7001)


def test_every_filter_of_the_applications_compiles(spark):
    for text in ("atalk", "aarp", "decnet", "iso", "ipx", "sca", "lat", "mopdl", "moprc", "netbeui", "ah", "esp", "pim", "vrrp", "igrp", "port 22 or port 23 or port 107 or port 614 or port  992", "tcp and (port 6881 or port 6882 or port 6969)", "port 137 or port 138 or port 139"):
        compile_filter(text)


def test_decoded_fields(packets):
    rows = {r.pkt_no: r for r in packets.collect()}
    assert (rows[0].src_ip, rows[0].dst_ip, rows[0].sport, rows[0].dport, rows[0].tcp_flags, rows[0].ip_ttl, bytes(rows[0].l4_payload)) == ("10.0.0.1", "10.0.0.2", 40000, 80, 16, 64, b"GET / HTTP/1.0")
    assert (rows[3].vlan_id, rows[3].dport, rows[4].mpls, rows[4].sport) == (5, 53, True, 554)
    assert rows[5].src_ip == "2001:0db8:0000:0000:0000:0000:0000:0001" and rows[5].udp_len == 11
    assert rows[9].sport is None and rows[9].ip_frag == 100 and bytes(rows[9].l4_payload) == b"later fragment"
    assert rows[13].sport == 40001 and rows[12].eth_type is None and rows[6].ip_version is None


@pytest.mark.parametrize("kind", ["pcap", "erf"])
def test_files_round_trip(spark, packets, tmp_path, kind):
    df = packets.where("caplen > 0")
    write_packets(df, str(tmp_path / "all"), kind)
    back = read_packets(spark, str(tmp_path / "all"), kind)
    pick = lambda d: [(r.us if kind == "pcap" else r.us // 100, r.wlen, bytes(r.pkt)) for r in d.orderBy("pkt_no").collect()]
    assert pick(back)[:3] == pick(df)[:3] and len(pick(back)) == 13
    assert back.agg(F.sum("wlen")).first()[0] == df.agg(F.sum("wlen")).first()[0]
    write_packets(df, str(tmp_path / "five"), kind, limit=5)
    assert read_packets(spark, str(tmp_path / "five"), kind).count() == 5
    write_packets(df, str(tmp_path / "five"), kind)
    more = read_packets(spark, str(tmp_path / "five"), kind)
    assert more.count() == 18 and [bytes(r.pkt) for r in more.orderBy("pkt_no").collect()][5:] == [bytes(r.pkt) for r in back.orderBy("pkt_no").collect()]
    write_packets(df, str(tmp_path / "five"), kind, mode="overwrite")
    assert pick(read_packets(spark, str(tmp_path / "five"), kind)) == pick(back)
    cut = next((tmp_path / "all").glob(f"*.{kind}"))
    (tmp_path / f"cut.{kind}").write_bytes(cut.read_bytes()[:-3])
    assert read_packets(spark, str(tmp_path / f"cut.{kind}"), kind).count() < 13


def test_trackers(spark):
    def flow(a, b, sport, dport, texts, start, proto=6, flags=16):
        out = []
        for k, text in enumerate(texts):
            ends = (a, b, sport, dport) if k % 2 == 0 else (b, a, dport, sport)
            body = tcp(ends[2], ends[3], text, flags) if proto == 6 else udp(ends[2], ends[3], text)
            out.append((start + k * 1_000_000, ethernet(ipv4(ends[0], ends[1], proto, body))))
        return out

    hello = bytes([0xE3]) + (3).to_bytes(4, "little") + b"\x01ab"
    frames = flow("1.1.1.1", "2.2.2.2", 1000, 2000, [b"first", b"GNUTELLA connect/0.6", b"then", b"more"], 0)  # 0-3
    frames += flow("1.1.1.1", "3.3.3.3", 1001, 6881, [b"\x13BitTorrent protocol", b"x"], 0)  # 4-5
    frames += flow("1.1.1.1", "4.4.4.4", 1002, 411, [b"$Hello you|", b"$other"], 0)  # 6-7
    frames += flow("1.1.1.1", "5.5.5.5", 1003, 6667, [b"PRIVMSG me", b"text"], 0) + flow("1.1.1.1", "5.5.5.5", 1003, 6667, [b"late"], 200_000_000)  # 8-10
    frames += flow("1.1.1.1", "6.6.6.6", 1004, 4662, [hello, b"data"], 0)  # 11-12
    frames += flow("7.7.7.7", "8.8.8.8", 1005, 30000, [b"before"], 0) + flow("7.7.7.7", "8.8.8.8", 1006, 21, [b"USER", b"331"], 1_000_000) + flow("7.7.7.7", "8.8.8.8", 1007, 30001, [b"file"], 9_000_000)  # 13-16
    frames += flow("7.7.7.7", "9.9.9.9", 1008, 443, [b"tls"], 0) + flow("7.7.7.7", "9.9.9.9", 1009, 2233, [b"m"], 0)  # 17-18
    frames += flow("7.7.7.7", "9.9.9.9", 1010, 5, [b"GNUTELLA/", b"y"], 0, flags=17)  # 19-20: FIN ends it at once
    df = decode(stream(spark, frames))
    got = lambda name: sorted(r.pkt_no for r in trackers.track(df, name).collect())
    assert got("TRACK_GNUTELLA") == [1, 2, 3, 19]
    assert got("TRACK_TORRENT") == [4, 5] and got("TRACK_DC") == [6, 7] and got("TRACK_IRC") == [8, 9] and got("TRACK_EDONKEY") == [11, 12]
    assert got("TRACK_FTP") == [14, 15, 16] and got("TRACK_GRID_FTP") == []
    assert got("TRACK_WEB") == [17] and got("TRACK_MONITOR") == [18] and got("TRACK_IPOVERIP") == []
    calls = flow("1.1.1.1", "99.9.9.9", 700, 80, [b"hi"], 0) + flow("1.1.1.1", "50.1.1.1", 5555, 7, [b"a"] * 9, 1_000_000, 17) + flow("1.1.1.1", "50.1.1.2", 5555, 8, [b"b", b"c"], 20_000_000, 17) + flow("1.1.1.1", "50.1.1.3", 6666, 8, [b"d"], 20_000_000, 17)
    found = trackers.skype(decode(stream(spark, calls)), ["99.9.9.9"]).collect()
    assert {bytes(r.l4_payload) for r in found} == {b"b", b"c"}


def test_only_wanted_fields_are_made(spark, packets):
    raw = packets.select("pkt_no", "us", "link_type", "pkt")
    some = decode(raw, ["src_ip", "l4_payload", "dport"])
    assert some.columns == ["pkt_no", "us", "link_type", "pkt", "src_ip", "dport", "l4_payload"]
    pick = lambda d: sorted((r.pkt_no, r.src_ip, r.dport, r.l4_payload) for r in d.where("src_ip is not null and dport is not null").collect())
    assert pick(some) == pick(packets) and len(pick(some)) > 5
    assert decode(raw, []).columns == raw.columns
    with pytest.raises(ValueError, match="nothing"):
        decode(raw, ["nothing"])


def test_large_and_null_packets(spark):
    """Payloads beyond a block of places, with packets that are null or cut between them."""
    rows = [(k, None if k % 7 == 3 else bytearray(ethernet(ipv4("10.0.0.1", f"10.0.{k % 9}.2", 17, udp(k, 53, bytes([k % 256]) * (k * 13 % 1400))))[: 20 if k % 11 == 5 else None])) for k in range(700)]
    got = {r.pkt_no: r for r in decode(spark.createDataFrame(rows, "pkt_no long, pkt binary").withColumn("link_type", F.lit(1)).coalesce(1)).collect()}
    for k, pkt in rows:
        if pkt is None or k % 11 == 5:
            assert got[k].src_ip is None and got[k].l4_payload is None
        else:
            assert (got[k].dst_ip, got[k].sport, bytes(got[k].l4_payload)) == (f"10.0.{k % 9}.2", k, bytes([k % 256]) * (k * 13 % 1400))
