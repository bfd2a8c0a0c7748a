"""Protocols told apart by filters, names of files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowspark.functions import anonymize as anon
from flowspark.plans import apps
from flowspark.sources.pcap import decode
from tests.packets import ethernet, ipv4, stream, tcp, udp


def test_traffic_of_filters(spark):
    bodies = [(6, tcp(9, 80)), (6, tcp(80, 9)), (17, udp(9, 53)), (6, tcp(554, 80)), (6, tcp(554, 81)), (17, udp(6881, 1)), (6, tcp(1, 6881)), (17, udp(513, 9)), (6, tcp(513, 9))]
    frames = [(k * 400_000, ethernet(ipv4("1.1.1.1", "2.2.2.2", proto, body))) for k, (proto, body) in enumerate(bodies)] + [(0, b""), (1, ethernet(bytes(46), 0x0806))]
    got = {(r.slot, r.protocol): (r.packets, r.bytes) for r in apps.protocol_traffic(decode(stream(spark, frames))).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        (0, "arp"): 1, (0, "ip"): 3, (0, "tcp"): 2, (0, "udp"): 1, (0, "http"): 2, (0, "dns"): 1, (1, "ip"): 2, (1, "tcp"): 2, (1, "http"): 1, (1, "radio"): 1,
        (2, "ip"): 3, (2, "udp"): 2, (2, "tcp"): 1, (2, "torrent"): 1, (2, "who"): 1, (3, "ip"): 1, (3, "tcp"): 1,
    }
    assert got[0, "ip"][1] == 180


def test_filters_of_ones_own(spark):
    packets = decode(stream(spark, [(0, ethernet(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(9, 25))))]))
    rows = apps.protocol_traffic(packets, {"mail": "port 25", "none": "port 26"}, "1m").collect()
    assert [(r.slot, r.protocol, r.packets) for r in rows] == [(0, "mail", 1)]
    assert apps.protocol_traffic(packets.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no filter"):
        apps.protocol_traffic(packets, {})


def test_names_of_files(spark):
    names = ["a/long name.tar.gz", "plain", ".rc", "x.", "", None, "ä" * 300 + ".txt"]
    df = spark.createDataFrame([(n,) for n in names], "f string").withColumn("d", F.lit("one"))
    rows = df.select("f", anon.filename_random(F.col("f")).alias("free"), anon.filename_random(F.col("f"), draw=F.col("d")).alias("drawn"), anon.filename_random(F.col("f"), draw=F.col("d")).alias("again")).collect()
    for r in rows:
        assert r.drawn == r.again
        for made in (r.free, r.drawn):
            if r.f is None:
                assert made is None
                continue
            stem, dot, end = r.f.rpartition(".") if "." in r.f else (r.f, "", "")
            assert len(made) == len(r.f) and made.endswith(dot + end)
            assert all(33 <= ord(x) <= 125 for x in made[: len(stem)])
    assert len({r.free for r in rows}) == 7
    assert len(set(rows[6].free[:300])) > 60
