import random
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.operators import rtp
from flowspark.operators.flows import flow_report
from flowspark.operators.order import keyed
from flowspark.sources.pcap import decode
from tests.packets import ethernet, ipv4, stream, udp

ROWS = "pkt_no long, us long, ssrc long, rtp_seq long, rtp_time long, rate int"


def recurrence(rows):
    state, out = {}, {}
    for number, us, ssrc, seq, time, rate in sorted(rows, key=lambda r: (r[1], r[0])):
        last = state.get(ssrc)
        j = last[3] if last else None
        if last and seq == (last[0] + 1) % 65536:
            d = abs((us - last[2]) - ((time - last[1] + 2**31) % 2**32 - 2**31) * 1_000_000 / rate)
            j = d if j is None else j + (d - j) / 16
        state[ssrc] = (seq, time, us, j)
        out[number] = j
    return out


@pytest.mark.parametrize("n, epoch", [(20_000, 4096), (400, 16)])
def test_jitter_is_the_recurrence_on_long_streams(spark, monkeypatch, n, epoch):
    """A stream with nearly all packets, over several epochs; numbers and timestamps that wrap; losses and repeats. Small epochs
    are too short to be exact, but must still agree to (15/16)**16 of the largest deviation."""
    monkeypatch.setattr(rtp, "STEPS_AN_EPOCH", epoch)
    r, rows, seq = random.Random(n), [], 65_000
    for k in range(n):
        seq += r.choice([1] * 30 + [0, 2, 5])
        rows.append((k, k * 20_000 + r.randrange(9000), 7 if r.random() < 0.95 else 8, seq % 65536, (2**32 - 5000 + k * 160) % 2**32, 8000))
    got = {x.pkt_no: x.jitter for x in rtp.jitter(spark.createDataFrame(rows, ROWS).repartition(5), ["ssrc"]).select("pkt_no", "jitter").collect()}
    want = recurrence(rows)
    close = 1e-9 if epoch == 4096 else 0.5
    assert set(got) == set(want) and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) <= close * max(1.0, want[k])) for k in want)


def test_streams_in_packets(spark):
    def frame(seq, time, ssrc=5, first=0x80, kind=0, cut=12):
        return ethernet(ipv4("10.0.0.1", "10.0.0.2", 17, udp(4000, 5004, struct.pack(">BBHII", first, kind, seq, time, ssrc)[:cut])))

    frames = [(0, frame(1, 0)), (20_000, frame(2, 160)), (45_000, frame(3, 320)), (60_000, frame(9, 480)), (70_000, frame(1, 0, 6)), (80_000, frame(4, 1, first=0x40)), (90_000, frame(4, 1, kind=72)), (95_000, frame(4, 1, cut=11))]
    got = {r.ssrc: r for r in rtp.rtp_report(rtp.rtp_packets(decode(stream(spark, frames)))).collect()}
    assert set(got) == {5, 6} and (got[5].packets, got[5].jumps, got[5].max_deviation, got[5].jitter) == (4, 1, 5000.0, 312.5)
    assert (got[6].packets, got[6].jumps, got[6].jitter) == (1, 0, None)
    assert rtp.rtp_report(rtp.rtp_packets(decode(stream(spark, frames))).where("false")).count() == 0


def test_lags_and_sums_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(k, us, r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, r.randrange(9)])) for k, us in enumerate(sorted(r.randrange(5_000_000) for _ in range(800)))]
    got = keyed(spark.createDataFrame(rows, "pkt_no long, us long, key string, v long").repartition(4), ["key"], {"before": F.col("v"), "at": F.col("us")}, {"total": F.col("v")}, block="100ms")
    state, want = {}, {}
    for number, us, key, v in rows:
        before, at, total = state.get(key, (None, None, 0))
        state[key] = (v, us, total + (v or 0))
        want[number] = (before, at, total + (v or 0))
    assert {x.pkt_no: (x.before, x.at, x.total) for x in got.collect()} == want


def test_flows_that_come_back(spark):
    s = 1_000_000
    times = [0, 10 * s, 100 * s, 500 * s, 530 * s, 560 * s, 2000 * s]
    df = spark.createDataFrame([(k, us, "k", 100) for k, us in enumerate(times)], "pkt_no long, us long, key string, wlen int")
    got = [(r.start_us // s, r.flow, r.continued, r.flow_first_us // s) for r in flow_report(df, ["key"], F.lit(True), cache="360s").orderBy("start_us").collect()]
    assert got == [(0, 1, False, 0), (100, 1, True, 0), (500, 2, False, 500), (2000, 3, False, 2000)]
