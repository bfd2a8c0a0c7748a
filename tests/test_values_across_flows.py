import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.asof import as_of
from flowspark.operators.flows import effective_windows, flow_report
from flowspark.operators.values import binop_at_records, byte_hash
from flowspark.plans import flow as api
from flowspark.plans.errors import FlowError
from flowspark.sources.pcap import decode
from tests.packets import ethernet, ipv4, stream, tcp, udp

RECORDS = "pkt_no long, us long, value long"


def streams(spark, seed):
    r = random.Random(seed)
    make = lambda n, gap: [(k, us, r.choice([None, r.randrange(100)])) for k, us in enumerate(sorted(r.randrange(gap) for _ in range(n)))]
    return [make(n, 4_000_000) for n in (300, 80, 5)]


def latest(rows, us):
    known = [v for n, t, v in sorted(rows, key=lambda x: (x[1], x[0])) if t <= us and v is not None]
    return known[-1] if known else None


@pytest.mark.parametrize("width", ["1ms", "100ms", "1s", "1h"])
def test_latest_values_of_other_streams(spark, width):
    own, a, b = streams(spark, 4)
    frames = [spark.createDataFrame(rows, RECORDS).repartition(4) for rows in (own, a, b)]
    got = as_of(frames[0], {"a": frames[1], "b": frames[2]}, width)
    assert got.columns == ["pkt_no", "us", "value", "a", "b"]
    assert {r.pkt_no: (r.us, r.value, r.a, r.b) for r in got.collect()} == {n: (us, v, latest(a, us), latest(b, us)) for n, us, v in own}


def test_binop_at_records(spark):
    own, a, b = streams(spark, 7)
    frames = [spark.createDataFrame(rows, RECORDS) for rows in (own, a, b)]
    for op, sign in ((0, 1), (1, -1)):
        got = {r.pkt_no: r.value for r in binop_at_records(*frames, op).collect()}
        assert got == {n: (latest(a, us) or 0) + sign * (latest(b, us) or 0) for n, us, _ in own}
    assert binop_at_records(frames[0], frames[1].limit(0), frames[2].limit(0), 0).where("value <> 0").count() == 0
    assert binop_at_records(frames[0].limit(0), frames[1], frames[2], 0).count() == 0
    with pytest.raises(FlowError):
        binop_at_records(*frames, 2)


def test_threshold_reads_binop_of_other_flows(spark):
    frames = [(k * 1000, ethernet(ipv4("10.0.0.1", "10.0.0.2", 6 if k % 3 else 17, (tcp if k % 3 else udp)(1, 2)))) for k in range(12)]
    packets = decode(stream(spark, frames))
    one, two, own = (api.create_flow(packets) for _ in range(3))
    one.apply("BPF_FILTER", "tcp")
    two.apply("BPF_FILTER", "udp")
    a, b = one.apply("PKT_COUNTER"), two.apply("PKT_COUNTER")
    c = own.apply("BINOP", 1, one.fd, a, two.fd, b)
    over = own.apply("THRESHOLD", 0, own.fd, c, 2, 1, 0, 0, 0)
    with pytest.raises(FlowError):
        own.values(c)
    for flow in (one, two, own):
        flow.connect()
    want = {k: sum(1 if j % 3 else -1 for j in range(k + 1)) for k in range(12)}
    assert {r.pkt_no: r.value for r in own.values(c).collect()} == want
    assert {r.pkt_no for r in own.read(over).collect()} == {k for k, v in want.items() if v > 2}
    assert own.read(c).first().value == 4  # 8 - 4 at the end


def dialogue(seed, n, start):
    r, sent, out, us = random.Random(seed), [0, 0], [], 0
    for _ in range(n):
        side, size = r.randrange(2), r.choice([0, 0, 3, 50])
        us += r.randrange(1000)
        ack = 0 if r.random() < 0.1 else (start + max(0, sent[1 - side] - r.choice([0, 0, 40, 90]))) % 2**32
        ends = ("10.0.0.1", "10.0.0.2", 1000, 80)
        src, dst, sport, dport = ends if side == 0 else (ends[1], ends[0], ends[3], ends[2])
        out.append((us, side, (start + sent[side]) % 2**32, ack, size, ethernet(ipv4(src, dst, 6, tcp(sport, dport, b"x" * size, seq=(start + sent[side]) % 2**32, ack=ack)))))
        sent[side] += size
    return out


def windows(packets):
    first, held, best = [None, None], [0, 0], [0, 0]
    for _, side, seq, ack, size, _ in packets:
        o = 1 - side
        if first[o] is not None and ack != 0 and 0 < (ack - first[o]) % 2**32 < 2**31:
            best[o], first[o] = max(best[o], held[o]), None
        held[side] = size if first[side] is None else held[side] + size
        first[side] = seq if first[side] is None else first[side]
    return tuple(best)


@pytest.mark.parametrize("start", [1, 2**32 - 300, 2**31 - 100])
def test_effective_windows(spark, start):
    packets = dialogue(start % 97, 200, start)
    rows = decode(stream(spark, [(p[0], p[-1]) for p in packets])).withColumn("dir_", (F.col("sport") == 80).cast("int")).withColumn("g", F.lit(None).cast("string"))
    got = effective_windows(rows, ["g"]).first()
    assert (got.g, got.effective_window0, got.effective_window1) == (None, *windows(packets)) and max(windows(packets)) > 0
    flow = flow_report(rows.drop("dir_"), ["g"], F.col("dport") == 80, "24h", "24h", tcp=True).first()
    assert {flow.effective_window0, flow.effective_window1} == set(windows(packets))
    assert effective_windows(rows.where("false"), ["g"]).count() == 0


def test_byte_hash(spark):
    data = [None, b"", b"\xff" * 5000, bytes(range(256)), b"a"]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, d binary")
    assert [r.h for r in df.orderBy("k").select(byte_hash(F.col("d")).alias("h")).collect()] == [0 if d is None else (len(d) + sum(d)) % 500009 for d in data]
