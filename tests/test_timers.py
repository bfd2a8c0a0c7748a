import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.windows import DIFF_GT, GT, LT
from flowspark.plans.errors import FlowError
from flowspark.streaming import timers
from flowspark.streaming.flows import replay

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
POLLED = "pkt_no long, us long, key string, wlen int"
SEGMENTS = "pkt_no long, us long, src_ip string, dst_ip string, ip_proto int, sport int, dport int, tcp_seq long, tcp_flags int, l4_payload binary"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, timers.ROCKSDB)
    yield
    spark.conf.set(PROVIDER, before)


def run(spark, tmp_path, parts, schema, query):
    """Parts arrive one after the other; the query is started anew for each, from its checkpoint."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    like = spark.createDataFrame([], schema)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        q = query(replay(spark, folder, like)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(200) and q.exception() is None
    return spark.read.parquet(out).collect()


def polls(rows, every, test, upto, quiet):
    out = {}
    for key in {r[2] for r in rows}:
        mine = sorted((r[1], r[3]) for r in rows if r[2] == key)
        slots, total, before, slot, still = {}, 0, 0, None, 0
        for us, n in mine:
            slots[us // every] = slots.get(us // every, 0) + n
        slot = min(slots)
        while slot is not None and (slot + 1) * every <= upto:
            known = slot in slots
            total += slots.pop(slot, 0)
            still = 0 if known else still + 1
            if test(total, before):
                out[key, (slot + 1) * every] = total
            before, slot = total, slot + 1
            if still >= quiet:
                slot, still = (min(slots), 0) if slots else (None, 0)
    return out


@pytest.mark.parametrize("bound, limit, test", [(LT, 900, lambda n, b: n < 900), (DIFF_GT, 250, lambda n, b: n - b > 250)])
def test_polls_over_restarts(spark, tmp_path, bound, limit, test):
    r = random.Random(bound)
    rows = [(k, us, r.choice("ab"), 100) for k, us in enumerate(sorted(r.choice([0, 60_000_000]) + r.randrange(20_000_000) for _ in range(120)))]
    rows.append((999, 120_000_000, "end", 1))
    got = run(spark, tmp_path, [rows[:40], rows[40:70], rows[70:]], POLLED, lambda s: timers.polled_threshold(s, ["key"], F.col("wlen"), bound, limit, "1s", quiet=5))
    want = polls(rows, 1_000_000, test, 120_000_000, 5)
    assert {(x.key, x.poll_us): x.value for x in got} == {k: v for k, v in want.items() if k[0] != "end"} and len(got) == len({(x.key, x.poll_us) for x in got})


def test_late_records_are_left_out(spark, tmp_path):
    parts = [[(0, 500_000, "a", 1), (1, 10_000_000, "a", 1)], [(2, 600_000, "a", 50), (3, 20_000_000, "b", 1)]]
    got = run(spark, tmp_path, parts, POLLED, lambda s: timers.polled_threshold(s, ["key"], F.col("wlen"), GT, 0, "1s", quiet=100))
    assert {x.value for x in got if x.key == "a"} == {1, 2} and max(x.poll_us for x in got) == 20_000_000


def test_bad_polls(spark):
    df = spark.createDataFrame([], POLLED)
    for args in ((9, 1, "1s"), (GT, 1, "1us"), (GT, 1, "0s")):
        with pytest.raises(FlowError):
            timers.polled_threshold(df, ["key"], F.col("wlen"), *args)


def segment(n, us, at, data, flags=16, sport=1000):
    return (n, us + 1000, "10.0.0.1", "10.0.0.2", 6, sport, 80, at % 2**32, flags, data)


def test_streams_come_together_over_restarts(spark, tmp_path):
    """Segments out of order over two runs, sent again and overlapping, with numbers that wrap."""
    r, start = random.Random(2), 2**32 - 700
    whole = bytes(r.randrange(256) for _ in range(2000))
    pieces = [(a, whole[a : a + 60]) for a in range(0, 2000, 50)]
    rest = pieces[1:]
    r.shuffle(rest)
    rows = [segment(0, 0, start - 1, b"", 2)] + [segment(k + 1, 1000 * k + 1000, start + a, d) for k, (a, d) in enumerate([pieces[0], *rest])]
    rows.append((99, 600_000_000, "9.9.9.9", "8.8.8.8", 6, 1, 2, 5, 16, b"later"))
    got = run(spark, tmp_path, [rows[:15], rows[15:]], SEGMENTS, lambda s: timers.reassemble(s, "60s"))
    mine = sorted((x.position, bytes(x.data), x.dropped) for x in got if x.sport == 1000)
    assert b"".join(d for _, d, _ in mine) == whole and all(not dropped for *_, dropped in mine)
    assert [p for p, *_ in mine] == [sum(len(d) for _, d, _ in mine[:k]) for k in range(len(mine))]


def test_dropped_bytes_are_told(spark, tmp_path):
    """A gap is given up when too much is held, at a FIN, and when the side falls silent."""
    rows = [segment(0, 0, 0, b"ab"), segment(1, 10, 12, b"x" * 40), segment(2, 20, 52, b"y" * 40)]
    rows += [segment(3, 0, 0, b"ab", sport=2), segment(4, 10, 5, b"end", sport=2), segment(5, 20, 8, b"", 17, sport=2)]
    rows += [segment(6, 0, 0, b"ab", sport=3), segment(7, 10, 4, b"silent", sport=3), segment(8, 900_000_000, 0, b"z", sport=9)]
    got = run(spark, tmp_path, [rows], SEGMENTS, lambda s: timers.reassemble(s, "60s", most_bytes=64))
    told = {s: sorted((x.position, bytes(x.data), x.dropped) for x in got if x.sport == s) for s in (1000, 2, 3)}
    assert told[1000] == [(0, b"ab", 0), (12, b"x" * 40, 10), (52, b"y" * 40, 0)]
    assert told[2] == [(0, b"ab", 0), (5, b"end", 3)] and told[3] == [(0, b"ab", 0), (4, b"silent", 2)]
