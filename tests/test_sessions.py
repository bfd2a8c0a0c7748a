import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.flows import expired_flows, sessions


def records(n=1500, seed=3):
    """A third of all records, and more, have one key; ties in time, long silences, nulls in keys."""
    r, us, out = random.Random(seed), 0, []
    for k in range(n):
        us += r.choice([0, 1, 10, 500, 900, 1000, 1001, 5000, 100_000] if r.random() < 0.4 else [0, 5, 50])
        out.append((k, us, r.choice(["hot", "hot", "hot", "a", "b", None]), r.randrange(100) < 5, r.randrange(100) < 3, r.randrange(1000)))
    return out


def plainly(rows, idle):
    state, out = {}, {}
    for number, us, key, closes, sign, value in sorted(rows, key=lambda x: (x[1], x[0])):
        last, closed, session, first, seen = state.get(key, (None, True, 0, None, False))
        if last is None or us - last > idle or closed:
            session, first, seen = session + 1, (us, value), False
        seen = seen or sign
        state[key] = (us, closes, session, first, seen)
        out[number] = (session, *first, seen)
    return out


@pytest.mark.parametrize("block", ["1ms", "7ms", "100ms", "10m"])
def test_sessions_of_a_hot_key_in_blocks(spark, block):
    rows = records()
    df = spark.createDataFrame(rows, "pkt_no long, us long, key string, closes boolean, sign boolean, value long").repartition(7)
    got = sessions(df, ["key"], "1ms", F.col("closes"), {"began": F.col("us"), "first_value": F.col("value")}, {"seen": F.col("sign")}, block)
    assert {r.pkt_no: (r.session, r.began, r.first_value, r.seen) for r in got.collect()} == plainly(rows, 1000)
    assert got.columns == [*df.columns, "session", "began", "first_value", "seen"]


def test_null_values_of_first_records(spark):
    df = spark.createDataFrame([(0, 0, "k", None), (1, 1500, "k", 5), (2, 9_000_000, "k", 6), (3, 9_000_001, "k", None)], "pkt_no long, us long, key string, value long")
    got = sessions(df, ["key"], "2ms", firsts={"first": F.col("value")}, block="1ms")
    assert {r.pkt_no: (r.session, r.first) for r in got.collect()} == {0: (1, None), 1: (1, None), 2: (2, 6), 3: (2, 6)}
    assert sessions(df.limit(0), ["key"], "2ms").count() == 0


def test_expired_flows_of_a_hot_key(spark):
    rows = records(600, 9)
    df = spark.createDataFrame([(n, us, k, 60) for n, us, k, *_ in rows], "pkt_no long, us long, key string, wlen int")
    flows = {}
    for n, us, k, *_ in rows:
        mine = flows.setdefault(k, [])
        if mine and us - mine[-1][1] <= 1000:
            mine[-1] = (mine[-1][0], us, mine[-1][2] + 1)
        else:
            mine.append((us, us, 1))
    want = sorted((str(k), *f) for k, found in flows.items() for f in found)
    assert sorted((str(r.key), r.start_us, r.end_us, r.packets) for r in expired_flows(df, ["key"], "1ms").collect()) == want
