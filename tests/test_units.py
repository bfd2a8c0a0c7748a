import random
import time

import pytest
from pyspark.sql import functions as F

from flowspark.functions import anonymize as anon
from flowspark.functions.intervals import absolute, micros
from flowspark.operators import aggregates, filters, order, values, windows
from flowspark.operators.filters import search_patterns
from flowspark.plans.errors import FlowError
from flowspark.sources.records import from_events, scope


def test_literals():
    assert [micros(x) for x in ("10us", "100ms", "1s", "1m", "+2h", "7", 5)] == [10, 100_000, 10**6, 60 * 10**6, 7200 * 10**6, 7, 5]
    assert absolute("1970-01-02 00:00:00") == 86_400 * 10**6
    for bad in ("", "1 year", "s"):
        with pytest.raises(FlowError):
            micros(bad)
    with pytest.raises(FlowError):
        absolute("tomorrow")


def test_search_patterns():
    assert search_patterns("a|41 42|b") == [b"aABb"] and search_patterns("x||y") == [b"x", b"y"] and search_patterns("a\\|b") == [b"a|b"]
    for bad in ("", "a||", "|4", "|zz|"):
        with pytest.raises(FlowError):
            search_patterns(bad)


def test_order_helpers_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "SPAN", 7)
    df = spark.createDataFrame([(k * 3, k * k) for k in range(50)], "pkt_no long, v long")
    rows = order.running_sum(order.lagged(order.row_numbers(df), "v", "before"), F.col("v"), "total").orderBy("pkt_no").collect()
    assert [r.n for r in rows] == list(range(1, 51))
    assert [r.before for r in rows] == [None, *(k * k for k in range(49))]
    assert [r.total for r in rows] == [sum(j * j for j in range(k + 1)) for k in range(50)]
    assert order.row_numbers(df.limit(0)).count() == 0


def test_samples(spark, sf_dir):
    e = from_events(spark, sf_dir)
    n = e.count()
    assert filters.sample_periodic(e, 20).count() == n // 20 and filters.sample_periodic(e, 0).count() == n
    share = filters.sample_probabilistic(e, 30).count() / n
    assert 0.25 < share < 0.35 and filters.sample_probabilistic(e, 100).count() == n and filters.sample_probabilistic(e, 0).count() == 0
    hashed = e.withColumn("h", filters.flow_hash(F.col("flow_key"), F.lit(1), F.lit(6), F.lit(80), F.lit(90)))
    assert hashed.where("h < 0 or h > 1023").count() == 0
    assert hashed.select("h", "flow_key").distinct().count() == e.select("flow_key").distinct().count()
    with pytest.raises(FlowError):
        filters.hash_sample(hashed, F.col("h"), 0)


def test_moving_window_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(60_000_000), rng.randrange(3), rng.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(rows, "pkt_no long, us long, sensor int, wlen long")
    got = {r.pkt_no: r.value for r in windows.moving_window(df, F.col("wlen"), "5s", "sensor").collect()}
    assert got == {k: sum(w for _, u, s, w in rows if s == sensor and us - 5_000_000 < u <= us) for k, us, sensor, _ in rows}


def test_buckets_over_several_blocks(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 150_000_000, 7), (2, 150_000_500, 1)], "pkt_no long, us long, wlen long")
    got = windows.bucket(df, F.col("wlen"), "1ms", reset=False, flush=True).orderBy("bucket").collect()
    assert len(got) == 150_001 and (got[0].value, got[149_999].value, got[150_000].value) == (5, 5, 13)


def test_values_and_histograms(spark):
    df = spark.createDataFrame([(0, 1_500_000, 5), (1, 2_000_000, 10), (2, 2_250_000, 30)], "pkt_no long, us long, wlen long")
    assert [r.value for r in values.pktinfo(df, 0).collect()] == [(1 << 32) + (1 << 31), 2 << 32, (2 << 32) + (1 << 30)]
    assert spark.createDataFrame([(bytearray(b"\x00\xff\x01"),), (None,)], "b binary").select(values.byte_hash(F.col("b"))).collect() == [(259,), (0,)]
    bins = {r["bin"]: r["count"] for r in aggregates.dist(df, F.col("wlen"), 10, 30, 10).collect()}
    assert bins == {0: 2, 1: 0, 2: 1}
    assert {r["bin"]: r["count"] for r in aggregates.dist(df.limit(0), F.col("wlen"), 10, 30, 10).collect()} == {0: 0, 1: 0, 2: 0}
    assert scope({"a": df.withColumn("sensor", F.lit(1)), "b": df.withColumn("sensor", F.lit(2))}).groupBy("sensor").count().count() == 2


def test_anonymisers(spark):
    df = spark.createDataFrame([(1, "Cookie: abc", "x.tar.gz"), (2, None, "plain")], "pkt_no long, v string, f string")
    got = df.select(anon.regexp(F.col("v"), "(cookie: )([a-z]+)", [None, "NO"]).alias("r"), anon.hashed(F.col("v"), "CRC32").alias("c"), anon.filename_random(F.col("f")).alias("f")).collect()
    assert got[0].r == "Cookie: NO" and len(got[0].c) == 8 and got[0].f.endswith(".gz") and len(got[0].f) == 8 and got[0].f != "x.tar.gz" and got[1].r is None and len(got[1].f) == 5
    same = spark.createDataFrame([("a",), ("a",), ("b",)], "v string").select(anon.map_distribution(F.col("v"), "UNIFORM", 1, 10**6).alias("m")).collect()
    assert same[0] == same[1] != same[2]
    with pytest.raises(FlowError):
        anon.hashed(F.col("v"), "ROT13")


def test_moving_window_is_no_square_of_its_rows(spark):
    """One window holds all rows: a frame that is summed anew at each of them takes minutes."""
    n = 200_000
    df = spark.range(n).selectExpr("id AS pkt_no", "id * 10 AS us", "0 AS sensor", "IF(id % 4 = 3, NULL, 1) AS wlen")
    started = time.monotonic()
    got = windows.moving_window(df, F.col("wlen"), "1m", "sensor").agg(F.max("value"), F.sum("value")).first()
    assert tuple(got) == (n * 3 // 4, sum(k - k // 4 for k in range(1, n + 1))) and time.monotonic() - started < 60
    assert windows.moving_window(df.where("wlen is null"), F.col("wlen"), "1m", "sensor").where("value is not null").count() == 0
