import os

import pytest
from pyspark.sql import functions as F

from flowspark.operators import flows as batch_flows
from flowspark.operators import trackers
from flowspark.sources.records import from_events
from flowspark.streaming import flows

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def records(spark, sf_dir, tmp_path_factory):
    """The events in order, four files that arrive one after the other."""
    folder = str(tmp_path_factory.mktemp("records") / "r")
    df = from_events(spark, sf_dir)
    df.repartitionByRange(4, "pkt_no").sortWithinPartitions("pkt_no").write.parquet(folder)
    for k, name in enumerate(sorted(x for x in os.listdir(folder) if x.startswith("part-"))):
        os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))  # files arrive in order
    return df, folder


def test_buckets_and_moving_sums_are_those_of_the_batch(spark, records, tmp_path):
    df, folder = records
    end = df.agg(F.max("us")).first()[0]
    got = flows.run_available(flows.bucket(flows.replay(spark, folder, df), F.col("wlen"), "1h", by=("sensor",)), "buckets", str(tmp_path / "a"))
    want = df.groupBy("sensor", F.floor(F.col("us") / HOUR).alias("k")).agg(F.count(F.lit(1)), F.sum("wlen")).collect()
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1] * HOUR, (r[1] + 1) * HOUR, r[2], r[3]) for r in want if (r[1] + 1) * HOUR <= end)
    moving = flows.run_available(flows.moving_sum(flows.replay(spark, folder, df), F.col("wlen"), "2h", 2), "moving", str(tmp_path / "b"))
    some = moving.orderBy("start_us").take(50)[-1]
    assert some.value == df.where((F.col("us") >= some.start_us) & (F.col("us") < some.end_us)).agg(F.sum("wlen")).first()[0]


def test_flows_and_alerts_are_those_of_the_batch(spark, records, tmp_path):
    df, folder = records
    end = df.agg(F.max("us")).first()[0]
    got = flows.run_available(flows.expired_flows(flows.replay(spark, folder, df), ["flow_key"], "12h"), "expired", str(tmp_path / "a"))
    want = [tuple(r) for r in batch_flows.expired_flows(df, ["flow_key"], "12h").collect() if r.end_us + 12 * HOUR <= end]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10
    alerts = flows.run_available(flows.threshold(flows.replay(spark, folder, df), F.col("wlen"), 20_000), "alerts", str(tmp_path / "b"))
    assert alerts.count() == df.where("wlen > 20000").count()


def test_tracker_is_that_of_the_batch(spark, records, tmp_path):
    df, folder = records
    got = flows.run_available(flows.track(flows.replay(spark, folder, df), ["flow_key"], F.col("proto") == "purchase", "8h"), "tracked", str(tmp_path / "a"))
    want = trackers.claimed(df, ["flow_key"], F.col("proto") == "purchase", "8h").where("claimed")
    assert sorted(r.pkt_no for r in got.collect()) == sorted(r.pkt_no for r in want.collect())
