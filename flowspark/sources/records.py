"""Record streams: the roles that operators read, and adapters that give them to tables.

A record stream has the columns pkt_no (position), us (microseconds since the epoch),
wlen (length), flow_key, proto, payload and sensor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ["pkt_no", "us", "wlen", "flow_key", "proto", "payload", "sensor"]


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a record stream; lengths are whole cents, so that sums are exact."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("pkt_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.round(F.col("value") * 100).cast("long").alias("wlen"),
        F.col("user_id").alias("flow_key"),
        F.col("event_type").alias("proto"),
        F.col("props").alias("payload"),
        (F.col("user_id") % 4).cast("int").alias("sensor"),
    )


def scope(sources: dict[str, DataFrame]) -> DataFrame:
    """One stream over several sensors: the union of their records, each with its sensor's name."""
    return reduce(DataFrame.unionByName, [df.drop("sensor").withColumn("sensor", F.lit(name)) for name, df in sources.items()])
