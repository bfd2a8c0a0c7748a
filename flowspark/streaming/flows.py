"""The operators as Structured Streaming queries over a replayed record stream.

Time is event time. A watermark of ``delay`` lets records arrive late; later ones are
left out. State is one row per open window or session, kept by Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowspark.functions.intervals import micros


def replay(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder of records as a stream, some files a batch, in order of arrival."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)


def bucket(stream: DataFrame, value: Column, interval: str, delay: str = "0 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, end, packets, value) of each interval with records, once the watermark has passed its end."""
    seconds = f"{micros(interval)} microseconds"
    out = _timed(stream, delay).groupBy(*by, F.window("ts", seconds)).agg(F.count(F.lit(1)).alias("packets"), F.sum(value).cast("long").alias("value"))
    return out.select(*by, F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "packets", "value")


def moving_sum(stream: DataFrame, value: Column, window: str, slots: int, delay: str = "0 seconds") -> DataFrame:
    """The sum over a window that moves on by a ``slots``-th of itself."""
    width = micros(window)
    out = _timed(stream, delay).groupBy(F.window("ts", f"{width} microseconds", f"{width // slots} microseconds")).agg(F.sum(value).cast("long").alias("value"))
    return out.select(F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "value")


def expired_flows(stream: DataFrame, key: list[str], idle: str = "30s", min_pkts: int = 0, delay: str = "0 seconds") -> DataFrame:
    """(key, start_us, end_us, packets, bytes) of each flow, once it has been silent for more than ``idle``."""
    gap = micros(idle)
    out = _timed(stream, delay).groupBy(*key, F.session_window("ts", f"{gap} microseconds")).agg(F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes"))
    out = out.where(F.col("packets") >= min_pkts)
    return out.select(*key, F.unix_micros("session_window.start").alias("start_us"), (F.unix_micros("session_window.end") - gap).alias("end_us"), "packets", "bytes")


def threshold(stream: DataFrame, value: Column, above: int) -> DataFrame:
    """Records whose value is above a limit, as they come."""
    return stream.withColumn("value", value).where(F.col("value") > above)


def track(stream: DataFrame, key: list[str], signature: Column, idle: str = "60s", delay: str = "0 seconds") -> DataFrame:
    """Positions of the records of sessions that have shown the signature, as column pkt_no with the key.

    The state of a key is when its session was last seen and whether it is claimed; it
    goes when the watermark says that the session is over.
    """
    limit = micros(idle)
    rows = _timed(stream, delay).withColumn("signature", F.coalesce(signature, F.lit(False))).select(*key, "us", "pkt_no", "signature", "ts")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, claimed = state.get if state.exists else (None, False)
        out = []
        for part in parts:
            for us, number, shown in part.sort_values(["us", "pkt_no"])[["us", "pkt_no", "signature"]].itertuples(index=False):
                if seen is not None and us - seen > limit:
                    claimed = False
                claimed = bool(claimed or shown)
                seen = max(int(us), seen or int(us))
                if claimed:
                    out.append((*who, int(number)))
        state.update((seen, claimed))
        state.setTimeoutTimestamp(max((seen + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*key, "pkt_no"])

    return rows.groupBy(*key).applyInPandasWithState(run, f"{kinds}, pkt_no bigint", "seen bigint, claimed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a query over what is there now, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
