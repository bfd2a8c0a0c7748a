"""Jitter of RTP streams (RFC 3550) by a parallel scan.

The estimate J follows J + (d - J) / 16 from packet to packet, which is an affine map of J. Maps compose, so after n
steps J is the sum of d / 16 times (15/16) to the power of the steps since. Steps are numbered along a stream and cut into
epochs of 4,096: within an epoch the terms, scaled to its beginning, are a running sum; of earlier epochs only the
last one has weight, as (15/16)**4096 is below 1e-114. A stream of any length is therefore scanned in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.order import keyed

STEPS_AN_EPOCH = 4096
STREAM = ["src_ip", "dst_ip", "sport", "dport", "ssrc"]
#: Clock rates by payload type (fixed values of RFC 3551); others have DYNAMIC_RATE.
RATES = {0: 8000, 3: 8000, 4: 8000, 5: 8000, 6: 16000, 7: 8000, 8: 8000, 9: 8000, 10: 44100, 11: 44100, 12: 8000, 13: 8000, 14: 90000, 15: 8000, 16: 11025, 17: 22050, 18: 8000, 25: 90000, 26: 90000, 28: 90000, 31: 90000, 32: 90000, 33: 90000, 34: 90000}
DYNAMIC_RATE = 90000


def _number(at: int, width: int) -> Column:
    return F.conv(F.hex(F.substring("l4_payload", at + 1, width)), 16, 10).cast("long")


def rtp_packets(df: DataFrame, rates: dict[int, int] | None = None) -> DataFrame:
    """Decoded UDP packets that can be RTP (version 2, a whole header, a payload type of ``rates`` or a dynamic one), with
    payload_type, rtp_seq, rtp_time, ssrc and rate. Control packets, of types 72 to 76 in this reading, are left out."""
    known = RATES | (rates or {})
    rows = df.where((F.col("ip_proto") == 17) & F.col("sport").isNotNull() & (F.octet_length("l4_payload") >= 12))
    kind = _number(1, 1).bitwiseAND(F.lit(127))
    rows = rows.withColumns({"version_": F.shiftright(_number(0, 1), 6), "payload_type": kind.cast("int"), "rtp_seq": _number(2, 2), "rtp_time": _number(4, 4), "ssrc": _number(8, 4)})
    rate = F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("payload_type")], F.lit(DYNAMIC_RATE))
    rows = rows.where((F.col("version_") == 2) & (F.col("payload_type").isin(*known) | (F.col("payload_type") >= 96)))
    return rows.withColumn("rate", rate).drop("version_")


def jitter(df: DataFrame, key: list[str] = STREAM) -> DataFrame:
    """``rtp_packets`` with deviation and jitter in microseconds.

    deviation: by how much the time between the packet and the one before differs from that between their timestamps
    (which wrap at 2**32); null for a stream's first packet and where the sequence number is not the next one (mod
    65,536). jitter: the first deviation, then J + (d - J) / 16 at each one; in between it stays, before the first it is null.
    """
    rows = keyed(df, key, lags={"seq_": F.col("rtp_seq"), "time_": F.col("rtp_time"), "us_": F.col("us")})
    step = F.pmod(F.col("rtp_time") - F.col("time_") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    late = (F.col("us") - F.col("us_")) - step * 1_000_000 / F.col("rate")
    rows = rows.withColumn("deviation", F.when(F.col("rtp_seq") == (F.col("seq_") + 1) % 65536, F.abs(late))).drop("seq_", "time_", "us_")
    rows = keyed(rows, key, sums={"step_": F.col("deviation").isNotNull().cast("long")})
    place = F.col("step_") - 1
    rows = rows.withColumns({"epoch_": F.floor(place / STEPS_AN_EPOCH), "in_epoch_": place % STEPS_AN_EPOCH})
    term = F.col("deviation") * F.when(place == 0, F.lit(1.0)).otherwise(F.lit(1 / 16)) * F.pow(F.lit(16 / 15), "in_epoch_")
    rows = rows.withColumn("term_", F.coalesce(term, F.lit(0.0)))
    w = Window.partitionBy(*key, "epoch_").orderBy("us", "pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*key, "epoch_").agg(F.sum("term_").alias("total_")).select(*(F.col(k).alias(f"e_{k}") for k in key), (F.col("epoch_") + 1).alias("e_epoch_"), "total_")
    same = F.col("epoch_") == F.col("e_epoch_")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    rows = rows.withColumn("sum_", F.sum("term_").over(w)).join(totals, same, "left")
    value = (F.col("sum_") + F.coalesce("total_", F.lit(0.0)) * F.pow(F.lit(15 / 16), F.lit(STEPS_AN_EPOCH))) * F.pow(F.lit(15 / 16), "in_epoch_")
    rows = rows.withColumn("jitter", F.when(F.col("step_") > 0, value))
    return rows.select(*df.columns, "deviation", "jitter")


def rtp_report(df: DataFrame, key: list[str] = STREAM) -> DataFrame:
    """One row a stream of ``jitter``: packets, jumps (sequence numbers that are not the next), the least, mean and largest
    deviation, and the jitter at its end."""
    rows = jitter(df, key)
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("packets"), (F.count(F.lit(1)) - 1 - F.count("deviation")).alias("jumps"), F.min("deviation").alias("min_deviation"),
        F.avg("deviation").alias("mean_deviation"), F.max("deviation").alias("max_deviation"), F.max_by("jitter", F.struct("us", "pkt_no")).alias("jitter"),
    )
