"""Counters, statistics, histograms and heavy hitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros
from flowspark.operators.order import lagged, running_sum
from flowspark.plans.errors import Err, FlowError

BY_PACKETS, BY_BYTES = 1, 2


def pkt_counter(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def byte_counter(df: DataFrame) -> DataFrame:
    """Sum of the lengths on the wire."""
    return df.agg(F.coalesce(F.sum("wlen"), F.lit(0)).cast("long").alias("value"))


def _stats(value: Column, of_sums: bool = False) -> list[Column]:
    # Sums of a period grow with the stream, and their squares pass 64 bits first.
    square = F.sum(value.cast("decimal(19,0)") * value.cast("decimal(19,0)")) if of_sums else F.sum(value * value).cast("long")
    return [F.count(value).alias("count"), F.sum(value).cast("long").alias("sum"), square.alias("sum2"), F.min(value).alias("min"), F.max(value).alias("max")]


def stats(df: DataFrame, value: Column, ticks: str = "0", by: list[str] | None = None, of_sums: bool = False) -> DataFrame:
    """count, sum, sum of squares, min and max of a value: of every record ("0"), of all but the first ("1"), or of
    its sums over each period that has records ("100ms", counted from the first record). Squares of such sums, also
    where the value is one already (``of_sums``), are added up as decimals of 38 digits, other squares in 64 bits."""
    by = by or []
    if ticks == "0":
        return df.groupBy(*by).agg(*_stats(value, of_sums))
    if ticks == "1":
        first = df.groupBy(*by).agg(F.min("pkt_no").alias("first_"))
        joined = df.join(first, by) if by else df.crossJoin(F.broadcast(first))  # without keys one row
        return joined.where("pkt_no > first_").groupBy(*by).agg(*_stats(value))
    period = micros(ticks)
    if period <= 0:
        raise FlowError(Err.INVALID_ARGUMENT_3, "no period")
    origin = df.groupBy(*by).agg(F.min("us").alias("origin_"))
    joined = df.join(origin, by) if by else df.crossJoin(F.broadcast(origin))  # without keys one row
    sums = joined.groupBy(*by, F.floor((F.col("us") - F.col("origin_")) / period).alias("slot_")).agg(F.sum(value).cast("long").alias("v_"))
    return sums.groupBy(*by).agg(*_stats(F.col("v_"), True))


def dist(df: DataFrame, value: Column, low: int, high: int, width: int, exact_legacy: bool = False) -> DataFrame:
    """Histogram (bin, count) with all bins: bin 0 below low + width, bin i from low + i * width, the last one from high on.

    ``exact_legacy`` gives the historic rule: below low 0, above high the last, else
    ceil((v - low - 1) / width) with the value low itself in the last bin.
    """
    if width <= 0 or high <= low:
        raise FlowError(Err.INVALID_ARGUMENT_4, "no interval")
    bins = -(-(high - low) // width)
    if exact_legacy:
        inside = F.when(value == low, F.lit(bins)).otherwise(F.least(F.lit(bins), F.ceil((value - low - 1) / F.lit(width))))
        slot = F.when(value < low, 0).when(value > high, bins).otherwise(inside)
    else:
        slot = F.when(value < low, 0).when(value >= high, bins).otherwise(F.floor((value - low) / F.lit(width)))
    counts = df.where(value.isNotNull()).groupBy(slot.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_"))
    every = df.sparkSession.range(bins + 1).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n_", F.lit(0)).alias("count"))


def burst(df: DataFrame, low: int, high: int, step: int, gap_ns: int, late_ns: int, early_ns: int, mbps: int) -> DataFrame:
    """Bursts of back-to-back records by size: (category, bytes, packets, bursts, gap_bytes, gaps), categories that occur.

    A record belongs to the burst before it if it starts when the one before has been
    sent at ``mbps`` plus ``gap_ns``, up to ``early_ns`` earlier or ``late_ns`` later.
    Category 0 is below ``low`` bytes, the last one from ``high`` on, ``step`` bytes each
    between. A gap is the silence before a burst, in bytes at that speed, in the
    category of its size.
    """
    if step <= 0 or high <= low or mbps <= 0:
        raise FlowError(Err.INVALID_ARGUMENT_3, "no step, range or speed")
    last = (high - low) // step + 1
    rows = df.select("pkt_no", "wlen", (F.col("us") * 1000).alias("ns"))
    rows = lagged(rows.withColumn("due", F.col("ns") + F.floor(F.col("wlen") * 8000 / F.lit(mbps)).cast("long")), "due", "due_before")
    late = F.col("ns") - (F.col("due_before") + gap_ns)
    rows = rows.withColumn("new", F.coalesce(((late < -early_ns) | (late > late_ns)).cast("int"), F.lit(1)))
    silence = F.when(F.col("due_before").isNotNull(), F.greatest(F.lit(0), F.col("ns") - F.col("due_before")))
    rows = running_sum(rows.withColumn("silence", F.floor(silence * mbps / F.lit(8000)).cast("long")), F.col("new").cast("long"), "burst")
    bursts = rows.groupBy("burst").agg(F.sum("wlen").cast("long").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.sum(F.when(F.col("new") == 1, F.col("silence"))).cast("long").alias("gap"))

    def category(v: Column) -> Column:
        return F.when(v < low, 0).when(v >= high, last).otherwise(F.floor((v - low) / F.lit(step)) + 1).cast("long")

    sizes = bursts.select(category(F.col("bytes")).alias("category"), "bytes", "packets", F.lit(1).alias("bursts"), F.lit(0).alias("gap_bytes"), F.lit(0).alias("gaps"))
    gaps = bursts.where("gap is not null").select(category(F.col("gap")).alias("category"), F.lit(0), F.lit(0), F.lit(0), F.col("gap"), F.lit(1))
    columns = ["bytes", "packets", "bursts", "gap_bytes", "gaps"]
    return sizes.union(gaps).groupBy("category").agg(*(F.sum(c).cast("long").alias(c) for c in columns))


def top(df: DataFrame, field: Column, many: int, sort_by: int = BY_PACKETS, reset: str | None = None) -> DataFrame:
    """The ``many`` heaviest values of a field: (value, packets, bytes), in each period of ``reset`` (period) if given.
    Ties go to the smaller value; counts are exact. Rows without the field don't count."""
    if not 1 <= many <= 1000:
        raise FlowError(Err.INVALID_ARGUMENT_1, "1 to 1000 values")
    if sort_by not in (BY_PACKETS, BY_BYTES):
        raise FlowError(Err.INVALID_ARGUMENT_4, "1 sorts by packets, 2 by bytes")
    rows = df.withColumn("value", field).where("value is not null")
    sums = [F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes")]
    order = [F.desc("packets" if sort_by == BY_PACKETS else "bytes"), F.asc("value")]
    if reset is None:
        return rows.groupBy("value").agg(*sums).orderBy(*order).limit(many)
    counted = rows.groupBy(F.floor(F.col("us") / micros(reset)).alias("period"), "value").agg(*sums)
    rank = F.row_number().over(Window.partitionBy("period").orderBy(*order))
    return counted.withColumn("rank", rank).where(F.col("rank") <= many)
