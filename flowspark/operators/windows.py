"""Buckets of time, thresholds and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros
from flowspark.operators.order import SPAN, lagged, running_sum
from flowspark.plans.errors import Err, FlowError

EQ, GT, LT, DIFF_GT, DIFF_LT = range(5)


def _numbers(ends: DataFrame, last: Column) -> DataFrame:
    """(first_, bucket): every number from 0 to ``last`` for the only row of ``ends``, in blocks that tasks expand by
    themselves, so that no row holds all of them."""
    blocks = ends.where("first_ is not null").select("first_", last.alias("last_")).where("last_ >= 0")
    blocks = blocks.select("first_", "last_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last_") / SPAN))).alias("block_"))
    begin = F.col("block_") * SPAN
    return blocks.repartition("block_").select("first_", F.explode(F.sequence(begin, F.least(begin + SPAN - 1, F.col("last_")))).alias("bucket"))


def bucket(df: DataFrame, value: Column, interval: str, reset: bool = True, flush: bool = False) -> DataFrame:
    """(bucket, end_us, value): the sum of ``value`` in each interval counted from the first record, half open.

    Empty intervals give 0 (or, without ``reset``, the sum so far). The last interval,
    which no later record closes, comes only with ``flush``.
    """
    width = micros(interval)
    if width <= 0:
        raise FlowError(Err.INVALID_ARGUMENT_3, "no interval")
    ends = df.agg(F.min("us").alias("first_"), F.max("us").alias("last_"))
    slot = F.floor((F.col("us") - F.col("first_")) / width)
    sums = df.crossJoin(F.broadcast(ends)).groupBy(slot.alias("bucket")).agg(F.sum(value).cast("long").alias("v_"))
    last = F.floor((F.col("last_") - F.col("first_")) / width) - (0 if flush else 1)
    every = _numbers(ends, last)
    out = every.join(sums, "bucket", "left").select("bucket", (F.col("first_") + (F.col("bucket") + 1) * width).alias("end_us"), F.coalesce("v_", F.lit(0)).alias("value"))
    if not reset:
        out = running_sum(out, F.col("value"), "value", "bucket").select("bucket", "end_us", F.col("value").cast("long").alias("value"))
    return out


def threshold(df: DataFrame, value: Column, bound: int, limit: int, events: int = 0) -> DataFrame:
    """Rows (with column value) at which the value is equal to, above or below ``limit``, or at which its difference to
    the row before is above or below it; the first ``events`` of them in order, all for 0. It drops no record."""
    rows = df.withColumn("value", value)
    if bound in (DIFF_GT, DIFF_LT):
        rows = lagged(rows, "value", "before_").withColumn("compared_", F.col("value") - F.col("before_")).drop("before_")
    else:
        rows = rows.withColumn("compared_", F.col("value"))
    tests = {EQ: F.col("compared_") == limit, GT: F.col("compared_") > limit, LT: F.col("compared_") < limit, DIFF_GT: F.col("compared_") > limit, DIFF_LT: F.col("compared_") < limit}
    if bound not in tests:
        raise FlowError(Err.INVALID_ARGUMENT_4, "unknown comparison")
    out = rows.where(tests[bound]).drop("compared_")
    return out.orderBy("pkt_no").limit(events) if events else out


def moving_window(df: DataFrame, value: Column, window: str, by: str) -> DataFrame:
    """``df`` with column value: the sum over the last ``window`` (its start excluded) of the row's ``by``, itself included.

    Time is cut into slices as long as the window, and a ``by`` that holds a third of all rows is dealt out by slices. A row
    adds its value to its own slice; to the next one it adds the value at the begin, and takes it off where the window
    has passed it. The running sum of these changes is the window's, whatever the number of rows that lie in it.
    """
    width = micros(window)
    slot = F.floor(F.col("us") / width)
    v = value.cast("decimal(38,6)")  # running sums may pass 64 bits where the window's own doesn't
    nothing = F.lit(None).cast(df.select(F.struct(*df.columns)).schema[0].dataType)

    def change(slice_: Column, at: Column, sign: int, row: Column) -> Column:
        return F.struct(slice_.alias("slice_"), at.cast("long").alias("at_"), (v * sign).cast("decimal(38,6)").alias("added_"), F.when(v.isNotNull(), sign).alias("many_"), row.alias("row_"))

    changes = [change(slot, F.col("us"), 1, F.struct(*df.columns)), change(slot + 1, (slot + 1) * width - 1, 1, nothing), change(slot + 1, F.col("us") + width, -1, nothing)]
    rows = df.where("us is not null").select(F.col(by).alias("by_"), F.explode(F.array(*changes)).alias("e_")).select("by_", "e_.*")
    upto = Window.partitionBy("by_", "slice_").orderBy("at_").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.when(F.sum("many_").over(upto) > 0, F.sum("added_").over(upto)).cast("long")).where("row_ is not null")
    return rows.select("row_.*", "sum_").withColumn("value", F.col("sum_")).drop("sum_")


COUNT, SECONDS, STATS = 1, 2, 3


def res2file(df: DataFrame, interval: str, values: list[tuple[int, str]], header: str = "") -> DataFrame:
    """(bucket, line): a line of text for each period with the values of several columns of ``df``: sums (COUNT), the
    last value as seconds (SECONDS; 32.32 fixed point), or count, sum, sum2, min and max (STATS). Empty periods give
    zeros; a header comes first, as bucket -1."""
    width = micros(interval)
    ends = df.agg(F.min("us").alias("first_"), F.max("us").alias("last_"))
    slot = F.floor((F.col("us") - F.col("first_")) / width)
    parts, formats, names = [], [], []
    for k, (kind, column) in enumerate(values):
        c = F.col(column)
        made = {
            COUNT: [F.sum(c).cast("long")],
            SECONDS: [F.max_by(c, "pkt_no") / F.lit(4294967296.0)],
            STATS: [F.count(c), F.sum(c).cast("long"), F.sum(c * c).cast("long"), F.min(c), F.max(c)],
        }[kind]
        for j, m in enumerate(made):
            names.append(f"v{k}_{j}")
            parts.append(m.alias(names[-1]))
            formats.append("%.12f" if kind == SECONDS else "%d")
    sums = df.crossJoin(F.broadcast(ends)).groupBy(slot.alias("bucket")).agg(*parts)
    every = _numbers(ends, F.floor((F.col("last_") - F.col("first_")) / width)).select("bucket")
    zeros = [F.coalesce(n, F.lit(0).cast("double" if f != "%d" else "long")) for n, f in zip(names, formats, strict=True)]
    lines = every.join(sums, "bucket", "left").select("bucket", F.format_string(" ".join(formats), *zeros).alias("line"))
    if header:
        lines = df.sparkSession.createDataFrame([(-1, header)], "bucket long, line string").union(lines)
    return lines
