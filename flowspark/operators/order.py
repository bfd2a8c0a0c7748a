"""Order-sensitive columns over a whole stream without sorting it in one task.

Positions are cut into blocks of ``SPAN``. Within a block an ordinary window gives
numbers, lags and running sums; a table with one row a block carries what one block
hands to the next, and is SPAN times smaller than the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros

SPAN = 1 << 16


def _block(order: str) -> Column:
    return F.floor(F.col(order) / SPAN)


def row_numbers(df: DataFrame, name: str = "n", order: str = "pkt_no") -> DataFrame:
    """``df`` with the position of each row in ``order``, from 1; ``order`` has no ties."""
    rows = df.withColumn("block_", _block(order))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("block_").count().select("block_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy("block_").orderBy(order))
    return rows.withColumn("within_", within).join(sizes, "block_").withColumn(name, F.col("before_") + F.col("within_")).drop("block_", "before_", "within_")


def lagged(df: DataFrame, column: str, name: str, order: str = "pkt_no") -> DataFrame:
    """``df`` with ``column`` of the row before in ``order``, null for the first."""
    rows = df.withColumn("block_", _block(order))
    ends = rows.groupBy("block_").agg(F.max_by(column, order).alias("end_"))
    ends = ends.select("block_", F.lag("end_").over(Window.orderBy("block_")).alias("end_"))
    within = Window.partitionBy("block_").orderBy(order)
    rows = rows.withColumn(name, F.lag(column).over(within)).withColumn("first_", F.row_number().over(within) == 1)
    return rows.join(ends, "block_").withColumn(name, F.when(F.col("first_"), F.col("end_")).otherwise(F.col(name))).drop("block_", "end_", "first_")


def running_sum(df: DataFrame, value: Column, name: str, order: str = "pkt_no") -> DataFrame:
    """``df`` with the sum of ``value`` from the first row to this one in ``order``."""
    rows = df.withColumn("block_", _block(order)).withColumn("value_", value)
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block_").agg(F.sum("value_").alias("sum_")).select("block_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    within = F.sum("value_").over(Window.partitionBy("block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within_", within).join(sums, "block_").withColumn(name, F.col("before_") + F.col("within_")).drop("block_", "value_", "before_", "within_")


def keyed(df: DataFrame, key: list[str], lags: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, block: str = "10m") -> DataFrame:
    """``df`` with, by name, values of the record before of the same key (``lags``; null for the first) and sums up to and with
    the record (``sums``), in order of us and pkt_no.

    A key's records are dealt by time block, so a key may hold any share of the stream; one row a key and block carries the
    block's last values and its sums.
    """
    lags, sums = lags or {}, sums or {}
    w = Window.partitionBy(*key, "block_").orderBy("us", "pkt_no")
    rows = df.withColumn("block_", F.floor(F.col("us") / micros(block)))
    rows = rows.withColumns({"own_": F.struct(F.lit(0).alias("any_"), *(c.alias(n) for n, c in lags.items()))} | {f"part_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    ends = rows.groupBy(*key, "block_").agg(F.max_by("own_", F.struct("us", "pkt_no")).alias("last_"), *(F.sum(f"part_{n}").alias(f"sum_{n}") for n in sums))
    b = Window.partitionBy(*key).orderBy("block_")
    before = b.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.lag("last_").over(b).alias("before_"), *(F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums)]
    ends = ends.select(*(F.col(k).alias(f"b_{k}") for k in key), F.col("block_").alias("b_block_"), *carried)
    same = F.col("block_") == F.col("b_block_")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    rows = rows.withColumns({"lag_": F.lag("own_").over(w)} | {f"upto_{n}": F.sum(f"part_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in sums}).join(ends, same)
    earlier = F.coalesce("lag_", "before_")
    return rows.select(*df.columns, *(earlier[n].alias(n) for n in lags), *((F.col(f"upto_{n}") + F.col(f"before_{n}")).alias(n) for n in sums))
