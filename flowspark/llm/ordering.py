"""Positions in a total order without sorting all of it, or all of a hot key, in one task; lookups of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import durable

#: A key with more rows than this and than one in ``HOT_KEYS`` of all rows is hot: there are never more than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 100_000, 1000


def positions(df: DataFrame, name: str, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` with the number of each row within its ``keys`` (non-null; none: in the whole table) in ``order``, from 1.

    Rows are dealt to range partitions of (keys, order), so one key may run over many of them, and are numbered within
    key and partition. Only keys that cross partitions need what earlier partitions hold; a partition has at most
    two such, its first and its last, so the table that carries it has at most two rows a partition and is broadcast.
    """
    part, local = "part of order", "number in part"
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    ranged = df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    rows = durable(ranged.withColumn(local, F.row_number().over(inside)))
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("rows in part"))
    of_key = Window.partitionBy(*keys)
    earlier = F.sum("rows in part").over(of_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("earlier rows", earlier).where(F.col("earlier rows").isNotNull()).drop("rows in part")
    number = (F.col(local) + F.coalesce("earlier rows", F.lit(0))).cast("long")
    return rows.join(F.broadcast(carried), [*keys, part], "left").withColumn(name, number).drop(part, local, "earlier rows")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], rows_a_key: str) -> DataFrame:
    """``rows`` inner joined to ``table``, whose keys ``on`` are unique and whose column ``rows_a_key`` is at least the number
    of rows of each key. Rows of hot keys stay where they are: the at most HOT_KEYS table rows they need are broadcast."""
    size = table.agg(F.sum(rows_a_key).alias("all"), F.max(rows_a_key).alias("most")).first()
    limit = max(HOT_ROWS, (size["all"] or 0) // HOT_KEYS)
    if (size["most"] or 0) <= limit:
        return rows.join(table, on)
    hot = F.broadcast(table.where(F.col(rows_a_key) > limit))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(rows_a_key) <= limit), on))
