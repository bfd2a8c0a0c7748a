"""The latest value of other streams at each record: an as-of join of whole streams, without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros


def as_of(df: DataFrame, others: dict[str, DataFrame], width: str = "1s") -> DataFrame:
    """``df`` with, by name, the value of each other stream (pkt_no, us, value) at the record's time: that of its latest record
    up to and with that time (of equal times, the largest position); null before its first, and null values are passed over.

    Records of all streams are cut into blocks of ``width`` of time. Within a block one ordered window carries the last values
    on; a table with one row a block carries what is current when a block begins.
    """
    span = micros(width)
    none = {n: o.schema["value"].dataType for n, o in others.items()}
    own = df.select(F.col("us"), F.lit(1).alias("kind_"), F.col("pkt_no").alias("at_"), F.struct(*df.columns).alias("row_"), *(F.lit(None).cast(t).alias(f"v_{n}") for n, t in none.items()))
    rows = own
    for name, other in others.items():
        values = (F.col("value") if n == name else F.lit(None).cast(t) for n, t in none.items())
        rows = rows.unionByName(other.select("us", F.lit(0).alias("kind_"), F.col("pkt_no").alias("at_"), F.lit(None).cast(own.schema["row_"].dataType).alias("row_"), *(v.alias(f"v_{n}") for n, v in zip(none, values, strict=True))))
    rows = rows.withColumn("block_", F.floor(F.col("us") / span))
    order = F.struct("us", "at_")
    current = [F.max_by(f"v_{n}", F.when(F.col(f"v_{n}").isNotNull(), order)).alias(f"v_{n}") for n in others]
    earlier = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block_").agg(*current)
    begins = blocks.select("block_", *(F.last(f"v_{n}", ignorenulls=True).over(earlier).alias(f"b_{n}") for n in others))
    inside = Window.partitionBy("block_").orderBy("us", "kind_", "at_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"v_{n}": F.last(f"v_{n}", ignorenulls=True).over(inside) for n in others}).where("kind_ = 1").join(begins, "block_")
    return rows.select("row_.*", *(F.coalesce(f"v_{n}", f"b_{n}").alias(n) for n in others))
