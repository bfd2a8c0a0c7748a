"""A value for each record."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.asof import as_of
from flowspark.operators.order import lagged
from flowspark.plans.errors import Err, FlowError

TIME, SIZE = 0, 1
ADD, SUB = 0, 1


def ntp(us: Column) -> Column:
    """Microseconds as 32.32 fixed point, seconds in the upper half."""
    seconds = F.floor(us / F.lit(1_000_000)).cast("long")
    rest = F.pmod(us, F.lit(1_000_000))
    return F.shiftleft(seconds, 32) + F.floor(rest * F.lit(4294967296) / F.lit(1_000_000)).cast("long")


def pktinfo(df: DataFrame, what: int) -> DataFrame:
    """The time (32.32) or the length of each record, as column value."""
    if what not in (TIME, SIZE):
        raise FlowError(Err.INVALID_ARGUMENT, "0 is time, 1 is size")
    return df.withColumn("value", ntp(F.col("us")) if what == TIME else F.col("wlen"))


def gap(df: DataFrame) -> DataFrame:
    """Microseconds since the record before, as column gap; 0 for the first."""
    return lagged(df, "us", "before_").withColumn("gap", F.coalesce(F.col("us") - F.col("before_"), F.lit(0))).drop("before_")


def byte_hash(data: Column) -> Column:
    """(length + sum of the bytes) mod 500009; 0 for null. Bytes of an Arrow batch are summed with numpy."""
    return _byte_hash(data.cast("binary"))


@F.pandas_udf(T.LongType())
def _byte_hash(data: pd.Series) -> pd.Series:
    values = [d or b"" for d in data]
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    upto = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(values), np.uint8), dtype=np.int64)))
    ends = np.cumsum(sizes)
    return pd.Series((sizes + upto[ends] - upto[ends - sizes]) % 500009)


def binop(left: DataFrame, right: DataFrame, op: int) -> DataFrame:
    """Sum or difference (signed) of two one-row results with column value."""
    if op not in (ADD, SUB):
        raise FlowError(Err.INVALID_ARGUMENT_1, "0 adds, 1 subtracts")
    both = left.select(F.col("value").alias("a_")).crossJoin(right.select(F.col("value").alias("b_")))
    return both.select((F.col("a_") + F.col("b_") if op == ADD else F.col("a_") - F.col("b_")).alias("value"))


def binop_at_records(df: DataFrame, left: DataFrame, right: DataFrame, op: int) -> DataFrame:
    """``df`` with column value: at each record, the sum or difference (signed) of what two other streams (pkt_no, us, value)
    show by then; a stream that has shown nothing yet counts 0."""
    if op not in (ADD, SUB):
        raise FlowError(Err.INVALID_ARGUMENT_1, "0 adds, 1 subtracts")
    rows = as_of(df, {"a_": left.select("pkt_no", "us", "value"), "b_": right.select("pkt_no", "us", "value")})
    a, b = F.coalesce("a_", F.lit(0)), F.coalesce("b_", F.lit(0))
    return rows.withColumn("value", a + b if op == ADD else a - b).drop("a_", "b_")
