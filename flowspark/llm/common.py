"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


#: Bits of a row of a key table, and most rows: 64 MB in all.
ROW_BITS, MOST_ROWS = 32768, 1 << 14


def key_table(keys: DataFrame, count: int, bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """(part, bits) for hashes in column h, ``count`` of them, and the number of parts: bitmaps of ROW_BITS bits, MOST_ROWS at
    most whatever the count, so that they can be broadcast. With more keys than fit more hashes seem to be among them."""
    parts = max(1, min(MOST_ROWS, -(-count * bits_a_key // ROW_BITS)))
    place = F.expr(f"pmod(shiftrightunsigned(h, 20), {ROW_BITS})")
    return keys.groupBy(F.expr(f"pmod(h, {parts}L)").alias("part")).agg(F.bitmap_construct_agg(place).alias("bits")), parts


def key_in_table(df: DataFrame, hashed: Column, bitmaps: DataFrame, parts: int, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false if the hash is certainly none of the table's."""
    rows = df.withColumn("hash_", hashed).withColumn("part", F.expr(f"pmod(hash_, {parts}L)")).withColumn("place_", F.expr(f"cast(pmod(shiftrightunsigned(hash_, 20), {ROW_BITS}) as int)"))
    rows = rows.join(F.broadcast(bitmaps), "part", "left")
    bit = F.expr("getbit(cast(conv(hex(substring(bits, place_ div 8 + 1, 1)), 16, 10) as bigint), place_ % 8) = 1")
    return rows.select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy_up(spark: SparkSession) -> None:
    """Let Spark delete files of shuffles and checkpoints that nothing needs any more: they go once the driver's garbage is
    collected, which by itself may be much later."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``durable``, then without the shuffle files that only this needed."""
    out = durable(df)
    del df
    tidy_up(out.sparkSession)
    return out


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _release() -> None:
    """Give memory that this worker has freed back to the system: workers live on and wait beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``; at its end a task gives back what it has freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return df.mapInArrow(tidy, schema)


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``map_batches``, with batches of 2,000 rows where the session has Spark's default of 10,000: rows that hold whole
    texts are large, and a worker holds a batch at a time."""
    conf = df.sparkSession.conf
    if conf.get(ROWS_A_BATCH) == "10000":
        conf.set(ROWS_A_BATCH, "2000")
    return map_batches(df, run, schema)
