"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level counts its groups and hands the next one a bit filter of the groups with
more than one member. A filter has a fixed number of bits, so what is broadcast is
bounded whatever the corpus; a full filter only means that more texts are hashed
whole, never a wrong group, since groups are formed by SHA-256 in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import lower_ascii
from flowspark.session import durable


def _bit_filter(keys: DataFrame, words: int) -> DataFrame:
    """At most ``words`` rows of 64 bits; ``keys`` has the hashes in column h."""
    return keys.groupBy(F.expr(f"pmod(shiftrightunsigned(h, 6), {words}L)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    )


def _passing(df: DataFrame, hashed: Column, bits: DataFrame, words: int) -> DataFrame:
    """``df`` with a boolean ``passed``: whether its hash may be among those of the filter."""
    df = df.withColumn("h", hashed).withColumn("word", F.expr(f"pmod(shiftrightunsigned(h, 6), {words}L)"))
    df = df.join(F.broadcast(bits), "word", "left")
    return df.withColumn("passed", F.expr("coalesce(shiftrightunsigned(bits, cast(h & 63 as int)) & 1L, 0L) = 1L")).drop("word", "bits", "h")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix_chars: int = 256,
    filter_words: int = 1 << 18,
) -> DataFrame:
    """One row per row of ``df``: id, carried columns, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty. Of equal texts the largest id stays. Repeated rows (same id and text) are
    members of their group each and share its verdict; rows with a null id go unless
    their whole group has none. An empty table gives an empty result. Columns that
    are neither the id, the text nor carried are not read, whatever their names.

    A hot group is counted before the shuffle (partial aggregation) and met in a
    sort-merge join whose large partitions adaptive execution splits.
    """
    source = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)],
    )
    size = F.octet_length("text")
    length_hash = F.xxhash64(size)
    prefix_hash = F.xxhash64(size, lower_ascii(F.substring("text", 1, prefix_chars)))
    carried = [f"c{k}" for k in range(len(carry))]

    by_length = source.groupBy(size.alias("n")).count().where("count > 1")
    lengths = _bit_filter(by_length.select(F.xxhash64("n").alias("h")), filter_words)
    by_prefix = _passing(source.select("text"), length_hash, lengths, filter_words).where("passed")
    by_prefix = by_prefix.groupBy(prefix_hash.alias("h")).count().where("count > 1")
    prefixes = _bit_filter(by_prefix, filter_words)

    # Whole texts are hashed for surviving groups alone; others get a key of their own, which spreads them.
    hashed = _passing(source, prefix_hash, prefixes, filter_words).select(
        "id", *carried, F.when(F.col("passed"), F.unhex(F.sha2(lower_ascii(F.col("text")), 256))).otherwise(F.encode(F.concat(F.lit("-"), F.monotonically_increasing_id()), "UTF-8")).alias("key")
    )
    hashed = durable(hashed)
    groups = durable(hashed.groupBy("key").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    out = hashed.join(groups, "key", "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top"))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)],
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
    )
