"""Row-dropping operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.intervals import absolute, micros
from flowspark.operators.order import row_numbers
from flowspark.plans.errors import Err, FlowError

PROBABILISTIC, PERIODIC = 3, 2


def search_patterns(text: str) -> list[bytes]:
    """Alternatives of a pattern: ``||`` separates them, ``|41 42|`` gives bytes in hex, a backslash takes the next character literally."""
    if not text:
        raise FlowError(Err.STRSEARCH_NOT_A_PATTERN, "empty pattern")
    out, now, k = [], bytearray(), 0
    while k < len(text):
        if text.startswith("||", k):
            out.append(bytes(now))
            now, k = bytearray(), k + 2
        elif text[k] == "|":
            end = text.find("|", k + 1)
            if end < 0:
                raise FlowError(Err.STRSEARCH_UNTERMINATED_PIPE, text)
            try:
                now += bytes.fromhex(text[k + 1 : end])
            except ValueError:
                raise FlowError(Err.STRSEARCH_NOT_A_PATTERN, text) from None
            k = end + 1
        else:
            k += text[k] == "\\" and k + 1 < len(text)
            now += text[k].encode()
            k += 1
    out.append(bytes(now))
    if not all(out):
        raise FlowError(Err.STRSEARCH_NOT_A_PATTERN, text)
    return out


def str_search(payload: Column, pattern: str, offset: int = 0, depth: int = 0) -> Column:
    """Whether one of the alternatives occurs in the ``depth`` bytes (0: all) from ``offset`` on."""
    if offset < 0:
        raise FlowError(Err.INVALID_ARGUMENT_2, "offset below 0")
    if depth < 0:
        raise FlowError(Err.INVALID_ARGUMENT_3, "depth below 0")
    found = search_patterns(pattern)
    if depth and all(depth < len(p) for p in found):
        raise FlowError(Err.STRSEARCH_DEPTH_LESS_THAN_PATTERN, pattern)
    data = payload.cast("binary")
    if offset or depth:
        data = F.substring(data, offset + 1, depth or 2**31 - 1)
    out = F.lit(False)
    for p in found:
        out = out | F.contains(data, F.lit(p))
    return F.coalesce(out, F.lit(False))


def regexp(payload: Column, pattern: str) -> Column:
    """Whether the regular expression matches anywhere in the bytes, one character each."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise FlowError(Err.INVALID_ARGUMENT, str(e)) from None
    return F.coalesce(F.decode(payload.cast("binary"), "ISO-8859-1").rlike(pattern), F.lit(False))


def sample_periodic(df: DataFrame, period: int) -> DataFrame:
    """Every ``period``-th row in order: rows n, 2n, ... (a period below 1 counts as 1)."""
    period = max(1, period)
    return row_numbers(df, "n_").where(F.col("n_") % period == 0).drop("n_") if period > 1 else df


def sample_probabilistic(df: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """Rows pass with ``percent`` in a hundred, by a hash of the position, so that a repeated run takes the same rows."""
    percent = min(100, max(0, percent))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("pkt_no").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(drawn % 100 < percent)


#: Fixed values of the mixing steps: bits shifted to the right, or to the left if below 0.
SHIFTS = (13, -8, 13, 12, -16, 5, 3, -10, 15)
#: Fixed start values of the words.
GOLDEN, START = 0x9E3779B9, 6564987


def flow_hash(src: Column, dst: Column, proto: Column, sport: Column, dport: Column) -> Column:
    """A flow's hash below 1024: all packets of a flow share it.

    Three 32-bit words are mixed reversibly (in the manner of Jenkins' lookup hash), as a fold over the shifts: written
    out, each step would hold the one before several times over, and so would a filter that is pushed below it.
    """
    word = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    a = src.cast("long") + F.lit(GOLDEN)
    b = dst.cast("long").bitwiseXOR(proto.cast("long")) + F.lit(GOLDEN)
    c = sport.cast("long").bitwiseOR(F.shiftleft(dport.cast("long"), 16)) + F.lit(START)

    def step(s: Column, bits: Column) -> Column:
        shifted = F.when(bits > 0, F.call_function("shiftright", s["z"], bits)).otherwise(F.call_function("shiftleft", s["z"], -bits))
        return F.struct(s["y"].alias("x"), s["z"].alias("y"), word(word(s["x"] - s["y"] - s["z"]).bitwiseXOR(shifted)).alias("z"))

    start = F.struct(word(a).alias("x"), word(b).alias("y"), word(c).alias("z"))
    return F.aggregate(F.array(*map(F.lit, SHIFTS)), start, step, lambda s: s["z"] % 1024)


def hash_sample(df: DataFrame, hashed: Column, keep_below: int) -> DataFrame:
    """Rows whose hash (below 1024) is below ``keep_below``: whole flows pass or go."""
    if not 1 <= keep_below <= 1024:
        raise FlowError(Err.INVALID_ARGUMENT_1, "range is 1 to 1024")
    return df.where(hashed < keep_below)


def startstop(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows between two times, both included. ``+1s`` counts from the first row (a stop after an absolute start from that)."""
    relative = start.strip().startswith("+")
    if relative and not stop.strip().startswith("+"):
        raise FlowError(Err.INVALID_ARGUMENT_2, "a relative start needs a relative stop")
    if not relative:
        first = absolute(start)
        last = first + micros(stop) if stop.strip().startswith("+") else absolute(stop)
        return df.where(F.col("us").between(first, last))
    origin = df.agg(F.min("us").alias("origin_"))  # one row
    return df.crossJoin(F.broadcast(origin)).where(F.col("us").between(F.col("origin_") + micros(start), F.col("origin_") + micros(stop))).drop("origin_")


def interface(df: DataFrame, number: int) -> DataFrame:
    if number < 0:
        raise FlowError(Err.INVALID_ARGUMENT, "interface below 0")
    return df.where(F.col("ifindex") == number)
