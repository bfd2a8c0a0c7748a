"""Streaming operators with timers and state of their own: polled thresholds and TCP reassembly of bounded memory.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Time is event time: timers fire when
the watermark passes them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowspark.functions.intervals import micros
from flowspark.operators.windows import DIFF_GT, DIFF_LT, EQ, GT, LT
from flowspark.plans.errors import Err, FlowError

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TESTS: dict[int, Callable[[int, int, int], bool]] = {
    EQ: lambda now, before, limit: now == limit,
    GT: lambda now, before, limit: now > limit,
    LT: lambda now, before, limit: now < limit,
    DIFF_GT: lambda now, before, limit: now - before > limit,
    DIFF_LT: lambda now, before, limit: now - before < limit,
}


def _kinds(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)


class _Polls(StatefulProcessor):
    """State of a key: what has been polled (sum at the last poll and the one before, next poll, polls without records) and the sums of
    the intervals that no poll has closed yet."""

    def __init__(self, key: list[str], every_ms: int, bound: int, limit: int, quiet: int) -> None:
        self.key, self.every, self.bound, self.limit, self.quiet = key, every_ms, bound, limit, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polled = handle.getValueState("polled", "total bigint, before bigint, next bigint, still bigint, timer bigint")
        self.sums = handle.getMapState("sums", "slot bigint", "sum bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for slot, added in part.groupby(part["us"] // (self.every * 1000))["value"].sum().items():
                slot, added = int(slot), int(added)
                before = self.sums.getValue((slot,))[0] if self.sums.containsKey((slot,)) else 0
                self.sums.updateValue((slot,), (before + added,))
                first = slot if first is None else min(first, slot)
        total, before, following, still, timer = self.polled.get() if self.polled.exists() else (0, 0, -1, 0, -1)
        # Polls begin, or begin again after a quiet time, with the interval of the first record.
        if following < 0 and first is not None:
            following, still = first, 0
        if timer < 0 and following >= 0:
            timer = (following + 1) * self.every
            self.handle.registerTimer(timer)
        self.polled.update((total, before, following, still, timer))
        yield pd.DataFrame([], columns=[*self.key, "poll_us", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, before, following, still, _ = self.polled.get()
        out, upto = [], timerValues.getCurrentWatermarkInMs()
        while following >= 0 and (following + 1) * self.every <= upto:
            known = self.sums.containsKey((following,))
            if known:
                total += self.sums.getValue((following,))[0]
                self.sums.removeKey((following,))
            still = 0 if known else still + 1
            if TESTS[self.bound](total, before, self.limit):
                out.append((*key, (following + 1) * self.every * 1000, total))
            before, following = total, following + 1
            if still >= self.quiet:
                later = [k[0] for k in self.sums.keys()]  # noqa: SIM118 (a map state, no dictionary)
                following, still = (min(later), 0) if later else (-1, 0)
        timer = -1
        if following >= 0:
            timer = (following + 1) * self.every
            self.handle.registerTimer(timer)
        self.polled.update((total, before, following, still, timer))
        yield pd.DataFrame(out, columns=[*self.key, "poll_us", "value"])

    def close(self) -> None:
        """Spark ends the state's own connection."""


def polled_threshold(stream: DataFrame, key: list[str], value: Column, bound: int, limit: int, every: str, delay: str = "0 seconds", quiet: int = 10) -> DataFrame:
    """(key, poll_us, value): polls, at every multiple of ``every``, at which the sum of ``value`` so far is equal to, above or
    below ``limit``, or differs by more or less than it from the poll before (of the first: from 0).

    A poll sees the records before its time, and is made once the watermark has passed it. ``quiet`` polls in a row without
    records are the last until the key has some again. Records later than ``delay`` are left out.
    """
    every_us = micros(every)
    if bound not in TESTS:
        raise FlowError(Err.INVALID_ARGUMENT_4, "unknown comparison")
    if every_us <= 0 or every_us % 1000:
        raise FlowError(Err.INVALID_ARGUMENT_5, "polls are whole milliseconds apart")
    rows = stream.select(*key, "us", F.coalesce(value, F.lit(0)).cast("long").alias("value"), F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy(*key).transformWithStateInPandas(_Polls(key, every_us // 1000, bound, limit, quiet), f"{_kinds(rows, key)}, poll_us bigint, value bigint", "append", "eventTime")


class _Segments(StatefulProcessor):
    """State of one side of a connection: the next position, the highest begun, bytes held, when it was last seen; segments that
    arrived early."""

    def __init__(self, key: list[str], idle_ms: int, most_bytes: int) -> None:
        self.key, self.idle, self.most = key, idle_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.side = handle.getValueState("side", "next bigint, top bigint, begun bigint, last_us bigint, timer bigint")
        self.early = handle.getListState("early", "at bigint, data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, top, begun, last, timer = self.side.get() if self.side.exists() else (-1, 0, 0, 0, -1)
        heap = [(at, bytes(data)) for at, data in self.early.get()] if self.early.exists() else []
        heapq.heapify(heap)
        held, out = sum(len(d) for _, d in heap), []

        def drain(give_up: bool) -> None:
            nonlocal following, held
            while heap and (heap[0][0] <= following or give_up or held > self.most):
                at, data = heapq.heappop(heap)
                held -= len(data)
                dropped, fresh = max(0, at - following), data[max(0, following - at) :]
                if fresh:
                    out.append((*key, last, max(at, following) - begun, fresh, dropped))
                    following = max(at, following) + len(fresh)

        for part in rows:
            for us, seq, flags, data in part.sort_values(["us", "pkt_no"])[["us", "tcp_seq", "tcp_flags", "data"]].itertuples(index=False):
                last = max(last, int(us))
                # Positions are sequence numbers without their wrap, from 2**33 on, so that none is negative.
                at = int(seq) + 2**33 if following < 0 or flags & 2 else top + (int(seq) - top + 2**31) % 2**32 - 2**31
                if flags & 2:
                    drain(True)
                    following = top = begun = at + 1
                    continue
                if following < 0:
                    following = top = begun = at
                if len(data):
                    top = max(top, at)
                    heapq.heappush(heap, (at, bytes(data)))
                    held += len(data)
                    drain(False)
                if flags & 5:
                    drain(True)
        self.early.clear()
        if heap:
            self.early.put([(at, data) for at, data in heap])
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(last // 1000 + self.idle + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.side.update((following, top, begun, last, timer))
        yield self._made(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, _, begun, last, _ = self.side.get()
        out = []
        for at, data in sorted((at, bytes(data)) for at, data in self.early.get()) if self.early.exists() else ():
            fresh = data[max(0, following - at) :]
            if fresh:
                out.append((*key, last, max(at, following) - begun, fresh, max(0, at - following)))
                following = max(at, following) + len(fresh)
        self.early.clear()
        self.side.clear()
        yield self._made(out)

    def _made(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.key, "us", "position", "data", "dropped"])

    def close(self) -> None:
        """Spark ends the state's own connection."""


SIDE = ["src_ip", "dst_ip", "sport", "dport"]


def reassemble(stream: DataFrame, idle: str = "60s", most_bytes: int = 1 << 20, delay: str = "0 seconds", key: list[str] | None = None) -> DataFrame:
    """(side, us, position, data, dropped): the bytes of each side of TCP connections in order, as they come together.

    ``stream`` has decoded packets. position: where the bytes stand in the side's stream, from 0; dropped: bytes before them
    that never came. What is missing is waited for until the early segments of the side hold more than ``most_bytes``, the
    connection ends (FIN, RST, a new SYN), or the watermark is ``idle`` beyond its last packet; then the side's state goes, too.
    State is bounded by ``most_bytes`` a side, and what that costs is told in ``dropped``.
    """
    side = key or SIDE
    rows = stream.where("ip_proto = 6 and sport is not null").select(*side, "us", "pkt_no", "tcp_seq", "tcp_flags", F.coalesce("l4_payload", F.lit(b"")).alias("data"), F.timestamp_micros("us").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy(*side).transformWithStateInPandas(_Segments(side, micros(idle) // 1000, most_bytes), f"{_kinds(rows, side)}, us bigint, position bigint, data binary, dropped bigint", "append", "eventTime")
