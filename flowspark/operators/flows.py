"""Flow records: sessions of records with one key, by a segmented scan that runs over any share of the stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros

IDLE, ACTIVE, FORCED = 1, 2, 4


#: Width of the time blocks in which a key's records are scanned: one task has one key's records of one block at a time.
BLOCK = "10m"


def sessions(
    df: DataFrame, key: list[str], idle: str, closes: Column | None = None, firsts: dict[str, Column] | None = None, seen: dict[str, Column] | None = None, block: str = BLOCK
) -> DataFrame:
    """``df`` with column session: the number, within its key, of the session each record is in. A session ends after
    more than ``idle`` without records, or after a record that ``closes`` it.

    ``firsts`` adds, by name, values of the session's first record; ``seen`` whether a condition has held in the session up to
    the record, itself included.

    A key may hold any share of the records. They are dealt by key and time block and scanned block by block; one row a
    key and block (its first and last record, its breaks, what its open session has) carries what a block hands to
    the next, so only these rows of a key meet in one task.
    """
    firsts, seen = firsts or {}, seen or {}
    span = micros(block)
    rows = df.withColumns({"block_": F.floor(F.col("us") / span), "closes_": F.lit(False) if closes is None else F.coalesce(closes, F.lit(False))})
    rows = rows.withColumns({f"seen_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, c in seen.items()} | {"own_": F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in firsts.items()))})
    w = Window.partitionBy(*key, "block_").orderBy("us", "pkt_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    breaks = (F.col("us") - F.lag("us").over(w) > micros(idle)) | F.lag("closes_").over(w)
    rows = rows.withColumn("new_", F.coalesce(breaks, F.lit(False)).cast("int"))  # the block's first record: see below
    rows = rows.withColumn("inner_", F.sum("new_").over(upto)).withColumn("start_", F.last(F.when(F.col("new_") == 1, F.col("own_")), ignorenulls=True).over(upto))
    inside = Window.partitionBy(*key, "block_", "inner_").orderBy("us", "pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"seen_{n}": F.max(f"seen_{n}").over(inside) for n in seen})

    last = F.struct("us", "pkt_no", "closes_", "inner_", "start_", *(f"seen_{n}" for n in seen))
    blocks = rows.groupBy(*key, "block_").agg(F.min(F.struct("us", "pkt_no", "own_")).alias("head_"), F.max_by(last, F.struct("us", "pkt_no")).alias("tail_"))
    b = Window.partitionBy(*key).orderBy("block_")
    earlier = b.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("head_.us") - F.lag("tail_.us").over(b) > micros(idle)) | F.lag("tail_.closes_").over(b), F.lit(True))
    blocks = blocks.withColumn("fresh_", fresh.cast("int"))
    blocks = blocks.withColumn("open_", F.sum(F.col("fresh_") + F.col("tail_.inner_")).over(b))  # the session that is open at the block's end
    blocks = blocks.withColumn("began_", F.coalesce("tail_.start_", F.when(F.col("fresh_") == 1, F.col("head_.own_"))))
    carried = {"number_": F.col("open_") - F.col("tail_.inner_"), "before_": F.when(F.col("fresh_") == 1, F.col("head_.own_")).otherwise(F.last("began_", ignorenulls=True).over(earlier))}
    of_session = Window.partitionBy(*key, "open_").orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({f"held_{n}": F.max(f"tail_.seen_{n}").over(of_session) for n in seen})
    carried |= {f"carried_{n}": F.when(F.col("fresh_") == 0, F.lag(f"held_{n}").over(b)) for n in seen}
    blocks = blocks.withColumns(carried).select(*(F.col(k).alias(f"b_{k}") for k in key), F.col("block_").alias("b_block_"), *carried)

    same = F.col("block_") == F.col("b_block_")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    out = rows.join(blocks, same)
    start = F.coalesce("start_", "before_")
    return out.select(
        *df.columns, (F.col("number_") + F.col("inner_")).alias("session"), *(start[n].alias(n) for n in firsts),
        *((F.greatest(F.col(f"seen_{n}"), F.when(F.col("inner_") == 0, F.col(f"carried_{n}"))) == 1).alias(n) for n in seen),
    )


def expired_flows(df: DataFrame, key: list[str], idle: str = "30s", min_pkts: int = 0, keep_open: bool = True) -> DataFrame:
    """(key, start_us, end_us, packets, bytes): one row a flow with at least ``min_pkts`` records, expired after more than
    ``idle`` of silence; flows still open at the end of the stream come too unless ``keep_open`` is false."""
    out = sessions(df, key, idle).groupBy(*key, "session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes")
    )
    if not keep_open:
        now = df.agg(F.max("us").alias("now_"))
        out = out.crossJoin(F.broadcast(now)).where(F.col("now_") - F.col("end_us") > micros(idle)).drop("now_")
    return out.where(F.col("packets") >= min_pkts).drop("session")


def ignored_flows(df: DataFrame, key: list[str], idle: str, min_pkts: int) -> DataFrame:
    """(sent, ignored, dropped) flows and packets: those reported, those with too few records; none is ever dropped."""
    flows = expired_flows(df, key, idle)
    small = F.col("packets") < min_pkts
    return flows.agg(
        F.count(F.when(~small, 1)).alias("sent_flows"), F.count(F.when(small, 1)).alias("ignored_flows"),
        F.coalesce(F.sum(F.when(~small, F.col("packets"))), F.lit(0)).cast("long").alias("sent_packets"), F.coalesce(F.sum(F.when(small, F.col("packets"))), F.lit(0)).cast("long").alias("ignored_packets"),
        F.lit(0).cast("long").alias("dropped_flows"),
    )


#: Upper edges of the packet length histogram in bytes and of the packet distance histogram in microseconds (fixed values).
LENGTH_EDGES = [50, 100, 200, 750, 1300, 1400, 1450, 1500, 65535]
DISTANCE_EDGES = [25, 50, 75, 100, 200, 300, 400, 500, 1000]


def flow_report(df: DataFrame, key: list[str], forward: Column, idle: str = "30s", lifetime: str = "240s", extra: dict[str, Column] | None = None, tcp: bool = False, cache: str | None = None,
                sides: dict[str, tuple[Callable[[Column], Column], Column]] | None = None, periods: tuple[str, ...] = ()) -> DataFrame:
    """Bidirectional flow records: one row a flow, counters for each direction, histograms, moments and rates.

    ``forward`` tells the direction of a record; direction 0 is that of the flow's first
    record. A flow ends after more than ``idle`` of silence, and is cut into records of
    ``lifetime`` counted from its first packet. end_reason: 1 idle, 2 lifetime, 4 end of
    the stream. ``extra`` adds aggregates by name (as min, max or bit_or of fields); ``tcp``, for decoded packets, each
    direction's segments out of sequence (below the highest number so far, unless numbers wrapped), its smallest and
    largest window, and its effective window (``effective_windows``). ``cache`` keeps flows in mind beyond their record: a
    record that begins no later than that after its key's record before ended continues its flow. It adds flow (the number
    within the key, from 1), flow_first_us (when the flow's first record began) and continued.

    With a column tcp_scale (``options.with_options``) windows are shifted by what the side's last SYN in the session has
    announced, also in an earlier record. ``sides`` adds aggregates (a function and its column) of each direction, named with 0
    or 1 at the end. ``periods`` adds each direction's lowest and highest bit rate over periods of those lengths: a period is the ten
    slots up to one that has packets; it counts once the direction has run for a whole one in the record, and the last counts
    always; silence of a period makes the lowest 0.
    """
    life = micros(lifetime)
    rows = sessions(df.withColumn("forward_", forward), key, idle, firsts={"first_us_": F.col("us"), "first_forward_": F.col("forward_")})
    rows = rows.withColumn("slice", F.floor((F.col("us") - F.col("first_us_")) / life).cast("long"))
    rows = rows.withColumn("dir_", (F.col("forward_") != F.col("first_forward_")).cast("int"))
    near = Window.partitionBy(*key, "session", "slice", "dir_").orderBy("us", "pkt_no")
    rows = rows.withColumn("distance_", F.col("us") - F.lag("us").over(near))
    if tcp:
        highest = F.max("tcp_seq").over(near.rowsBetween(Window.unboundedPreceding, -1))
        wrapped = (highest > 0xAFFFFFFF) & (F.col("tcp_seq") < 0x3FFFFFFF)
        rows = rows.withColumn("late_", F.coalesce((F.col("tcp_seq") < highest) & ~wrapped, F.lit(False)))
    scaled = tcp and "tcp_scale" in df.columns
    if scaled:
        rows = rows.withColumn("scale_", F.last("tcp_scale", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    for name in periods:
        rows = _moving(rows, [*key, "session", "slice", "dir_"], near, name)
    aggregates = [F.min("first_us_").alias("flow_start_us"), F.min("us").alias("start_us"), F.max("us").alias("end_us")]
    for d in (0, 1):
        mine = F.col("dir_") == d
        pick = lambda c, mine=mine: F.when(mine, c)
        aggregates += [
            F.count(pick(F.lit(1))).alias(f"packets{d}"),
            F.coalesce(F.sum(pick(F.col("wlen"))), F.lit(0)).cast("long").alias(f"bytes{d}"),
            F.min(pick(F.col("wlen"))).alias(f"min_length{d}"),
            F.max(pick(F.col("wlen"))).alias(f"max_length{d}"),
            F.min(pick(F.col("us"))).alias(f"first_us{d}"),
            F.max(pick(F.col("us"))).alias(f"last_us{d}"),
            F.coalesce(F.sum(pick(F.col("distance_"))), F.lit(0)).cast("long").alias(f"distance_sum{d}"),
            F.coalesce(F.sum(pick(F.when(F.col("distance_").isNotNull(), F.col("wlen") * F.col("wlen")))), F.lit(0)).cast("long").alias(f"length_sum2_{d}"),
            F.array(*_histogram(F.col("wlen"), mine, LENGTH_EDGES[:-1])).alias(f"lengths{d}"),
            F.array(*_histogram(F.col("distance_"), mine, DISTANCE_EDGES)).alias(f"distances{d}"),
        ]
        if tcp:
            aggregates += [F.count(pick(F.when(F.col("late_"), 1))).alias(f"out_of_sequence{d}"), F.min(pick(F.col("tcp_win"))).alias(f"min_window{d}"), F.max(pick(F.col("tcp_win"))).alias(f"max_window{d}")]
        if scaled:
            unknown, wide = pick(F.when(F.col("scale_").isNull(), F.col("tcp_win"))), pick(F.call_function("shiftleft", F.col("tcp_win").cast("long"), F.col("scale_")))
            aggregates += [F.min(unknown).alias(f"low_{d}"), F.max(unknown).alias(f"high_{d}"), F.min(wide).alias(f"low_wide_{d}"), F.max(wide).alias(f"high_wide_{d}")]
            aggregates.append(F.max_by("tcp_scale", pick(F.when(F.col("tcp_scale").isNotNull(), F.struct("us", "pkt_no")))).alias(f"scale_{d}"))
        aggregates += [f(pick(c)).alias(f"{name}{d}") for name, (f, c) in (sides or {}).items()]
        for name in periods:
            bits = lambda c, name=name: (c * 8_000_000 / micros(name)).cast("long")
            whole, last = pick(F.when(F.col(f"whole_{name}"), F.col(f"sum_{name}"))), F.max_by(f"sum_{name}", pick(F.struct("us", "pkt_no")))
            lowest = F.when(F.coalesce(F.bool_or(pick(F.col(f"still_{name}"))), F.lit(False)), F.lit(0)).otherwise(F.least(F.min(whole), last))
            aggregates += [bits(lowest).alias(f"min_rate{d}_{name}"), bits(F.greatest(F.max(whole), last)).alias(f"max_rate{d}_{name}")]
    aggregates += [c.alias(name) for name, c in (extra or {}).items()]
    group = [*key, "session", "slice"]
    out = rows.groupBy(*group).agg(*aggregates)
    if tcp:
        flights = effective_windows(rows, group).select(*(F.col(c).alias(f"w_{c}") for c in group), "effective_window0", "effective_window1")
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        out = out.join(flights, same, "left").drop(*(f"w_{c}" for c in group)).withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("effective_window0", "effective_window1")})
    later = Window.partitionBy(*key).orderBy("session", "slice")
    following = F.lead("session").over(later)
    reason = F.when(following == F.col("session"), ACTIVE).when(following.isNotNull(), IDLE).otherwise(FORCED)
    latency = F.when((F.col("slice") == 0) & F.col("first_us0").isNotNull() & F.col("first_us1").isNotNull(), F.col("first_us1") - F.col("first_us0"))
    out = out.withColumn("end_reason", reason).withColumn("latency_us", latency)
    if scaled:
        before = Window.partitionBy(*key, "session").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"scale_{d}": F.coalesce(F.last(f"scale_{d}", ignorenulls=True).over(before), F.lit(0)) for d in (0, 1)})
        shifted = lambda name, d: F.call_function("shiftleft", F.col(f"{name}_{d}").cast("long"), F.col(f"scale_{d}"))
        windows = {f"min_window{d}": F.least(shifted("low", d), F.col(f"low_wide_{d}")) for d in (0, 1)} | {f"max_window{d}": F.greatest(shifted("high", d), F.col(f"high_wide_{d}")) for d in (0, 1)}
        out = out.withColumns(windows).drop(*(f"{n}_{d}" for n in ("low", "high", "low_wide", "high_wide", "scale") for d in (0, 1)))
    if cache is None:
        return out
    fresh = F.coalesce(F.col("start_us") - F.lag("end_us").over(later) > micros(cache), F.lit(True))
    out = out.withColumn("continued", ~fresh).withColumn("flow", F.sum(fresh.cast("int")).over(later))
    return out.withColumn("flow_first_us", F.min("start_us").over(Window.partitionBy(*key, "flow")))


def effective_windows(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, effective_window0, effective_window1): the most payload that a side had on its way at once, as seen from here.

    A flight begins with a side's first TCP segment when it has none, and takes in all its segments until the other side
    acknowledges more than the flight's first sequence number (numbers wrap); an acknowledgement of 0 is none. Flights that are never
    acknowledged don't count. ``rows`` have dir_, tcp_seq, tcp_ack and l4_payload; a group is a flow record, no longer than
    its lifetime, and is scanned in order: four numbers a side are held.
    """
    seen = rows.where("tcp_seq is not null").select(*group, "us", "pkt_no", "dir_", "tcp_seq", "tcp_ack", F.coalesce(F.octet_length("l4_payload"), F.lit(0)).alias("size_"))
    schema = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in group) + ", effective_window0 bigint, effective_window1 bigint"
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, best, kinds = None, [None, None], [0, 0], [0, 0], None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[] for _ in range(width + 2)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*group, "effective_window0", "effective_window1"])

        for batch in batches:
            kinds, done = [*(batch.schema.field(c).type for c in group), pa.int64(), pa.int64()], []
            for *whose, _, _, side, seq, ack, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whose != now:
                    if now is not None:
                        done.append((*now, *best))
                    now, first, held, best = whose, [None, None], [0, 0], [0, 0]
                other = 1 - side
                if first[other] is not None and ack and 0 < (ack - first[other]) % 2**32 < 2**31:
                    best[other], first[other] = max(best[other], held[other]), None
                if first[side] is None:
                    first[side], held[side] = seq, size
                else:
                    held[side] += size
            yield made(done)
        if now is not None:
            yield made([(*now, *best)])

    return seen.repartition(*group).sortWithinPartitions(*group, "us", "pkt_no").mapInArrow(run, schema)


def packet_sides() -> dict[str, tuple[Callable[[Column], Column], Column]]:
    """Bits of each direction of packets with their options: of IPv4 and TCP options and of ICMP types (up to 62)."""
    types = F.expr("CASE WHEN ip_proto = 1 AND icmp_type <= 62 THEN shiftleft(1L, icmp_type) END")
    return {"ip_options": (F.bit_or, F.col("ip_options")), "tcp_options": (F.bit_or, F.col("tcp_options")), "icmp_types": (F.bit_or, types)}


#: Slots of a period of bit rates.
SLOTS = 10


def _moving(rows: DataFrame, side: list[str], near: WindowSpec, period: str) -> DataFrame:
    """``rows`` with, for one period, the bytes of the ten slots up to each record's slot, whether its side has run for a whole
    period by then, and whether it was silent for one before. All windows are dealt alike, so rows are shuffled once for
    any number of periods; a slot's sum is made once, of the records of ten slots."""
    width = micros(period) // SLOTS
    slot = lambda us: F.floor(us / width)
    first = F.min("us").over(near.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn(f"slot_{period}", slot(F.col("us")))
    return rows.withColumns({
        f"sum_{period}": F.sum("wlen").over(Window.partitionBy(*side).orderBy(f"slot_{period}").rangeBetween(1 - SLOTS, 0)),
        f"whole_{period}": F.col(f"slot_{period}") - slot(first) >= SLOTS - 1,
        f"still_{period}": F.col(f"slot_{period}") - slot(F.lag("us").over(near)) >= SLOTS,
    })


def _histogram(value: Column, mine: Column, edges: list[int]) -> list[Column]:
    """Counts of the values up to each edge, and of those above the last."""
    low = [None, *edges]
    out = []
    for a, b in zip(low, [*edges, None], strict=True):
        inside = mine & value.isNotNull()
        inside = inside if a is None else inside & (value > a)
        inside = inside if b is None else inside & (value <= b)
        out.append(F.count(F.when(inside, 1)))
    return out


def rates(df: DataFrame, key: list[str], widths: tuple[str, ...] = ("1s", "100ms", "10ms", "1ms"), slots: int = 10) -> DataFrame:
    """Lowest and highest bit rate of each key: moving averages over ``slots`` intervals of each width, at records."""
    out = None
    for name in widths:
        width = micros(name)
        per = df.groupBy(*key, F.floor(F.col("us") / width).alias("slot")).agg((F.sum("wlen") * 8).cast("long").alias("bits"))
        moving = F.sum("bits").over(Window.partitionBy(*key).orderBy("slot").rangeBetween(-(slots - 1), 0))
        per = per.withColumn("rate", (moving * 1_000_000 / F.lit(width * slots)).cast("long"))
        part = per.groupBy(*key).agg(F.min("rate").alias(f"min_rate_{name}"), F.max("rate").alias(f"max_rate_{name}"))
        out = part if out is None else out.join(part, key)
    return out
