"""Flows: functions applied in order to a packet stream, then read as DataFrames.

    flow = create_offline_flow(spark, "trace.pcap")
    flow.apply("BPF_FILTER", "tcp and dst port 80")
    count = flow.apply("PKT_COUNTER")
    flow.connect()
    flow.read(count).show()

A function sees the stream as the filters before it left it. Nothing runs before a
result is read; Catalyst gets one plan for each result.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import anonymize as anon
from flowspark.functions.bpf import compile_filter
from flowspark.functions.options import with_options
from flowspark.operators import aggregates, filters, flows, reassembly, trackers, values, windows
from flowspark.operators.order import running_sum
from flowspark.plans.errors import Err, FlowError
from flowspark.sources.pcap import FIELD_BYTES, decode, encode, read_packets, write_packets

PAYLOAD = "pkt"
# Modes of THRESHOLD (fixed values).
POLLED, MOVING = 64, 128


@dataclass
class FunctionDef:
    """A function that flows can apply.

    ``check`` validates arguments when the function is applied. ``filters`` gives the
    stream that later functions see, ``changes`` the same where only decoded columns change;
    ``value`` a record's part of the function's value, for functions that read others,
    which ``counts`` says are to be added up; ``result`` the result over the stream so far.
    """

    name: str
    library: str
    argdescr: str = ""
    check: Callable = lambda *a: None
    filters: Callable | None = None
    changes: Callable | None = None
    value: Callable | None = None
    result: Callable | None = None
    modifies: bool = False
    counts: bool = False


@dataclass
class Instance:
    fid: int
    function: FunctionDef
    args: tuple
    stream: DataFrame | None = None  # as the function sees it


FUNCTIONS: dict[tuple[str, str], FunctionDef] = {}


def register_function(function: FunctionDef) -> None:
    """Make a function known by name; one of the same library and name is replaced."""
    FUNCTIONS[function.library, function.name] = function


def resolve(name: str) -> FunctionDef:
    """``[library:]NAME``; without a library the first one that has the name."""
    library, colon, plain = name.rpartition(":")
    found = [f for (lib, n), f in FUNCTIONS.items() if n == plain and (not colon or lib == library)]
    if not found:
        raise FlowError(Err.FUNCTION_NOT_FOUND, name)
    return found[0]


_ids = itertools.count(1)
OPEN: dict[int, Flow] = {}


@dataclass
class Device:
    """A source: live ones are replayed folders."""

    id: int
    name: str
    description: str = ""
    link_speed: int = 0
    mpls: bool = False
    vlan: bool = False


DEVICES: dict[str, Device] = {}


def register_device(name: str, **fields) -> Device:
    DEVICES[name] = Device(len(DEVICES) + 1, name, **fields)
    return DEVICES[name]


@dataclass
class Flow:
    packets: DataFrame
    device: str = "offline"
    instances: list[Instance] = field(default_factory=list)
    status: str = "INIT"
    fd: int = field(default_factory=lambda: next(_ids))

    def __post_init__(self) -> None:
        OPEN[self.fd] = self

    def _open(self) -> None:
        if self.status == "CLOSED":
            raise FlowError(Err.INVALID_FLOW, str(self.fd))

    def apply(self, name: str, *args) -> int:
        """Add a function; its number, from 1."""
        self._open()
        if self.status != "INIT":
            raise FlowError(Err.FLOW_ALREADY_ACTIVE, name)
        function = resolve(name)
        if len(args) != len(function.argdescr):
            raise FlowError(Err.INVALID_ARGUMENT, f"{name} takes {len(function.argdescr)} arguments")
        for k, (kind, arg) in enumerate(zip(function.argdescr, args, strict=True)):
            if (kind in "ilcrf" and not isinstance(arg, int)) or (kind in "sSw" and not isinstance(arg, str)):
                raise FlowError([Err.INVALID_ARGUMENT_1, Err.INVALID_ARGUMENT_2, Err.INVALID_ARGUMENT_3, Err.INVALID_ARGUMENT_4, Err.INVALID_ARGUMENT_5][min(k, 4)], f"{name}: {arg!r}")
        function.check(*args)
        self.instances.append(Instance(len(self.instances) + 1, function, args))
        return len(self.instances)

    def connect(self) -> None:
        self._open()
        if self.status != "INIT":
            raise FlowError(Err.FLOW_ALREADY_ACTIVE, str(self.fd))
        stream, unwritten = self.packets, False
        for k, instance in enumerate(self.instances):
            instance.stream = stream
            if instance.function.changes is not None:
                # Bytes are written back once, after the last of several changes in a row (or where checksums are due).
                before, adjust = stream, instance.args[0].split(",")[2:3] == ["CHECKSUM_ADJUST"]
                stream = instance.function.changes(stream, *instance.args)
                unwritten |= stream is not before
                more = k + 1 < len(self.instances) and self.instances[k + 1].function.changes is not None
                if unwritten and "pkt" in stream.columns and (adjust or not more):
                    stream, unwritten = encode(stream, adjust), False
            elif instance.function.filters is not None:
                stream = instance.function.filters(stream, *instance.args)
        self.stream, self.status = stream, "ACTIVE"

    def instance(self, fid: int) -> Instance:
        self._open()
        if not 1 <= fid <= len(self.instances):
            raise FlowError(Err.INVALID_FUNCTION_ID, str(fid))
        return self.instances[fid - 1]

    def read(self, fid: int) -> DataFrame:
        """The result of a function, with the time of reading in microseconds."""
        instance = self.instance(fid)
        if self.status == "INIT":
            raise FlowError(Err.FLOW_NOT_CONNECTED, str(self.fd))
        if instance.function.result is None:
            raise FlowError(Err.NOT_SUPPORTED, f"{instance.function.name} has no result")
        out = instance.function.result(instance.stream, *instance.args)
        return out.withColumn("read_us", F.lit(int(time.time() * 1e6)))

    def values(self, fid: int) -> DataFrame:
        """The packets a function sees, with column value: the function's at each of them (a counter's, what it has counted)."""
        if self.instance(fid) and self.status == "INIT":
            raise FlowError(Err.FLOW_NOT_CONNECTED, str(self.fd))
        return _current(self.fd, fid)

    def packets_left(self) -> DataFrame:
        """The packets that pass all functions, in order where they are read one by one."""
        if self.status == "INIT":
            raise FlowError(Err.FLOW_NOT_CONNECTED, str(self.fd))
        return self.stream

    def next_packets(self) -> Iterator[Row]:
        """The packets one by one; needs TO_BUFFER."""
        if not any(i.function.name == "TO_BUFFER" for i in self.instances):
            raise FlowError(Err.INVALID_FUNCTION_ID, "no TO_BUFFER")
        return self.packets_left().select("pkt_no", "us", "ifindex", "caplen", "wlen", "pkt").orderBy("pkt_no").toLocalIterator()

    def loop(self, count: int, callback: Callable[[Row], None]) -> int:
        """Call back for each packet, ``count`` of them at most (-1: all); how many there were."""
        done = 0
        for row in itertools.islice(self.next_packets(), None if count < 0 else count):
            callback(row)
            done += 1
        return done

    def close(self) -> None:
        self._open()
        self.status = "CLOSED"
        OPEN.pop(self.fd, None)

    # -- catalog --

    def info(self) -> dict:
        return {"fd": self.fd, "device": self.device, "num_functions": len(self.instances), "status": self.status}

    def function_info(self, fid: int) -> dict:
        i = self.instance(fid)
        return {"fid": fid, "name": i.function.name, "library": i.function.library, "args": i.args}

    def function_counts(self) -> DataFrame:
        """Packets that reached each function: one pass each over the plan up to it."""
        rows = [i.stream.agg(F.count(F.lit(1)).alias("pkts")).select(F.lit(i.fid).alias("fid"), F.lit(i.function.name).alias("name"), "pkts") for i in self.instances]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out


def create_flow(packets: DataFrame, device: str = "stream") -> Flow:
    return Flow(packets, device)


def create_offline_flow(spark: SparkSession, path: str, kind: str = "pcap") -> Flow:
    try:
        packets = read_packets(spark, path, kind)
    except KeyError:
        raise FlowError(Err.NO_DRIVER, kind) from None
    return Flow(decode(packets), path)


def next_after(ids: list[int], at: int) -> int | None:
    """The next id in order, or None: how infos of flows, functions and devices are listed."""
    return min((i for i in ids if i > at), default=None)


def next_flow_info(fd: int) -> dict | None:
    following = next_after(list(OPEN), fd)
    return None if following is None else OPEN[following].info()


def libraries() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for library, name in FUNCTIONS:
        out.setdefault(library, []).append(name)
    return out


# -- the functions ----------------------------------------------------------


def _source(fd: int, fid: int) -> tuple[Instance, Column]:
    """Another function and a record's part of its value."""
    if fd not in OPEN:
        raise FlowError(Err.INVALID_FLOW, str(fd))
    instance = OPEN[fd].instance(fid)
    if instance.function.value is None:
        raise FlowError(Err.INVALID_FUNCTION_ID, f"{instance.function.name} has no value")
    return instance, instance.function.value


def _over(f: Callable) -> Callable:
    """A result over another function's values: (fd, fid, ...) become its stream and value column."""

    def run(stream: DataFrame, fd: int, fid: int, *rest) -> DataFrame:
        instance, value = _source(fd, fid)
        return f(value(instance.stream, *instance.args), *rest)

    return run


def _checked(fd: int, fid: int, *rest) -> None:
    _source(fd, fid)


def _bad(test: bool, code: Err, text: str = "") -> None:
    if test:
        raise FlowError(code, text)


def _column(name: str, c: Callable[[], Column]) -> Callable:
    return lambda df, *a: df.withColumn("value", c())


def _int_result(df: DataFrame, op: int, fd1: int, fid1: int, fd2: int, fid2: int) -> DataFrame:
    one, two = (OPEN[fd].read(fid).select("value") for fd, fid in ((fd1, fid1), (fd2, fid2)))
    return values.binop(one, two, op)


def _current(fd: int, fid: int) -> DataFrame:
    """What a function shows at each record of its stream: counters what they have counted, others the record's value."""
    instance, value = _source(fd, fid)
    rows = value(instance.stream, *instance.args)
    return running_sum(rows.withColumnRenamed("value", "part_"), F.col("part_"), "value").drop("part_") if instance.function.counts else rows


def _binop_values(df: DataFrame, op: int, fd1: int, fid1: int, fd2: int, fid2: int) -> DataFrame:
    return values.binop_at_records(df, _current(fd1, fid1), _current(fd2, fid2), op)


#: Fields of TOP: by number of the protocol and the field's name.
TOP_FIELDS = {
    "IP": ["ip_tos", "ip_len", "ip_id", "ip_frag", "ip_ttl", "ip_proto", "ip_csum", "src_ip", "dst_ip"],
    "TCP": ["sport", "dport", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_win", "tcp_csum", "tcp_urg"],
    "UDP": ["sport", "dport", "udp_len", "udp_csum"],
}


def _top_field(proto: str, name: str) -> Column:
    number = {"IP": None, "TCP": 6, "UDP": 17}[proto]
    return F.col(name) if number is None else F.when(F.col("ip_proto") == number, F.col(name))


def _check_top(many, proto, name, sort_by, reset):
    _bad(not 1 <= many <= 1000, Err.INVALID_ARGUMENT_1)
    _bad(proto not in TOP_FIELDS, Err.INVALID_ARGUMENT_2, proto)
    _bad(name not in TOP_FIELDS.get(proto, []), Err.INVALID_ARGUMENT_3, name)
    _bad(sort_by not in (1, 2), Err.INVALID_ARGUMENT_4)


FIVE = ["src_ip", "dst_ip", "ip_proto", "sport", "dport"]


#: Functions on texts, for fields of application protocols; random ones draw anew, or (in lambdas) from a column.
TEXT_FUNCTIONS = {
    "ZERO": lambda c, a: F.repeat(F.lit("\0"), F.char_length(c)),
    "STRIP": lambda c, a: anon.strip(c, int(a[0]) if a else 0),
    "PATTERN_FILL": lambda c, a: anon.pattern_fill(c, chr(int(a[1]) & 255) if a[0] == "INTEGER" else a[1]),
    "REPLACE": lambda c, a: anon.replace(c, a[0]),
    "HASHED": lambda c, a: anon.hashed(c, a[0], a[1] if len(a) > 1 else None),
    "REGEXP": lambda c, a: anon.regexp(c, a[0], [None if x == "NULL" else x for x in a[2:]]),
    "FILENAME_RANDOM": lambda c, a, draw=None: anon.filename_random(c, draw=draw),
    "RANDOM": lambda c, a, draw=None: F.substring(F.repeat(F.sha2(F.rand().cast("string") if draw is None else F.concat(draw, c), 256), F.ceil(F.char_length(c) / 64).cast("int")), F.lit(1), F.char_length(c)),
    "UNCHANGED": lambda c, a: c,
}


def _anonymized(df: DataFrame, text: str) -> DataFrame:
    """The packets with the columns of a field changed; their bytes are as before."""
    proto, name, how, *args = text.split(",")
    if proto in ("HTTP", "FTP") and anon.text_field(proto, name):
        if how not in TEXT_FUNCTIONS:
            raise FlowError(Err.INVALID_ARGUMENT, how)
        draws = {"draw": F.col("draw_")} if how in ("RANDOM", "FILENAME_RANDOM") else {}
        drawn = df.withColumn("draw_", F.rand().cast("string")) if draws else df
        return drawn.withColumn("l4_payload", anon.in_text_field(F.col("l4_payload"), proto, name, lambda c: TEXT_FUNCTIONS[how](c, args, **draws))).drop("draw_")
    columns = ANON_COLUMNS | {"CHECKSUM": {"TCP": "tcp_csum", "UDP": "udp_csum"}.get(proto, "ip_csum")}
    if proto not in ("IP", "TCP", "UDP", "ICMP", "HTTP", "FTP"):
        raise FlowError(Err.INVALID_ARGUMENT, proto)
    if name not in columns:
        raise FlowError(Err.INVALID_ARGUMENT, name)
    c = columns[name]
    number = {"TCP": 6, "UDP": 17, "ICMP": 1, "HTTP": 6, "FTP": 6}.get(proto)
    kind, of_protocol = df.schema[c].dataType, F.lit(True) if number is None else F.coalesce(F.col("ip_proto") == number, F.lit(False))
    if how == "UNCHANGED":
        return df
    if how == "MAP":
        shared = {"src_ip": ["src_ip", "dst_ip"], "dst_ip": ["src_ip", "dst_ip"], "sport": ["sport", "dport"], "dport": ["sport", "dport"]}.get(c, [c])
        made = anon.map_first_seen(df, shared)
        n = F.col(f"{c}_map")
        six = F.concat(F.lit("2001:0db8:0000:0000:"), F.regexp_replace(F.lower(F.lpad(F.hex(n), 16, "0")), "(.{4})(?=.)", "$1:"))
        new = F.when(F.col(c).contains(":"), six).otherwise(anon.ipv4_text(n)) if c in ("src_ip", "dst_ip") else n.cast("string").cast(kind)
        return made.withColumn(c, F.when(of_protocol, new).otherwise(F.col(c))).drop(*(f"{x}_map" for x in shared))
    if how == "PREFIX_PRESERVING_MAP":
        return anon.anonymize_ip(df, (args[0] if args else "").encode(), (c,), anon.prefix_preserving_map)
    if how == "PREFIX_PRESERVING":
        return anon.anonymize_ip(df, (args[0] if args else "0123456789abcdefFEDCBA9876543210").encode(), (c,))
    if how == "CHECKSUM_ADJUST":
        return df.withColumn(c, F.col(c))
    if how == "MAP_DISTRIBUTION":
        new = anon.map_distribution(F.col(c), args[0], float(args[1]), float(args[2]))
        if c in ("src_ip", "dst_ip"):
            new = anon.ipv4_text(F.pmod(new.cast("long"), F.lit(1 << 32)))
    elif c == "l4_payload":
        if how not in TEXT_FUNCTIONS:
            raise FlowError(Err.INVALID_ARGUMENT, how)
        new = F.encode(TEXT_FUNCTIONS[how](F.decode(c, "ISO-8859-1"), args), "ISO-8859-1")
    else:
        new = anon.on_bytes(F.col(c), FIELD_BYTES.get(c), lambda data: _byte_function(how, args, data))
    return df.withColumn(c, F.when(of_protocol, new.cast(kind)).otherwise(F.col(c)))


def _byte_function(how: str, args: list[str], data: Column) -> Column:
    """A function on the bytes of a field of fixed width, which the caller fits to that width."""
    if how == "ZERO":
        return F.lit(b"")
    if how == "STRIP":
        return F.substring(data, 1, int(args[0]) if args else 0)
    if how == "PATTERN_FILL":
        return F.lit((bytes([int(args[1]) & 255]) if args[0] == "INTEGER" else args[1].encode()) * 16)
    if how == "HASHED":
        return F.unhex(anon.hashed(data, args[0]))
    if how == "RANDOM":
        return F.unhex(F.sha2(F.rand().cast("string"), 256))
    raise FlowError(Err.INVALID_ARGUMENT, how)


#: Fields of each protocol that can be changed; protocols above TCP reach down to its fields, all of them to those of IP.
ANON_COLUMNS = {
    "TOS": "ip_tos", "PACKET_LENGTH": "ip_len", "ID": "ip_id", "TTL": "ip_ttl", "CHECKSUM": "ip_csum", "SRC_IP": "src_ip", "DST_IP": "dst_ip", "SRC_PORT": "sport", "DST_PORT": "dport",
    "SEQUENCE_NUMBER": "tcp_seq", "ACK_NUMBER": "tcp_ack", "FLAGS": "tcp_flags", "WINDOW": "tcp_win", "URGENT_POINTER": "tcp_urg", "UDP_DATAGRAM_LENGTH": "udp_len", "TYPE": "icmp_type", "CODE": "icmp_code", "PAYLOAD": "l4_payload",
}
_IP = {"TOS", "PACKET_LENGTH", "ID", "TTL", "CHECKSUM", "SRC_IP", "DST_IP", "PAYLOAD"}
_TCP = _IP | {"SRC_PORT", "DST_PORT", "SEQUENCE_NUMBER", "ACK_NUMBER", "FLAGS", "WINDOW", "URGENT_POINTER"}
ANON_FIELDS = {"IP": _IP, "TCP": _TCP, "HTTP": _TCP, "FTP": _TCP, "UDP": _IP | {"SRC_PORT", "DST_PORT", "UDP_DATAGRAM_LENGTH"}, "ICMP": _IP | {"TYPE", "CODE"}}
HEADER_FUNCTIONS = {"UNCHANGED", "MAP", "MAP_DISTRIBUTION", "STRIP", "RANDOM", "HASHED", "PATTERN_FILL", "ZERO", "PREFIX_PRESERVING", "PREFIX_PRESERVING_MAP", "CHECKSUM_ADJUST"}


def _check_anonymize(text: str) -> None:
    """Which function may change which field: prefixes only of addresses, checksums only by their adjustment or as plain
    numbers, texts only in payloads and fields of applications."""
    _bad(text.count(",") < 2, Err.INVALID_ARGUMENT, text)
    proto, name, how, *_ = text.split(",")
    _bad(proto not in ANON_FIELDS, Err.INVALID_ARGUMENT, proto)
    if proto in ("HTTP", "FTP") and anon.text_field(proto, name) or name == "PAYLOAD":
        _bad(how not in TEXT_FUNCTIONS and not (name == "PAYLOAD" and how in ("MAP", "UNCHANGED")), Err.INVALID_ARGUMENT, how)
        return
    _bad(name not in ANON_FIELDS[proto], Err.INVALID_ARGUMENT, name)
    _bad(how not in HEADER_FUNCTIONS, Err.INVALID_ARGUMENT, how)
    _bad(how.startswith("PREFIX_PRESERVING") and name not in ("SRC_IP", "DST_IP"), Err.INVALID_ARGUMENT, name)
    _bad(how == "CHECKSUM_ADJUST" and name != "CHECKSUM", Err.INVALID_ARGUMENT, name)


def _check_threshold(kind: int, fd: int, fid: int, limit: int, bound: int, timeout: int, divider: int, events: int) -> None:
    """In line, or (kind MOVING) over the sum of the last ``timeout`` milliseconds at each record, whatever the divider; polls
    by wall clock have no meaning for a finished stream."""
    _checked(fd, fid)
    _bad(bool(kind & POLLED), Err.NOT_SUPPORTED, "polling")
    _bad(not kind & MOVING and bool(timeout or divider > 1), Err.NOT_SUPPORTED, "timeout and divider without a moving window")
    _bad(bool(kind & MOVING) and timeout <= 0, Err.INVALID_ARGUMENT_5, "no window")


def _threshold(df: DataFrame, kind: int, fd: int, fid: int, limit: int, bound: int, timeout: int, divider: int, events: int) -> DataFrame:
    def run(rows: DataFrame) -> DataFrame:
        if kind & MOVING:
            rows = windows.moving_window(rows.withColumn("all_", F.lit(0)), F.col("value"), f"{timeout}ms", "all_").drop("all_")
        return windows.threshold(rows, F.col("value"), bound, limit, events)

    return _over(run)(df, fd, fid)


def _to_file(df: DataFrame, kind: int, path: str, limit: int) -> DataFrame:
    write_packets(df, path, {0: "pcap", 1: "pcap", 2: "erf"}[kind], limit)
    return df.sparkSession.createDataFrame([(path,)], "value string")


def _report(df: DataFrame, kind: str, transport: str, keys: str, record: str) -> DataFrame:
    wanted = [x.strip() for x in record.split(",") if x.strip()]
    rows = trackers.with_session_key(with_options(df.where("src_ip is not null")))
    periods = ("1s", "100ms", "10ms", "1ms") if not wanted or any("_rate" in x for x in wanted) else ()
    out = flows.flow_report(rows, trackers.SESSION_KEY, F.col("src_ip") == F.col("low_ip"), extra={"tcp_flags": F.bit_or("tcp_flags"), "tos": F.bit_or("ip_tos"), "min_ttl": F.min("ip_ttl"), "max_ttl": F.max("ip_ttl"), "icmp_types": F.bit_or(F.expr("CASE WHEN icmp_type <= 62 THEN shiftleft(1L, icmp_type) END"))}, tcp=True, cache="360s", sides=flows.packet_sides(), periods=periods)
    return out.select(*trackers.SESSION_KEY, *wanted) if wanted else out


def _install() -> None:
    std, extra, track = "std", "extra", "track"
    count = lambda df, *a: df.withColumn("value", F.lit(1).cast("long"))
    wlen = lambda df, *a: df.withColumn("value", F.col("wlen").cast("long"))
    info = lambda df, what: values.pktinfo(df, what)
    last = lambda f: lambda df, *a: f(df, *a).agg(F.max_by("value", "pkt_no").alias("value"))
    gap = lambda df, *a: values.gap(df).withColumnRenamed("gap", "value")
    data = {0: "pkt", 1: "substring(pkt, coalesce(l3_off, 0) + 1)", 2: "substring(pkt, coalesce(l4_off, l3_off + 28) + 1)", 3: "l4_payload"}
    hashed = lambda df, layer: df.withColumn("value", values.byte_hash(F.expr(data[layer])))
    pay = lambda: F.col(PAYLOAD)
    for f in (
        FunctionDef("PKT_COUNTER", std, value=count, counts=True, result=lambda df: aggregates.pkt_counter(df)),
        FunctionDef("BYTE_COUNTER", std, value=wlen, counts=True, result=lambda df: aggregates.byte_counter(df)),
        FunctionDef("BPF_FILTER", std, "s", check=lambda s: compile_filter(s), filters=lambda df, s: df.where(compile_filter(s))),
        FunctionDef("STR_SEARCH", std, "sii", check=lambda s, o, d: filters.str_search(F.lit(b""), s, o, d), filters=lambda df, s, o, d: df.where(filters.str_search(pay(), s, o, d))),
        FunctionDef("SAMPLE", std, "ii", filters=lambda df, v, mode: filters.sample_probabilistic(df, v) if mode == filters.PROBABILISTIC else filters.sample_periodic(df, v)),
        FunctionDef("HASHSAMP", std, "ii", check=lambda n, k: _bad(not 1 <= n <= 1024, Err.INVALID_ARGUMENT_1), filters=_hash_sample, result=_hash_records),
        FunctionDef("STARTSTOP", std, "ss", filters=filters.startstop, result=lambda df, a, b: filters.startstop(df, a, b).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))),
        FunctionDef("SYNC", std, "s"),
        FunctionDef("PKTINFO", std, "i", check=lambda w: _bad(w not in (0, 1), Err.INVALID_ARGUMENT_1), value=info, result=last(info)),
        FunctionDef("GAP", std, value=gap, result=last(gap)),
        FunctionDef("HASH", std, "i", check=lambda w: _bad(w not in data, Err.INVALID_ARGUMENT_1), value=hashed, result=last(hashed)),
        FunctionDef("BINOP", std, "irfrf", check=lambda op, a, b, c, d: (_bad(op not in (0, 1), Err.INVALID_ARGUMENT_1), _checked(a, b), _checked(c, d)), value=_binop_values, result=_int_result),
        FunctionDef("STATS", std, "rfs", check=_checked, result=_over(lambda df, ticks: aggregates.stats(df, F.col("value"), ticks))),
        FunctionDef("DIST", std, "rfsss", check=_checked, result=_over(lambda df, lo, hi, w: aggregates.dist(df, F.col("value"), int(lo), int(hi), int(w)))),
        FunctionDef("BURST", std, "iiiiiii", result=aggregates.burst),
        FunctionDef("BUCKET", std, "rfsi", check=_checked, result=_over(lambda df, t, reset: windows.bucket(df, F.col("value"), t, bool(reset)))),
        FunctionDef("THRESHOLD", std, "irfliiii", check=_check_threshold, result=_threshold),
        FunctionDef("TO_BUFFER", std, "i"),
        FunctionDef("TO_FILE", std, "iwl", check=lambda k, p, n: _bad(k not in (0, 1, 2), Err.FUNCTION_COULD_NOT_APPLY), result=_to_file),
        FunctionDef("RES2FILE", std, "sSswsi", result=_res2file),
        FunctionDef("REGEXP", extra, "s", check=lambda s: filters.regexp(F.lit(b""), s), filters=lambda df, s: df.where(filters.regexp(pay(), s))),
        FunctionDef("TOP", extra, "issii", check=_check_top, result=lambda df, n, p, name, by, reset: aggregates.top(df.withColumn("wlen", F.col("wlen") - F.coalesce("l3_off", F.lit(0))), _top_field(p, name), n, by, f"{reset}s" if reset else None)),
        FunctionDef("EXPIRED_FLOWS", extra, "iii", result=lambda df, a, b, least: flows.expired_flows(df.where("sport is not null"), FIVE, "30s", least)),
        FunctionDef("COOKING", extra, "iiii", filters=lambda df, n, t, once, c: reassembly.cooked_packets(df, n or 32000, f"{t or 60}s", bool(once), c or reassembly.BOTH), modifies=True),
        FunctionDef("ANONYMIZEIP", extra, "s", check=lambda k: _bad(len(k.encode()) != 32, Err.INVALID_ARGUMENT_1), filters=lambda df, k: encode(anon.anonymize_ip(df, k.encode())), modifies=True),
        FunctionDef("ANONYMIZE", "anon", "s", check=_check_anonymize, changes=_anonymized, modifies=True),
        FunctionDef("PRINT_PACKET", "anon", result=lambda df: df.drop("pkt", "l4_payload")),
        FunctionDef("UNCOOK", "anon", "iii", check=lambda *a: _bad(True, Err.NOT_SUPPORTED, "take the packets of cooked ones apart with reassembly.uncook")),
        FunctionDef("INTERFACE", "capture", "i", check=lambda n: _bad(n < 0, Err.INVALID_ARGUMENT), filters=filters.interface),
        FunctionDef("FLOW_REPORT", "report", "ssss", result=_report),
        *(FunctionDef(n, track, filters=lambda df, n=n: trackers.track(df, n)) for n in [*trackers.SIGNATURES, *trackers.STATELESS, "TRACK_FTP", "TRACK_GRID_FTP"]),
        FunctionDef("TRACK_SKYPE", track, "s", filters=lambda df, hosts: trackers.skype(df, hosts.split(","))),
    ):
        register_function(f)


def _hash_sample(df: DataFrame, below: int, keep: int) -> DataFrame:
    h = filters.flow_hash(anon.ipv4_number(F.col("src_ip")), anon.ipv4_number(F.col("dst_ip")), F.col("ip_proto"), F.col("sport"), F.col("dport"))
    return filters.hash_sample(df.where("ip_version = 4 and sport is not null"), h, below)


def _hash_records(df: DataFrame, below: int, keep: int) -> DataFrame:
    if not keep:
        raise FlowError(Err.NOT_SUPPORTED, "HASHSAMP keeps no records")
    return _hash_sample(df, below, keep).select("us", "src_ip", "dst_ip", "sport", "dport", "tcp_seq", "tcp_flags", "ip_proto")


def _res2file(df: DataFrame, types: str, sources: str, header: str, path: str, interval: str, reset: int) -> DataFrame:
    """Values of several functions ("fid@fd,..."), by types 1 (number), 2 (seconds) or 3 (statistics); the lines are
    written as text and are the result."""
    joined, columns = None, []
    for k, part in enumerate(sources.split(",")):
        fid, fd = map(int, part.split("@"))
        instance, value = _source(fd, fid)
        one = value(instance.stream, *instance.args).select("pkt_no", "us", F.col("value").alias(f"r{k}"))
        joined = one if joined is None else joined.join(one.drop("us"), "pkt_no")
        columns.append((int(types.split(",")[k]), f"r{k}"))
    lines = windows.res2file(joined, interval, columns, header)
    lines.coalesce(1).sortWithinPartitions("bucket").select("line").write.mode("overwrite").text(path)  # a report: one line a period
    return lines


_install()
