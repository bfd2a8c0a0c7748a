"""TCP streams put together from packets, in chunks ("cooked" packets), and taken apart again.

Packets are dealt by connection and read in order of time; a task holds, for the
connection at hand, one unfinished chunk a side and segments that arrived early: the
first MiB of those in memory, the bytes of the rest in a temporary file of the task. What
is missing may arrive at any time until the connection ends. A chunk's row tells the
packets that went into it.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.anonymize import ipv4_number
from flowspark.functions.intervals import micros
from flowspark.operators.defragment import defragment
from flowspark.plans.errors import Err, FlowError
from flowspark.sources.pcap import ETHERNET, PACKETS, decode

CLIENT, SERVER, BOTH = 1, 2, 3
FIN, SYN, RST = 1, 2, 4
MOST_EARLY_BYTES = 1 << 20
COOKED = "pkt_no bigint, us bigint, src_ip string, dst_ip string, ip_proto int, sport int, dport int, wlen int, chunk_no int, payload binary, packets array<bigint>"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
NAMES = [part.split()[0] for part in COOKED.split(", ")]
HEADERS = 14 + 20 + 20


class Early:
    """Segments that arrived early, by position; of the same position the longest comes first, then the oldest."""

    def __init__(self) -> None:
        self.heap: list[tuple[int, int, int, int, bytes | None, int]] = []  # position, -length, arrival, packet, data or None, place in the file
        self.arrived, self.held, self.end, self.file = 0, 0, 0, None

    def __len__(self) -> int:
        return len(self.heap)

    def first(self) -> int:
        return self.heap[0][0]

    def push(self, at: int, data: bytes, number: int) -> None:
        self.arrived += 1
        size, place, kept = len(data), 0, data
        if self.held + size <= MOST_EARLY_BYTES:
            self.held += size
        else:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.end)
            self.file.write(data)
            place, kept = self.end, None
            self.end += size
        heapq.heappush(self.heap, (at, -size, self.arrived, number, kept, place))

    def pop(self) -> tuple[int, bytes, int]:
        at, size, _, number, data, place = heapq.heappop(self.heap)
        if data is None:
            self.file.seek(place)
            data = self.file.read(-size)
        else:
            self.held += size
        if not self.heap and self.file:
            self.file.close()
            self.file, self.end = None, 0
        return at, data, number


class Side:
    """One direction of a connection. Positions are sequence numbers without their wrap at 2**32."""

    def __init__(self, ends: tuple, size: int, once: bool) -> None:
        self.ends, self.size, self.once = ends, size, once
        self.next: int | None = None
        self.top = 0
        self.early = Early()
        self.data, self.packets, self.chunks = bytearray(), [], 0
        self.last = (0, 0)

    def take(self, seq: int, data: bytes, flags: int, number: int, us: int) -> Iterator[tuple]:
        self.last = (number, us)
        at = self.top + (seq - self.top + 2**31) % 2**32 - 2**31
        if flags & SYN:
            self.next = self.top = at + 1
        elif self.next is None:
            self.next = self.top = at
        if data and not flags & SYN:
            self.top = max(self.top, at)
            self.early.push(at, data, number)
            yield from self._drain()
        if flags & (FIN | RST):
            yield from self.finish()

    def _drain(self) -> Iterator[tuple]:
        while self.early and self.early.first() <= self.next:
            at, data, number = self.early.pop()
            data = data[self.next - at :]
            if data:
                self.next += len(data)
                self.data += data
                self.packets.append(number)
            while len(self.data) >= self.size:
                yield from self._chunk(self.size)

    def _chunk(self, size: int) -> Iterator[tuple]:
        data, self.data = bytes(self.data[:size]), self.data[size:]
        packets, self.packets = self.packets, self.packets[-1:] if self.data else []
        self.chunks += 1
        if not self.once or self.chunks == 1:
            src, dst, sport, dport = self.ends
            yield (*self.last, src, dst, 6, sport, dport, HEADERS + size, self.chunks - 1, data, packets)

    def finish(self) -> Iterator[tuple]:
        """The rest, gaps left out."""
        while self.early:
            self.next = self.early.first()
            yield from self._drain()
        if self.data:
            yield from self._chunk(len(self.data))
        self.next = None


def cook(df: DataFrame, threshold: int = 32000, timeout: str = "60s", once: bool = False, collect: int = BOTH) -> DataFrame:
    """Decoded packets as cooked ones: a row for each ``threshold`` bytes of a TCP stream and for the rest at its end
    (FIN, RST, ``timeout`` of silence, end of input), of the client's side, the server's or both; other packets as they
    are, without chunk_no. ``once`` gives a stream's first chunk alone. The client is who sent the first packet."""
    if threshold <= 0:
        raise FlowError(Err.INVALID_ARGUMENT_1, "threshold above 0")
    if collect not in (CLIENT, SERVER, BOTH):
        raise FlowError(Err.INVALID_ARGUMENT_4, "1, 2 or 3")
    idle = micros(timeout)
    other = df.where("not coalesce(ip_proto = 6 and sport is not null, false)").select(
        "pkt_no", "us", "src_ip", "dst_ip", "ip_proto", "sport", "dport", "wlen", F.lit(None).cast("int").alias("chunk_no"), F.col("l4_payload").alias("payload"), F.array("pkt_no").alias("packets")
    )
    a, b = (F.concat_ws(":", ip, port) for ip, port in (("src_ip", "sport"), ("dst_ip", "dport")))
    tcp = df.where("ip_proto = 6 and sport is not null").select(F.concat_ws(" ", F.least(a, b), F.greatest(a, b)).alias("key"), "us", "pkt_no", "src_ip", "dst_ip", "sport", "dport", "tcp_seq", "tcp_flags", "l4_payload")
    tcp = tcp.repartition("key").sortWithinPartitions("key", "us", "pkt_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, client, seen, out = None, {}, None, 0, []

        def close() -> None:
            for side in sides.values():
                out.extend(side.finish())
            sides.clear()

        for batch in batches:
            for now, us, number, src, dst, sport, dport, seq, flags, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key or us - seen > idle:
                    close()
                    key, client = now, (src, sport)
                seen = us
                if collect == BOTH or (collect == CLIENT) == ((src, sport) == client):
                    ends = (src, dst, sport, dport)
                    if ends not in sides:
                        sides[ends] = Side(ends, threshold, once)
                    out.extend(sides[ends].take(seq, data or b"", flags, number, us))
                if flags & RST:
                    close()
                if len(out) > 256:
                    yield _batch(out)
                    out.clear()
        close()
        if out:
            yield _batch(out)

    return tcp.mapInArrow(run, COOKED).unionByName(other)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def cooked_packets(df: DataFrame, threshold: int = 32000, timeout: str = "60s", once: bool = False, collect: int = BOTH) -> DataFrame:
    """``cook`` for what follows in a flow: its chunks as decoded packets, with bytes of their own (Ethernet, IP and TCP
    headers with the chunk's length and sequence number 0), and the other packets as they are. The columns chunk_no,
    payload and packets come on top. Fragments of IP datagrams are put together first."""
    df = defragment(df)
    tcp = F.coalesce((F.col("ip_proto") == 6) & F.col("sport").isNotNull(), F.lit(False))
    chunks = cook(df.where(tcp), threshold, timeout, once, collect)
    number = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    size, six = F.octet_length("payload"), F.col("src_ip").contains(":")
    length = lambda more: number(F.least(size + more, F.lit(65535)), 4)
    four = F.concat(F.lit("4500"), length(40), F.lit("0000000040060000"), number(ipv4_number(F.when(~six, F.col("src_ip"))), 8), number(ipv4_number(F.when(~six, F.col("dst_ip"))), 8))
    long = F.concat(F.lit("60000000"), length(20), F.lit("0640"), F.replace("src_ip", F.lit(":"), F.lit("")), F.replace("dst_ip", F.lit(":"), F.lit("")))
    head = F.concat(F.lit("020000000001020000000002"), F.when(six, F.concat(F.lit("86DD"), long)).otherwise(F.concat(F.lit("0800"), four)), number("sport", 4), number("dport", 4), F.lit("00000000000000005018FFFF00000000"))
    pkt = F.concat(F.unhex(head), "payload")
    ntp = F.shiftleft(F.floor(F.col("us") / 1_000_000), 32) + F.floor((F.col("us") % 1_000_000) * 4294967296 / 1_000_000)
    made = {"pkt_no": F.col("pkt_no"), "us": F.col("us"), "ts_ntp": ntp, "ifindex": F.lit(0), "caplen": F.octet_length(pkt), "wlen": F.octet_length(pkt), "link_type": F.lit(ETHERNET), "pkt": pkt}
    frames = chunks.select(*(made[name].cast(kind).alias(name) for name, kind in (c.split() for c in PACKETS.split(", "))), "chunk_no", "payload", "packets")
    others = df.where(~tcp).select("*", F.lit(None).cast("int").alias("chunk_no"), F.col("l4_payload").alias("payload"), F.array("pkt_no").alias("packets"))
    return decode(frames).unionByName(others, allowMissingColumns=True).select(*others.columns)


def uncook(cooked: DataFrame, packets: DataFrame) -> DataFrame:
    """The packets that went into cooked ones, each once."""
    return packets.join(cooked.select(F.explode("packets").alias("pkt_no")).distinct(), "pkt_no", "left_semi")
