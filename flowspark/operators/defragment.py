"""IP datagrams put together from their fragments (IPv4 and IPv6).

Fragments are dealt by (source, destination, protocol, identification) and read in order of time. A task holds, for the
datagram at hand, the stretches of bytes that have arrived: at most 64 KiB, whatever comes. Other packets stay where they
are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.intervals import micros
from flowspark.plans.errors import Err, FlowError
from flowspark.sources.pcap import PACKETS, checksum, decode

FIRST, LAST = "first", "last"
MOST_BYTES = 65_535
NAMES = [part.split()[0] for part in PACKETS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


class Datagram:
    """The bytes of one datagram, as stretches (start, end, data, fragment) in order that don't overlap."""

    def __init__(self, us: int, policy: str) -> None:
        self.us, self.policy = us, policy
        self.parts: list[tuple[int, int, bytes, int]] = []
        self.rows: dict[int, tuple] = {}  # packets of fragments that still have bytes in it, by arrival
        self.size: int | None = None
        self.head: tuple | None = None
        self.arrived = 0

    def add(self, start: int, data: bytes, more: bool, row: tuple, head: tuple | None) -> None:
        """Bytes that overlap with earlier ones: the first to arrive stay, or the last ones take their place, by policy."""
        if not more and self.size is None:
            self.size = start + len(data)
            self.parts = [(a, min(b, self.size), d[: self.size - a], k) for a, b, d, k in self.parts if a < self.size]
        if self.size is not None:
            data = data[: max(0, self.size - start)]
        end, number = start + len(data), self.arrived
        self.arrived += 1
        if head is not None and (self.head is None or self.policy == LAST):
            self.head = head
        if not data:
            return
        new = (start, end, data, number)
        winners, others = ([new], self.parts) if self.policy == LAST else (self.parts, [new])
        kept = list(winners)
        for a, b, d, k in others:
            at = a
            for x, y, _, _ in winners:
                if y <= at or x >= b:
                    continue
                if x > at:
                    kept.append((at, x, d[at - a : x - a], k))
                at = max(at, y)
            if at < b:
                kept.append((at, b, d[at - a :], k))
        self.parts = sorted(kept)
        self.rows[number] = row
        used = {k for *_, k in self.parts}
        self.rows = {k: r for k, r in self.rows.items() if k in used}

    def whole(self) -> bytes | None:
        if self.size is None or self.head is None or sum(b - a for a, b, _, _ in self.parts) != self.size:
            return None
        return b"".join(d for _, _, d, _ in self.parts)


def _packet(head: tuple, data: bytes) -> bytes | None:
    """The packet of the first fragment with all of the datagram's data; None where lengths don't allow it."""
    packet, l3, at, version = head
    if version == 4:
        made = bytearray(packet[:at])
        size = at - l3 + len(data)
        if size > MOST_BYTES:
            return None
        made[l3 + 2 : l3 + 4] = struct.pack(">H", size)
        made[l3 + 6 : l3 + 8] = struct.pack(">H", struct.unpack_from(">H", made, l3 + 6)[0] & 0x4000)
        made[l3 + 10 : l3 + 12] = b"\0\0"
        made[l3 + 10 : l3 + 12] = struct.pack(">H", checksum(bytes(made[l3:at])))
        return bytes(made) + data
    made, fragment = bytearray(packet[: at - 8]), packet[at - 8 : at]
    size = at - 8 - (l3 + 40) + len(data)
    if size > MOST_BYTES:
        return None
    field, place = l3 + 6, l3 + 40  # the field that names the fragment header is in the header before it
    while place < at - 8:
        field, place = place, place + 8 * (made[place + 1] + 1)
    made[field] = fragment[0]
    made[l3 + 4 : l3 + 6] = struct.pack(">H", size)
    return bytes(made) + data


def is_fragment():
    return F.coalesce(F.col("ip_more") | (F.col("ip_frag") > 0), F.lit(False))


def defragment(df: DataFrame, timeout: str = "30s", policy: str = FIRST) -> DataFrame:
    """Decoded packets with fragments put together: a datagram is a packet with position, time and interface of the fragment
    that made it whole.

    Where fragments overlap, ``policy`` first keeps the bytes that came first (by time, then position), last those that came
    last. A datagram's end is what the first fragment without a successor says; bytes beyond it are cut. What isn't whole
    ``timeout`` after its first fragment, or at the end of the input, stays as fragments, but for those whose bytes others
    have replaced. So do fragments that no datagram can have: cut by the capture, of a length that is no multiple of 8 with
    more to come, or ending beyond 65,535. An identification that is used again begins a new datagram. Columns that
    decoding doesn't give are null in datagrams.
    """
    if policy not in (FIRST, LAST):
        raise FlowError(Err.INVALID_ARGUMENT_2, policy)
    most = micros(timeout)
    key = ["src_ip", "dst_ip", "ip_version", "proto_", "frag_id"]
    pieces = df.where(is_fragment()).withColumn("proto_", F.when(F.col("ip_version") == 4, F.col("ip_proto")).otherwise(F.lit(-1)))
    pieces = pieces.select(*NAMES, *key, "l3_off", "frag_at", "ip_frag", "ip_more", "ip_len").repartition(*key).sortWithinPartitions(*key, "us", "pkt_no")
    fields = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []

        def give_up() -> None:
            out.extend(held.rows[k] for k in sorted(held.rows))

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, whose = r[: len(NAMES)], r[len(NAMES) : len(NAMES) + len(key)]
                l3, at, place, more, size = r[len(NAMES) + len(key) :]
                packet, us, start = row[NAMES.index("pkt")], row[NAMES.index("us")], place * 8
                data = packet[at : l3 + size]
                if held is not None and (whose != now or us - held.us > most):
                    give_up()
                    held = None
                now = whose
                if l3 + size > len(packet) or at > l3 + size or start + len(data) > MOST_BYTES or (more and len(data) % 8):
                    out.append(row)
                    continue
                held = held or Datagram(us, policy)
                held.add(start, data, more, row, (packet, l3, at, whose[2]) if start == 0 else None)
                whole = held.whole()
                made = None if whole is None else _packet(held.head, whole)
                if whole is not None:
                    if made is None:
                        give_up()
                    else:
                        out.append((*row[:4], len(made), len(made), row[6], made))
                    held = None
                if len(out) >= 256:
                    yield _batch(out)
                    out.clear()
        if held is not None:
            give_up()
        if out:
            yield _batch(out)

    assert fields[: len(NAMES)] == NAMES
    made = decode(pieces.mapInArrow(run, PACKETS))
    return df.where(~is_fragment()).unionByName(made, allowMissingColumns=True).select(*df.columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
