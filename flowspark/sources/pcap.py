"""PCAP and ERF capture files as Spark data sources, and the packet decoder.

A folder of files is read in order of name. ``pkt_no`` has the file's place in its upper bits and
the record's number in it below, so it orders the whole stream. ``read_packets`` cuts large
files into ranges (``splits``); ``stream_packets`` follows a growing folder (``capture_stream``).
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from flowspark.sources.capture_stream import CaptureStreamReader
from flowspark.sources.formats import CISCO_HDLC, ETHERNET, MAGIC, PACKETS, SNAPLEN, opened
from flowspark.sources.splits import SPLIT_BYTES, files_of, layout_of, read_ranges, rows_between


@dataclass
class File(InputPartition):
    path: str
    place: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class CaptureReader(DataSourceReader):
    """A file is a task."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        return [File(f.path, k) for k, f in enumerate(files_of(self.path))]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with opened(self.path)[0].open_input_file(partition.path) as file:
            layout = layout_of(self.kind, file)
            if layout is not None:
                yield from rows_between(file, layout, layout.start, file.size(), partition.place << 40)


class CaptureWriter(DataSourceWriter):
    """One file a partition, in the order of its rows; files move into place on commit."""

    def __init__(self, path: str, erf: bool, overwrite: bool) -> None:
        self.path, self.erf, self.overwrite = path, erf, overwrite
        self.job = f"{time.time_ns():019d}-{uuid.uuid4().hex[:8]}"  # later jobs sort after earlier ones

    def write(self, iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        end = "erf" if self.erf else "pcap"
        temporary, final = f"{folder}/_attempt-{task.partitionId():05d}-{task.taskAttemptId()}", f"{folder}/part-{self.job}-{task.partitionId():05d}.{end}"
        with system.open_output_stream(temporary) as out:
            first = True
            for r in iterator:
                if first and not self.erf:
                    out.write(struct.pack("<IHHiIII", MAGIC, 2, 4, 0, 0, SNAPLEN, r.link_type))
                first = False
                out.write(erf_record(r) if self.erf else struct.pack("<IIII", r.us // 10**6, r.us % 10**6, len(r.pkt), r.wlen) + bytes(r.pkt))
            if first and not self.erf:
                out.write(struct.pack("<IHHiIII", MAGIC, 2, 4, 0, 0, SNAPLEN, ETHERNET))
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        put_in_place(system, folder, [(m.temporary, m.final) for m in messages if m is not None], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


def put_in_place(system: fs.FileSystem, folder: str, moves: list[tuple[str, str]], overwrite: bool) -> None:
    """Give a job's files their names, all or none of them; with ``overwrite`` the files before them go afterwards."""
    before = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.startswith("part-")]
    done: list[tuple[str, str]] = []
    try:
        for temporary, final in moves:
            system.move(temporary, final)
            done.append((temporary, final))
    except Exception:
        for temporary, final in done:
            system.move(final, temporary)
        raise
    if overwrite:
        for path in before:
            system.delete_file(path)


def erf_record(r) -> bytes:
    ethernet = r.link_type == ETHERNET
    data = (b"\0\0" if ethernet else b"") + bytes(r.pkt)
    return struct.pack("<QBB", r.ts_ntp, 2 if ethernet else 1, (r.ifindex & 3) | 4) + struct.pack(">HHH", 16 + len(data), 0, r.wlen) + data


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["path"], self.name())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStreamReader(self.options["path"], self.name(), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CaptureWriter(self.options["path"], False, overwrite)


class ErfSource(PcapSource):
    @classmethod
    def name(cls) -> str:
        return "erf"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CaptureWriter(self.options["path"], True, overwrite)


#: Readers by the name of the format.
FORMATS = {"pcap": PcapSource, "erf": ErfSource}


def read_packets(spark: SparkSession, path: str, kind: str = "pcap", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of a file or a folder of files. Where a file is larger than ``split_bytes``, all are cut into ranges of that
    size, which are measured at once, and each range is a task; the rows are the same."""
    spark.dataSource.register(FORMATS[kind])
    files = files_of(path)
    if any(f.size > split_bytes for f in files):
        return read_ranges(spark, path, kind, PACKETS, files, split_bytes)
    return spark.read.format(kind).load(path)


def stream_packets(spark: SparkSession, path: str, kind: str = "pcap") -> DataFrame:
    """The same packets as a stream: what is in the folder, then what comes (``capture_stream``)."""
    spark.dataSource.register(FORMATS[kind])
    return spark.readStream.format(kind).load(path)


def write_packets(df: DataFrame, path: str, kind: str = "pcap", limit: int = 0, mode: str = "append") -> None:
    """Write packets in order, at most ``limit`` (0: all): ranges of positions are dealt out, so that the files in order
    of name are the stream in order. By default they are added to those in the folder; ``mode`` overwrite replaces them."""
    df.sparkSession.dataSource.register(FORMATS[kind])
    rows = df.select(*[part.split()[0] for part in PACKETS.split(", ")])
    rows = rows.orderBy("pkt_no").limit(limit) if limit else rows.repartitionByRange("pkt_no").sortWithinPartitions("pkt_no")
    rows.write.format(kind).mode(mode).save(path)


# -- decoding ---------------------------------------------------------------

DECODED = (
    "eth_type int, vlan_id int, mpls boolean, l3_off int, l4_off int, ip_version int, ip_tos int, ip_len int, ip_id int, ip_frag int, ip_ttl int, ip_proto int, ip_csum int, "
    "src_ip string, dst_ip string, sport int, dport int, tcp_seq bigint, tcp_ack bigint, tcp_flags int, tcp_win int, tcp_csum int, tcp_urg int, udp_len int, udp_csum int, "
    "icmp_type int, icmp_code int, ip_more boolean, frag_id bigint, frag_at int, l4_payload binary"
)
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def decode(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``df`` with the header fields of its packets, null where a packet has no such header.

    Ethernet with 802.1Q and MPLS, Cisco HDLC; IPv4, IPv6 with extension headers; TCP,
    UDP, ICMP. Fields are read for a whole batch at once; a later fragment has no ports. Of fragments, and of all IPv4:
    ip_more (fragments follow), frag_id, and frag_at, where in the packet the fragment's data begins. ``fields`` names those
    that are wanted, in the order of DECODED; others aren't made, which Spark cannot see for itself.
    """
    names, at_pkt, at_link = df.columns, df.columns.index("pkt"), df.columns.index("link_type")
    every = [part.split() for part in DECODED.split(", ")]
    if unknown := set(fields or ()) - {n for n, _ in every}:
        raise ValueError(f"no fields of packets: {sorted(unknown)}")
    wanted = [(n, k) for n, k in every if fields is None or n in fields]
    if not wanted:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = decode_batch(batch.column(at_pkt), batch.column(at_link).to_numpy(zero_copy_only=False), {n for n, _ in wanted})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_array(made[n], _KINDS[k]) for n, k in wanted)], [*names, *(n for n, _ in wanted)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{n} {k}" for n, k in wanted)])
    return df.mapInArrow(run, schema)


def _array(value, kind: pa.DataType) -> pa.Array:
    if callable(value):
        return value()
    numbers, valid = value
    return pa.array(numbers, kind, mask=~valid)


def _addresses(octets: np.ndarray, text: Callable[[bytes], str]) -> pa.Array:
    """Rows of octets as text; each different one is made once."""
    width = octets.shape[1]
    different, which = np.unique(np.ascontiguousarray(octets).view(f"V{width}").ravel(), return_inverse=True)
    return pa.array([text(x.tobytes()) for x in different], pa.string()).take(pa.array(which, pa.int64()))


def decode_batch(packets: pa.Array, link: np.ndarray, wanted: set[str] | None = None) -> dict:
    """Fields of a batch: numbers and where they are valid, or a function that makes the array."""
    n = len(packets)
    packets = packets.cast(pa.large_binary()).fill_null(b"")
    _, offsets, held = packets.buffers()
    ends = np.frombuffer(offsets, np.int64)[packets.offset : packets.offset + n + 1] if n else np.zeros(1, np.int64)
    base, sizes = ends[:-1], np.diff(ends)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)

    def u(off: np.ndarray, width: int = 1) -> np.ndarray:
        """Big-endian numbers; 0 beyond the packet."""
        out = np.zeros(n, np.int64)
        for k in range(width):
            inside = (off + k >= 0) & (off + k < sizes)
            out = out * 256 + np.where(inside, data[np.where(inside, base + off + k, 0)], 0)
        return out

    has = lambda off, width: (off >= 0) & (off + width <= sizes)
    ethernet, hdlc = link == ETHERNET, link == CISCO_HDLC
    off = np.where(ethernet, 14, np.where(hdlc, 4, 0)).astype(np.int64)
    kind = u(off - 2, 2)
    linked = (ethernet | hdlc) & has(off - 2, 2)
    kind = np.where(linked, kind, -1)
    vlan, mpls = np.full(n, -1, np.int64), np.zeros(n, bool)
    for _ in range(3):
        tagged = (kind == 0x8100) & has(off, 4)
        vlan = np.where(tagged & (vlan < 0), u(off, 2) & 0xFFF, vlan)
        kind = np.where(tagged, u(off + 2, 2), kind)
        off = np.where(tagged, off + 4, off)
    labelled = kind == 0x8847
    mpls |= labelled
    for _ in range(8):
        last = labelled & has(off, 4) & (u(off + 2) & 1 == 1)
        off = np.where(labelled & has(off, 4), off + 4, off)
        kind = np.where(last, np.where(u(off) >> 4 == 6, 0x86DD, 0x0800), kind)
        labelled &= ~last
    version = u(off) >> 4
    v4, v6 = (kind == 0x0800) & (version == 4) & has(off, 20), (kind == 0x86DD) & (version == 6) & has(off, 40)
    proto = np.where(v4, u(off + 9), np.where(v6, u(off + 6), -1))
    l4 = np.where(v4, off + 4 * (u(off) & 15), off + 40)
    frag, more, ident = np.where(v4, u(off + 6, 2) & 0x1FFF, 0), v4 & (u(off + 6) & 0x20 > 0), np.where(v4, u(off + 4, 2), -1)
    frag_at = np.where(v4, l4, -1)
    for _ in range(6):  # IPv6 extension headers
        plain = v6 & np.isin(proto, (0, 43, 60)) & has(l4, 8) & (frag == 0)
        fragment = v6 & (proto == 44) & has(l4, 8) & (frag_at < 0)
        frag = np.where(fragment, u(l4 + 2, 2) >> 3, frag)
        more |= fragment & (u(l4 + 3) & 1 == 1)
        ident, frag_at = np.where(fragment, u(l4 + 4, 4), ident), np.where(fragment, l4 + 8, frag_at)
        following = u(l4)
        step = np.where(plain, 8 * (u(l4 + 1) + 1), np.where(fragment, 8, 0))
        proto = np.where(plain | fragment, following, proto)
        l4 = l4 + step
    ip = v4 | v6
    first = ip & (frag == 0)
    tcp, udp, icmp = first & (proto == 6) & has(l4, 20), first & (proto == 17) & has(l4, 8), first & np.isin(proto, (1, 58)) & has(l4, 4)
    start = np.where(tcp, l4 + 4 * (u(l4 + 12) >> 4), np.where(udp | icmp, l4 + 8, l4))
    end = np.minimum(sizes, np.where(v4, off + u(off + 2, 2), np.where(v6, off + 40 + u(off + 4, 2), sizes)))
    end = np.where(end <= off, sizes, end)

    def address(four: int, six: int) -> pa.Array:
        """IPv4 and IPv6 addresses as text, null in other packets."""
        parts, place = [], np.full(n, -1, np.int64)
        for which, at, width, text in ((v4, four, 4, lambda b: ".".join(map(str, b))), (v6, six, 16, lambda b: b.hex(":", 2))):
            rows = np.flatnonzero(which)
            if len(rows):
                place[rows] = sum(map(len, parts)) + np.arange(len(rows))
                parts.append(_addresses(data[(base[rows] + off[rows] + at)[:, None] + np.arange(width)], text))
        found = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return found.take(pa.array(place, pa.int64(), mask=place < 0))

    def payload() -> pa.Array:
        """What follows the last header, copied for many packets at once."""
        lengths = np.where(ip, np.maximum(0, end - start), 0)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        body = np.empty(upto[-1], np.uint8)
        for k in range(0, n, 256):  # places take eight times the room of the bytes they name
            few, at = slice(k, min(n, k + 256)), upto[k]
            to = upto[few.stop]
            body[at:to] = data[np.repeat((base + start - upto[:-1])[few], lengths[few]) + np.arange(at, to)]
        valid = pa.py_buffer(np.packbits(ip, bitorder="little").tobytes())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [valid, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.binary())

    ports = tcp | udp
    made = {
        "eth_type": lambda: (kind, linked), "vlan_id": lambda: (vlan, vlan >= 0), "mpls": lambda: (mpls, np.ones(n, bool)), "l3_off": lambda: (off, linked), "l4_off": lambda: (l4, ip), "ip_version": lambda: (version, ip),
        "ip_tos": lambda: (np.where(v4, u(off + 1), u(off, 2) >> 4 & 255), ip), "ip_len": lambda: (np.where(v4, u(off + 2, 2), 40 + u(off + 4, 2)), ip), "ip_id": lambda: (u(off + 4, 2), v4), "ip_frag": lambda: (frag, ip),
        "ip_ttl": lambda: (np.where(v4, u(off + 8), u(off + 7)), ip), "ip_proto": lambda: (proto, ip), "ip_csum": lambda: (u(off + 10, 2), v4),
        "src_ip": lambda: lambda: address(12, 8), "dst_ip": lambda: lambda: address(16, 24),
        "sport": lambda: (u(l4, 2), ports), "dport": lambda: (u(l4 + 2, 2), ports), "tcp_seq": lambda: (u(l4 + 4, 4), tcp), "tcp_ack": lambda: (u(l4 + 8, 4), tcp), "tcp_flags": lambda: (u(l4 + 13), tcp), "tcp_win": lambda: (u(l4 + 14, 2), tcp),
        "tcp_csum": lambda: (u(l4 + 16, 2), tcp), "tcp_urg": lambda: (u(l4 + 18, 2), tcp), "udp_len": lambda: (u(l4 + 4, 2), udp), "udp_csum": lambda: (u(l4 + 6, 2), udp), "icmp_type": lambda: (u(l4), icmp), "icmp_code": lambda: (u(l4 + 1), icmp),
        "ip_more": lambda: (more, ip), "frag_id": lambda: (ident, ident >= 0), "frag_at": lambda: (frag_at, frag_at >= 0), "l4_payload": lambda: payload,
    }
    return {name: make() for name, make in made.items() if wanted is None or name in wanted}


# -- writing fields back ----------------------------------------------------


def checksum(data: bytes) -> int:
    """The Internet checksum (RFC 1071)."""
    if len(data) % 2:
        data += b"\0"
    total = int(np.frombuffer(data, ">u2").sum(dtype=np.int64))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def _address(text: str) -> bytes:
    return bytes(map(int, text.split("."))) if "." in text else bytes.fromhex(text.replace(":", ""))


#: Columns by header: offset in it and width.
_V4 = {"ip_tos": (1, 1), "ip_len": (2, 2), "ip_id": (4, 2), "ip_ttl": (8, 1), "ip_csum": (10, 2)}
_L4 = {
    6: {"sport": (0, 2), "dport": (2, 2), "tcp_seq": (4, 4), "tcp_ack": (8, 4), "tcp_flags": (13, 1), "tcp_win": (14, 2), "tcp_csum": (16, 2), "tcp_urg": (18, 2)},
    17: {"sport": (0, 2), "dport": (2, 2), "udp_len": (4, 2), "udp_csum": (6, 2)},
    1: {"icmp_type": (0, 1), "icmp_code": (1, 1)},
}
#: Width of each column that is a number in a header.
FIELD_BYTES = {name: width for header in (_V4, *_L4.values()) for name, (_, width) in header.items()}


def rebuild(r: dict, adjust: bool = False) -> bytes:
    """The bytes of a decoded packet with its columns written back. A payload of another length moves the end of the
    packet; lengths in headers stay as their columns say. ``adjust`` computes the checksums of IPv4, TCP, UDP and both
    ICMPs anew."""
    data, l3, l4 = bytearray(r["pkt"] or b""), r["l3_off"], r["l4_off"]
    if r["ip_version"] is None:
        return bytes(data)

    def put(at: int, width: int, value: int | None) -> None:
        if value is not None:
            data[at : at + width] = (value & (1 << 8 * width) - 1).to_bytes(width, "big")

    v4 = r["ip_version"] == 4
    if v4:
        for name, (at, width) in _V4.items():
            put(l3 + at, width, r[name])
    for name, at in (("src_ip", 12 if v4 else 8), ("dst_ip", 16 if v4 else 24)):
        value = _address(r[name])
        if len(value) != (4 if v4 else 16):
            raise ValueError(f"{name} {r[name]} doesn't fit IPv{r['ip_version']}")  # else the old address would stay
        data[l3 + at : l3 + at + len(value)] = value
    fields = _L4.get(r["ip_proto"], {}) if r["sport"] is not None or r["icmp_type"] is not None else {}
    for name, (at, width) in fields.items():
        put(l4 + at, width, r[name])
    if r["l4_payload"] is not None:
        start = l4 + (4 * (data[l4 + 12] >> 4) if r["ip_proto"] == 6 and fields else 8 if fields else 0)
        data[start:] = r["l4_payload"]
    if adjust:
        if v4:
            ihl = 4 * (data[l3] & 15)
            put(l3 + 10, 2, 0)
            put(l3 + 10, 2, checksum(bytes(data[l3 : l3 + ihl])))
        at = {6: 16, 17: 6, 1: 2, 58: 2}.get(r["ip_proto"]) if fields or r["ip_proto"] == 58 else None
        if at is not None:
            put(l4 + at, 2, 0)
            body = bytes(data[l4:])
            if v4:
                pseudo = b"" if r["ip_proto"] == 1 else bytes(data[l3 + 12 : l3 + 20]) + struct.pack(">BBH", 0, r["ip_proto"], len(body))
            else:
                pseudo = bytes(data[l3 + 8 : l3 + 40]) + struct.pack(">II", len(body), r["ip_proto"])
            put(l4 + at, 2, checksum(pseudo + body))
    return bytes(data)


def rebuild_batch(batch: pa.RecordBatch) -> list[bytes]:
    """``rebuild`` of all packets of a batch, without checksums: fixed-width fields are written for all rows at once."""
    at = batch.schema.get_field_index
    column = lambda name: batch.column(at(name))
    n = batch.num_rows
    packets = [p or b"" for p in column("pkt").to_pylist()]
    sizes = np.fromiter(map(len, packets), np.int64, n)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(packets) + bytes(64), np.uint8).copy()

    def numbers(name: str) -> tuple[np.ndarray, np.ndarray]:
        return column(name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column(name).is_valid().to_numpy(zero_copy_only=False)

    (version, ip), (l3, _), (l4, _), (proto, _) = (numbers(c) for c in ("ip_version", "l3_off", "l4_off", "ip_proto"))
    v4 = ip & (version == 4)

    def put(where: np.ndarray, off: np.ndarray, width: int, values: np.ndarray) -> None:
        for k in range(width):
            data[(base + off)[where] + k] = (values[where] >> 8 * (width - 1 - k) & 255).astype(np.uint8)

    for name, (place, width) in _V4.items():
        values, valid = numbers(name)
        put(v4 & valid, l3 + place, width, values)
    for name, four, six in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        coded = column(name).dictionary_encode()
        known = [_address(x) for x in coded.dictionary.to_pylist()]
        index, there = coded.indices.fill_null(0).to_numpy(zero_copy_only=False), ip & coded.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.array([len(x) for x in known] or [0])[index]
        wrong = there & (lengths != np.where(v4, 4, 16))
        if wrong.any():  # else the old address would stay
            row = int(np.flatnonzero(wrong)[0])
            raise ValueError(f"{name} {column(name)[row]} doesn't fit IPv{version[row]}")
        for length, off, mine in ((4, l3 + four, there & v4), (16, l3 + six, there & ~v4)):
            table = np.array([list(x) if len(x) == length else [0] * length for x in known] or [[0] * length], np.uint8)
            data[((base + off)[mine, None] + np.arange(length)).reshape(-1)] = table[index[mine]].reshape(-1)
    ported, typed = numbers("sport")[1], numbers("icmp_type")[1]
    headed = ip & (ported | typed) & np.isin(proto, list(_L4))
    for number, header in _L4.items():
        for name, (place, width) in header.items():
            values, valid = numbers(name)
            put(headed & (proto == number) & valid, l4 + place, width, values)
    words = data[np.where(headed & (proto == 6), base + l4 + 12, 0)] >> 4
    start = np.where(ip, l4 + np.where(headed, np.where(proto == 6, 4 * words.astype(np.int64), 8), 0), sizes)
    whole, out = data.tobytes(), []
    for first, size, cut, payload in zip(base.tolist(), sizes.tolist(), start.tolist(), column("l4_payload").to_pylist(), strict=True):
        out.append(whole[first : first + size] if payload is None else whole[first : first + min(cut, size)] + payload)
    return out


def encode(df: DataFrame, adjust: bool = False) -> DataFrame:
    """Decoded packets with the bytes (and captured length) that their columns give."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rebuild(r, True) for r in batch.to_pylist()] if adjust else rebuild_batch(batch)
            columns = dict(zip(names, batch.columns, strict=True))
            columns["pkt"] = pa.array(made, pa.binary())
            columns["caplen"] = pa.array(map(len, made), pa.int32())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return df.mapInArrow(run, df.schema)
