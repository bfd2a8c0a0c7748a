"""Records of PCAP and ERF captures, and where their files are opened."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow import fs

PACKETS = "pkt_no bigint, us bigint, ts_ntp bigint, ifindex int, caplen int, wlen int, link_type int, pkt binary"
ETHERNET, CISCO_HDLC = 1, 104
# Magic numbers of the file header and the length of its snapshots; lengths of headers (fixed values of the formats).
MAGIC, MAGIC_NANO, SNAPLEN = 0xA1B2C3D4, 0xA1B23C4D, 65535
PCAP_HEAD, ERF_HEAD = 24, 16
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [part.split()[0] for part in PACKETS.split(", ")]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pcap_row(head: tuple, data: bytes, unit: int, link: int) -> tuple:
    """(us, ntp, ifindex, caplen, wlen, link type, bytes) of a record with ``unit`` parts a second."""
    sec, part, caplen, wlen = head
    return sec * 10**6 + part * 10**6 // unit, (sec << 32) + (part << 32) // unit, 0, caplen, wlen, link, data


def is_packet(kind: int) -> bool:
    """Whether an ERF record of this type is a packet: 2 is Ethernet, 1 HDLC."""
    return kind & 0x7F in (1, 2)


def erf_row(head: bytes, data: bytes) -> tuple:
    """The same of an ERF record; Ethernet has two bytes of padding first."""
    ts, kind, flags, wlen = struct.unpack("<QBB", head[:10]) + struct.unpack(">H", head[14:16])
    data = data[2:] if kind & 0x7F == 2 else data
    data = data[:wlen]
    us = (ts >> 32) * 10**6 + ((ts & 0xFFFFFFFF) * 10**6 + 2**31 >> 32)
    return us, ts, flags & 3, len(data), wlen, ETHERNET if kind & 0x7F == 2 else CISCO_HDLC, data


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
