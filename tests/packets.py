"""Frames for tests, built by hand."""

from __future__ import annotations

import socket
import struct


def ipv4(src, dst, proto, payload, ttl=64, tos=0, ident=1, frag=0, options=b""):
    ihl = 5 + len(options) // 4
    return struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, tos, 4 * ihl + len(payload), ident, frag, ttl, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + options + payload


def ipv6(src, dst, nxt, payload):
    return struct.pack(">IHBB", 6 << 28, len(payload), nxt, 64) + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + payload


def tcp(sport, dport, payload=b"", flags=16, seq=1, ack=0):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 1000, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def icmp(kind, code=0, payload=b""):
    return struct.pack(">BBHI", kind, code, 0, 0) + payload


def ethernet(payload, kind=0x0800, vlan=None, dst=b"\x02\0\0\0\0\1", src=b"\x02\0\0\0\0\2"):
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return dst + src + tag + struct.pack(">H", kind) + payload


def mpls(payload, label=7):
    return struct.pack(">I", label << 12 | 0x100 | 64) + payload


PACKETS = "pkt_no long, us long, ts_ntp long, ifindex int, caplen int, wlen int, link_type int, pkt binary"


def stream(spark, frames):
    """(microseconds, frame) pairs as packets."""
    rows = [(k, us, (us // 10**6 << 32) + (us % 10**6 << 32) // 10**6, 0, len(f), max(60, len(f)), 1, bytearray(f)) for k, (us, f) in enumerate(frames)]
    return spark.createDataFrame(rows, PACKETS)
