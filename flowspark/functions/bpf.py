"""A packet filter language (that of tcpdump) compiled to a Spark boolean column on decoded packets.

    expression := term { ("or" | "||") term };  term := factor { ("and" | "&&") factor }
    factor := ("not" | "!") factor | "(" expression ")" | primitive | arithmetic comparison

Primitives have a protocol, a direction and a kind: ``tcp dst port 80``, ``ip src net
10.0/8``, ``vlan 5``, ``icmp``, ``proto 89``; kinds and directions left out are those of
the primitive before (``port 80 or 81``). Arithmetic: ``ip[9] == 4``,
``tcp[tcpflags] & (tcp-syn|tcp-ack) != 0``, ``len > 100``.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.plans.errors import Err, FlowError

# Numbers of protocols, types and flags (fixed values).
IP_PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "igrp": 9, "udp": 17, "ipv6-icmp": 58, "esp": 50, "ah": 51, "icmp6": 58, "eigrp": 88, "ospf": 89, "pim": 103, "vrrp": 112, "sctp": 132}
ETHER_TYPES = {"ip": 0x0800, "arp": 0x0806, "rarp": 0x8035, "atalk": 0x809B, "aarp": 0x80F3, "ip6": 0x86DD, "decnet": 0x6003, "sca": 0x6007, "lat": 0x6004, "mopdl": 0x6001, "moprc": 0x6002, "ipx": 0x8137, "loopback": 0x9000}
#: Link service access points of protocols that come with a length instead of a type.
LLC = {"iso": 0xFE, "stp": 0x42, "netbeui": 0xF0}
CONSTANTS = {
    "tcpflags": 13, "tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32, "icmptype": 0, "icmpcode": 1,
    "icmp-echoreply": 0, "icmp-unreach": 3, "icmp-sourcequench": 4, "icmp-redirect": 5, "icmp-echo": 8, "icmp-routeradvert": 9, "icmp-routersolicit": 10, "icmp-timxceed": 11,
    "icmp-paramprob": 12, "icmp-tstamp": 13, "icmp-tstampreply": 14, "icmp-ireq": 15, "icmp-ireqreply": 16, "icmp-maskreq": 17, "icmp-maskreply": 18,
}
SERVICES = {"ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "http": 80, "www": 80, "pop3": 110, "ntp": 123, "snmp": 161, "https": 443}
TOKEN = re.compile(r"\s*(\|\||&&|==|!=|<=|>=|<<|>>|[()\[\]:!<>=&|+*/-]|0x[0-9a-fA-F]+|(?:[0-9a-fA-F]{1,2}:){5}[0-9a-fA-F]{1,2}|[0-9a-fA-F]*:[0-9a-fA-F:]*:[0-9a-fA-F:.]*(?:/\d+)?|\d+(?:\.\d+)+(?:/\d+)?|\d+/\d+|\d+-\d+|[A-Za-z][\w.-]*|\d+)")
DIRECTIONS, KINDS = ("src", "dst"), ("host", "net", "port", "portrange", "proto")
NAMES = {*IP_PROTOCOLS, *ETHER_TYPES, *LLC, "ether"}


def _error(text: str) -> FlowError:
    return FlowError(Err.BPF_SYNTAX, text)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise _error(f"at {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.before = 0, (None, None, None)

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else None

    def take(self, *expected: str) -> str:
        token = self.peek()
        if token is None or (expected and token not in expected):
            raise _error(f"{' or '.join(expected) or 'more'} expected, not {token!r}")
        self.at += 1
        return token

    def whole(self) -> Column:
        out = self.either()
        if self.peek() is not None:
            raise _error(f"unexpected {self.peek()!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek() in ("or", "||"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.factor()
        while self.peek() in ("and", "&&"):
            self.take()
            out = out & self.factor()
        return out

    def factor(self) -> Column:
        token = self.peek()
        if token in ("not", "!"):
            self.take()
            return ~self.factor()
        if token == "(":
            at = self.at
            try:
                self.take()
                out = self.either()
                self.take(")")
                if self.peek() not in ("==", "=", "!=", "<", ">", "<=", ">=", "&", "|", "+", "-", "*", "/", "<<", ">>"):
                    return out
            except FlowError:
                pass
            self.at = at
            return self.comparison()
        if token == "len" or (token in NAMES and self.peek(1) == "[") or (token is not None and re.fullmatch(r"\d+|0x[0-9a-fA-F]+", token) and self.peek(1) in ("==", "=", "!=", "<", ">", "<=", ">=", "&", "+", "*")):
            return self.comparison()
        return self.primitive()

    # -- arithmetic --

    def comparison(self) -> Column:
        left = self.sum()
        sign = self.take("==", "=", "!=", "<", ">", "<=", ">=")
        right = self.sum()
        out = {"==": left == right, "=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]
        return F.coalesce(out, F.lit(False))

    def sum(self) -> Column:
        out = self.product()
        while self.peek() in ("+", "-", "&", "|", "<<", ">>"):
            sign, right = self.take(), self.product()
            if sign in ("<<", ">>"):
                power = F.pow(F.lit(2), right).cast("long")
                out = out * power if sign == "<<" else F.floor(out / power)
            else:
                out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b)}[sign](out, right)
        return out

    def product(self) -> Column:
        out = self.atom()
        while self.peek() in ("*", "/"):
            out = out * self.atom() if self.take() == "*" else F.try_divide(out, self.atom()).cast("long")
        return out

    def atom(self) -> Column:
        token = self.take()
        if token == "(":
            out = self.sum()
            self.take(")")
            return out
        if token == "len":
            return F.col("wlen").cast("long")
        if token in CONSTANTS:
            return F.lit(CONSTANTS[token]).cast("long")
        if re.fullmatch(r"\d+|0x[0-9a-fA-F]+", token):
            return F.lit(int(token, 0)).cast("long")
        if token in NAMES:
            return self.bytes_at(token)
        raise _error(f"unexpected {token!r}")

    def bytes_at(self, name: str) -> Column:
        self.take("[")
        start, width = self.sum(), 1
        if self.peek() == ":":
            self.take()
            width = int(self.take("1", "2", "4"))
        self.take("]")
        if name == "ether":
            base, held = F.lit(0), F.lit(True)
        elif name in ("ip", "ip6", "arp", "rarp"):
            base, held = F.col("l3_off"), _protocol(name)
        else:
            base, held = F.col("l4_off"), _protocol(name) & (F.coalesce("ip_frag", F.lit(0)) == 0)
        at = (base + start).cast("int")
        value = F.conv(F.hex(F.substring("pkt", at + 1, F.lit(width))), 16, 10).cast("long")
        return F.when(held & (at + width <= F.octet_length("pkt")), value)

    # -- primitives --

    def primitive(self) -> Column:
        proto = direction = kind = None
        token = self.peek()
        if token in ("vlan", "mpls"):
            self.take()
            column = F.col("vlan_id").isNotNull() if token == "vlan" else F.coalesce("mpls", F.lit(False))
            if self.peek() and self.peek().isdigit():
                if token == "mpls":
                    raise _error("labels of mpls are not kept")
                column = F.coalesce(F.col("vlan_id") == int(self.take()), F.lit(False))
            return column
        if token in NAMES:
            proto = self.take()
        if self.peek() in DIRECTIONS:
            direction = self.take()
            if self.peek() in ("or", "and") and self.peek(1) in DIRECTIONS:
                direction += f" {self.take()} {self.take()}"
        if self.peek() in KINDS:
            kind = self.take()
        if self.peek() in ("broadcast", "multicast") and direction is None and kind is None:
            return self.cast(proto, self.take())
        if proto and direction is None and kind is None and (self.peek() is None or self.peek() in ("and", "or", "&&", "||", ")")):
            self.before = (None, None, None)
            return _protocol(proto)
        if proto is None and direction is None and kind is None:
            proto, direction, kind = self.before
            if kind is None and not re.match(r"\d+\.|.*:", self.peek() or ""):
                raise _error(f"unexpected {self.peek()!r}")
        self.before = (proto, direction, kind or "host")
        return self.named(proto, direction, kind or "host")

    def cast(self, proto: str | None, what: str) -> Column:
        first = F.conv(F.hex(F.substring("pkt", 1, 1)), 16, 10).cast("int")
        link = F.coalesce((F.substring("pkt", 1, 6) == F.lit(b"\xff" * 6)) if what == "broadcast" else first.bitwiseAND(F.lit(1)) == 1, F.lit(False))
        if proto in (None, "ether"):
            return link
        top = F.split("dst_ip", r"\.").getItem(0).try_cast("int")
        ip = F.col("dst_ip") == "255.255.255.255" if what == "broadcast" else top.between(224, 239) if proto == "ip" else F.col("dst_ip").startswith("ff")
        return _protocol(proto) & F.coalesce(ip, F.lit(False))

    def named(self, proto: str | None, direction: str | None, kind: str) -> Column:
        value = self.take()
        if value == "(":  # port (80 or 81)
            out = self.named(proto, direction, kind)
            while self.peek() == "or":
                self.take()
                out = out | self.named(proto, direction, kind)
            self.take(")")
            return out
        if kind == "proto":
            return self.protocol_number(proto, value)
        if kind in ("port", "portrange"):
            test = _ports(kind, value)
            sides = {"src": "sport", "dst": "dport"}
        elif proto == "ether":
            raw = bytes.fromhex(value.replace(":", "")) if value.count(":") == 5 else None
            if raw is None:
                raise _error(f"no link address: {value!r}")
            columns = {"src": F.substring("pkt", 7, 6), "dst": F.substring("pkt", 1, 6)}
            return self.sided(direction, {k: F.coalesce(c == F.lit(raw), F.lit(False)) for k, c in columns.items()})
        else:
            test = _network(value, self.mask() if kind == "net" else None, kind)
            sides = {"src": "src_ip", "dst": "dst_ip"}
        out = self.sided(direction, {k: F.coalesce(test(F.col(c)), F.lit(False)) for k, c in sides.items()})
        return out & _protocol(proto) if proto else out

    def mask(self) -> str | None:
        if self.peek() == "mask":
            self.take()
            return self.take()
        return None

    @staticmethod
    def sided(direction: str | None, tests: dict[str, Column]) -> Column:
        if direction in tests:
            return tests[direction]
        return tests["src"] & tests["dst"] if direction and " and " in direction else tests["src"] | tests["dst"]

    @staticmethod
    def protocol_number(proto: str | None, value: str) -> Column:
        if proto == "ether":
            number = ETHER_TYPES.get(value, int(value, 0) if value[0].isdigit() else None)
            column = F.col("eth_type")
        else:
            number = IP_PROTOCOLS.get(value, int(value, 0) if value[0].isdigit() else None)
            column = F.col("ip_proto")
        if number is None:
            raise _error(f"unknown protocol {value!r}")
        out = F.coalesce(column == number, F.lit(False))
        return out & _protocol(proto) if proto in ("ip", "ip6") else out


def _protocol(name: str) -> Column:
    if name == "ether":
        return F.lit(True)
    if name == "ip":
        test = (F.col("eth_type") == 0x0800) | (F.col("ip_version") == 4)
    elif name == "ip6":
        test = (F.col("eth_type") == 0x86DD) | (F.col("ip_version") == 6)
    elif name in ETHER_TYPES:
        test = F.col("eth_type") == ETHER_TYPES[name]
    elif name in LLC:
        test = (F.col("eth_type") <= 1500) & (F.conv(F.hex(F.substring("pkt", F.col("l3_off") + 1, F.lit(1))), 16, 10).cast("int") == LLC[name])
    else:
        test = F.col("ip_proto") == IP_PROTOCOLS[name]
    return F.coalesce(test, F.lit(False))


def _ports(kind: str, value: str):
    def number(text: str) -> int:
        if text in SERVICES:
            return SERVICES[text]
        if not text.isdigit() or int(text) > 65535:
            raise _error(f"no port: {text!r}")
        return int(text)

    if kind == "portrange":
        low, dash, high = value.partition("-")
        if not dash:
            raise _error(f"no range of ports: {value!r}")
        return lambda c, a=number(low), b=number(high): c.between(a, b)
    return lambda c, a=number(value): c == a


def _as_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return reduce(lambda a, b: a + b, [F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * 256 ** (3 - k) for k in range(4)])


def _network(value: str, mask: str | None, kind: str):
    try:
        if ":" in value:
            net = ipaddress.ip_network(value, strict=False)
            if net.prefixlen % 16 == 0:
                start = net.network_address.exploded[: net.prefixlen // 16 * 5]
                return lambda c: c.startswith(start)
            bits, whole = net.prefixlen, net.prefixlen // 4
            first = int(net.network_address) >> (128 - bits)
            digits = f"{int(net.network_address):032x}"[:whole]
            nibble = lambda c: F.regexp_replace(c, ":", "")
            low, high = (first << (4 - bits % 4)) & 15, ((first << (4 - bits % 4)) & 15) + 2 ** (4 - bits % 4) - 1
            return lambda c: nibble(c).startswith(digits) & F.conv(F.substring(nibble(c), whole + 1, 1), 16, 10).cast("int").between(low, high)
        text, _, length = value.partition("/")
        parts = text.split(".")
        full = ".".join([*parts, *["0"] * (4 - len(parts))])
        if mask:
            net = ipaddress.ip_network(f"{full}/{mask}", strict=False)
        else:
            net = ipaddress.ip_network(f"{full}/{length or 8 * len(parts)}", strict=False)
    except ValueError as e:
        raise _error(str(e)) from None
    if kind == "host" and net.prefixlen == 32:
        return lambda c: c == str(net.network_address)
    low, high = int(net.network_address), int(net.broadcast_address)
    return lambda c: ~F.contains(c, F.lit(":")) & _as_number(F.when(~F.contains(c, F.lit(":")), c)).between(low, high)


def compile_filter(text: str | None) -> Column:
    """The filter as a boolean column on decoded packets (``flowspark.sources.pcap.decode``), never null."""
    if not text or not text.strip():
        raise FlowError(Err.INVALID_ARGUMENT_1, "empty filter")
    return _Parser(text).whole()
