"""Application protocols: which packets belong to sessions that showed a protocol's signature.

A session (both directions of a 5-tuple) is a protocol's from the first packet with the
signature on, until more than 60 s of silence or a TCP FIN. ``color`` gives each packet
the first protocol in order that claims it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.flows import sessions

# Signatures (fixed values): strings, and how many bytes of the payload are searched.
GNUTELLA = ["GET /uri-res/N2R?urn:sha1:", "GNUTELLA CONNECT/", "GNUTELLA/", "Server: LimeWire/"]
TORRENT = [
    ("GET /scrape?info_hash=", 100), ("GET /announce?info_hash=", 100), ("d1:rd2:id20:", 20), ("d1:ad2:id20:", 20), ("User-Agent: Azureus", 100), ("/scrape?info_hash=", 100),
    ("BT_PIECE", 50), ("BT_REQUEST", 50), ("BT_CHOKE", 50), ("BT_UNCHOKE", 50), ("BT_HAVE", 50), ("BT_UNINTERESTED", 50), ("BT_INTERESTER", 50), ("BT_BITFIELD", 50), ("BT_CANCEL", 50),
]
DIRECT_CONNECT = [
    "$MyNick", "$Lock EXTENDEDPROTOCOL", "$Sending", "$Direction Download ", "$Direction Upload ", "$Supports", "$GetNickList|", "$ValidateNick", "$ConnectToMe",
    "$HubName", "$Hello", "$MyINFO $ALL", "$GetINFO", "$Search Hub:", "$OpList",
]
IRC = ["PRIVMSG ", "NOTICE ", " :DOWN// ", " :EFTP// ", "ACTION"]
EDONKEY_MAGIC = b"\x03\x02\x00\x70\x72\x01\x00\x00\x00"
EDONKEY_HEADERS = [0xE3, 0xC5, 0xD4]
# Operation codes (fixed values) between client and server, between clients, and of the extended protocol, over TCP.
EDONKEY_SERVER = [0x01, 0x05, 0x14, 0x15, 0x16, 0x18, 0x19, 0x1A, 0x1C, 0x21, 0x32, 0x33, 0x34, 0x35, 0x36, 0x38, 0x40, 0x41, 0x42, 0x43]
EDONKEY_CLIENT = [
    0x10, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x4B, 0x4C, 0x4D, 0x4E, 0x4F, 0x50, 0x51, 0x52, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5D, 0x5E, 0x5F, 0x60, 0x61,
]
EDONKEY_EXTENDED = [0x01, 0x02, 0x40, 0x60, 0x81, 0x82]
# The same over UDP: servers, extended protocol, overnet.
EDONKEY_UDP_SERVER = [0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0xA1, 0xA2, 0xA3, 0xA4]
EDONKEY_UDP_EXTENDED = [0x90, 0x91, 0x92, 0x93]
EDONKEY_OVERNET = [0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x16, 0x18, 0x19, 0x1A, 0x1B, 0x1C, 0x1D]
EDONKEY_TCP = [*EDONKEY_SERVER, *EDONKEY_CLIENT, *EDONKEY_EXTENDED]
EDONKEY_UDP = [*EDONKEY_UDP_SERVER, *EDONKEY_UDP_EXTENDED, *EDONKEY_OVERNET]

IDLE = "60s"
SESSION_KEY = ["ip_proto", "low_ip", "high_ip", "low_port", "high_port"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _head(n: int) -> Column:
    return F.substring("l4_payload", 1, n)


def _has(text: str | bytes, n: int) -> Column:
    return F.contains(_head(n), F.lit(text.encode() if isinstance(text, str) else text))


def _byte(k: int) -> Column:
    return F.conv(F.hex(F.substring("l4_payload", k + 1, 1)), 16, 10).cast("int")


def _is_edonkey() -> Column:
    size = sum((_byte(k + 1).cast("long") * 256**k for k in range(1, 4)), _byte(1).cast("long"))
    code = _byte(5)
    fits = size == F.octet_length("l4_payload") - 5
    tcp, udp = (F.col("ip_proto") == 6) & fits & code.isin(EDONKEY_TCP), (F.col("ip_proto") == 17) & code.isin(EDONKEY_UDP)
    return _has(EDONKEY_MAGIC, 100) | (_byte(0).isin(EDONKEY_HEADERS) & (tcp | udp))


#: Signature of each protocol that is tracked by session, on a decoded packet.
SIGNATURES = {
    "TRACK_GNUTELLA": lambda: _any([F.contains(F.lower(F.decode(_head(100), "ISO-8859-1")), F.lit(s.lower())) for s in GNUTELLA]),
    "TRACK_TORRENT": lambda: (_head(20) == F.lit(b"\x13BitTorrent protocol")) | _any([_has(s, n) for s, n in TORRENT]),
    "TRACK_DC": lambda: (_head(1) == F.lit(b"$")) & _any([_has(s, 100) for s in DIRECT_CONNECT]),
    "TRACK_EDONKEY": _is_edonkey,
    "TRACK_IRC": lambda: _any([_has(s, 100) for s in IRC]),
}
#: Tests on a packet alone.
STATELESS = {
    "TRACK_WEB": lambda: (F.col("ip_proto") == 6) & (F.octet_length("l4_payload") > 0) & (F.col("sport").isin(80, 443) | F.col("dport").isin(80, 443)),
    "TRACK_MONITOR": lambda: (F.col("ip_proto") == 6) & ((F.col("sport") == 2233) | (F.col("dport") == 2233)),
    "TRACK_IPOVERIP": lambda: F.col("ip_proto") == 4,
}


def with_session_key(df: DataFrame) -> DataFrame:
    """Decoded packets with the ends of their session in order."""
    a, b = (F.struct(F.col(ip).alias("ip"), F.col(port).alias("port")) for ip, port in (("src_ip", "sport"), ("dst_ip", "dport")))
    rows = df.withColumn("low_", F.least(a, b)).withColumn("high_", F.greatest(a, b))
    return rows.select(*df.columns, F.col("low_.ip").alias("low_ip"), F.col("high_.ip").alias("high_ip"), F.col("low_.port").alias("low_port"), F.col("high_.port").alias("high_port"))


def claimed(df: DataFrame, key: list[str], signature: Column, idle: str = IDLE, closes: Column | None = None) -> DataFrame:
    """``df`` with column claimed: whether the record's session had shown the signature by then, itself included."""
    return sessions(df, key, idle, closes, seen={"claimed": signature}).drop("session")


def track(df: DataFrame, protocol: str) -> DataFrame:
    """The decoded packets of a protocol."""
    if protocol in STATELESS:
        return df.where(STATELESS[protocol]())
    if protocol in ("TRACK_FTP", "TRACK_GRID_FTP"):
        return _ftp(df, 21, None) if protocol == "TRACK_FTP" else _ftp(df, 2811, (20000, 25000))
    if protocol not in SIGNATURES:
        raise KeyError(protocol)
    rows = with_session_key(df.where("sport is not null and octet_length(l4_payload) > 0"))
    fin = (F.col("ip_proto") == 6) & (F.col("tcp_flags").bitwiseAND(F.lit(1)) == 1)
    return claimed(rows, SESSION_KEY, SIGNATURES[protocol](), closes=F.coalesce(fin, F.lit(False))).where("claimed").select(*df.columns)


def _ftp(df: DataFrame, port: int, data_ports: tuple[int, int] | None) -> DataFrame:
    """Control packets, and TCP packets between the same two hosts from the first control packet on: one row a pair
    of hosts meets the packets in a join."""
    rows = with_session_key(df.where("ip_proto = 6")).withColumn("control_", (F.col("sport") == port) | (F.col("dport") == port))
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    rows = rows.withColumn("a_", low).withColumn("b_", high)
    started = rows.where("control_").groupBy("a_", "b_").agg(F.min("us").alias("since_"))
    joined = rows.join(started, ["a_", "b_"], "left")
    data = F.col("us") >= F.col("since_")
    if data_ports:
        data = data & (F.col("sport").between(*data_ports) | F.col("dport").between(*data_ports))
    return joined.where(F.col("control_") | data).select(*df.columns)


def skype(df: DataFrame, contact_hosts: list[str], measure: str = "10s", stays: str = "600s") -> DataFrame:
    """UDP packets of hosts that contacted one of ``contact_hosts``: the port a host used most from then on for
    ``measure`` is taken for the program's, and its packets pass while no more than ``stays`` of silence lies between."""
    from flowspark.functions.intervals import micros

    contacts = df.where(F.col("dst_ip").isin(contact_hosts)).groupBy(F.col("src_ip").alias("host_")).agg(F.min("us").alias("since_"))
    udp = df.where("ip_proto = 17")
    used = udp.join(contacts, udp.src_ip == contacts.host_).where((F.col("us") >= F.col("since_")) & (F.col("us") <= F.col("since_") + micros(measure)))
    used = used.groupBy("host_", "since_", F.col("sport").alias("port_")).count()
    best = used.groupBy("host_").agg(F.max(F.struct(F.col("count"), -F.col("port_"))).alias("best_"), F.min("since_").alias("since_"))
    ends = best.select("host_", (-F.col("best_.col2")).alias("port_"), (F.col("since_") + micros(measure)).alias("from_"))
    mine = (((F.col("src_ip") == F.col("host_")) & (F.col("sport") == F.col("port_"))) | ((F.col("dst_ip") == F.col("host_")) & (F.col("dport") == F.col("port_")))) & (F.col("us") > F.col("from_"))
    found = udp.withColumn("host_", F.explode(F.array("src_ip", "dst_ip"))).join(ends, "host_").where(mine)
    alive = sessions(found, ["host_", "port_"], stays).where("session = 1")
    return alive.select(*df.columns).dropDuplicates(["pkt_no"])


def color(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``df`` with column color: the first name in order whose test holds, else null."""
    chain = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        chain = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(chain)
    return df.withColumn("color", chain)
