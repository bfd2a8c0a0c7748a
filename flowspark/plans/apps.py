"""The applications: queries composed of operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.bpf import compile_filter
from flowspark.functions.intervals import micros
from flowspark.operators import aggregates, trackers


def netload(df: DataFrame) -> DataFrame:
    """Packets and bits of each second and sensor."""
    return df.groupBy("sensor", F.floor(F.col("us") / 1_000_000).alias("second")).agg(F.count(F.lit(1)).alias("packets"), (F.sum("wlen") * 8).cast("long").alias("bits"))


def bandwidth(df: DataFrame, protocols: dict[str, Column], interval: str = "1s") -> DataFrame:
    """Packets and bytes of each interval and sensor, in all and by protocol, in one pass."""
    sums = [F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes")]
    for name, test in protocols.items():
        sums += [F.count(F.when(test, 1)).alias(f"{name}_packets"), F.coalesce(F.sum(F.when(test, F.col("wlen"))), F.lit(0)).cast("long").alias(f"{name}_bytes")]
    return df.groupBy("sensor", F.floor(F.col("us") / micros(interval)).alias("slot")).agg(*sums)


def load_statistics(df: DataFrame, widths: list[str]) -> DataFrame:
    """Statistics of the bytes in each interval, for several widths of interval. The narrowest is summed first."""
    narrow = min(widths, key=micros)
    base = df.groupBy(F.floor(F.col("us") / micros(narrow)).alias("slot")).agg(F.sum("wlen").cast("long").alias("v"))
    parts = []
    for width in widths:
        if micros(width) % micros(narrow):
            raise ValueError("widths are multiples of the narrowest")
        sums = base.groupBy(F.floor(F.col("slot") / (micros(width) // micros(narrow))).alias("slot")).agg(F.sum("v").cast("long").alias("v"))
        parts.append(aggregates.stats(sums, F.col("v"), of_sums=True).select(F.lit(width).alias("width"), "count", "sum", "sum2", "min", "max"))
    return reduce(DataFrame.union, parts)


def application_monitor(df: DataFrame, tests: dict[str, Column], direction: Column, host: Column, many: int = 10) -> DataFrame:
    """The ``many`` hosts with most bytes of each application (the first whose test holds, else other) and direction."""
    rows = trackers.color(df, tests).select(F.coalesce("color", F.lit("other")).alias("app"), direction.alias("direction"), host.alias("host"), "wlen")
    counted = rows.groupBy("app", "direction", "host").agg(F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("app", "direction").orderBy(F.desc("bytes"), "host"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= many)


#: Protocols told apart by one filter each (fixed values).
PROTOCOLS = {
    "ip": "ip", "ip6": "ip6", "arp": "arp", "rarp": "rarp", "atalk": "atalk", "aarp": "aarp", "decnet": "decnet", "iso": "iso", "stp": "stp", "ipx": "ipx", "sca": "sca", "lat": "lat", "mopdl": "mopdl", "moprc": "moprc", "netbeui": "netbeui",
    "tcp": "tcp", "udp": "udp", "icmp": "icmp", "igmp": "igmp", "igrp": "igrp", "ah": "ah", "esp": "esp", "pim": "pim", "vrrp": "vrrp", "eigrp": "proto eigrp",
    "dns": "port 53", "ftp": "port 21", "gprs": "port 3386", "http": "port 80", "kerberos": "port 88", "ipp": "port 631", "hsrp": "port 1985", "msn": "port 1863", "netbios": "port 137 or port 138 or port 139",
    "radio": "port 554 and not port 80", "shells": "port 22 or port 23 or port 107 or port 614 or port 992", "ssdp": "port 1900", "sunrpc": "port 111", "torrent": "tcp and (portrange 6881-6899 or port 6969)",
    "ucp": "port 2491", "who": "udp port 513", "winmx": "port 6699", "xdmcp": "port 177",
}


def protocol_traffic(df: DataFrame, filters: dict[str, str] | None = None, interval: str = "1s") -> DataFrame:
    """(slot, protocol, packets, bytes) of decoded packets: what passes each of the ``filters`` (name and expression; PROTOCOLS) in each
    interval, in one pass and one aggregate. A packet counts for every filter it passes; filters without packets have no row."""
    names = [F.when(compile_filter(text), F.lit(name)) for name, text in (PROTOCOLS if filters is None else filters).items()]
    if not names:
        raise ValueError("no filter")
    rows = df.select(F.floor(F.col("us") / micros(interval)).alias("slot"), F.explode(F.array_compact(F.array(*names))).alias("protocol"), "wlen")
    return rows.groupBy("slot", "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes"))


def dynamic_filter(df: DataFrame, key: list[str], discovers: Column) -> DataFrame:
    """Records of keys that a record discovered, from that record's time on."""
    found = df.where(discovers).groupBy(*key).agg(F.min("us").alias("since_"))
    return df.join(found, key).where(F.col("us") >= F.col("since_")).drop("since_")


def packet_loss(sent: DataFrame, received: DataFrame, key: list[str]) -> DataFrame:
    """Packets of each flow at two points of observation, and how many were lost between."""
    a = sent.groupBy(*key).agg(F.count(F.lit(1)).alias("sent"))
    b = received.groupBy(*key).agg(F.count(F.lit(1)).alias("received"))
    return a.join(b, key, "left").select(*key, "sent", F.coalesce("received", F.lit(0)).alias("received"), (F.col("sent") - F.coalesce("received", F.lit(0))).alias("lost"))


#: Base of the rolling polynomial and the inverse of it; both odd, so that each byte keeps its weight modulo 2**32.
BASE, MODULUS = 257, 1 << 32
INVERSE = pow(BASE, -1, MODULUS)
BYTES_AT_ONCE = 1 << 23


def rolling_fingerprints(payloads: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, payload, end): that of each ``span`` bytes that lie in one payload, the payload's number, and where in all the bytes
    the span ends. The fingerprint is the polynomial of the bytes in 257 modulo 2**32, the last byte with weight 1."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, payloads), np.int64, len(payloads)))
    powers, inverses = (np.full(len(data), x, np.uint32) for x in (BASE, INVERSE))
    powers[:1] = inverses[:1] = 1
    powers, inverses = np.cumprod(powers, dtype=np.uint32), np.cumprod(inverses, dtype=np.uint32)
    upto = np.concatenate((np.zeros(1, np.uint32), np.cumsum(data * inverses, dtype=np.uint32)))
    last = np.arange(span - 1, len(data))  # sums of the span's bytes times 257**-place, moved up to the place of its last byte
    whose = np.searchsorted(ends, last, side="right")
    inside = last - (ends - np.diff(ends, prepend=0))[whose] >= span - 1
    last, whose = last[inside], whose[inside]
    return (upto[last + 1] - upto[last + 1 - span]) * powers[last], whose, last


def common_fingerprints(df: DataFrame, payload: str, destination: str, span: int, least: int, mask: int = 0xFF, skip_zeros: bool = False) -> DataFrame:
    """(fingerprint, destinations): fingerprints of all stretches of ``span`` bytes of ``payload`` (text or bytes; null has none)
    that went to at least ``least`` destinations, of those whose bits in ``mask`` are 0. ``skip_zeros`` leaves out stretches with
    a zero byte. Null destinations don't count.

    The same content has the same fingerprint wherever it stands, so sampling by mask is consistent. A batch is fingerprinted
    at once; distinct pairs of fingerprint and destination come first, so that a fingerprint with very many records is counted in two
    levels.
    """
    kind = df.schema[destination].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, size = [], [], 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size >= BYTES_AT_ONCE:
                    if held:
                        yield found(held, batch.column(1).take(pa.array(rows)))
                    held, rows, size = [], [], 0
                if k < batch.num_rows:
                    data = batch.column(0)[k].as_py()
                    if data is not None and len(data) >= span:
                        held.append(data)
                        rows.append(k)
                        size += len(data)

    def found(held: list[bytes], where: pa.Array) -> pa.RecordBatch:
        prints, whose, last = rolling_fingerprints(held, span)
        kept = prints & np.uint32(mask) == 0
        if skip_zeros:
            zeros = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(held), np.uint8) == 0)))
            kept &= zeros[last + 1] == zeros[last + 1 - span]
        pairs = np.unique(np.stack([prints[kept].astype(np.int64), whose[kept].astype(np.int64)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), where.take(pa.array(pairs[1]))], ["fingerprint", "d"])

    rows = df.where(F.col(destination).isNotNull()).select(F.col(payload).cast("binary").alias("data"), F.col(destination).alias("d"))
    pairs = rows.mapInArrow(run, f"fingerprint bigint, d {kind}").distinct()
    return pairs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("destinations")).where(F.col("destinations") >= least)
