"""Options of IPv4 and TCP headers, read in the JVM from the bytes of decoded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, NONE, WINDOW_SCALE = 0, 1, 3
SYN = 2
#: Bit of all kinds that have no bit of their own, and the largest shift of a window (RFC 7323).
LAST_BIT, LARGEST_SCALE = 62, 14


def _scan(area: Column, numbers: bool = False, scaled: bool = False) -> Column:
    """(bits, scale) of an area of options: a bit for each kind that occurs, and the shift of a window scale option.

    The list ends at the end option, at a length of 0 and at the area's end; an option that is cut counts.
    """
    size = F.coalesce(F.octet_length(area), F.lit(0))
    digits = F.hex(area)
    octets = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    def step(state: Column, octet: Column) -> Column:
        here = ~state["ended"] & (state["pos"] == state["next"])
        kind = octet.bitwiseAND(31) if numbers else octet
        length = F.coalesce(F.get(state["all"], state["pos"] + 1), F.lit(0))
        single = octet <= NONE
        shift = F.get(state["all"], state["pos"] + 2)
        wide = here & (octet == WINDOW_SCALE) & (length == 3) & shift.isNotNull() if scaled else F.lit(False)
        return F.struct(
            state["all"].alias("all"), (state["pos"] + 1).alias("pos"), F.when(here, state["pos"] + F.when(single, F.lit(1)).otherwise(length)).otherwise(state["next"]).alias("next"),
            (state["ended"] | (here & ((octet == END) | (~single & (length == 0))))).alias("ended"),
            F.when(here, state["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(kind, F.lit(LAST_BIT))))).otherwise(state["bits"]).alias("bits"),
            F.when(wide, F.least(shift, F.lit(LARGEST_SCALE))).otherwise(state["scale"]).alias("scale"),
        )

    start = F.struct(octets.alias("all"), F.lit(0).alias("pos"), F.lit(0).alias("next"), F.lit(False).alias("ended"), F.lit(0).cast("long").alias("bits"), F.lit(None).cast("int").alias("scale"))
    found = F.aggregate(octets, start, step, lambda s: F.struct(s["bits"].alias("bits"), s["scale"].alias("scale")))
    return F.when(size > 0, found).otherwise(F.struct(F.lit(0).cast("long").alias("bits"), F.lit(None).cast("int").alias("scale")))


def _octet(at: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col("pkt"), at + 1, F.lit(1))), 16, 10).cast("int")


def with_options(df: DataFrame) -> DataFrame:
    """Decoded packets with ip_options (bit n: option number n of IPv4 occurs, without its copy flag and class), tcp_options (bit
    n: kind n occurs; kinds from 62 on share that bit) and tcp_scale (the shift a SYN announces). Null where the packet
    has no such header, 0 without options. Most headers have none and cost two comparisons.
    """
    ip_size = _octet(F.col("l3_off")).bitwiseAND(15) * 4 - 20
    tcp_size = F.call_function("shiftright", _octet(F.col("l4_off") + 12), F.lit(4)) * 4 - 20
    area = lambda at, size: F.when(size > 0, F.substring(F.col("pkt"), at + 21, size))
    v4, tcp = F.col("ip_version") == 4, F.col("tcp_seq").isNotNull()
    rows = df.withColumns({
        "ip_found_": F.when(v4, _scan(area(F.col("l3_off"), ip_size), numbers=True)), "tcp_found_": F.when(tcp, _scan(area(F.col("l4_off"), tcp_size), scaled=True)),
    })
    scale = F.when(F.col("tcp_flags").bitwiseAND(SYN) != 0, F.col("tcp_found_.scale"))
    return rows.withColumns({"ip_options": F.col("ip_found_.bits"), "tcp_options": F.col("tcp_found_.bits"), "tcp_scale": scale}).drop("ip_found_", "tcp_found_")
