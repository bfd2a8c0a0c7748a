"""Functions that hide values: on columns, keyed where the same value must stay the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.plans.errors import Err, FlowError


def zero(c: Column) -> Column:
    """Zero for numbers, zero bytes of the same length for bytes, null stays null."""
    return F.when(c.isNotNull(), F.repeat(F.lit("\0"), F.octet_length(c.cast("binary"))))


def pattern_fill(c: Column, pattern: str) -> Column:
    """The pattern repeated over the length of the value."""
    length = F.char_length(c)
    return F.substring(F.repeat(F.lit(pattern), F.ceil(length / len(pattern)).cast("int")), F.lit(1), length)


def replace(c: Column, text: str, most: int = 1514) -> Column:
    if len(text) > most:
        raise FlowError(Err.INVALID_ARGUMENT, f"longer than {most}")
    return F.when(c.isNotNull(), F.lit(text))


def strip(c: Column, keep: int) -> Column:
    """The first ``keep`` characters or bytes."""
    return F.substring(c, 1, keep)


PAD, SHORTEN = "PAD_WITH_ZERO", "STRIP_REST"


def hashed(c: Column, how: str, fit: str | None = None, key: bytes = b"0123456789abcdef") -> Column:
    """Hex digest of the value: MD5, SHA, SHA_2, CRC32 or AES. ``fit`` makes it as long as the value: cut off, or padded
    with the character 0 (PAD_WITH_ZERO); STRIP_REST leaves the digest's own length."""
    data = c.cast("binary")
    made = {
        "MD5": lambda: F.md5(data), "SHA": lambda: F.sha1(data), "SHA_2": lambda: F.sha2(data, 256), "CRC32": lambda: F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0"),
        "AES": lambda: F.lower(F.hex(F.aes_encrypt(data, F.lit(key), F.lit("ECB")))),
    }.get(how)
    if made is None:
        raise FlowError(Err.NOT_SUPPORTED, how)
    if fit == PAD:
        length = F.char_length(c)
        return F.rpad(F.substring(made(), F.lit(1), length), length, "0")
    if fit not in (None, SHORTEN):
        raise FlowError(Err.INVALID_ARGUMENT, fit)
    return made()


def regexp(c: Column, pattern: str, replacements: list[str | None]) -> Column:
    """If the pattern, case ignored, matches, its groups are replaced one by one; None keeps a group."""
    whole = f"(?is)^(.*?)(?:{pattern})(.*)$"
    found = F.regexp_like(c, F.lit(whole))
    parts = [F.regexp_extract(c, whole, 1)]
    parts += [F.regexp_extract(c, whole, k + 2) if r is None else F.lit(r) for k, r in enumerate(replacements)]
    return F.when(found, F.concat(*parts, F.regexp_extract(c, whole, len(replacements) + 2))).otherwise(c)


def filename_random(c: Column, seed: int = 42, draw: Column | None = None) -> Column:
    """Everything before the last dot replaced by as many random printable characters (codes 33 to 125); with ``draw``, those
    that follow from it. Null stays null."""
    stem, end = F.regexp_extract(c, r"(?s)^(.*)(\.[^.]*)$", 1), F.regexp_extract(c, r"(?s)^(.*)(\.[^.]*)$", 2)
    n = F.char_length(F.when(end != "", stem).otherwise(c))
    drawn = F.rand(seed).cast("string") if draw is None else F.concat(draw.cast("string"), c)
    made = F.transform(F.array_repeat(drawn, n), lambda one, k: F.call_function("char", F.pmod(F.xxhash64(one, k), F.lit(93)) + 33))
    return F.when(c.isNotNull(), F.concat(F.array_join(made, ""), end))


def map_first_seen(df: DataFrame, columns: list[str], order: str = "pkt_no", suffix: str = "_map") -> DataFrame:
    """``df`` with, for each of the columns, the number of its value in order of first appearance from 1; the columns share
    one numbering, and within a row the first column is seen first. The numbering is made over distinct values."""
    seen = df.select(F.explode(F.array(*(F.struct(F.col(c).cast("string").alias("v"), (F.col(order).cast("decimal(30,0)") * len(columns) + k).alias("at")) for k, c in enumerate(columns)))).alias("s")).select("s.*")
    firsts = seen.where("v is not null").groupBy("v").agg(F.min("at").alias("at"))
    # Numbers without one task: rank within ranges of the first position, plus the sizes of the ranges before.
    firsts = firsts.withColumn("part", F.floor(F.col("at") / 65536))
    before = firsts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    numbers = firsts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("at"))).join(before, "part").select("v", (F.col("b") + F.col("r")).alias("n"))
    for c in columns:
        df = df.join(numbers.select(F.col("v").alias("v_"), F.col("n").alias(c + suffix)), F.col(c).cast("string") == F.col("v_"), "left").drop("v_")
    return df


def map_distribution(c: Column, kind: str, a: float, b: float, key: str = "") -> Column:
    """A draw from UNIFORM (a to b, whole numbers) or GAUSSIAN (mean a, deviation b) that is the same for equal values."""
    drawn = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}{salt}:"), c.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    u = lambda salt: (drawn(salt) + 1) / F.lit(float(2**52 + 1))
    if kind == "UNIFORM":
        return (F.lit(a) + F.floor(u("u") * (b - a + 1))).cast("long")
    if kind == "GAUSSIAN":
        return F.lit(a) + F.lit(b) * F.sqrt(-2 * F.ln(u("r"))) * F.cos(2 * F.pi() * u("a"))
    raise FlowError(Err.INVALID_ARGUMENT, kind)


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return reduce(lambda x, y: x + y, [F.element_at(parts, k + 1).cast("long") * 256 ** (3 - k) for k in range(4)])


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def on_bytes(c: Column, width: int | None, change) -> Column:
    """A header field of fixed width with ``change`` applied to its bytes in network order: what is longer is cut off, what
    is shorter gets zero bytes. ``width`` is that of a number; without it the field is an address of IPv4 or IPv6."""
    six = c.contains(":")
    size = F.lit(width) if width else F.when(six, 16).otherwise(4)
    if width:
        data = F.unhex(F.lpad(F.hex(c.cast("long")), 2 * width, "0"))
    else:
        data = F.when(six, F.unhex(F.replace(c, F.lit(":"), F.lit("")))).otherwise(F.unhex(F.lpad(F.hex(ipv4_number(F.when(~six, c))), 8, "0")))
    digits = F.rpad(F.substring(F.lower(F.hex(change(data))), F.lit(1), 2 * size), 2 * size, "0")
    number = F.conv(digits, 16, 10).cast("long")
    new = number if width else F.when(six, F.regexp_replace(digits, "(.{4})(?=.)", "$1:")).otherwise(ipv4_text(number))
    return F.when(c.isNotNull(), new)


def prefix_preserving(c: Column, key: bytes) -> Column:
    """Crypto-PAn (Xu et al., 2002): two addresses (both IPv4 or both IPv6) that share k bits share k bits afterwards. The
    first half of the 32-byte key is the cipher's, the second gives the padding. IPv6 comes out as eight groups of four
    digits. Apply it to distinct addresses and join where they repeat."""
    if len(key) != 32:
        raise FlowError(Err.INVALID_ARGUMENT_1, "the key has 32 bytes")
    six = c.contains(":")
    return F.when(six, _prefix_preserving_6(F.when(six, c), key)).otherwise(_prefix_preserving_4(F.when(~six, c), key))


def ipv6_digits(c: Column) -> Column:
    """The 32 hex digits of an IPv6 address, with or without ``::`` or an IPv4 address at its end."""
    four = F.lpad(F.lower(F.hex(ipv4_number(F.when(c.contains("."), F.substring_index(c, ":", -1))))), 8, "0")
    plain = F.when(c.contains("."), F.concat(F.regexp_replace(c, "[^:]*$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))).otherwise(F.lower(c))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(plain, "::", 1)), F.when(plain.contains("::"), groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    return F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")


def _prefix_preserving_6(c: Column, key: bytes) -> Column:
    """The construction over 128 bits, as text of the digits 0 and 1."""
    half = lambda x, at, a, b: F.lpad(F.conv(F.substring(x, at, 64 if a == 2 else 16), a, b), 64 if b == 2 else 16, "0")
    to_bits = lambda x: F.concat(half(x, 1, 16, 2), half(x, 17, 16, 2))
    to_digits = lambda x: F.concat(half(x, 1, 2, 16), half(x, 65, 2, 16))
    block = lambda x: F.substring(F.aes_encrypt(x, F.lit(key[:16]), F.lit("ECB")), 1, 16)
    bits, pad = to_bits(ipv6_digits(c)), to_bits(F.hex(block(F.lit(key[16:]))))
    first = lambda x: F.substring(to_bits(F.hex(block(F.unhex(to_digits(x))))), 1, 1)

    def changed(at: Column) -> Column:
        flip = first(F.concat(F.substring(bits, F.lit(1), at), F.substring(pad, at + 1, F.lit(128))))
        return F.when(F.substring(bits, at + 1, F.lit(1)) == flip, "0").otherwise("1")

    new = F.lower(to_digits(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(127)), changed), "")))
    return F.when(c.isNotNull(), F.regexp_replace(new, "(.{4})(?=.)", "$1:"))


def _prefix_preserving_4(c: Column, key: bytes) -> Column:
    cipher, number = F.lit(key[:16]), ipv4_number(c)
    # The first block of ECB with padding is the plain block cipher.
    block = lambda x: F.substring(F.aes_encrypt(x, cipher, F.lit("ECB")), 1, 16)
    pad = block(F.lit(key[16:]))
    pad_top = F.conv(F.hex(F.substring(pad, 1, 4)), 16, 10).cast("long")
    flips = []
    for i in range(32):
        kept = (0xFFFFFFFF << (32 - i)) & 0xFFFFFFFF
        head = number.bitwiseAND(F.lit(kept)).bitwiseOR(pad_top.bitwiseAND(F.lit(0xFFFFFFFF ^ kept)))
        data = F.concat(F.unhex(F.lpad(F.hex(head), 8, "0")), F.substring(pad, 5, 12))
        bit = F.shiftright(F.conv(F.hex(F.substring(block(data), 1, 1)), 16, 10).cast("long"), 7)
        flips.append(bit * (1 << (31 - i)))
    return ipv4_text(number.bitwiseXOR(reduce(lambda x, y: x + y, flips)))


def prefix_preserving_map(c: Column, key: bytes = b"") -> Column:
    """Addresses (IPv4 or IPv6) whose bits are flipped or kept by a draw for the bits before: those that share k bits share
    k bits afterwards. The draws are the last bits of MD5 over key, number of bits and those bits as text."""
    six = c.contains(":")
    half = lambda at: F.lpad(F.conv(F.substring(ipv6_digits(F.when(six, c)), at, 16), 16, 2), 64, "0")
    bits = F.when(six, F.concat(half(1), half(17))).otherwise(F.lpad(F.conv(ipv4_number(F.when(~six, c)).cast("string"), 10, 2), 32, "0"))

    def changed(own: Column, k: Column) -> Column:
        drawn = F.md5(F.concat(F.lit(key.decode("latin-1") + ":"), k.cast("string"), F.lit(":"), F.substring(own, F.lit(1), k)).cast("binary"))
        flip = F.substring(drawn, 32, 1).isin(*"13579bdf")
        return F.when((F.substring(own, k + 1, F.lit(1)) == "1") != flip, "1").otherwise("0")

    def whole(own: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(own) - 1), lambda k: changed(own, k)), "")

    def text(new: Column) -> Column:
        digits = F.lower(F.concat(*(F.lpad(F.conv(F.substring(new, a, 64), 2, 16), 16, "0") for a in (1, 65))))
        return F.when(F.char_length(new) == 128, F.regexp_replace(digits, "(.{4})(?=.)", "$1:")).otherwise(ipv4_text(F.conv(new, 2, 10).cast("long")))

    # Arrays of one element: what a function of several uses is given is computed once.
    return F.when(c.isNotNull(), F.transform(F.transform(F.array(bits), whole), text)[0])


def anonymize_ip(df: DataFrame, key: bytes, columns: tuple[str, ...] = ("src_ip", "dst_ip"), change=prefix_preserving) -> DataFrame:
    """``df`` with prefix-preserving addresses; each distinct address is changed once."""
    values = df.select(F.explode(F.array(*columns)).alias("a_")).where("a_ is not null").distinct()
    made = values.withColumn("made_", change(F.col("a_"), key))
    for c in columns:
        df = df.join(made, F.col(c) == F.col("a_"), "left").withColumn(c, F.col("made_")).drop("a_", "made_")
    return df


# Fields of application protocols (fixed names): requests' and responses' first lines, header lines, commands.
HTTP_HEADERS = """USER_AGENT ACCEPT ACCEPT_CHARSET ACCEPT_ENCODING ACCEPT_LANGUAGE ACCEPT_RANGES AGE ALLOW AUTHORIZATION CACHE_CONTROL CONTENT_TYPE CONTENT_LENGTH CONTENT_LOCATION CONTENT_MD5
CONTENT_RANGE COOKIE ETAG EXPECT EXPIRES FROM HOST IF_MATCH IF_MODIFIED_SINCE IF_NONE_MATCH IF_RANGE IF_UNMODIFIED_SINCE LAST_MODIFIED PRAGMA PROXY_AUTHENTICATE PROXY_AUTHORIZATION RANGE RETRY_AFTER
SET_COOKIE SERVER TE TRAILER TRANSFER_ENCODING UPGRADE VIA WARNING WWW_AUTHENTICATE X_POWERED_BY VARY DATE CONTENT_ENCODING KEEP_ALIVE LOCATION CONTENT_LANGUAGE DERIVED_FROM ALLOWED MIME_VERSION TITLE REFRESH""".split()
HTTP_NAMES = {n: n.replace("_", "-") for n in HTTP_HEADERS} | {"CONNECTION_TYPE": "CONNECTION", "MAX_FORWRDS": "MAX-FORWARDS", "REFERRER": "REFERER"}
FTP_COMMANDS = {n: n for n in "USER PASS ACCT STRU MODE CWD PWD CDUP PASV RETR REST PORT LIST NLST QUIT SYST STAT HELP NOOP STOR APPE STOU ALLO MKD RMD DELE RNFR RNTO SITE".split()} | {"FTP_TYPE": "TYPE"}


#: Where a line begins, and first lines of requests and responses: a body before them need not end with a line.
LINE, METHODS = r"(?<=^|\r\n)", "GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH"
#: Values in a text stand between two of these: texts are bytes, so no character beyond 255 is theirs.
MARK = "\ue000"
REQUEST_LINE, STATUS_LINE = rf"(?:{METHODS}) [^ \r\n]+ HTTP/[0-9.]+\r\n", r"HTTP/[0-9.]+ [0-9]{3}[ \r]"


def text_field(proto: str, name: str) -> str | None:
    """A pattern of the field's values, at every place where the field stands: also in the second request of a payload. A look
    at the character before comes first, so that the long ones are not tried at each place."""
    if proto == "HTTP":
        if name in HTTP_NAMES:
            return rf"(?i)(?<=[: \t])(?<=\r\n{HTTP_NAMES[name]}:[ \t]{{0,64}})[^\r\n \t][^\r\n]*"
        return {
            "METHOD": rf"(?:{LINE}[A-Z]+|{METHODS})(?= [^ \r\n]+ HTTP/)",
            "URI": r"(?<=[A-Z] )[^ \r\n]+(?= HTTP/)",
            "HTTP_VERSION": r"HTTP/[0-9.]+(?= [0-9]{3}[ \r]|\r\n)",
            "RESPONSE_CODE": r"(?<= )(?<=HTTP/[0-9.]{1,16} )[0-9]{3}",
            "RESP_CODE_DESCR": r"(?<= )(?<=HTTP/[0-9.]{1,16} [0-9]{3} )[^\r\n]+",
            # From a blank line to the next first line of a request or response, or the end.
            "HTTP_PAYLOAD": rf"(?s)(?<=\r\n\r\n)(?!{REQUEST_LINE}|{STATUS_LINE}).+?(?={REQUEST_LINE}|{STATUS_LINE}|\z)",
        }.get(name)
    if proto == "FTP":
        if name in FTP_COMMANDS:
            return rf"(?i)(?<=[ \t])(?<=(?:^|\r\n){FTP_COMMANDS[name]}[ \t]{{1,64}})[^\r\n \t][^\r\n]*"
        return {"FTP_RESPONSE_CODE": rf"{LINE}[0-9]{{3}}(?=[ -])", "FTP_RESPONSE_ARG": r"(?<=(?:^|\r\n)[0-9]{3}[ -])[^\r\n]+"}.get(name)
    return None


def in_text_field(payload: Column, proto: str, name: str, change) -> Column:
    """The payload (bytes) with ``change`` applied to each of a field's values; as it is where the field is not there.

    All of the values are marked in one pass; the payload is cut at the marks, and put together again from what lies between
    and what the values have become: they may change their length. ``change`` is part of a lambda, so it must be deterministic.
    """
    pattern = text_field(proto, name)
    if pattern is None:
        raise FlowError(Err.INVALID_ARGUMENT, f"{proto} has no {name}")
    text = F.decode(payload, "ISO-8859-1")
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)  # every second one is a value
    edits = F.transform(parts, lambda part, k: F.when(k % 2 == 1, F.coalesce(change(part), F.lit(""))).otherwise(part))
    return F.encode(F.array_join(edits, ""), "ISO-8859-1")
