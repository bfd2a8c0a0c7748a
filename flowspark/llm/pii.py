"""Personal data replaced by keyed surrogates of the same kind and format.

A surrogate is drawn by a keyed hash of the entity's kind and normal form, so all
mentions of an entity, however formatted, in any document get the same one. It keeps
separators, lengths, letter case and script, and what the kind needs: vowels and
consonants of names, gendered endings of given names and the last letter of other names
(titles stay), Luhn validity of card numbers, check digits of IBANs, country codes of
phone numbers, private or public ranges of addresses. Each word of a name is an entity by
itself, so a surname alone meets the surname in a full name; names found after a title
are also replaced where the same text repeats them without one.

Distinct entities must have distinct surrogates, none of them an entity of the corpus
itself: a job over the table of distinct entities finds clashes and moves the clashing
ones to their next draw (a name's then grows) until there are none.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_batches, map_texts
from flowspark.session import durable

#: Titles also stand in capitals, but for Ms and Mme, which are common abbreviations then.
WORDS = ["Mr", "Mrs", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sra", "Monsieur", "Madame"]
TITLES = "|".join([*WORDS, "Ms", "Mme", *(w.upper() for w in WORDS)])
#: Given names whose surrogates take the endings of their gender.
FEMALE = frozenset("mary anna anne maria emma erika eva sarah julia laura marie sophie claire camille carmen lucia elena sofia isabel ingrid helga petra sabine susan linda karen lisa nancy betty helen sandra donna carol ruth sharon michelle jane alice emily olivia amelia grace charlotte".split())
MALE = frozenset("john james robert michael william david richard thomas bob paul mark george peter hans karl heinz klaus jürgen stefan wolfgang max felix jean pierre jacques louis michel juan carlos josé luis miguel pedro antonio daniel matthew anthony steven andrew kevin brian henry jack oliver noah liam".split())
ENDINGS = {"f": ("a", "ia", "ina", "ella"), "m": ("o", "us", "an", "er")}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
# Every part starts at the edge of a run, and is bounded or gives nothing back, so that the search is linear in the text.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]{1,64}@(?:[\w\-]{1,63}\.){1,8}[^\W\d_]{2,24})"
    r"|(?P<secret>(?<=[\"'])[A-Za-z0-9_\-+/=.]{16,}+(?=[\"'])|\b[0-9a-f]{32,}+\b|\b[0-9A-F]{32,}+\b)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]\d{2,4})?\b|\+\d{8,15}\b|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}\b"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.])(?<!\d )\d{3}(?P<between>[. ])\d{3}(?P=between)\d{4}(?!\w|[. ]\d))"
    r"|(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,4}|\d{4}(?:-\d{4}){2}-\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|\.\d))"
    rf"|(?P<person>\b(?:{TITLES})\b\.? (?P<name>{_NAME}(?: (?!(?:{TITLES})\b){_NAME})?))"
)
MAYBE = re.compile(rf"[\d@:]|\b(?:{TITLES})\b|[\"'][A-Za-z0-9_\-+/=.]{{16}}|[0-9a-fA-F]{{32}}")
LEAST_DRAWS = 10**7


def _letters() -> dict[str, str]:
    """Each character that is replaced, with the alphabet that its surrogate comes from."""
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåèéêëìíîïòóôõöùúûü", "çñß", "αειου", "βγδζθκλμνξπρσφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "0123456789"]
    return {c: g for g in groups for c in g}


ALPHABETS = _letters()
HEX = "0123456789abcdef"


def _alphabet(c: str) -> str | None:
    """The alphabet of a lower-case character: its group, or the letters of its block of 64 code points."""
    known = ALPHABETS.get(c)
    if known is None and c.isdecimal():  # the ten digits of another script
        return "".join(chr(ord(c) - int(c) + d) for d in range(10))
    if known or not c.isalpha():
        return known
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and x == x.lower())


def _number(key: bytes, kind: str, norm: str, draw: int) -> int:
    data = f"{kind}\0{draw}\0{norm}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big") | int.from_bytes(hashlib.blake2b(data + b"\1", key=key, digest_size=64).digest(), "big") << 512


def _drawn(key: bytes, kind: str, norm: str, draw: int, kept: int = 0, grow: int = 0) -> str:
    """``norm`` with every letter and digit replaced but for the last ``kept``; ``grow`` characters more stand before those."""
    value, out, used = _number(key, kind, norm, draw), [], None
    hexadecimal = kind == "secret" and set(norm.lower()) <= set(HEX)
    for c in norm[: len(norm) - kept]:
        alphabet = (HEX.upper() if c.isupper() else HEX) if hexadecimal and (c.isdigit() or c.isalpha()) else _alphabet(c)
        if alphabet:
            value, k = divmod(value, len(alphabet))
            if value == 0:
                value = _number(key, kind, norm + str(len(out)), draw)
            c, used = alphabet[k], alphabet
        out.append(c)
    for _ in range(grow if used else 0):
        value, k = divmod(value, len(used))
        out.append(used[k])
    return "".join(out) + norm[len(norm) - kept :]


def _short(norm: str) -> int:
    """Characters that a text lacks to have some LEAST_DRAWS draws."""
    size, used = 1, None
    for c in norm:
        used = _alphabet(c) or used
        size *= len(_alphabet(c) or "-")
    more = 0
    while used and size < LEAST_DRAWS:
        size, more = size * len(used), more + 1
    return more


def _name(key: bytes, norm: str, draw: int) -> str:
    """A word of a name: of the same length, longer by a letter every fourth draw."""
    gender = "f" if norm in FEMALE else "m" if norm in MALE else None
    if gender is None:
        return _drawn(key, "person", norm, draw, int(len(norm) > 2), (draw + 3) // 4)
    fitting = [e for e in ENDINGS[gender] if len(e) + 2 <= len(norm)] or [ENDINGS[gender][0]]
    ending = fitting[_number(key, "ending", norm, draw) % len(fitting)]
    return _drawn(key, "person", norm[: len(norm) - len(ending)], draw, 0, (draw + 3) // 4) + ending


def _luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits)))) % 10


def normal(kind: str, value: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "secret" else value.lower()


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities of a mention, (kind, normal form): the words of a name, else the mention itself."""
    return [(kind, normal(kind, w)) for w in value.split(" ")] if kind == "person" else [(kind, normal(kind, value))]


def _iban_rest(value: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


#: The draw of entities in ranges so full that surrogates can't avoid the corpus, and the share of a range that makes it so.
DENSE, DENSE_SHARE = -1, 4
_PRIVATE = {"10/8": (10 << 24, 1 << 24), "127/8": (127 << 24, 1 << 24), "192.168/16": (0xC0A8 << 16, 1 << 16), "172.16/12": (0xAC1 << 20, 1 << 20)}


def _address(norm: str) -> int:
    return int.from_bytes(bytes(map(int, norm.split("."))), "big")


def _country_code(norm: str) -> int:
    """Leading digits of a phone number that stay."""
    return 1 if len(norm) == 11 and norm[0] == "1" else 2 if len(norm) > 10 else 0


def closed_range(kind: str, norm: str) -> tuple[str, int] | None:
    """Name and size of the range in which all surrogates of an entity lie, for kinds whose ranges can fill up."""
    if kind == "ip":
        value = _address(norm)
        return next(((name, size) for name, (base, size) in _PRIVATE.items() if base <= value < base + size), ("public", 1 << 32))
    if kind == "phone" and norm.isascii():
        kept = _country_code(norm)
        return f"{norm[:kept]}+{len(norm) - kept}", 10 ** (len(norm) - kept)
    return ("9 digits", 10**9) if kind == "ssn" and norm.isascii() else None


def _permuted(key: bytes, label: str, x: int, size: int, back: bool) -> int:
    """A keyed permutation of the numbers below ``size``, or its inverse: a Feistel network of eight rounds over the next even
    number of bits, walked along until it is below ``size`` again."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in reversed(range(8)) if back else range(8):
            mixed = lambda part, k=k: int.from_bytes(hashlib.blake2b(f"{label}\0{k}\0{part}".encode(), key=key, digest_size=8).digest(), "big") & mask
            left, right = (right ^ mixed(left), left) if back else (right, left ^ mixed(right))
        x = left << half | right
        if x < size:
            return x


def _shifted(key: bytes, label: str, x: int, size: int, fits=lambda y: True) -> int:
    """Another number below ``size`` that ``fits``, a different one for each x: the next one in a keyed order of all."""
    while True:
        x = _permuted(key, label, (_permuted(key, label, x, size, False) + 1) % size, size, True)
        if fits(x):
            return x


def _in_full_range(key: bytes, kind: str, norm: str) -> str:
    """The surrogate of an entity in a full range: never itself, and no two alike, but perhaps another entity of the corpus."""
    name, size = closed_range(kind, norm)
    label = f"{kind} {name}"
    if kind != "ip":
        kept = _country_code(norm) if kind == "phone" else 0
        return norm[:kept] + f"{_shifted(key, label, int(norm[kept:]), size):0{len(norm) - kept}d}"
    if name in _PRIVATE:
        base = _PRIVATE[name][0]
        value = base + _shifted(key, label, _address(norm) - base, size)
    else:
        value = _shifted(key, label, _address(norm), size, lambda y: not any(base <= y < base + n for base, n in _PRIVATE.values()))
    return ".".join(map(str, value.to_bytes(4, "big")))


def surrogate(key: bytes, kind: str, norm: str, draw: int) -> str:
    """The normal form of the surrogate."""
    if draw == DENSE:
        return _in_full_range(key, kind, norm)
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        *labels, top = domain.split(".")
        # A domain has one surrogate of its own, whatever stands before it.
        return _drawn(key, kind + domain, local, draw, grow=(draw + 3) // 4) + "@" + ".".join([*(_drawn(key, "domain", x, 0, grow=_short(x)) for x in labels), top])
    if kind == "ip":
        value = _number(key, kind, norm, draw)
        a, b, *_ = map(int, norm.split("."))
        octets = [value >> s & 255 for s in (0, 8, 16, 24)]
        if a == 10 or a == 127:
            octets[0] = a
        elif (a, b) == (192, 168):
            octets[:2] = a, b
        elif a == 172 and 16 <= b < 32:
            octets[:2] = a, 16 + octets[1] % 16
        else:
            octets[0] = 1 + octets[0] % 222
            if octets[0] in (10, 127) or tuple(octets[:2]) == (192, 168) or octets[0] == 172:
                octets[0] = 11
        return ".".join(map(str, octets))
    if kind == "ipv6":
        old = int(ipaddress.IPv6Address(norm))
        # Link-local, local and documentation prefixes stay; all else becomes a global address.
        bits = next((b for b, p in ((16, 0xFE80 << 112), (7, 0xFC << 120), (32, 0x20010DB8 << 96)) if old >> 128 - b == p >> 128 - b), None)
        kept = old if bits else 1 << 125
        low = (1 << 128 - (bits or 3)) - 1
        return str(ipaddress.IPv6Address(kept & ~low | _number(key, kind, norm, draw) & low))
    if kind == "iban":
        body = _drawn(key, kind, norm[4:].lower(), draw).upper()
        return f"{norm[:2]}{98 - _iban_rest(norm[:2] + '00' + body):02d}{body}"
    if kind == "card":
        body = _drawn(key, kind, norm[:-1], draw)
        valid = _luhn(norm) == 0
        last = next(str(d) for d in range(10) if (_luhn(body + str(d)) == 0))
        return body + (last if valid else str((int(last) + 1 + _number(key, "check", norm, draw) % 9) % 10))
    if kind == "phone":
        kept = _country_code(norm)
        return norm[:kept] + _drawn(key, kind, norm[kept:], draw)
    return _name(key, norm, draw) if kind == "person" else _drawn(key, kind, norm, draw)


def _formatted(kind: str, value: str, new: str) -> str:
    """The surrogate's normal form, written as the mention (of a name, its word) was."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in value)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in value)
    if kind in ("ip", "ipv6", "secret"):
        return new
    if value.isupper() and len(value) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if value[:1].isupper() else new


def _is_name(word: str) -> bool:
    """Whether a word can be one of a name: it begins with a capital or with a letter of a script without capitals."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _in_small_letters(word: str, text: str) -> bool:
    """Whether a word that begins with a capital also stands in the text without capitals, not as part of an address."""
    return word != word.lower() and re.search(rf"(?<![\w@.]){re.escape(word.lower())}(?![\w@]|\.\w)", text) is not None


def _judged(kind: str, value: str) -> bool:
    """Whether what looks like an entity is one."""
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "ipv6":
        try:
            return int(ipaddress.IPv6Address(value)) > 1
        except ValueError:
            return False
    if kind == "iban":
        return 15 <= len(value.replace(" ", "")) <= 34 and _iban_rest(value.replace(" ", "")) == 1
    if kind == "secret":  # not a long number, and with dots neither a name of a file nor a host
        return not value.isdigit() and ("." not in value or any(c.isdigit() for c in value) and any(c.isupper() for c in value))
    return True


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each entity, from left to right.

    A name follows a title: one word, or two if the second doesn't stand in the text in
    small letters, too. Its words are mentions wherever else they stand as whole words
    with the same first letter, unless the text has them in small letters as well.
    """
    if not MAYBE.search(text):
        return
    found, names, at = [], set(), 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        start, end = m.span("name") if kind == "person" else m.span()
        value = text[start:end]
        if kind == "person":
            words = value.split(" ")
            if not _is_name(words[0]):
                at = start
                continue
            if len(words) == 2 and (not _is_name(words[1]) or _in_small_letters(words[1], text)):
                words = words[:1]
            value = " ".join(words)
            end = start + len(value)
            names.update(words)
        at = end
        if _judged(kind, value):
            found.append((start, end, kind, value))
    if names:
        names = {w for w in names if len(w) > 1 and not _in_small_letters(w, text)}
        names |= {f for w in names for f in (w.upper(), w[:1] + w[1:].lower())}
    if names:
        word = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
        again = re.compile(rf"(?<![\w@.])(?:{word})(?: (?:{word}))*(?!\w|@|\.\w)")
        taken, k = list(found), 0
        for m in again.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or taken[k][0] >= m.end():
                found.append((m.start(), m.end(), "person", m.group()))
        found.sort()
    yield from found


def replaced(text: str, key: bytes, draw_of) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of mentions by kind. ``draw_of`` gives the draw of (kind, normal form)."""
    out, at, count = [], 0, {}
    for start, end, kind, value in mentions(text):
        words = value.split(" ") if kind == "person" else [value]
        new = [_formatted(kind, w, surrogate(key, *unit, draw_of(unit))) for w, unit in zip(words, units(kind, value), strict=True)]
        out += [text[at:start], " ".join(new)]
        at = end
        count[kind] = count.get(kind, 0) + 1
    return (text if not out else "".join([*out, text[at:]])), count


def entities(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct (kind, norm) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {unit for t in batch.column(0) for _, _, kind, value in mentions(t.as_py() or "") for unit in units(kind, value)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], ["kind", "norm"])

    return map_texts(df.select(text_col), run, "kind string, norm string").distinct()


def full_ranges(found: DataFrame) -> frozenset[tuple[str, str]]:
    """(kind, range) of the closed ranges of which the corpus has more than one in DENSE_SHARE: half of a range taken leaves no
    surrogates that are both distinct and new, and long before that most draws clash. There are few ranges: of addresses
    five, of phone numbers one a country code and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, norms = (c.to_pylist() for c in batch.columns)
            ranges = [(k, *r) for k, n in zip(kinds, norms, strict=True) if (r := closed_range(k, n))]
            columns = list(zip(*ranges, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array([float(x) for x in columns[2]], pa.float64())], ["kind", "range", "size"])

    closed = map_batches(found.where(F.col("kind").isin("ip", "phone", "ssn")).select("kind", "norm"), run, "kind string, range string, size double")
    counted = closed.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return frozenset((r.kind, r.range) for r in counted.where(F.col("n") * DENSE_SHARE > F.col("size")).collect())


def _is_dense(kind: str, norm: str, full: frozenset) -> bool:
    return bool(full) and kind in ("ip", "phone", "ssn") and (r := closed_range(kind, norm)) is not None and (kind, r[0]) in full


def _without_dense(found: DataFrame, full: frozenset) -> DataFrame:
    """The entities that are drawn; those of full ranges have no draws and clash with none of the others."""
    if not full:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [not _is_dense(k, n, full) for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return durable(map_batches(found.select("kind", "norm"), run, "kind string, norm string"))


def clashing(found: DataFrame, key: bytes, most_draws: int = 50) -> DataFrame:
    """(kind, norm, draw) of the entities that must not take their first draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, norm, draw = (c.to_pylist() for c in batch.columns)
            made = [surrogate(key, *x) for x in zip(kind, norm, draw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "norm", "draw", "made"])

    drawn = found.select("kind", "norm", F.lit(0).alias("draw"))
    for _ in range(most_draws):
        made = durable(map_batches(drawn, run, "kind string, norm string, draw int, made string"))
        taken = found.select("kind", F.col("norm").alias("made"), F.lit(True).alias("taken"))
        firsts = durable(made.groupBy("kind", "made").agg(F.min("norm").alias("first"), F.count(F.lit(1)).alias("n")).join(taken, ["kind", "made"], "left").where("n > 1 or taken"))
        if firsts.isEmpty():
            return made.where("draw > 0").select("kind", "norm", "draw")
        judged = made.join(firsts, ["kind", "made"], "left")
        again = F.col("first").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("norm") != F.col("first")))
        drawn = judged.select("kind", "norm", (F.col("draw") + again.cast("int")).alias("draw"))
    raise RuntimeError(f"surrogates still clash after {most_draws} draws")


def replace_pii(df: DataFrame, key: bytes, text_col: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """``df`` with surrogates in its text, and columns n_found and found (number of mentions by kind).

    The same key gives the same surrogates in every run over the same corpus. Null text
    stays null and empty text empty, with nothing found; text without entities is
    unchanged. Repeated rows get the same text, and mentions that tie (stand at the same place) go to the kind that
    comes first in the pattern. Columns named n_found or found in ``df`` are replaced, others pass unchanged,
    whatever their names; an empty table gives an empty result.

    Where a closed range (private addresses, phone numbers of a length, nine-digit numbers) is so full that new values
    can't be had (``full_ranges``), its entities take those of a keyed permutation of the range: distinct, never their
    own, but perhaps another entity's.

    The few entities that clash go out by broadcast if they are counted to be few, else
    they are joined to the texts that mention them.
    """
    names = [n for n in df.columns if n not in ("n_found", "found")]
    rows = df.select(*names)
    found = durable(entities(df, text_col))
    full = full_ranges(found)
    later = durable(clashing(_without_dense(found, full), key))
    draws_col = "later draws"
    while draws_col in names:
        draws_col += " "
    if later.count() <= most_broadcast:
        held = df.sparkSession.sparkContext.broadcast({(r.kind, r.norm): r.draw for r in later.collect()})
        rows = rows.withColumn(draws_col, F.lit(None).cast("map<string,int>"))
    else:
        held = df.sparkSession.sparkContext.broadcast({})
        rows = _with_draws(rows, later, text_col, draws_col)
    at, last = names.index(text_col), len(names)
    made_names = [*names, "n_found", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = held.value
        for batch in batches:
            texts, totals, kinds = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(last), strict=True):
                draws = dict(own.as_py() or ())
                new, count = replaced(text or "", key, lambda unit, draws=draws: DENSE if _is_dense(*unit, full) else few.get(unit, 0) or draws.get(" ".join(unit), 0))
                texts.append(new if count else text)
                totals.append(sum(count.values()))
                kinds.append(sorted(count.items()))
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], made_names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields), "n_found int, found map<string,int>"])
    return map_texts(rows, run, schema)


def _with_draws(rows: DataFrame, later: DataFrame, text_col: str, draws_col: str) -> DataFrame:
    """``rows`` with the later draws of the entities each text mentions; texts are known by two hashes."""
    texts = rows.select(F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h.as_py(), g.as_py(), *unit) for h, g, t in zip(*batch.columns, strict=True) for _, _, kind, value in mentions(t.as_py() or "") for unit in units(kind, value)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["h", "g", "kind", "norm"])

    pairs = map_batches(texts, run, "h bigint, g int, kind string, norm string").distinct().join(later, ["kind", "norm"])
    entry = F.struct(F.concat_ws(" ", "kind", "norm").alias("key"), F.col("draw").alias("value"))
    draws = durable(pairs.groupBy("h", "g").agg(F.map_from_entries(F.collect_list(entry)).alias("later draws")))
    whole = rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g"))
    return whole.join(draws, ["h", "g"], "left").select("row.*", F.col("later draws").alias(draws_col))
