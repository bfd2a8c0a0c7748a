"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding runs left to right over pieces of text and keeps a bounded buffer:

* Pre-tokens. A match of the pre-token pattern is final once the buffer holds enough
  text behind it to fix its end. A pre-token longer than the window is passed on in
  parts while its class of characters lasts.
* Merges. For a merge list in which every merge uses tokens made by earlier merges,
  appending text to ``w`` can only change tokens near the end of ``w``. Follow the
  frontier up to which both runs agree: it moves left over a token t only when a rule
  (t, y) applies across it in one run, each such rule has a higher rank than the one
  before, and y starts with the token that the frontier moved over before. The largest
  sum of |t| over such chains (``Merges.lookahead``) is a sufficient lookahead: tokens
  that end at least so many bytes before the end of the buffer are final. No merge
  crosses the end of a final token, so encoding goes on from there exactly.
  (Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023, show that such
  a constant exists.)

Short pre-tokens that no table of the task has yet are merged together, one merge of each
at a time (``Merges.merge_many``).

Decoding feeds token bytes through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from flowspark.llm.common import map_texts

# The pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for text of nothing but ASCII.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
SPACE = regex.compile(r"\s+")
RUNS = [regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), SPACE, regex.compile(r"[^\s\p{L}\p{N}]+")]
WINDOW = 1 << 16
CACHE = 1 << 16
# Bytes of the longest pre-token that is kept; characters of texts, and texts, whose pre-tokens are looked up at once.
LONGEST, AT_ONCE, TEXTS_AT_ONCE = 64, 1 << 19, 2000
# No token: where bytes end, or where one was merged away; no rule.
NO_TOKEN, NO_RULE = (1 << 24) - 1, (1 << 31) - 1


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable bytes for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(data: dict) -> dict[int, bytes]:
    """The bytes of each id, special tokens included."""
    alphabet = byte_alphabet()
    plain = {i: bytes(alphabet[c] for c in token) for token, i in data["model"]["vocab"].items() if all(c in alphabet for c in token)}
    return plain | {x["id"]: x["content"].encode() for x in data.get("added_tokens", [])}


class Merges:
    """Merge list, vocabulary and added tokens of a tokenizer file in the tokenizers library's JSON format."""

    def __init__(self, content: bytes) -> None:
        data = json.loads(content)
        model, alphabet = data["model"], byte_alphabet()
        vocab = model["vocab"]
        self.bytes_of = token_bytes(data)
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rules[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.lookahead = self._lookahead()
        # The rules by pair, for lookups of many pairs; tokens by rank; ranks of pairs of bytes.
        pairs = np.array([a << 24 | b for a, b in self.rules], np.int64)
        ranks, made = (np.array([r[k] for r in self.rules.values()], np.int32) for k in (0, 1))
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.append(pairs[order], 1 << 60), np.append(ranks[order], np.int32(NO_RULE))
        self.made = np.full(int(ranks.max(initial=-1)) + 1, NO_TOKEN, np.int32)
        self.made[ranks] = made
        ids = np.array(self.byte_ids, np.int32)
        self.of_byte, self.of_bytes = ids, self._ranks(ids[:, None], ids[None, :])

    def _lookahead(self) -> int:
        """Bytes before the end of a buffer whose tokens appended text may change."""
        left = dict.fromkeys(self.byte_ids)
        best: dict[int, int] = {}
        most = 0
        for (a, b), (_, made) in self.rules.items():
            if a not in left or b not in left or made in left:
                raise ValueError("a merge must use tokens of earlier merges and make a new one")
            below, x = 0, b
            while x is not None:
                below = max(below, best.get(x, 0))
                x = left[x]
            moved = len(self.bytes_of[a]) + below
            best[a] = max(best.get(a, 0), moved)
            left[made] = a
            most = max(most, moved)
        return most

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the rules of pairs of tokens, NO_RULE where there is none."""
        pair = a.astype(np.int64) << 24 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], np.int32(NO_RULE))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed tokens of each string of at most LONGEST bytes, as ``merge`` has them."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for least, most in itertools.pairwise((0, 2, 4, 6, 8, 12, 16, 24, 32, LONGEST)):
            at = np.flatnonzero((sizes > least) & (sizes <= most))
            if len(at):
                data = np.frombuffer(b"".join([words[k].ljust(most, b"\0") for k in at.tolist()]), np.uint8).reshape(-1, most)
                tokens = self._merged(data, sizes[at])
                alive = tokens != NO_TOKEN
                ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
                packed = tokens[alive].astype("<u4").tobytes()
                for k, begin, end in zip(at.tolist(), [0, *ends], ends, strict=False):
                    out[k] = packed[begin:end]
        return out

    def _merged(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each row of bytes, of which the first ``sizes`` count, with NO_TOKEN between them: in each round the
        leftmost of the lowest ranks of every row is merged. Column 0 and the last one hold no token."""
        n, width = data.shape
        tokens = np.full((n, width + 2), NO_TOKEN, np.int32)
        place = np.arange(width + 2, dtype=np.int16)
        inside = place[None, 1:-1] <= sizes[:, None]
        tokens[:, 1:-1][inside] = self.of_byte[data[inside]]
        ranks = np.full((n, width + 2), NO_RULE, np.int32)
        both = inside[:, 1:]
        ranks[:, 1:-2][both] = self.of_bytes[data[:, :-1][both], data[:, 1:][both]]
        after, before = np.tile(np.minimum(place + 1, width + 1), (n, 1)), np.tile(np.maximum(place - 1, 0), (n, 1))
        rows = np.arange(n)
        while len(rows):
            k = ranks[rows].argmin(axis=1)
            rule = ranks[rows, k]
            goes_on = rule != NO_RULE
            rows, k, rule = rows[goes_on], k[goes_on], rule[goes_on]
            j, left = after[rows, k], before[rows, k]
            right = after[rows, j]
            made = self.made[rule]
            tokens[rows, k], tokens[rows, j] = made, NO_TOKEN
            after[rows, k], before[rows, right] = right, k
            ranks[rows, j] = NO_RULE
            ranks[rows, k] = self._ranks(made, tokens[rows, right])
            ranks[rows, left] = self._ranks(tokens[rows, left], made)
        return tokens

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a whole string of bytes: lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        rules = self.rules
        if len(ids) > LONGEST:
            return self._merge_long(ids)
        while len(ids) > 1:
            found = None
            for k in range(len(ids) - 1):
                rule = rules.get((ids[k], ids[k + 1]))
                if rule is not None and (found is None or rule < found):
                    found, at = rule, k
            if found is None:
                break
            ids[at : at + 2] = [found[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rules = len(ids), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := rules.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := rules.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [i for i in ids if i >= 0]


class _Words(dict):
    """Packed ids of short pre-tokens, the last CACHE to twice as many that were used, and those learnt together."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            stream = Transducer(self.merges)
            return stream.feed(word.encode()) + stream.finish()
        packed = self.older.get(word)
        if packed is None:
            ids = self.merges.merge(word.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self._make_room()
        self[word] = packed
        return packed

    def _make_room(self) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()

    def learn(self, words: Iterable[str]) -> None:
        """Take in all of some pre-tokens (beyond CACHE, too, until others come); those not known are merged together."""
        self._make_room()
        wanted = [w for w in set(words) if w not in self and len(w) <= LONGEST]
        new = [w for w in wanted if w not in self.older]
        coded = [w.encode() for w in new]
        short = [k for k, c in enumerate(coded) if len(c) <= LONGEST]
        merged = self.merges.merge_many([coded[k] for k in short])
        self.update((w, self.older[w]) for w in wanted if w in self.older)
        self.update((new[k], packed) for k, packed in zip(short, merged, strict=True))


class Transducer:
    """The bytes of one pre-token in, packed ids out; holds at most twice the lookahead and one piece."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""

    def feed(self, data: bytes, final: bool = False) -> bytes:
        out: list[int] = []
        step = max(self.merges.lookahead, 1024)
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            if len(self.held) > self.merges.lookahead + step // 2:
                end, stable = 0, len(self.held) - self.merges.lookahead
                for i in self.merges.merge(self.held):
                    size = len(self.merges.bytes_of[i])
                    if end + size > stable:
                        break
                    out.append(i)
                    end += size
                self.held = self.held[end:]
        if final:
            out += self.merges.merge(self.held)
            self.held = b""
        return struct.pack(f"<{len(out)}I", *out)

    def finish(self) -> bytes:
        return self.feed(b"", final=True)


class Encoder:
    """Pieces of one text in, packed ids (little-endian unsigned 32-bit) out."""

    def __init__(self, merges: Merges, words: _Words | None = None, window: int = WINDOW) -> None:
        self.merges = merges
        self.words = _Words(merges) if words is None else words
        self.find, self.find_ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.margin = 2 + max([4, *map(len, merges.special)])
        self.window = max(window, 2 * self.margin)
        self.text, self.run, self.stream = "", None, None

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a whole text without special tokens."""
        return (self.find_ascii if text.isascii() else self.find).findall(text)

    def packed(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        words = self.split(text)
        if len(words) > 1000:
            self.words.learn(words)
        return self.packed(words)

    def _close_run(self) -> bytes:
        done, self.run, self.stream = self.stream.finish(), None, None
        return done

    def _segment(self, text: str, final: bool) -> tuple[bytes, str]:
        """Ids of the final part of ``text`` (which has no special token before its margin), and the rest."""
        out = b""
        if self.run is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            if final and end == len(text):
                return self.stream.feed(text.encode()) + self._close_run(), ""
            undecided = not final and end > len(text) - self.margin
            if self.run is SPACE and end < len(text):
                end -= 1  # the last space before other text belongs to what follows
            if undecided:
                end = max(0, min(end, len(text) - self.margin))
                return self.stream.feed(text[:end].encode()), text[end:]
            out += self.stream.feed(text[:end].encode()) + self._close_run()
            text = text[end:]
        if final:
            return out + self._whole(text), ""
        stop = len(text) - self.margin
        ends = 0
        words = []
        for m in self.find.finditer(text):
            if m.end() > stop:
                break
            words.append(m.group())
            ends = m.end()
        if len(words) > 1000:
            self.words.learn(words)
        out += self.packed(words)
        text = text[ends:]
        if len(text) > self.window:
            head = 1 if text[0] == " " and not SPACE.match(text, 1) else 0
            self.run = next(r for r in RUNS if r.match(text, head))
            self.stream = Transducer(self.merges)
            out += self.stream.feed(text[:head].encode())
            more, text = self._segment(text[head:], False)
            out += more
        return out, text

    def feed(self, piece: str, final: bool = False) -> bytes:
        out = b""
        text = self.text + piece
        if self.special:
            while m := self.special.search(text):
                ids, _ = self._segment(text[: m.start()], True)
                out += ids + struct.pack("<I", self.merges.special[m.group()])
                text = text[m.end() :]
        ids, self.text = self._segment(text, final)
        return out + ids

    def finish(self, piece: str = "") -> bytes:
        return self.feed(piece, final=True)

    def encode(self, text: str) -> bytes:
        if len(text) <= self.window:
            return self.finish(text)
        parts = [self.feed(text[at : at + self.window]) for at in range(0, len(text), self.window)]
        return b"".join([*parts, self.finish()])

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text; new pre-tokens of some AT_ONCE characters are merged together."""
        for group in _groups(texts):
            plain = [len(t) <= self.window and not (self.special and self.special.search(t)) for t in group]
            words = [self.split(t) if is_plain else [] for t, is_plain in zip(group, plain, strict=True)]
            self.words.learn(itertools.chain.from_iterable(words))
            for text, found, is_plain in zip(group, words, plain, strict=True):
                yield self.packed(found) if is_plain else self.encode(text)


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of some AT_ONCE characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= AT_ONCE or len(held) >= TEXTS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


class Decoder:
    """Packed ids in, text out as soon as its bytes are complete; bytes that are no UTF-8 give U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes], table: pa.Array | None = None) -> None:
        self.table = _table(bytes_of) if table is None else table
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, final: bool = False) -> str:
        found = self.table.take(pa.array(np.frombuffer(packed, "<u4")))
        if found.null_count:
            raise KeyError("an id without a token")
        _, ends, whole = found.buffers()
        data = whole[: np.frombuffer(ends, np.int32)[len(found)]] if len(found) else b""
        return self.machine.decode(data, final)

    def decode(self, packed: bytes) -> str:
        step = 4 * WINDOW
        parts = [self.feed(packed[at : at + step]) for at in range(0, len(packed), step)]
        return "".join([*parts, self.feed(b"", final=True)])


def _table(bytes_of: dict[int, bytes]) -> pa.Array:
    """The bytes of each id, null for numbers that are none."""
    return pa.array([bytes_of.get(k) for k in range(max(bytes_of, default=-1) + 1)], pa.binary())


@functools.lru_cache(maxsize=2)
def _table_of(content: bytes) -> pa.Array:
    return _table(token_bytes(json.loads(content)))


@functools.lru_cache(maxsize=2)
def _loaded(content: bytes) -> tuple[Merges, _Words]:
    merges = Merges(content)
    return merges, _Words(merges)


def _tokenizer(df: DataFrame, path: str) -> Broadcast:
    """The tokenizer file (its size does not depend on the data), read once by the driver."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, column: str, name: str, kind: pa.DataType, sql_kind: str, make) -> DataFrame:
    """``df`` with column ``name``, which make() makes of the values of ``column`` in order; rows go out in parts of some MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at, size, values = 0, 0, []
            source = batch.column(batch.schema.get_field_index(column))
            for k, value in enumerate(f(x.as_py() for x in source)):
                values.append(value)
                size += len(values[-1])
                if size > 1 << 24 or k + 1 == batch.num_rows:
                    part = batch.slice(at, len(values))
                    columns = [c for c, field in zip(part.columns, part.schema, strict=True) if field.name != column]
                    names = [field.name for field in part.schema if field.name != column]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(values, kind)], [*names, name])
                    at, size, values = k + 1, 0, []

    kept = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` {sql_kind}"])
    return map_texts(df, run, schema)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by ``ids_col``: ids packed as little-endian unsigned 32-bit integers.

    Null text counts as empty and gives no ids. Strings of special tokens in a text
    become those tokens. A map over rows without shuffle: repeated rows, ties and an
    empty table need nothing; other columns pass unchanged (one named like ``ids_col``
    is replaced).
    """
    content = _tokenizer(df, path)

    def make():
        merges, words = _loaded(content.value)
        return lambda texts: Encoder(merges, words).encode_many(text or "" for text in texts)

    return _mapped(df.drop(ids_col), text_col, ids_col, pa.binary(), "binary", make)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with packed ids replaced by their text; null ids give empty text, special tokens their strings."""
    content = _tokenizer(df, path)

    def make():
        table = _table_of(content.value)
        return lambda values: (Decoder({}, table).decode(packed or b"") for packed in values)

    return _mapped(df.drop(text_col), ids_col, text_col, pa.string(), "string", make)
