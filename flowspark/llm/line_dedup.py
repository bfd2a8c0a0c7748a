"""Line dedup: documents probe arrays indexed by a sharded minimal perfect hash.

Keys of lines are counted by grouped aggregation of two 64-bit hashes. Keys found in
enough documents are dealt to shards of some 100,000 keys; each shard's task builds a
minimal perfect hash (levels of bit arrays, rank as index: Limasset et al., "Fast and
Scalable Minimal Perfect Hashing for Massive Key Sets", 2017) and the arrays behind it:
a 64-bit fingerprint and a count for each key. Documents then look their lines up in
the arrays. Shards go out in rounds of bounded size, in turn, so what a task holds
does not grow with the corpus; a corpus whose arrays fit one round takes one pass. Lines
of fewer documents are not in the arrays: a key that is not found has too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_texts
from flowspark.session import durable

KEYS_A_SHARD = 100_000
LEVELS, SPREAD = 24, 2.0


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends (space, tab to carriage return), A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct 64-bit hashes to its own number below n; other hashes to any number or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray, left: np.ndarray) -> None:
        self.sizes, self.bits, self.left = sizes, bits, left
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        # Set bits before each word of 64: half a bit for each bit.
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32))).astype(np.uint32)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, parts, rest = [], [], hashes
        for level in range(LEVELS):
            if not len(rest):
                break
            size = -(-int(SPREAD * len(rest)) // 8) * 8
            at = _place(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        bits = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        return cls(sizes, bits, np.sort(rest))

    def index(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _place(hashes[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.rank[at[hit] >> 6].astype(np.int64) + below
            todo = todo[~hit]
        if len(self.left) and len(todo):  # the few that met at every level
            at = np.minimum(np.searchsorted(self.left, hashes[todo]), len(self.left) - 1)
            hit = self.left[at] == hashes[todo]
            out[todo[hit]] = int(self.rank[-1]) + at[hit]
        return out


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray) -> None:
        self.perfect, self.prints, self.counts = perfect, prints, counts

    @classmethod
    def build(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> Shard:
        perfect = PerfectHash.build(h)
        order = np.argsort(perfect.index(h))
        return cls(perfect, prints[order], np.minimum(counts[order], 2**32 - 1).astype(np.uint32))

    def pack(self) -> tuple:
        p = self.perfect
        return p.sizes, p.bits.tobytes(), p.left.tobytes(), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def unpack(cls, sizes, bits, left, prints, counts) -> Shard:
        u8 = lambda b, kind: np.frombuffer(b, kind)
        return cls(PerfectHash(list(sizes), u8(bits, np.uint8), u8(left, np.uint64)), u8(prints, np.uint64), u8(counts, np.uint32))

    def count(self, h: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Documents of each key (2**32 - 1 at most), 0 where it isn't one of the shard's."""
        if not len(self.counts):
            return np.zeros(len(h), np.int64)
        at = self.perfect.index(h)
        return np.where((at >= 0) & (self.prints[at] == prints), self.counts[at], 0)


def line_counts(df: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    """(h, print, n): documents that have each line key of at least ``least_chars`` code points, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                keys = {line_key(line) for line in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")}
                found += [_hashes(k) for k in keys if len(k) >= least_chars and (len(k) >= 4 * least_chars or len(k.decode("utf-8", "surrogatepass")) >= least_chars)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["h", "print"])

    return map_texts(df.select(text_col), run, "h bigint, print bigint").groupBy("h", "print").agg(F.count(F.lit(1)).alias("n"))


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its number and packed arrays. A shard's keys are some 100,000, dealt by hash."""
    schema = "shard int, sizes array<int>, bits binary, unplaced binary, prints binary, counts binary"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        h, prints = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "print"))
        packed = Shard.build(h, prints, part["n"].to_numpy(np.int64)).pack()
        return pd.DataFrame([[int(part["shard"].iloc[0]), *packed]], columns=["shard", "sizes", "bits", "unplaced", "prints", "counts"])

    return counts.withColumn("shard", F.expr(f"cast(pmod(h, {shards}) as int)")).groupBy("shard").applyInPandas(run, schema)


def drop_common_lines(
    df: DataFrame,
    text_col: str = "text",
    least_docs: int = 10,
    least_chars: int = 1,
    shards_a_round: int = 64,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``df`` with common lines taken out of its text, and columns n_lines and n_dropped (or as named).

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of
    at least ``least_chars`` code points found in at least ``least_docs`` documents lose all their
    lines in every document; other lines stay as they are, joined by newlines. Rows are
    documents: a repeated row counts again, a line repeated within a row does not. Null
    or empty text is one empty line and stays empty (null becomes empty). Columns of
    ``df`` with the names of the two are replaced; other columns pass unchanged. An
    empty table gives an empty result.
    """
    if least_chars < 1:
        raise ValueError("empty lines are no keys: least_chars must be 1 or more")
    common = durable(line_counts(df, text_col, least_chars).where(F.col("n") >= least_docs))
    shards = max(1, -(-common.count() // KEYS_A_SHARD))
    arrays = durable(build_shards(common, shards))
    names = [n for n in df.columns if n not in (lines_col, dropped_col)]
    out = df.select(*names, F.lit(None).cast("long").alias(lines_col), F.lit(0).cast("long").alias(dropped_col))
    for first in range(0, shards, shards_a_round):  # some 150 MB of arrays a round at most
        if first:
            out = durable(out)
        rows = arrays.where(f"shard >= {first} and shard < {first + shards_a_round}").collect()
        out = _probe(out, text_col, rows, shards, least_docs, least_chars, lines_col, dropped_col)
    return out


def _probe(df: DataFrame, text_col: str, rows: list, shards: int, least_docs: int, least_chars: int, lines_col: str, dropped_col: str) -> DataFrame:
    """One pass of the documents over the arrays of one round."""
    held = df.sparkSession.sparkContext.broadcast({r.shard: tuple(r)[1:] for r in rows})
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {k: Shard.unpack(*v) for k, v in held.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                yield probe(whole.slice(at, 512), opened)

    def probe(batch: pa.RecordBatch, opened: dict[int, Shard]) -> pa.RecordBatch:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") for t in batch.column(names.index(text_col))]
        keys = [line_key(line) for lines in texts for line in lines]
        pairs = np.array([_hashes(k) for k in keys], np.uint64).reshape(-1, 2)
        shard = pairs[:, 0].view(np.int64) % shards
        counts = np.zeros(len(keys), np.int64)
        for k in np.unique(shard).tolist():
            if k in opened:
                mine = np.flatnonzero(shard == k)
                counts[mine] = opened[k].count(pairs[mine, 0], pairs[mine, 1])
        common = counts >= least_docs
        kept, dropped, lines_before, at = [], [], [], 0
        for lines in texts:
            gone = common[at : at + len(lines)]
            at += len(lines)
            kept.append(b"\n".join(line for line, out in zip(lines, gone.tolist(), strict=True) if not out) if gone.any() else b"\n".join(lines))
            dropped.append(int(gone.sum()))
            lines_before.append(len(lines))
        columns = dict(zip(names, batch.columns, strict=True))
        columns[text_col] = pa.array(kept, pa.binary()).cast(pa.string())
        earlier = columns[lines_col].to_pylist()
        columns[lines_col] = pa.array([n if e is None else e for e, n in zip(earlier, lines_before, strict=True)], pa.int64())
        columns[dropped_col] = pa.array([e + n for e, n in zip(columns[dropped_col].to_pylist(), dropped, strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return map_texts(df, run, df.schema)

