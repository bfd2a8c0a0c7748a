"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which of some following token positions a hash covers; the others may
hold anything, so a substitution there does not hide the match. Hashes of all masks at
all positions of the benchmark are joined with those of the documents, in the tasks
that read the documents: the benchmark goes out in blocks of bounded size, and a
document's hash can match only where all covered words are words of the benchmark.
Each hit fixes a document, an item and an alignment; the tokens around it, substitutions
allowed, decide whether the two overlap.

The masks are chosen so that no overlap is without a hit: every way to place the
substitutions that 12 tokens or more at a share of 0.8 allow leaves one of ``MASKS``
intact somewhere, and every way in items of 5 to 11 tokens one of ``SHORT_MASKS`` (a test
goes through them all; a stretch of 24 tokens or more holds a shorter one).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowspark.llm.common import map_texts
from flowspark.session import durable

WORD = re.compile(rb"[a-z0-9_\x80-\xff]+")
#: 1: the position counts, 0: it is ignored.
MASKS = ("11111", "110111")
#: For items of fewer tokens than a stretch has.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
LEAST = 5
BLOCK_CHARS = 1 << 24
TOKENS_AT_ONCE = 1 << 18
HITS_AT_ONCE = 1 << 13
#: Tokens that equal no word: those between items, those between documents.
ITEM_GAP, DOC_GAP = -1, -2


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def _offsets(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each window whose covered ids are all above zero."""
    offsets = _offsets(mask)
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids > 0
    fits = known[:n].copy()
    for o in offsets[1:]:
        fits &= known[o : o + n]
    at = np.flatnonzero(fits)
    h = np.full(len(at), int(mask, 2), np.uint64)
    for o in offsets:
        h = (h ^ ids[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h


class Benchmark:
    """A block of items: vocabulary, token ids one after the other with gaps, and the sorted seed hashes with their positions."""

    def __init__(self, items: list[tuple[int | None, str]], masks: tuple[str, ...], short_masks: tuple[str, ...], least_tokens: int, similarity: float) -> None:
        self.reach = 2 * least_tokens - 2  # a shortest stretch around a hit lies within so many tokens of it
        self.share = Fraction(similarity).limit_denominator(10_000)
        self.vocabulary: dict[bytes, int] = {}
        gap = np.full(self.reach + max(map(len, masks + short_masks)), ITEM_GAP, np.int64)
        self.names, self.starts, self.sizes, parts, at = [], [], [], [gap], len(gap)
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            if len(ids) >= LEAST:
                self.names.append(name)
                self.starts.append(at)
                self.sizes.append(len(ids))
                parts += [ids, gap]
                at += len(ids) + len(gap)
        self.tokens = np.concatenate(parts)
        self.starts, self.sizes = np.array(self.starts, np.int64), np.array(self.sizes, np.int64)
        self.need = np.minimum(self.sizes, least_tokens)
        self.seeds = [self._seeds(self.sizes >= least_tokens, masks), self._seeds(self.sizes < least_tokens, short_masks)]

    def _seeds(self, which: np.ndarray, masks: tuple[str, ...]) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
        """The masks, the sorted hashes of the items chosen, and where each begins."""
        if not which.any():
            return (), np.empty(0, np.uint64), np.empty(0, np.int64)
        found = [seed_hashes(np.where(np.repeat(which, self.sizes)[self._item_of_token()] & (self.tokens > 0), self.tokens, 0), mask) for mask in masks]
        at, h = (np.concatenate([f[k] for f in found]) for k in range(2))
        order = np.argsort(h, kind="stable")
        return masks, h[order], at[order]

    def _item_of_token(self) -> np.ndarray:
        """For each token its number among those of items (0 in gaps)."""
        return np.where(self.tokens > 0, np.cumsum(self.tokens > 0) - 1, 0)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of words; 0 for those that are not the benchmark's."""
        return np.fromiter(map(self.vocabulary.get, tokens, itertools.repeat(0)), np.int64, len(tokens))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``ids`` and in the items' tokens where a seed matches, in parts of bounded size: a seed that
        repeats in a text and in the items gives the product of both."""
        for masks, hashes, place in self.seeds:
            for mask in masks:
                at, h = seed_hashes(ids, mask)
                first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                at, first, last = at[last > first], first[last > first], last[last > first]
                ends = np.cumsum(last - first)
                for begin in range(0, int(ends[-1]) if len(ends) else 0, HITS_AT_ONCE):
                    flat = np.arange(begin, min(begin + HITS_AT_ONCE, int(ends[-1])))
                    owner = np.searchsorted(ends, flat, "right")
                    yield at[owner], place[last[owner] - (ends[owner] - flat)]

    def overlapping(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which hits lie in a stretch that is long and equal enough, within both texts."""
        item = np.searchsorted(self.starts, place, "right") - 1
        around = np.arange(-self.reach, self.reach + 1)
        mine, other = ids[at[:, None] + around], self.tokens[place[:, None] + around]
        equal = mine == other
        p, q = self.share.numerator, self.share.denominator
        some = np.flatnonzero(equal.sum(axis=1) * q >= self.need[item] * p)
        outside = (mine[some] == DOC_GAP) | (other[some] == ITEM_GAP)
        surplus = np.where(outside, -(10**9), np.where(equal[some], q - p, -p))
        sums = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(surplus, axis=1)], axis=1)
        need, good = self.need[item[some]], np.zeros(len(some), bool)
        for size in range(int(need.min()) if len(some) else 1, self.reach + 2):
            good |= (need <= size) & ((sums[:, size:] - sums[:, :-size]).max(axis=1) >= 0)
        return some[good]


def longest_stretch(equal: np.ndarray, share: Fraction) -> tuple[int, int]:
    """(length, equal tokens) of the longest stretch whose share of equal tokens is ``share`` or more; of several the one
    with most equal tokens."""
    p, q = share.numerator, share.denominator
    sums = np.concatenate(([0], np.cumsum(np.where(equal, q - p, -p))))
    highest = np.maximum.accumulate(sums[::-1])[::-1]  # from each place on; it falls, so the last place not below a sum is found by halving
    ends = np.searchsorted(-highest, -sums, "right") - 1
    sizes = ends - np.arange(len(sums))
    begin = np.flatnonzero(sizes == sizes.max())
    matched = np.concatenate(([0], np.cumsum(equal)))
    return int(sizes.max()), int((matched[ends[begin]] - matched[begin]).max())


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, masks: tuple, short_masks: tuple, least_tokens: int, similarity: float) -> Iterator[Broadcast]:
    """The items in blocks of bounded size, each built and sent when its pass begins."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS))
    items = items.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {blocks})"))
    for block in range(blocks):
        rows = [(r.item, r.text) for r in items.where(F.col("block") == block).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark(rows, masks, short_masks, least_tokens, similarity))


def _pass(df: DataFrame, held: Broadcast, text_col: str, overlaps_col: str) -> DataFrame:
    """``df`` with the overlaps with one block's items added to those in ``overlaps_col``."""
    names = df.columns
    text_at, made_at = names.index(text_col), names.index(overlaps_col)
    kind = to_arrow_type(df.schema[overlaps_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        for batch in batches:
            made, waiting, size = batch.column(made_at).to_pylist(), [], 0
            for row, text in enumerate(batch.column(text_at)):
                waiting.append((row, bench.ids(words(text.as_py()))))
                size += len(waiting[-1][1])
                if size > TOKENS_AT_ONCE or row + 1 == batch.num_rows:
                    for k, item, overlap, matched in _verified(bench, waiting):
                        made[k].append({"item": item, "overlap": overlap, "matched": matched})
                    waiting, size = [], 0
            columns = [*batch.columns[:made_at], pa.array(made, kind), *batch.columns[made_at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(df, run, df.schema)


def _verified(bench: Benchmark, docs: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """(row, item id, overlap, matched): the longest stretch of each document and item that overlap."""
    gap = np.full(bench.reach + 1, DOC_GAP, np.int64)
    ids = np.concatenate([gap, *(part for _, d in docs for part in (d, gap))])
    sizes = np.array([len(d) for _, d in docs], np.int64)
    starts = len(gap) + np.cumsum(sizes + len(gap)) - sizes - len(gap)
    found: set[tuple[int, int, int]] = set()
    for at, place in bench.hits(ids):
        good = bench.overlapping(ids, at, place)
        doc, item = np.searchsorted(starts, at[good], "right") - 1, np.searchsorted(bench.starts, place[good], "right") - 1
        found.update(zip(doc.tolist(), item.tolist(), (at[good] - place[good]).tolist(), strict=True))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for doc, item, shift in sorted(found):
        first = max(int(starts[doc]), int(bench.starts[item]) + shift)
        last = min(int(starts[doc] + sizes[doc]), int(bench.starts[item] + bench.sizes[item]) + shift)
        stretch = longest_stretch(ids[first:last] == bench.tokens[first - shift : last - shift], bench.share)
        best[doc, item] = max(best.get((doc, item), (0, 0)), stretch)
    return [(docs[doc][0], bench.names[item], *stretch) for (doc, item), stretch in sorted(best.items())]


def _with_none(df: DataFrame, benchmark: DataFrame, item_col: str, overlaps_col: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("overlap", T.IntegerType()), T.StructField("matched", T.IntegerType())]))
    return df.drop(overlaps_col).withColumn(overlaps_col, F.array().cast(kind))


def mark_overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    overlaps_col: str = "overlaps",
    least_tokens: int = 12,
    similarity: float = 0.8,
    masks: tuple[str, ...] = MASKS,
    short_masks: tuple[str, ...] = SHORT_MASKS,
) -> DataFrame:
    """``df`` with ``overlaps_col``: the items that each document overlaps with, as structs of the item's id
    (item), the tokens of the longest such stretch (overlap) and those of them that are equal (matched).

    Tokens are lower-cased runs of letters, digits and underscores. They overlap when an
    aligned stretch of ``least_tokens`` tokens (of a shorter item: all its tokens, five at
    least) or more, within both texts, has a share of equal tokens of ``similarity`` or
    more. With the masks and sizes given here none is missed; for other sizes choose the
    masks to fit. Null texts on either side count as empty and overlap with nothing, as do
    items of fewer than five tokens. A map over rows: repeated rows, null ids and an empty
    table need nothing; other columns pass unchanged (one named like ``overlaps_col`` is
    replaced). The benchmark goes out in blocks of bounded size, one pass of the documents
    after the other.
    """
    out = _with_none(df, benchmark, item_col, overlaps_col)
    for block, held in enumerate(_blocks(benchmark, item_col, item_text_col, masks, short_masks, least_tokens, similarity)):
        out = _pass(durable(out) if block else out, held, text_col, overlaps_col)
    return out


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_tokens: int = 12,
    similarity: float = 0.8,
    masks: tuple[str, ...] = MASKS,
    short_masks: tuple[str, ...] = SHORT_MASKS,
) -> DataFrame:
    """One row for each document and item that overlap: id, item, overlap, matched (see ``mark_overlaps``). Each block of
    the benchmark is a scan of its own, whose tasks hold that block only."""
    rows = _with_none(df.select(id_col, text_col), benchmark, item_col, "overlaps found")
    passes = [_pass(rows, held, text_col, "overlaps found") for held in _blocks(benchmark, item_col, item_text_col, masks, short_masks, least_tokens, similarity)]
    return reduce(DataFrame.union, [p.select(id_col, F.explode("overlaps found").alias("found")).select(id_col, "found.*") for p in passes])


def without_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **parameters) -> DataFrame:
    """``df`` without the documents that overlap with an item, columns unchanged."""
    return mark_overlaps(df, benchmark, text_col, **parameters, overlaps_col="overlaps found").where("size(`overlaps found`) = 0").select(*df.columns)
