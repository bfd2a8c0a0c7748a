"""SimHash near-duplicates: tiled exact comparison of all fingerprints.

A fingerprint has one or more lanes of 64 bits (one hash seed each). Fingerprints are
laid out in tiles, pairs of tiles that cannot hold a link are skipped, and numpy takes
exclusive-or and bit counts of every fingerprint against every other in the remaining
pairs, so the result is exact. Three layouts:

* For a small radius, the bits are cut into ``blocks`` parts and fingerprints with the
  same population counts in all parts form a tile. Counts of two fingerprints at most
  ``radius`` bits apart differ by at most ``radius`` in sum; all other tile pairs are
  skipped. With 8 parts and radius 2 a fingerprint goes to at most 73 tiles, 16 bytes
  each, and meets some 1e-4 of the corpus; more parts make smaller tiles.
* For a wide radius, population counts exclude little. Tiles are then bands of the number
  of distinct shingles, whose pairs are skipped when the numbers alone rule the similarity
  of the sets out. Work grows with the square of the corpus.
* With an index, tiles are the rows that share a key made of two minima of the hashes of
  their sets (min-wise hashing). Sets of similarity s share one of k keys in all but
  (1 - s * s) ** k of cases, 5e-6 for 0.8 and twelve keys; sets with little in common never
  meet, so work grows with the corpus.

A tile that is counted to be large is cut into blocks that meet each other in tasks of
their own. A task emits a spanning forest of the links it finds, at most one edge for each
row it read rather than all pairs. Components come from the edges by large-star and
small-star rounds of joins and minima (Kiveris et al., 2014).

Where links are defined by the similarity of shingle sets, fingerprints only find
candidates: the sets of the rows that have one are compared exactly within each component
of candidates (``similar``), which again gives a spanning forest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_batches, map_texts, tidy_up
from flowspark.session import durable

WORDS_AT_ONCE = 1 << 16
#: Rows of a tile beyond which it is cut into blocks, and blocks at most.
TILE_ROWS, MOST_CUTS = 1 << 17, 1 << 12
#: Odd factors that reorder the hashes of a lane, so that each lane has as many minima, and rows beyond which a tile of the index is cut.
REORDERED, INDEX_ROWS = (1, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7), 1 << 13
#: Rows of a tile that is compared together with others.
FEW_ROWS = 32
#: Shingle hashes that a block of a component of candidates holds.
HASHES_A_BLOCK = 1 << 18
#: Rows of a table of keys that may be broadcast (some 30 bytes each).
MOST_BROADCAST = 200_000


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in parts; none without words, that of all words if they are fewer than ``width``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1 if words else 0, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - size + 1].tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
        yield np.fromiter((digest(x, seed) for x in shingles), np.uint64, len(shingles))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, width)]))


def index_keys(lanes: int) -> int:
    """The number of keys of the index that ``fingerprint`` makes with so many lanes."""
    return len(REORDERED) * lanes // 2


def fingerprint(text: str | None, width: int, seeds: tuple[int, ...] = (42,), distinct: bool = False, index: bool = False) -> tuple[int, ...]:
    """The number of word shingles, then a signed 64-bit SimHash of them for each seed; no words: zeros. With
    ``distinct`` each different shingle counts once, else every occurrence. With ``index`` keys of 38 bits follow, each
    made of two minima of different lanes."""
    if distinct:
        whole = shingle_set(text, width)
        parts = (whole[k : k + WORDS_AT_ONCE] for k in range(0, len(whole), WORDS_AT_ONCE))
    else:
        parts = shingle_hashes(text, width, seeds[0])
    ones, number = np.zeros(64 * len(seeds), np.int64), 0
    least = np.full((len(REORDERED), len(seeds)), 2**64 - 1, np.uint64)
    for hashes in parts:
        number += len(hashes)
        # Further lanes mix the first hash with their seed; they need no other pass over the text.
        mixed = np.stack([hashes, *(_mixed(hashes, seed) for seed in seeds[1:])])
        if index and len(hashes):
            least = np.minimum(least, [(mixed * np.uint64(factor)).min(axis=1) for factor in REORDERED])
        rows = np.ascontiguousarray(mixed.T).view(np.uint8)
        for at in range(0, len(rows), 255):  # as many ones as a byte can count
            ones += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    bits = np.packbits((2 * ones > number).reshape(len(seeds), 64), axis=1, bitorder="little")
    out = (number, *bits.view(np.int64)[:, 0].tolist())
    return (*out, *_paired(least.ravel()).tolist()) if index else out


def _paired(least: np.ndarray) -> np.ndarray:
    """Keys of 38 bits from the first half of the minima, each with its fellow of the second half and its number."""
    half = len(least) // 2
    first, second = least[:half], least[half : 2 * half]
    return (_mixed(_mixed(first, 1) + second * np.uint64(REORDERED[1]) + np.arange(half, dtype=np.uint64), 2) >> np.uint64(26)).astype(np.int64)


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of splitmix64 over hash and seed."""
    x = hashes + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, text_col: str, width: int, seeds: tuple[int, ...] = (42,), distinct: bool = False, index: bool = False) -> DataFrame:
    """``df`` with its text replaced by the columns shingles (their number; with ``distinct``: of different ones), f0,
    f1, ... (a lane for each seed) and with ``index`` k0, k1, ... (its keys)."""
    names = ["shingles", *(f"f{k}" for k in range(len(seeds))), *(f"k{k}" for k in range(index_keys(len(seeds)) if index else 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            values = [fingerprint(t.as_py(), width, seeds, distinct, index) for t in batch.column(at)]
            made = np.array(values, np.int64).reshape(-1, len(names))
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *(pa.array(made[:, k]) for k in range(len(names)))], [*(batch.schema.names[k] for k in rest), *names])

    kept = [f for f in df.schema.fields if f.name != text_col]
    return map_texts(df, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} bigint" for n in names)]))


def _neighbours(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """Changes of up to ``radius`` counts in sum, as lists of (part, change), each with its first change positive."""
    out = []
    for used in range(1, radius + 1):
        for parts in itertools.combinations(range(blocks), used):
            for steps in itertools.product([s for s in range(-radius, radius + 1) if s], repeat=used):
                if steps[0] > 0 and sum(map(abs, steps)) <= radius:
                    out.append(list(zip(parts, steps, strict=True)))
    return out


def _by_counts(fps: np.ndarray, blocks: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, probe): each fingerprint in its own cell and, as a probe, in the neighbouring cells above."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, edges[:-1], axis=1).astype(np.int64)
    sizes = np.diff(edges)
    weight = np.cumprod(np.concatenate(([1], sizes[:-1] + 1)))
    own = counts @ weight
    cells, rows = [own], [np.arange(len(fps))]
    for change in _neighbours(blocks, radius):
        fits = np.ones(len(fps), bool)
        for part, step in change:
            fits &= (counts[:, part] + step >= 0) & (counts[:, part] + step <= sizes[part])
        cells.append(own[fits] + sum(step * int(weight[part]) for part, step in change))
        rows.append(np.flatnonzero(fits))
    probe = np.repeat([0, 1], [len(fps), sum(map(len, rows)) - len(fps)])
    return np.concatenate(cells), np.concatenate(rows), probe


def _by_band(band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for bands: each row in its own and, as a probe, in the one above."""
    rows = np.arange(len(band))
    return np.concatenate([band, band + 1]), np.concatenate([rows, rows]), np.repeat([0, 1], len(band))


def _dealt(cell: np.ndarray, row: np.ndarray, probe: np.ndarray, fps: np.ndarray, cut: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and row numbers. A key is a cell, two of its blocks and, in the last bit, whether the row is a probe. The first
    block's rows are held and the second's pass by; in a tile of a block with itself, probes from other cells, too.
    ``cut`` has the cells of several blocks in order, ``cuts`` how many."""
    found = np.searchsorted(cut, cell)
    is_cut = (cut[np.minimum(found, len(cut) - 1)] == cell) if len(cut) else np.zeros(len(cell), bool)
    keys, rows = [cell[~is_cut] << 25 | probe[~is_cut]], [row[~is_cut]]
    many = cuts[found[is_cut]] if len(cut) else np.empty(0, np.int64)
    cell, row, probe = cell[is_cut], row[is_cut], probe[is_cut]
    mine = ((fps[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % np.maximum(many, 1)
    for k in range(int(many.max()) if len(many) else 0):
        at = np.flatnonzero(many > k)
        low, high = (np.where(probe[at] == 1, k, f(mine[at], k)) for f in (np.minimum, np.maximum))
        passes = (probe[at] == 1) | (mine[at] > k)
        keys.append(cell[at] << 25 | low << 13 | high << 1 | passes)
        rows.append(row[at])
    return np.concatenate(keys), np.concatenate(rows)


class _Forest:
    """Union-find over fingerprints; keeps the edges that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _meet(own: np.ndarray, others: np.ndarray, radius: int, forest: _Forest, step: int = 512) -> None:
    """Link own and other rows (a node id, then the lanes). Of a block's links, those between each other
    row and its first match and those between the matches of one row are enough."""
    for first, at in itertools.product(range(0, len(own), step), range(0, len(others), step)):
        block, other = own[first : first + step], others[at : at + step]
        left, right = other.view(np.uint64), block.view(np.uint64)  # bits of signed numbers would be those of their absolute value
        apart = np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
        for lane in range(2, own.shape[1]):
            apart = apart + np.bitwise_count(left[:, None, lane] ^ right[None, :, lane]).astype(np.uint16)
        rows, cols = np.nonzero(apart <= radius)
        if not len(rows):
            continue
        lead = cols[np.searchsorted(rows, rows)]
        star = np.unique(np.stack([lead, cols], axis=1)[lead != cols], axis=0)
        new = np.concatenate(([True], rows[1:] != rows[:-1]))
        for a, b in itertools.chain(block[star, 0].tolist(), zip(other[rows[new], 0].tolist(), block[cols[new], 0].tolist(), strict=True)):
            forest.link(a, b)


def _few(key: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, rows left): links in all tiles of FEW_ROWS rows at most that surely begin and end in this batch, and which rows
    are of other tiles or of blocks that meet others. ``key`` is in order."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(starts, len(key)))
    few = (n <= FEW_ROWS) & (key[starts] & ((1 << 25) - 1) == 0)
    few[[0, -1]] = False
    is_few, n = np.repeat(few, n), np.repeat(n, n)
    edges = [np.empty((0, 2), np.int64)]
    for far in range(1, int(n[is_few].max(initial=1))):
        at = np.flatnonzero(is_few[:-far] & (key[far:] == key[:-far]))
        near = np.bitwise_count((rows[at, 1:] ^ rows[at + far, 1:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= radius
        edges.append(np.stack([rows[at, 0], rows[at + far, 0]], axis=1)[near])
    return np.concatenate(edges), ~is_few


def links(nodes: DataFrame, radius: int, lanes: int, blocks: int = 8, ratio: float | None = None, least_cuts: int = 8, tile_rows: int = TILE_ROWS, keys: int = 0) -> DataFrame:
    """Edges (a, b) between node ids that connect the nodes within ``radius`` bits, by way of others: exactly those
    without ``ratio``; with it, all whose numbers are within the ratio, and none beyond the radius; with ``keys`` (the
    columns k0, k1, ... of an index, so many) all that share a key, and none beyond the radius.

    ``nodes`` has columns node, shingles, f0, f1, ... (shingles: a number that bounds the
    similarity, such as that of distinct shingles). Without ``ratio`` tiles are by
    population counts (one lane), with it by that number: then texts whose numbers differ
    by more than that ratio need not be linked. Tiles of more than ``tile_rows`` rows are
    cut into blocks, bands of more than 1,024 rows into ``least_cuts`` at least, which
    spreads the comparisons over tasks. A block is held in memory; copies are one node.
    """
    names = ["node", *(f"f{k}" for k in range(lanes))]
    # Bands of numbers within the ratio; texts within it are in one band or in two that follow each other.
    band = F.lit(0) if ratio is None else F.floor(F.log(F.greatest("shingles", F.lit(1))) / F.lit(-float(np.log(ratio))))
    if keys:
        nodes, counted = _sharing(nodes, names, keys)
    else:
        nodes = nodes.select(band.cast("long").alias("band"), *names)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1 + len(names))]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_band, *values = columns(batch)
            cell = _by_counts(values[1], blocks, 0)[0] if ratio is None else at_band
            cell, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    if keys:
        most = tile_rows = min(tile_rows, INDEX_ROWS)
    else:
        counted = map_batches(nodes, sizes, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        most = tile_rows if ratio is None else min(tile_rows, 1024)
    # Some 100 bands at most, or one row for each tile_rows rows.
    large = counted.where(F.col("n") > most).orderBy("cell").collect()
    cut = np.array([r.cell for r in large], np.int64)
    cuts = np.array([min(MOST_CUTS, max(1 if ratio is None else least_cuts, -(-r.n // tile_rows))) for r in large], np.int64)

    def cells(at_band: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if keys:
            return at_band, np.arange(len(at_band)), np.zeros(len(at_band), np.int64)
        return _by_counts(fps, blocks, radius) if ratio is None else _by_band(at_band)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                at_band, *values = columns(batch.slice(at, 4096))
                key, row = _dealt(*cells(at_band, values[1]), values[1], cut, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(v[row]) for v in values)], ["key", *names])

    def runs(batches: Iterator[pa.RecordBatch], edges: list[tuple[int, int]]) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(tile, whether they are probes, rows), in parts. With an index, links of small tiles go to ``edges`` at once."""
        for batch in batches:
            key, *values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            rows = np.stack(values, axis=1)
            if keys and len(key):
                found, left = _few(key, rows, radius)
                edges += map(tuple, found.tolist())
                key, rows = key[left], rows[left]
            ends = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(ends):
                if a < b:
                    k = int(key[a])
                    yield k >> 1, bool(k & 1), rows[a:b]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty((0, len(names)), np.int64)
        tile, own, forest, found, at_once = None, nothing, _Forest(), [], []
        for at, is_probe, rows in itertools.chain(runs(batches, at_once), [(None, False, nothing)]):
            if at != tile:
                found += forest.edges + at_once
                at_once.clear()
                if len(found) > 50_000 or (at is None and found):
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    found = []
                tile, own, forest = at, nothing, _Forest()
            with_itself = tile is not None and tile >> 12 & 4095 == tile & 4095
            if len(own) and (is_probe or with_itself):
                _meet(own, rows, radius, forest)
            if not is_probe and len(rows):
                if with_itself:
                    _meet(rows, rows, radius, forest)
                own = np.concatenate([own, rows])

    schema = ", ".join(f"{n} bigint" for n in ["key", *names])
    spread_out = map_batches(nodes, spread, schema)
    spread_out = spread_out.repartition(F.expr("shiftright(key, 1)")).sortWithinPartitions("key", "node")
    return map_batches(spread_out, compare, "a bigint, b bigint").where("a <> b").distinct()


def _sharing(nodes: DataFrame, names: list[str], keys: int) -> tuple[DataFrame, DataFrame]:
    """(band, node, lanes) for each key that a node shares with another, the band being the key; and (cell, n), the shared
    keys. Keys alone are counted and matched, lanes meet those of them that are shared."""
    held = nodes.select("node", F.explode(F.array(*(f"k{k}" for k in range(keys)))).alias("cell"))
    counted = durable(held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = held.join(counted.select("cell"), "cell").join(nodes.select(*names), "node")
    return shared.select(F.col("cell").alias("band"), *names), counted


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node of its component."""
    stars = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        # Both sides of each join are plain tables, so that adaptive execution can split a hub's rows.
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = durable(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        stars = durable(small.where("a <> b").distinct())
        tidy_up(stars.sparkSession)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 2,
    seeds: tuple[int, ...] = (42,),
    blocks: int = 8,
    ratio: float | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``df``: id, carried columns, fingerprint (16 hex digits a lane), component_id.

    Null or empty texts have fingerprint zero and are linked like any other. Rows with
    equal fingerprints (with ``ratio``: and equal numbers of distinct shingles) are one
    node, however many they are, so a group of copies costs one. component_id is the
    smallest id in the component; null ids are ignored in it unless there is no other. An
    empty table gives an empty result; other columns are not read.
    """
    lanes = [f"f{k}" for k in range(len(seeds))]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    marked, nodes = _nodes(source, F.col("id"), width, seeds, ratio is not None)
    rooted = _rooted(nodes, components(links(nodes, radius, len(seeds), blocks, ratio)))
    grouped = durable(rooted.groupBy("root").agg(F.min("least").alias("component")))
    labelled = durable(rooted.join(grouped, "root").select("node", "component"))
    out = marked.join(labelled, "node")
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)],
        F.concat(*(F.lower(F.lpad(F.hex(f), 16, "0")) for f in lanes)).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _nodes(source: DataFrame, order: Column, width: int, seeds: tuple[int, ...], distinct: bool, index: bool = False) -> tuple[DataFrame, DataFrame]:
    """``source`` with fingerprints and node in place of its text, and a row for each node with its least ``order``."""
    lanes = [f"f{k}" for k in range(len(seeds))]
    keys = [f"k{k}" for k in range(index_keys(len(seeds)) if index else 0)]
    node = F.xxhash64("shingles", *lanes) if distinct else F.col("f0") if len(seeds) == 1 else F.xxhash64(*lanes)
    marked = durable(fingerprints(source, "text", width, seeds, distinct, index).withColumn("node", node))
    return marked, durable(marked.groupBy("node").agg(F.min(order).alias("least"), F.min("shingles").alias("shingles"), *(F.first(f).alias(f) for f in lanes + keys)))


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, least, root) of all nodes."""
    return durable(nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))


def single_linkage(nodes: list[int], sets: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """Edges that connect exactly the nodes whose sets have a similarity (common elements over all) of ``similarity`` or
    more, by way of others: from the smallest node of each component to its others. Each node is met once, and then
    compared with those that no one has met."""
    p, q = similarity.numerator, similarity.denominator
    order = sorted(range(len(nodes)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    names = np.array([nodes[k] for k in order], np.int64)
    numbers = np.unique(np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in order)]), return_inverse=True)[1].astype(np.int32)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(int(numbers.max()) + 1 if len(numbers) else 1, bool)
    # Those not met yet, in order of size, with their elements one after the other.
    left, left_sizes, left_first, elements, met, waiting = np.arange(len(order)), sizes, first, numbers, np.zeros(len(order), bool), []
    start, edges, tree = 0, [], []
    while True:
        if not waiting:
            least = min(tree, default=0)
            edges += [(least, x) for x in tree if x != least]
            while start < len(order) and met[start]:
                start += 1
            if start == len(order):
                return edges
            met[start] = True
            waiting.append(start)
            tree = [int(names[start])]
        x = waiting.pop()
        if 2 * np.count_nonzero(met[left]) > len(left):
            keep = ~met[left]
            elements = elements[np.repeat(keep, left_sizes)]
            left, left_sizes = left[keep], left_sizes[keep]
            left_first = np.cumsum(left_sizes) - left_sizes
        low, high = np.searchsorted(left_sizes * q, sizes[x] * p, "left"), np.searchsorted(left_sizes * p, sizes[x] * q, "right")
        if low >= high or not sizes[x]:
            continue
        mine = numbers[first[x] : first[x] + sizes[x]]
        mark[mine] = True
        common = np.add.reduceat(mark[elements[left_first[low] : left_first[high - 1] + left_sizes[high - 1]]], left_first[low:high] - left_first[low], dtype=np.int64)
        mark[mine] = False
        near = left[low:high][(common * (p + q) >= (sizes[x] + left_sizes[low:high]) * p)]
        near = near[~met[near]]
        met[near] = True
        waiting += near.tolist()
        tree += names[near].tolist()


def similar(clusters: DataFrame, width: int, similarity: Fraction, hashes_a_block: int = HASHES_A_BLOCK) -> DataFrame:
    """Edges (a, b) that connect the nodes of a cluster whose shingle sets are similar, compared exactly.

    ``clusters`` has columns root, parts, node, text: a cluster is dealt to ``parts``
    blocks, each of which meets itself and the others; a task holds two blocks' sets. A
    node that comes more than once counts once.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            made = []
            for root, parts, node, text in zip(*batch.columns, strict=True):
                root, parts, node = root.as_py(), parts.as_py(), node.as_py()
                if node in seen:
                    continue
                seen.add(node)
                mine = (node * 0x9E3779B97F4A7C15 >> 13) % parts
                data = shingle_set(text.as_py(), width).tobytes()
                made += [(root, min(mine, k), max(mine, k), node, data) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["root", "i", "j", "node", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, {}
        for batch in itertools.chain(batches, [None]):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, 0, 0, 0, b"")]
            for root, i, j, node, data in rows:
                if (root, i, j) != at:
                    edges = single_linkage(list(members), list(members.values()), similarity)
                    if edges:
                        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], ["a", "b"])
                    at, members = (root, i, j), {}
                members[node] = np.frombuffer(data, np.uint64)

    rows = map_texts(clusters.select("root", "parts", "node", "text"), sets, "root bigint, i int, j int, node bigint, data binary")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return map_texts(rows, compare, "a bigint, b bigint").distinct()


def keep_one_of_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, slack: float = 4.0) -> DataFrame:
    """``df`` without all but one row of each group of near copies, columns unchanged.

    Near copies are linked by a similarity (common elements over all) of their sets of
    ``width``-word shingles of ``similarity`` or more; a text of fewer words is one
    shingle, texts without words are copies of each other. Candidates are pairs that share a
    key of the index and whose 512-bit SimHashes of the sets are within the radius expected
    at that similarity, widened by ``slack`` standard deviations of it; each component of candidates is then compared
    exactly, so no row goes without a chain of real links. The row with the smallest id
    stays, null ids last; of rows with that id, the one with the smallest hash of its text;
    of rows that repeat id and text, one. A row stays or goes by its own text: others with
    its id (or without one, too) don't count.
    """
    lanes = tuple(range(42, 50))
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    radius = int(64 * len(lanes) * share + slack * np.sqrt(64 * len(lanes) * share * (1 - share)))
    hashes = lambda: (F.xxhash64(text_col), F.hash(text_col))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(n) for h, n in zip(hashes(), "hg", strict=True)))
    marked, nodes = _nodes(source, F.struct(F.isnull("id").alias("none"), "id", "h", "g"), width, lanes, True, index=True)
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"]) & (a["g"] == b["g"])
    h, g = hashes()

    def meet(rows: DataFrame, how: str, columns: list[Column] | None = None) -> DataFrame:
        """``df`` joined with a table of ids and hashes, which is broadcast if it is counted to be small."""
        few = F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows
        joined = df.join(few, df[id_col].eqNullSafe(rows["id"]) & (h == rows["h"]) & (g == rows["g"]), how)
        return joined.select(*columns) if columns else joined

    candidates = components(links(nodes, radius, len(lanes), keys=index_keys(len(lanes)))).join(nodes.select("node", "least.id", "least.h", "least.g", "shingles"), "node")
    candidates = durable(candidates)
    parts = durable(candidates.groupBy("root").agg(F.ceil(F.sum("shingles") / HASHES_A_BLOCK).cast("int").alias("parts")))
    candidates = durable(candidates.join(parts, "root").select("id", "h", "g", "root", F.greatest("parts", F.lit(1)).alias("parts"), "node"))
    clusters = meet(candidates, "inner", [candidates["root"], candidates["parts"], candidates["node"], df[text_col].alias("text")])
    linked = durable(similar(clusters, width, Fraction(similarity).limit_denominator(10_000)))
    if parts.where("parts > 1").isEmpty():  # each cluster was compared in one task, whose edges lead to a tree's smallest node
        found = linked.select(F.col("b").alias("node"), F.col("a").alias("root")).union(linked.select("a", "a").distinct())
    else:
        found = components(linked)
    rooted = _rooted(nodes, found)
    tidy_up(df.sparkSession)
    kept = durable(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.h", "least.g"))
    keys = marked.groupBy("id", "h", "g").count()
    # Rows that repeat id and text can't be told apart; all others are chosen by the join alone.
    several = durable(kept.join(keys.where("count > 1").drop("count"), same(kept, keys), "left_semi"))
    gone = durable(keys.select("id", "h", "g").join(kept, same(keys, kept), "left_anti"))
    if several.isEmpty():
        return meet(gone, "left_anti")
    once = meet(several, "left_semi").withColumn("h of text", h).withColumn("g of text", g).dropDuplicates([id_col, "h of text", "g of text"])
    return meet(durable(gone.union(several)), "left_anti").unionByName(once.select(*df.columns))
