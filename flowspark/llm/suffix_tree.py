"""LM scoring with a probabilistic suffix tree over words.

The tree's contexts are sequences of up to ``depth`` words ("The Power of Amnesia", Ron,
Singer and Tishby, 1996). Level by level, sequences of one word more are counted over all
training texts; every sequence seen ``least`` times or more counts, at every size of the
corpus. A context is retained if its next-symbol distribution differs from that of its
longest retained suffix: twice its count times the divergence must be above the Bayesian
information criterion's charge for its symbols. Levels are added until one retains no
context. Distributions are smoothed by absolute discounting towards the suffix's, down to
the base distribution over all words. A token is scored by the longest suffix state of its
history.

The logarithm of model over base probability is a sum over levels: at each retained
context the share left to its suffix, and where the sequence itself is known, the
difference that makes. So the tree is a table (sequence, weight) and a text's score the sum
of the weights of its sequences of 1, 2, ... words. Sequences are known by 64-bit hashes.

The table grows with the corpus and never is in one place: it is made by joins and
aggregates, dealt to buckets by hash, and texts send their sequences to the buckets, packed
in blobs. A bit array of fixed size and the most frequent sequences (a fixed number at
most) go out by broadcast; they only save sending what has no weight or is everywhere.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_batches, map_texts, settled, tidy_up
from flowspark.session import durable

END = b"\n"  # no word has a newline
DISCOUNT = 0.75
FILTER_BITS = 27
TOKENS_AT_ONCE = 1 << 19
KEYS_A_BUCKET = 1 << 18


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text (null: empty text) mod 5 is 1."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _hash_long(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8-byte numbers, as Spark's xxhash64 takes it of a long."""
    u = np.uint64
    one, two, three, four, five = (u(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: v << u(k) | v >> u(64 - k)
    h = np.asarray(seed).astype(np.int64).view(u) + (five + u(8))
    h = turn(h ^ turn(x.view(u) * two, 31) * one, 27) * one + four
    h = (h ^ h >> u(33)) * two
    h = (h ^ h >> u(29)) * three
    return (h ^ h >> u(32)).view(np.int64)


def sequence_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a sequence from those of all but its last and all but its first word: xxhash64(context, suffix) in SQL."""
    return _hash_long(suffix, _hash_long(context, np.full(1, 42)))


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


class Table:
    """Numbers of distinct keys from 0 to 2**62, by open addressing; -1 for other keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.numbers = np.full(1 << self.bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            at, who = at[free], todo[free]
            first = np.unique(at, return_index=True)[1]
            self.keys[at[first]], self.numbers[at[first]] = keys[who[first]], who[first]
            todo = todo[self.numbers[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.numbers[slot], -1)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = slot[todo]
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.numbers[at[hit]]
            todo = todo[~hit & (self.keys[at] != -1)]
        return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, keys of the words of some texts, where each text begins) in parts of some tokens."""
    first, flat, starts = 0, [], []
    for row, text in enumerate(batch.column(column)):
        starts.append(len(flat))
        flat += tokens(text.as_py())
        if len(flat) >= TOKENS_AT_ONCE or row + 1 == batch.num_rows:
            yield first, word_keys(flat), np.array(starts, np.int64)
            first, flat, starts = row + 1, [], []


def levels(keys: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sequences of 1, 2, ... ``most`` words: where they end, and their keys at all places (what stands in others has no meaning)."""
    place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    yield np.arange(len(keys)), keys
    for size in range(2, most + 1):
        keys = np.concatenate([keys[:1], sequence_key(keys[:-1], keys[1:])])
        yield np.flatnonzero(place >= size - 1), keys


class Bits:
    """A Bloom filter over keys: a key one of whose bits is not set was not put in."""

    SHIFTS = (0, 20, 37)

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> Bits:
        """``keys`` has the column key. The filter has a fixed size; when it fills up it only lets more through."""
        places = F.array(*(F.shiftrightunsigned("key", k).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for k in cls.SHIFTS))
        found = keys.select(F.explode(places).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(1 << FILTER_BITS - 6, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return cls(words)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in self.SHIFTS:
            place = (keys.view(np.uint64) >> np.uint64(k)).astype(np.int64) & ((1 << FILTER_BITS) - 1)
            out &= (self.words[place >> 6] >> (place & 63) & 1).astype(bool)
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """(key, n) over the texts in the only column, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > 300_000:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word_keys(list(seen))), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    return map_texts(training, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def sequence_counts(training: DataFrame, size: int, held: Broadcast | None) -> DataFrame:
    """(context, suffix, n): how often each sequence of ``size`` words comes, if both may be among the keys of ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, much = [], 0
        for batch in batches:
            for _, keys, starts in _texts(batch, 0):
                (at, below), (ends, own) = list(levels(keys, starts, size))[-2:]
                if held is not None:
                    may = held.value.may_have(below)
                    ends = ends[may[ends] & may[ends - 1]]
                waiting.append((own[ends], below[ends - 1], below[ends]))
                much += len(ends)
                if much > 1 << 20:
                    yield out(waiting)
                    waiting, much = [], 0
        yield out(waiting)

    def out(waiting: list[tuple]) -> pa.RecordBatch:
        own, context, suffix = (np.concatenate([np.empty(0, np.int64), *(w[k] for w in waiting)]) for k in range(3))
        _, first, n = np.unique(own, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(context[first]), pa.array(suffix[first]), pa.array(n.astype(np.int64))], ["context", "suffix", "n"])

    return map_texts(training, run, "context bigint, suffix bigint, n bigint").groupBy("context", "suffix").agg(F.sum("n").alias("n"))


def grown(found: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences of ``found`` (context, suffix, n) with key, n, base, ratio and weight, and the retained contexts
    (key, n, weight). ``below`` has the same for the sequences of a word less; ratio is that of the model to the base
    probability of a sequence's last word after the others."""
    found = settled(found)
    contexts = below.select(F.col("key").alias("context"), F.col("n").alias("times"))
    suffixes = below.select(F.col("key").alias("suffix"), "base", F.col("ratio").alias("before"))
    rows = found.join(contexts, "context").join(suffixes, "suffix")
    rows = settled(rows.select(F.xxhash64("context", "suffix").alias("key"), "context", "n", "times", "base", "before"))
    own, other = F.col("n") / F.col("times"), F.least(F.col("before") * F.col("base"), F.lit(1.0))
    sums = rows.groupBy("context").agg(
        F.max("times").alias("times"), F.count(F.lit(1)).alias("symbols"), F.sum(own).alias("mass"), F.sum(other).alias("mass_before"),
        F.sum(own * F.log(own / other)).alias("gained"), F.sum((F.col("n") - DISCOUNT) / F.col("times")).alias("taken"),
    )
    left = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(1e-12), 1 - F.col(c)))
    divergence = F.col("gained") + F.when(F.col("mass") < 1 - 1e-12, left("mass") * F.log(left("mass") / left("mass_before"))).otherwise(0.0)
    retained = sums.where(2 * F.col("times") * divergence > F.col("symbols") * F.log("times")).select("context", "times", (1 - F.col("taken")).alias("rest"))
    retained = durable(retained)
    rows = rows.drop("times").join(retained, "context", "left")
    ratio = F.coalesce(F.col("rest") * F.col("before") + (F.col("n") - DISCOUNT) / F.col("times") / F.col("base"), F.col("before"))
    weight = F.coalesce(F.log10(ratio) - F.log10("before") - F.log10("rest"), F.lit(0.0))
    rows = settled(rows.select("key", "n", "base", ratio.alias("ratio"), weight.alias("weight")))
    return rows, retained.select(F.col("context").alias("key"), F.col("times").alias("n"), F.log10("rest").alias("weight"))


def tree(training: DataFrame, depth: int, least: int) -> tuple[DataFrame, int, int]:
    """(key, n, base, gain) of all sequences that weigh something, the number of training tokens and that of distinct ones.
    base is what a known word adds to an unknown one's logarithm, gain the model's over the base distribution."""
    words = settled(word_counts(training))
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    none = F.lit(0.0)
    weights = words.select("key", "n", F.log10((F.col("n") + 0.5) / 0.5).alias("base"), none.alias("gain"))
    below = words.select("key", "n", ((F.col("n") + 0.5) / F.lit(n + 0.5 * (distinct + 1))).alias("base"), F.lit(1.0).alias("ratio")).where(F.col("n") >= least)
    for size in range(2, depth + 2):
        held = training.sparkSession.sparkContext.broadcast(Bits.of(below))
        rows, retained = grown(sequence_counts(training, size, held).where(F.col("n") >= least), below)
        if retained.isEmpty():
            break
        for part in (rows.where("weight <> 0"), retained):
            weights = weights.union(part.select("key", "n", none, "weight"))
        below = rows
    return settled(weights.groupBy("key").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("gain").alias("gain"))), n, distinct


class Frequent:
    """Weights of the most frequent sequences."""

    def __init__(self, rows: pa.Table) -> None:
        self.table = Table(rows["key"].to_numpy().astype(np.int64))
        self.base, self.gain = rows["base"].to_numpy(), rows["gain"].to_numpy()


def _most_frequent(weights: DataFrame, most: int) -> DataFrame:
    """(key, base, gain) of the sequences above a power of two that no more than ``most`` reach."""
    sizes = {r.p: r.m for r in weights.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("m")).collect()}
    power, held = 63, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= most:
        power, held = power - 1, held + sizes.get(power - 1, 0)
    return weights.where(F.col("n") >= 2**power).select("key", "base", "gain")


#: Rows that meet in a bucket (weights, then sequences of a part of the texts, then the texts' own rows), and the parts' sums.
KINDS = ("part bigint", "bucket int", "kind int", "doc int", "apart boolean", "n_tokens bigint", "known bigint", "base double", "gain double", "a binary", "b binary", "c binary")
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _rows(many: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of the columns given; the others are null."""
    kinds = {"id": id_type} | {name: ARROW[kind] for name, kind in (k.split() for k in KINDS)}
    return pa.RecordBatch.from_arrays([columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], kind) if n in columns else pa.nulls(many, kind) for n, kind in kinds.items()], list(kinds))


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(value of ``by``, kind, rows) of sorted rows, in parts."""
    for batch in batches:
        key, kind = batch.column(by).to_numpy(), batch.column("kind").to_numpy()
        ends = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(key)]
        for a, b in itertools.pairwise(ends):
            if a < b:
                yield int(key[a]), int(kind[a]), batch.slice(a, b - a)


def _numbers(rows: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows.column(column))])


def score_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept_out: Column | None = None,
    depth: int = 2,
    least: int = 4,
    frequent: int = 1 << 19,
) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learnt from the rows that ``kept_out`` (by default ``held_out``) is not
    true for; every row is scored. Scores are log10 probabilities of the whole text
    with its end; base_score is by smoothed counts of single words, score by the tree.
    Null text counts as empty: its only token is the end. Repeated rows are learnt from
    and scored once each. Without training rows every word is unknown. An empty table
    gives an empty result; other columns are not read. ``frequent`` only bounds what tasks
    hold to send less: the most frequent sequences, so many at most.
    """
    if id_col in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"):
        raise ValueError(f"{id_col} is the name of a column made here")
    spark = df.sparkSession
    apart = F.coalesce(held_out(F.col(id_col)) if kept_out is None else kept_out, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), apart.alias("apart"), F.col(text_col).alias("text"))
    weights, n, distinct = tree(rows.where("not apart").select("text"), depth, least)
    tidy_up(spark)
    unknown = float(np.log10(0.5 / (n + 0.5 * (distinct + 1))))
    top = spark.sparkContext.broadcast(Frequent(_most_frequent(weights, frequent).toArrow()))
    held = spark.sparkContext.broadcast(Bits.of(weights))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weights.count() // KEYS_A_BUCKET))
    id_kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {id_kind}", *KINDS])
    bucket_of = lambda keys: (keys.view(np.uint64) >> np.uint64(24)).astype(np.int64) % buckets

    def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        yield from zip(names.tolist(), np.split(order, first[1:]), strict=True) if len(names) else ()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bits = top.value, held.value
        part = TaskContext.get().partitionId() << 24
        for batch in batches:
            id_type = batch.column(0).type
            for first, keys, starts in _texts(batch, 2):
                many = len(starts)
                owner = np.repeat(np.arange(many, dtype=np.int32), np.diff(np.append(starts, len(keys))))
                known, base, gain = (np.zeros(many, kind) for kind in (np.int64, np.float64, np.float64))
                sent, sent_doc = [], []
                for size, (at, own) in enumerate(levels(keys, starts, depth + 1)):
                    own, doc = own[at], owner[at]
                    number = frequent.table.find(own)
                    hit = number >= 0
                    base += np.bincount(doc[hit], frequent.base[number[hit]], many)
                    gain += np.bincount(doc[hit], frequent.gain[number[hit]], many)
                    known += np.bincount(doc[hit], minlength=many) if size == 0 else 0
                    rest = np.flatnonzero(~hit)
                    rest = rest[bits.may_have(own[rest])]
                    sent.append(own[rest])
                    sent_doc.append(doc[rest])
                source = batch.slice(first, many)
                yield _rows(many, id_type, id=source.column(0), apart=source.column(1), part=np.full(many, part), bucket=np.full(many, part % buckets), kind=np.full(many, 2), doc=np.arange(many), n_tokens=np.bincount(owner, minlength=many), known=known, base=base, gain=gain)
                own, doc = np.concatenate(sent), np.concatenate(sent_doc)
                made = [(bucket, own[at].tobytes(), doc[at].tobytes()) for bucket, at in by_bucket(own)]
                yield _rows(len(made), id_type, part=np.full(len(made), part), bucket=[m[0] for m in made], kind=np.full(len(made), 1), a=[m[1] for m in made], b=[m[2] for m in made])
                part += 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *values = (batch.column(k).to_numpy() for k in range(3))
            made = [(bucket, keys[at].tobytes(), *(v[at].tobytes() for v in values)) for bucket, at in by_bucket(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int32() if k == 0 else pa.binary()) for k in range(4)], ["bucket", "a", "b", "c"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, table, base, gain = None, [], None, None, None
        sums: dict[int, np.ndarray] = {}  # of the parts met so far, handed on when they grow large

        def flushed() -> Iterator[pa.RecordBatch]:
            for part, own in sums.items():
                docs = np.flatnonzero(own.any(axis=0))
                yield _rows(1, id_type, part=[part], kind=[0], a=[docs.astype(np.int32).tobytes()], b=[own[:, docs].tobytes()])
            sums.clear()

        for bucket, kind, rows in _runs(batches, "bucket"):
            id_type = rows.column("id").type
            if bucket != at:
                at, blobs, table = bucket, [], None
            if kind == 0:
                blobs.append([_numbers(rows, c, t) for c, t in (("a", np.int64), ("b", np.float64), ("c", np.float64))])
            elif kind == 2:
                yield rows
            else:
                if table is None:
                    keys, base, gain = (np.concatenate([np.empty(0, t), *(b[k] for b in blobs)]) for k, t in enumerate((np.int64, np.float64, np.float64)))
                    table, blobs = Table(keys), []
                for part, own, doc in zip(rows.column("part").to_pylist(), rows.column("a"), rows.column("b"), strict=True):
                    number, doc = table.find(np.frombuffer(own.as_buffer(), np.int64)), np.frombuffer(doc.as_buffer(), np.int32)
                    doc, number = doc[number >= 0], number[number >= 0]
                    if len(doc):
                        many = int(doc.max()) + 1
                        found, own = np.stack([np.bincount(doc, x, many) for x in (base[number], gain[number], base[number] > 0)]), sums.get(part, np.zeros((3, 0)))
                        if own.shape[1] < many:
                            own = np.concatenate([own, np.zeros((3, many - own.shape[1]))], axis=1)
                        own[:, :many] += found
                        sums[part] = own
                if sum(x.nbytes for x in sums.values()) > 1 << 25:
                    yield from flushed()
        yield from flushed()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((3, 0))
        for part, kind, rows in _runs(batches, "part"):
            if part != at:
                at, sums = part, np.zeros((3, 0))
            if kind == 0:
                for a, b in zip(rows.column("a"), rows.column("b"), strict=True):
                    docs, values = np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.float64).reshape(3, -1)
                    if len(docs) and docs[-1] >= sums.shape[1]:
                        sums = np.concatenate([sums, np.zeros((3, int(docs[-1]) + 1 - sums.shape[1]))], axis=1)
                    sums[:, docs] += values
            else:
                doc = rows.column("doc").to_numpy()
                have = np.zeros((3, len(doc)))
                within = doc < sums.shape[1]
                have[:, within] = sums[:, doc[within]]
                n_tokens = rows.column("n_tokens").to_numpy()
                base = n_tokens * unknown + rows.column("base").to_numpy() + have[0]
                gain = rows.column("gain").to_numpy() + have[1]
                known = rows.column("known").to_numpy() + np.rint(have[2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("apart"), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(base + gain)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    sent = map_texts(rows, send, schema)
    packed = map_batches(weights.select("key", "base", "gain"), pack, "bucket int, a binary, b binary, c binary").withColumn("kind", F.lit(0))
    met = sent.unionByName(packed, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "kind")
    met = map_texts(met, look_up, schema).repartition("part").sortWithinPartitions("part", "kind", "doc")
    out = map_texts(met, sum_up, f"id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
