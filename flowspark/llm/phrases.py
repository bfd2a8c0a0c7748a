"""Phrase collocations by suffix-sigma (Berberich and Bedathur, "Computing n-gram statistics in MapReduce", 2013).

Every word of a text starts a suffix, cut after ``most_words`` words or at the end of its piece. A task counts equal
suffixes of its batches before they are shuffled by language and first word. Each partition is sorted in reverse
lexicographic order, so that all suffixes with a common beginning come together, and one pass with one stack, an open
prefix for each number of words, counts every prefix: a prefix is done when the next suffix doesn't begin with it.

A first word with a large share of all words would overload its partition. Words are counted first (equal words of a
batch as one row), and the suffixes of such a word are dealt to several partitions by their second word: prefixes of two
words and more stay whole, only those of one word are then added up. There are at most ``4 * parts`` such words, because each
has more than one in ``4 * parts`` of all words, so their table is broadcast.

Keys are binary: language and words, each after the first preceded by a zero byte. No byte is smaller, so what shares
its first words stands together in byte order; zero bytes of texts are escaped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import map_batches
from flowspark.session import durable

#: Classes of bytes: 0 ends a piece, 1 separates words, 2 belongs to a word.
ENDS_PIECE, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text whose suffixes are counted together; words that a partition should hold.
BYTES_AT_ONCE, WORDS_A_PART = 1 << 24, 1 << 21
RANK_SALTS = 64

_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(ENDS_PIECE)] = 0
_CLASS[list(BETWEEN)] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data`` up to each end, as one array."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words_in(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of ``texts``, A-Z lower-cased, zero bytes escaped; the piece and the text of each."""
    if any(b"\x00" in t or b"\x01" in t for t in texts):
        texts = [t.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = _CLASS[data]
    inside = kind == 2
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    stops = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    pieces = np.cumsum(kind == 0, dtype=np.int64)[starts]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return _binary(data[inside], np.cumsum(stops - starts)), pieces, np.searchsorted(text_ends, starts, side="right")


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*parts, b"\x00", null_handling="skip")


def _in_batches(rows: DataFrame, count, schema: str) -> DataFrame:
    """``count(texts, langs)`` over stretches of some BYTES_AT_ONCE of the texts, whole texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
                texts.append(whole)
                langs.append((lang.as_py() if lang.is_valid else "und").encode("utf-8", "surrogatepass").replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01"))
                size += len(whole)
                if size >= BYTES_AT_ONCE:
                    yield from count(texts, langs)
                    texts, langs, size = [], [], 0
        if texts:
            yield from count(texts, langs)

    return map_batches(rows, run, schema)


def _numbered(texts: list[bytes], langs: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Distinct words in byte order, each occurrence's number among them, its piece; distinct languages, each occurrence's."""
    words, pieces, of_text = words_in(texts)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names = sorted(set(langs))
    at = {name: k for k, name in enumerate(names)}
    lang = np.array([at[x] for x in langs], np.int64)[of_text]
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], pieces, pa.array(names, pa.binary()), lang


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` in order and how often each occurs."""
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in sorted_], np.diff(np.append(at, len(order)))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of ``rows`` (lang, text), as binary keys."""

    def count(texts: list[bytes], langs: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, number, _, names, lang = _numbered(texts, langs)
        (lang, number), n = _distinct([lang, number])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), words.take(pa.array(number)), pa.array(n)], ["lang", "word", "n"])

    return _in_batches(rows, count, "lang binary, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _placed(keys: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(keys.to_pylist(), object), categorize=False) if len(keys) else np.empty(0, np.uint64)


def suffixes(rows: DataFrame, most_words: int, parts: int, salts: dict[tuple[bytes, bytes], int]) -> DataFrame:
    """(part, key, n): distinct suffixes of each stretch of text and how often they occur, with the partition they go to."""
    held = rows.sparkSession.sparkContext.broadcast(salts)

    def count(texts: list[bytes], langs: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, number, pieces, names, lang = _numbered(texts, langs)
        columns = [lang, number]
        for k in range(1, most_words):
            following = np.full(len(number), -1, np.int64)  # -1: the piece ends before
            if len(number) > k:
                following[:-k] = np.where(pieces[k:] == pieces[:-k], number[k:], -1)
            columns.append(following)
        (lang, *numbers), n = _distinct(columns)
        first, of_first = np.unique(lang * len(words) + numbers[0], return_inverse=True)
        hashes = _placed(_joined([names.take(pa.array(first // len(words))), words.take(pa.array(first % len(words)))])) if len(words) else np.empty(0, np.uint64)
        place = hashes[of_first]
        spread = np.array([held.value.get((names[a].as_py(), words[b].as_py()), 0) for a, b in zip((first // max(1, len(words))).tolist(), (first % max(1, len(words))).tolist(), strict=True)] if held.value else [0] * len(first), np.uint64)[of_first]
        hot = np.flatnonzero(spread)
        if len(hot) and most_words > 1:
            second, of_second = np.unique(numbers[1][hot], return_inverse=True)
            salted = _placed(words.take(pa.array(np.where(second < 0, 0, second))))[of_second] % spread[hot]
            place[hot] += np.where(numbers[1][hot] < 0, np.uint64(0), salted)
        place %= np.uint64(parts)
        for at in range(0, len(n), 1 << 16):
            cut = slice(at, at + (1 << 16))
            key = [names.take(pa.array(lang[cut]))] + [words.take(pa.array(x[cut], mask=x[cut] < 0)) for x in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(place[cut].astype(np.int32)), _joined(key), pa.array(n[cut])], ["part", "key", "n"])

    return _in_batches(rows, count, "part int, key binary, n bigint")


def _prefixes(keys: pa.Array, most_words: int) -> list[tuple[np.ndarray, pa.Array]]:
    """For each number of words: the keys that have as many, and their beginnings of language and so many words."""
    data = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] is not None else np.empty(0, np.uint8)
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    zeros = np.flatnonzero(data[offsets[0] : offsets[-1]] == 0) + offsets[0]
    before = np.searchsorted(zeros, offsets[:-1])
    here = np.searchsorted(zeros, offsets[1:]) - before
    out = []
    for k in range(1, most_words + 1):
        mine = np.flatnonzero(here >= k)
        cut = before[mine] + k
        stops = np.where(here[mine] > k, zeros[np.minimum(cut, max(0, len(zeros) - 1))] if len(zeros) else 0, offsets[1:][mine])
        starts = offsets[:-1][mine]
        sizes = stops - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        out.append((mine, _binary(data[at], ends)))
    return out


def prefix_counts(sorted_rows: DataFrame, most_words: int, least: int, salted: set[bytes]) -> DataFrame:
    """(key, words, n): the prefixes of partitions sorted by key that occur ``least`` times, and all one-word ones in ``salted``."""
    held = sorted_rows.sparkSession.sparkContext.broadcast(salted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, int] | None] = [None] * most_words  # the open prefix of each number of words

        def closed(k: int, keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
            kept = [(key, n) for key, n in zip(keys, counts, strict=True) if n >= least or (k == 0 and key in held.value)]
            columns = [pa.array([x for x, _ in kept], pa.binary()), pa.array([k + 1] * len(kept), pa.int32()), pa.array([n for _, n in kept], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["key", "words", "n"])

        for batch in batches:
            n = batch.column(1).to_numpy()
            for k, (mine, prefixes) in enumerate(_prefixes(batch.column(0), most_words)):
                if not len(mine):
                    continue
                changes = np.concatenate(([0], np.flatnonzero(pc.not_equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)) + 1))
                sums = np.add.reduceat(n[mine], changes)
                opened = prefixes[0].as_py()
                if stack[k] is not None and stack[k][0] == opened:
                    sums[0] += stack[k][1]
                elif stack[k] is not None:
                    yield closed(k, [stack[k][0]], [stack[k][1]])
                done = sums[:-1] >= least if k else np.ones(len(sums) - 1, bool)
                yield closed(k, prefixes.take(pa.array(changes[:-1][done])).to_pylist(), sums[:-1][done].tolist())
                stack[k] = (prefixes[int(changes[-1])].as_py(), int(sums[-1]))
        for k, entry in enumerate(stack):
            if entry is not None:
                yield closed(k, [entry[0]], [entry[1]])

    return map_batches(sorted_rows.select("key", "n"), run, "key binary, words int, n bigint")


def phrase_counts(df: DataFrame, text_col: str, lang_col: str, most_words: int, least: int, words_a_part: int = WORDS_A_PART) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase array, f) of all phrases of one to ``most_words`` words that occur ``least`` times, and (lang, n)."""
    spark = df.sparkSession
    rows = df.select(lang_col, text_col)
    words = durable(word_counts(rows))
    totals = durable(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // words_a_part))
    fair = max(1, total // (4 * parts))
    hot = words.where(F.col("n") > fair).collect()  # fewer than 4 * parts rows, as their counts add up to the total at most
    salts = {(bytes(r.lang), bytes(r.word)): -(-r.n // fair) for r in hot}
    dealt = suffixes(rows, most_words, parts, salts).repartitionById(parts, "part").sortWithinPartitions(F.col("key").desc())
    found = prefix_counts(dealt, most_words, least, {a + b"\x00" + b for a, b in salts})
    found = found.groupBy("key", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[_unescaped(x) for x in key.split(b"\x00")] for key in batch.column(0).to_pylist()]
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1:] for k in keys], pa.list_(pa.string())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    lang = totals.select("lang", "n").mapInArrow(_plain_langs, "lang string, n bigint")
    return durable(map_batches(found.select("key", "f"), plain, "lang string, phrase array<string>, f bigint")), lang


def _unescaped(word: bytes) -> str:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01").decode("utf-8", "surrogatepass")


def _plain_langs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_unescaped(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["lang", "n"])


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10, swallowed_percent: int = 50, most: int = 2000, words_a_part: int = WORDS_A_PART
) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts, A-Z lower-cased, are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs into words. A
    phrase of 2 to ``most_words`` words inside one piece that occurs a >= ``least`` times (overlaps counted) is a candidate.
    Cut after its first k words, its parts occur l and r times, and score is 1,000,000 a a / (l r), rounded down; the cut of
    the lowest score counts, the smallest k of equal ones. A candidate inside a longer candidate that occurs at least
    ``swallowed_percent`` percent as often is dropped, also where the longer one is dropped itself. Order is score and a
    descending, then the phrase's UTF-8 bytes. n: all words of the language.

    Null text is empty, null language ``und``. Every row counts, repeated ones again. Other columns are not read. Arithmetic is
    in decimals of 38 digits, enough for phrases up to 1e16 times; beyond, it fails instead of rounding. An empty table gives
    no rows.
    """
    counts, totals = phrase_counts(df, text_col, lang_col, most_words, least, words_a_part)
    candidates = counts.where(F.size("phrase") > 1)

    # Candidates inside longer ones: for each contiguous part of a longer one, how often the most frequent such one occurs.
    size = F.size("phrase")
    spans = F.expr("""flatten(transform(sequence(2, size(phrase) - 1), m -> transform(sequence(1, size(phrase) - m + 1), i -> slice(phrase, i, m))))""")
    inner = candidates.where(size > 2).select("lang", F.explode(spans).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * swallowed_percent))

    # Parts are joined afterwards: every cut of a candidate with the counts of its two parts. A part is one row of counts;
    # where many candidates share it, AQE splits their side of the join.
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(phrase, 1, k)"), "rest": F.expr("slice(phrase, k + 1, size(phrase) - k)")})
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(38,0)") * big("a") * big("a")).withColumn("under", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("cast(top div under as bigint)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= most)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
