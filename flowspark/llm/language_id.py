"""Language identification by Bayesian fusion of evidence.

log P(language | row) = text likelihood + P(declared language | language)
+ P(address suffix | language) + host prior, up to a constant.

* Text: hashed byte trigrams of the words, naive Bayes, fitted on a bounded sample of
  labelled rows; the sum is tempered, since trigrams of a text are far from independent.
* Beside the languages there is a class for everything else, whose trigrams are the
  sample's bytes drawn one by one. A row is rejected where its posterior wins.
* Declared markup language and address suffix: smoothed tables of soft counts (each
  row's posterior by its text alone), by grouped aggregation over all rows.
* Host prior: soft counts by host, smoothed towards its domain's, those towards the
  whole corpus's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_texts
from flowspark.session import durable

GRAMS = 1 << 16
#: Bytes of words: letters and everything beyond ASCII; all else separates words.
LETTER = np.array([b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def letters(text: str | None) -> np.ndarray:
    """The bytes of the lower-cased words, a space before and after each."""
    data = LETTER[np.frombuffer((" " + (text or "") + " ").lower().encode("utf-8", "surrogatepass"), np.uint8)]
    space = data == 0x20
    return data[~(space & np.concatenate(([False], space[:-1])))]


def _numbers(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers below GRAMS of byte trigrams."""
    a, b, c = (x.astype(np.uint32) for x in (a, b, c))
    return ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(16)


def grams(text: str | None) -> np.ndarray:
    """Numbers of the trigrams of the words."""
    data = letters(text)
    return _numbers(data[:-2], data[1:-1], data[2:]) if len(data) >= 3 else np.empty(0, np.uint32)


def chance(bytes_seen: np.ndarray) -> np.ndarray:
    """P(trigram) when bytes are drawn one by one from the 256 counts; trigrams that can't come up share a thousandth."""
    used = np.flatnonzero(bytes_seen)
    p = bytes_seen[used] / max(1, bytes_seen.sum())
    out = np.full(GRAMS, 0.001 / GRAMS)
    for a, share in zip(used, p, strict=True):
        numbers = _numbers(np.full(1, a), used[:, None], used[None, :])
        out += np.bincount(numbers.ravel(), (share * np.outer(p, p)).ravel(), GRAMS)
    return out / out.sum()


def sample_of(labelled: DataFrame, label_col: str, rows_a_label: int, seed: int = 7) -> DataFrame:
    """A random sample of expected ``rows_a_label`` rows of each label (all of a label that has fewer)."""
    counts = labelled.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()  # one row a language
    shares = {r[0]: min(1.0, rows_a_label / r["count"]) for r in counts}
    return labelled.sampleBy(label_col, shares, seed) if shares else labelled.limit(0)


def fit(sample: DataFrame, text_col: str, label_col: str, strength: float = 1000.0, margin: float = 1.0) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table of log P(trigram | class): a column for each language, then that of everything
    else. Languages are smoothed towards ``chance``, worth ``strength`` trigrams. Everything else is ``chance``,
    a ``margin`` less likely at each trigram (natural logarithm), so that it takes a text that clearly fits no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str | None, np.ndarray] = {None: np.zeros(256, np.int64)}
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                if label.as_py() not in sums:
                    sums[label.as_py()] = np.zeros(GRAMS, np.int64)
                sums[label.as_py()] += np.bincount(grams(text.as_py()), minlength=GRAMS)
                sums[None] += np.bincount(letters(text.as_py()), minlength=256)
            for label, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "gram", "n"])

    counts = map_texts(sample.where(F.col(label_col).isNotNull()).select(text_col, F.col(label_col).cast("string")), run, "label string, gram int, n bigint")
    rows = counts.groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()  # languages times GRAMS at most; without a label, bytes
    label, gram, n = np.array(rows["label"].to_pylist(), object), rows["gram"].to_numpy(), rows["n"].to_numpy()
    labels = sorted(set(label) - {None})
    seen = np.bincount(gram[label == None], n[label == None], 256)  # noqa: E711
    table = np.stack([np.bincount(gram[label == x], n[label == x], GRAMS) for x in labels], axis=1) if labels else np.zeros((GRAMS, 0))
    drawn = chance(seen)
    table = np.log((table + strength * drawn[:, None]) / (table.sum(axis=0) + strength))
    return labels, np.concatenate([table, (np.log(drawn) - margin)[:, None]], axis=1).astype(np.float32)


def text_evidence(df: DataFrame, text_col: str, table: np.ndarray, cap: float) -> DataFrame:
    """``df`` with its text replaced by t0, t1, ... (tempered log-likelihoods) and best (how much likelier a trigram is
    in the best language than in the last class, on average; null without letters)."""
    held = df.sparkSession.sparkContext.broadcast(table)  # GRAMS rows, whatever the data
    many = table.shape[1]
    made = [f"t{k}" for k in range(many)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out, best = np.zeros((batch.num_rows, many)), []
            for row, text in enumerate(batch.column(at)):
                found = grams(text.as_py())
                if not len(found):
                    best.append(None)
                    continue
                mean = weights[found].mean(axis=0, dtype=np.float64)
                out[row] = mean * (len(found) / (1 + len(found) / cap))
                best.append(float(mean[:-1].max() - mean[-1]))
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *(pa.array(out[:, k]) for k in range(many)), pa.array(best, pa.float64())], [*(batch.schema.names[k] for k in rest), *made, "best"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text_col]
    return map_texts(df, run, ", ".join([*kept, *(f"{m} double" for m in made), "best double"]))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def _joined(df: DataFrame, small: DataFrame, key: str, most_rows: int = 100_000) -> DataFrame:
    """Left join with a table that is broadcast only if it is counted to be small."""
    small = durable(small)
    return df.join(F.broadcast(small) if small.count() <= most_rows else small, key, "left")


def identify(
    df: DataFrame,
    labels: list[str],
    table: np.ndarray,
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    cap: float = 60.0,
    smoothing: float = 5.0,
    rest: float = 0.01,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``df``: carried columns, language, confidence (its posterior), text_fit, rejected.

    ``table`` has a column for each language and one for everything else, whose prior is
    ``rest`` before any row is seen and which takes part in all evidence like a language. A
    row is rejected, with language null, when its text has no letters or everything else
    has the largest posterior; without any language every row is. text_fit is the
    average advantage of the best language at a trigram. Null text counts as empty. Null
    evidence counts as none; a null host takes its domain's or the corpus's prior. Ties go
    to the language first in order. Repeated rows each give a row, an empty table an empty
    result; other columns are not read.
    """
    n = len(labels) + 1
    start = [(1 - rest) / max(1, n - 1)] * (n - 1) + [rest]
    nothing = F.lit(None).cast("string")
    if not labels:
        unknown = F.lit(None).cast("double")
        return df.select(*carry, nothing.alias("language"), unknown.alias("confidence"), unknown.alias("text_fit"), F.lit(True).alias("rejected"))
    evidence = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}
    source = df.select(
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)],
        F.col(text_col).alias("text"),
        *[(nothing if c is None else F.lower(c.cast("string"))).alias(name) for name, c in evidence.items()],
    )
    rows = text_evidence(source, "text", table, cap)
    soft = [F.when(F.col("best").isNull(), F.lit(0.0)).otherwise(p).alias(f"p{k}") for k, p in enumerate(_softmax([F.col(f"t{k}") + float(np.log(start[k])) for k in range(n)]))]
    rows = durable(rows.select("*", *soft))
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(n)]
    whole = rows.agg(*sums).first()
    total = sum(whole[f"s{k}"] or 0.0 for k in range(n))
    share = [((whole[f"s{k}"] or 0.0) + n * start[k]) / (total + n) for k in range(n)]
    score = [F.col(f"t{k}") for k in range(n)]

    for name in ("declared", "suffix"):
        if evidence[name] is None:
            continue
        # P(value | language) over P(value): a value seen rarely says little.
        counts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(*sums)
        every = reduce(lambda a, b: a + b, [F.col(f"s{k}") for k in range(n)])
        lifts = [F.log((F.col(f"s{k}") + smoothing * share[k]) / ((every + smoothing) * share[k])).alias(f"{name}{k}") for k in range(n)]
        rows = _joined(rows, counts.select(name, *lifts), name)
        score = [s + F.coalesce(f"{name}{k}", F.lit(0.0)) for k, s in enumerate(score)]

    if host is None and domain is None:
        prior = [F.lit(x) for x in share]
    else:
        every = reduce(lambda a, b: a + b, [F.col(f"s{k}") for k in range(n)])
        domains = rows.where("domain is not null").groupBy("domain").agg(*sums)
        domains = durable(domains.select("domain", *[((F.col(f"s{k}") + smoothing * share[k]) / (every + smoothing)).alias(f"d{k}") for k in range(n)]))
        hosts = rows.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain"), *sums)
        hosts = hosts.join(domains, "domain", "left")
        above = [F.coalesce(f"d{k}", F.lit(share[k])) for k in range(n)]
        hosts = durable(hosts.select("host", *[((F.col(f"s{k}") + smoothing * above[k]) / (every + smoothing)).alias(f"h{k}") for k in range(n)]))
        # The host tables may be of any size, a host may hold a third of all rows: both sides are plain, for adaptive execution to split.
        spread = F.coalesce("host", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
        rows = rows.withColumn("host_key", spread).join(hosts.withColumnRenamed("host", "host_key"), "host_key", "left")
        prior = [F.coalesce(f"h{k}", F.lit(share[k])) for k in range(n)]

    score = [s + F.log(p) for s, p in zip(score, prior, strict=True)]
    posterior = F.array(*_softmax(score))
    out = rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], posterior.alias("post"), F.col("best").alias("text_fit"))
    top = F.array_max("post")
    place = F.array_position("post", top).cast("int")
    rejected = F.col("text_fit").isNull() | (place == n)
    return out.select(
        *carry,
        F.when(~rejected, F.element_at(F.array(*map(F.lit, [*labels, ""])), place)).alias("language"),
        F.when(~rejected, top).alias("confidence"),
        "text_fit",
        rejected.alias("rejected"),
    )


TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_text(html: Column) -> Column:
    """The text of a page without tags, scripts and comments."""
    return F.regexp_replace(F.regexp_replace(html, TAGS, " "), "&[#a-zA-Z0-9]{1,31};", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html tag, or null."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.when(found != "", F.lower(found))


def host_of(url: Column) -> Column:
    """Host without user and port, lower-cased; null without one."""
    found = F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source", rows_a_label: int = 400, most_rows: int = 100_000) -> DataFrame:
    """``df`` without the rows that ``identify`` rejects, columns unchanged.

    The classifier is fitted on a sample of the rows that have a label; without any
    label nothing can be judged and all rows stay. A row is known by its id (null
    included) and its text.
    """
    labels, table = fit(sample_of(df, label_col, rows_a_label), text_col, label_col)
    if not labels:
        return df
    judged = identify(
        df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"), F.col(host_col).alias("host")),
        labels, table, host=F.col("host"), carry=("id", "digest"),
    )
    gone = durable(judged.where("rejected").select(F.col("id").alias("gone_id"), "digest").distinct())
    gone = F.broadcast(gone) if gone.count() <= most_rows else gone
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_col) == gone["digest"]), "left_anti")
