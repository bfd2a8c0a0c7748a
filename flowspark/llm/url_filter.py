"""URL filters: a trie over reversed host labels, then path segments, longest match first.

A rule has an action (allow or block), a host and a path. It fits its host and all
subdomains if the URL's path starts with the rule's. The trie is broadcast when the
rules are counted to be few enough; beyond that the candidates of each URL (suffixes
of its host with prefixes of its path) are joined with the rules instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import lower_ascii, map_batches

MOST_RULES, MOST_BYTES = 200_000, 1 << 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both are
    empty for a null URL or one without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


class Trie:
    """Rules by reversed host labels, then path segments; the last piece of a rule's path is a prefix of a segment."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("host", label), {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("path", segment), {})
            rule = (action, host + path)
            ends = node.setdefault("ends", {})
            ends[last] = min(rule, ends.get(last, rule))  # of equal rules allow goes before block

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits: most host labels, then the longest path."""
        found, node = None, self.root
        segments = path.split("/")
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.get(("host", label))
                if node is None:
                    break
            below = node
            for segment in segments:
                ends = below.get("ends")
                if ends:
                    fits = next((ends[segment[:k]] for k in range(len(segment), -1, -1) if segment[:k] in ends), None)
                    found = fits or found
                below = below.get(("path", segment))
                if below is None:
                    break
        return found


def judge_by_trie(df: DataFrame, rules: list[tuple[str, str, str]], host_col: str, path_col: str) -> DataFrame:
    """``df`` with columns rule and action, null where no rule fits."""
    held = df.sparkSession.sparkContext.broadcast(Trie(rules))
    names = df.columns
    host_at, path_at = names.index(host_col), names.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            found = [trie.match(h.as_py() or "", p.as_py() or "") or (None, None) for h, p in zip(batch.column(host_at), batch.column(path_at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for _, r in found], pa.string()), pa.array([a for a, _ in found], pa.string())], [*names, "rule", "action"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "rule string", "action string"])
    return map_batches(df, run, schema)


def judge_by_join(df: DataFrame, rules: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """The same for any number of rules, as a join; a hot host's candidates are met once each, by distinct pair."""
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action"))
    lengths = rules.select(F.char_length("path").alias("n")).distinct()
    pairs = df.select(F.coalesce(host_col, F.lit("")).alias("h"), F.coalesce(path_col, F.lit("")).alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    candidates = pairs.withColumn("host", F.explode(F.array_distinct(suffixes))).join(F.broadcast(lengths) if lengths.count() < 10_000 else lengths, F.expr("n <= char_length(p)"))
    candidates = candidates.withColumn("path", F.expr("substring(p, 1, n)"))
    best = F.struct(F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("labels"), F.col("n"), F.concat("host", "path").alias("rule"), "action")
    found = candidates.join(rules, ["host", "path"]).groupBy("h", "p").agg(F.max(best).alias("best"))
    out = df.join(found, (F.coalesce(df[host_col], F.lit("")) == found["h"]) & (F.coalesce(df[path_col], F.lit("")) == found["p"]), "left")
    return out.select(*df.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", carry: tuple[str, ...] = (), most_rules: int = MOST_RULES) -> DataFrame:
    """One row per row of ``df``: carried columns, host, path, rule (null where none fits), verdict.

    ``rules`` has columns action, host, path (null host or path: empty, fits all). The
    longest rule wins: most host labels, then the longest path; of equal rules allow
    wins. Without a fitting rule the verdict is ``default``. A null URL or one without
    :// has empty host and path. Repeated rows each give a row, empty tables give an
    empty result or no rules; other columns are not read. The trie is broadcast if the rules
    are counted to be few and their texts short in sum; else they are joined. Carried
    columns may not have the names of those made.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(carry):
        raise ValueError(f"names of columns made here: {sorted(clash)}")
    host, path = host_and_path(F.col(url_col))
    rows = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], host.alias("host"), path.alias("path"))
    rules = rules.select("action", lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    many, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    few = many <= most_rules and size <= MOST_BYTES
    judged = judge_by_trie(rows, [tuple(r) for r in rules.collect()], "host", "path") if few else judge_by_join(rows, rules, "host", "path")
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
