"""Mixing sources to target weights: a min-cost flow of words from membership patterns to sources.

Documents may belong to several sources. Those of the same set of sources form a membership pattern, and only
patterns enter the flow: words go from a pattern to the sources of its documents, at most the quota of each
source. A pattern offers its words several times over; the k-th copy costs k - 1 a word, so costs are convex and no
document is repeated while another pattern still has words of fewer copies that could stand in.

All costs are on the arcs into patterns, so a shortest augmenting path costs what its first arc costs: the flow is
maximal within the first copies, then augmented within the second, and so on, re-routing earlier words where that
helps (successive shortest paths, a whole cost level at a time by blocking flows). Patterns whose only source has no
other pattern need no search and are solved as columns. The others are solved in one task: they are counted first
and refused beyond ``most_arcs``.

A pattern's words become documents by a seeded order: whole copies for all, then one more copy for the first ones of
the order, the last of which is cut. The order is that of a hash whose leading bits form 4,096 buckets; sums of buckets
tell where the cut falls, and only the rows of that one bucket are sorted.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import durable

#: Characters of a word: anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, BUCKET_BITS = 60, 12
#: Patterns (some 100 bytes each) that may be broadcast; more are joined, with each pattern's rows spread over salts.
MOST_BROADCAST, SALTS = 100_000, 64


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float, most_copies: int) -> DataFrame:
    """``sources`` (source, weight, source_size) with column target: shares of ``total`` by weight, none above
    ``most_copies`` times its source's size; what is cut off goes to the others by weight, until none is above.

    Each round reads two sums; a source once at its limit stays there.
    """
    limit = (F.col("source_size") * most_copies).cast("double")
    level, words = None, 0.0
    while True:
        share = F.lit(None).cast("double") if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1])
        above = F.lit(False) if level is None else share > limit
        got = sources.agg(F.sum(F.when(above, limit)).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        following = (float(total) - (got.c or 0.0), got.w or 0.0)
        if following == level or not following[1]:
            break
        level = following
    if level is None:  # no weight at all
        return sources.withColumn("target", F.lit(0.0))
    share = F.col("weight") * F.lit(level[0]) / F.lit(level[1])
    return sources.withColumn("target", F.least(share, limit))


def least_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], most_copies: int) -> dict[tuple[int, int], int]:
    """Words from pattern p to source s, by (p, s): as many as the quotas take, and of those flows one of least cost
    when the k-th copy of a pattern's words costs k - 1 each."""
    patterns, nodes = len(sizes), len(sizes) + len(quotas) + 2
    origin, sink = nodes - 2, nodes - 1
    heads: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            out[x].append(len(heads))
            heads.append(y)
            room.append(c)
        return len(heads) - 2

    entries = [arc(origin, p, 0) for p in range(patterns)]
    routes = {(p, s): arc(p, patterns + s, sum(quotas)) for p in range(patterns) for s in members[p]}
    for s, quota in enumerate(quotas):
        arc(patterns + s, sink, quota)

    def levels() -> list[int]:
        found = [-1] * nodes
        found[origin] = 0
        todo = deque([origin])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] and found[heads[e]] < 0:
                    found[heads[e]] = found[a] + 1
                    todo.append(heads[e])
        return found

    for _ in range(most_copies):
        for p, e in enumerate(entries):
            room[e] += sizes[p]
        while (rank := levels())[sink] >= 0:
            following = [0] * nodes
            path: list[int] = []
            a = origin
            while True:
                if a == sink:
                    pushed = min(room[e] for e in path)
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    path, a = [], origin
                while following[a] < len(out[a]):
                    e = out[a][following[a]]
                    if room[e] and rank[heads[e]] == rank[a] + 1:
                        break
                    following[a] += 1
                else:
                    if a == origin:
                        break
                    a = heads[path.pop() ^ 1]
                    following[a] += 1
                    continue
                path.append(e)
                a = heads[e]
    return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1]}


def route(patterns: DataFrame, quotas: DataFrame, most_copies: int = 3, most_arcs: int = 1_000_000) -> DataFrame:
    """(pattern, source, words): the flow from ``patterns`` (pattern array, size) to ``quotas`` (source, quota)."""
    arcs = patterns.select("pattern", "size", F.explode("pattern").alias("source"))
    shared = arcs.groupBy("source").agg(F.count(F.lit(1)).alias("patterns_"))
    quota = quotas.select("source", "quota")
    known = arcs.alias("a").join(quota.alias("q"), F.expr("a.source <=> q.source")).join(shared.alias("s"), F.expr("a.source <=> s.source"))
    known = durable(known.select("a.pattern", "a.source", "size", "quota", ((F.col("patterns_") == 1) & (F.size("a.pattern") == 1)).alias("alone")))
    alone = known.where("alone").select("pattern", "source", F.least("quota", F.col("size") * most_copies).alias("words"))
    meeting = known.where("not alone")
    number = meeting.count()
    if not number:
        return alone
    if number > most_arcs:
        raise ValueError(f"{number} memberships of patterns in sources meet in the flow, more than most_arcs = {most_arcs}")
    at = {f.name: f.dataType.simpleString() for f in known.schema.fields}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(key=[tuple(p) for p in rows["pattern"]])
        rows = rows.assign(order=[tuple((x is None, x or "") for x in k) for k in rows["key"]]).sort_values("order", kind="stable")
        keys = list(dict.fromkeys(rows["key"]))
        sources = sorted(set(rows["source"]), key=lambda x: (x is None, x or ""))
        of_key, of_source = {k: i for i, k in enumerate(keys)}, {s: i for i, s in enumerate(sources)}
        sizes, members, wanted = [0] * len(keys), [[] for _ in keys], [0] * len(sources)
        for key, source, size, quota in zip(rows["key"], rows["source"], rows["size"], rows["quota"], strict=True):
            sizes[of_key[key]] = int(size)
            members[of_key[key]].append(of_source[source])
            wanted[of_source[source]] = int(quota)
        flow = least_cost_flow(sizes, [sorted(m) for m in members], wanted, most_copies)
        made = [(list(keys[p]), sources[s], words) for (p, s), words in flow.items()]
        return pd.DataFrame(made, columns=["pattern", "source", "words"])

    solved = meeting.groupBy("alone").applyInPandas(solve, f"pattern {at['pattern']}, source string, words bigint")
    return alone.unionByName(durable(solved))


def mix_sources(
    df: DataFrame,
    weights: DataFrame,
    sources_col: str = "sources",
    id_cols: tuple[str, ...] = ("doc_id",),
    size_col: str = "size",
    share: float = 1.0,
    most_copies: int = 3,
    seed: int = 42,
    most_arcs: int = 1_000_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, flow) of a mix of ``share`` of all words of ``df``.

    ``df`` has ids, a size in words and its sources: a string or an array of strings (null is a source like any other;
    repeats in an array count once; an empty array, or a source without weight, is taken nothing for). ``weights``
    has (source, weight). documents: the id and size columns, pattern, and taken, the words of a row that the mix takes: at
    most ``most_copies`` times its size, repeats counted; the copy that fills a pattern's share is cut there. sources:
    weight, source_size, target (``targets``), quota (the target, rounded). flow: words by pattern and source.

    Null sizes count 0. Rows of equal ids are documents of their own; equal rows are interchangeable, so any order of them
    gives the same result. The same seed gives the same mix, however the table is partitioned. Columns of ``df`` other
    than those named are not read. An empty table gives empty results.
    """
    kind = df.schema[sources_col].dataType.typeName()
    array = F.array_sort(F.array_distinct(F.coalesce(sources_col, F.array().cast("array<string>")))) if kind == "array" else F.array(F.col(sources_col))
    ids = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols))
    draw = F.conv(F.substring(F.md5(ids), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = df.select(*(F.col(c).alias(f"id {k}") for k, c in enumerate(id_cols)), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), array.alias("pattern"), draw.alias("draw"))
    rows = durable(rows)

    buckets = rows.groupBy("pattern", F.shiftright("draw", HASH_BITS - BUCKET_BITS).cast("int").alias("bucket")).agg(F.sum("size").alias("words"))
    buckets = durable(buckets)
    patterns = durable(buckets.groupBy("pattern").agg(F.sum("words").alias("size")))
    total = (patterns.agg(F.sum("size")).first()[0] or 0) * share
    sizes = patterns.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = sizes.alias("s").join(weights.alias("w"), F.expr("s.source <=> w.source"))
    sources = durable(sized.select("s.source", F.col("weight").cast("double").alias("weight"), "source_size"))
    sources = durable(targets(sources, total, most_copies).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")))
    flow = durable(route(patterns, sources, most_copies, most_arcs))

    # Whole copies of each pattern, then the bucket in which the last copy ends, and what is left when it begins.
    given = flow.groupBy("pattern").agg(F.sum("words").alias("given"))
    plan = patterns.join(given, "pattern", "left").select("pattern", "size", F.coalesce("given", F.lit(0)).alias("given"))
    plan = plan.withColumn("copies", F.when(F.col("size") > 0, F.expr("given div size")).otherwise(F.lit(0))).withColumn("rest", F.col("given") - F.col("copies") * F.col("size"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("words")
    cut = buckets.withColumn("before", before).join(plan.select("pattern", "rest"), "pattern").where("before <= rest and rest < before + words")
    plan = plan.join(cut.select("pattern", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left")), "pattern", "left")
    plan = durable(plan.select("pattern", "copies", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("left", F.lit(0)).alias("left")))

    if plan.count() <= MOST_BROADCAST:
        planned = rows.join(F.broadcast(plan), "pattern")
    else:
        spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        planned = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int")).join(spread, ["pattern", "salt"]).drop("salt")
    bucket = F.shiftright("draw", HASH_BITS - BUCKET_BITS).cast("int")
    names = [f"id {k}" for k in range(len(id_cols))]
    sure = planned.where(bucket != F.col("cut")).withColumn("extra", F.when(bucket < F.col("cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("pattern").orderBy("draw", *names, "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("size").over(order) - F.col("size")
    edge = planned.where(bucket == F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - start)).cast("long"))
    taken = sure.unionByName(edge).select(*(F.col(n).alias(c) for n, c in zip(names, id_cols, strict=True)), F.col("size").alias(size_col), "pattern", (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
    return taken, sources, flow
