import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowspark.llm import mixing, queries
from flowspark.llm.mixing import least_cost_flow, mix_sources, targets, words_of
from tests.oracle import connect, same


def best_flow(sizes, members, quotas, most_copies):
    """All integer flows: (most words, least cost of such)."""
    arcs = [(p, s) for p in range(len(sizes)) for s in members[p]]
    best = None
    for words in itertools.product(*(range(min(quotas[s], most_copies * sizes[p]) + 1) for p, s in arcs)):
        out, into = [0] * len(sizes), [0] * len(quotas)
        for (p, s), n in zip(arcs, words, strict=True):
            out[p] += n
            into[s] += n
        if any(n > most_copies * size for n, size in zip(out, sizes, strict=True)) or any(n > q for n, q in zip(into, quotas, strict=True)):
            continue
        cost = sum(sum(k for k in range(most_copies) for _ in range(min(max(0, n - k * size), size))) for n, size in zip(out, sizes, strict=True))
        if best is None or (-sum(out), cost) < best:
            best = (-sum(out), cost)
    return -best[0], best[1]


def test_flow_is_largest_and_cheapest():
    r = random.Random(1)
    for _ in range(60):
        patterns, sources = r.randint(1, 3), r.randint(1, 3)
        sizes, quotas = [r.randint(0, 3) for _ in range(patterns)], [r.randint(0, 5) for _ in range(sources)]
        members = [sorted(r.sample(range(sources), r.randint(1, min(2, sources)))) for _ in range(patterns)]
        flow = least_cost_flow(sizes, members, quotas, 2)
        out = [sum(n for (p, _), n in flow.items() if p == k) for k in range(patterns)]
        into = [sum(n for (_, s), n in flow.items() if s == k) for k in range(sources)]
        assert all(s in members[p] for p, s in flow) and all(n <= q for n, q in zip(into, quotas, strict=True)) and all(n <= 2 * z for n, z in zip(out, sizes, strict=True))
        cost = sum(max(0, n - size) for n, size in zip(out, sizes, strict=True))
        assert (sum(out), cost) == best_flow(sizes, members, quotas, 2)


def test_flow_takes_back_what_it_gave():
    """The first pattern serves both sources; what it gave to one must move to the other for all to be used once."""
    assert least_cost_flow([10, 10], [[0, 1], [0]], [10, 10], 3) == {(0, 1): 10, (1, 0): 10}


def test_query_and_sql(spark, sf_dir):
    same(queries.op12_mixing(spark, sf_dir), connect(sf_dir), queries.OP12_SQL)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


EDGE = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, None, None, None, None), (None, "one two", "en", None, 7), (3, "", "en", "y", 0), (4, "w " * 5000, "en", "z", 9), (5, " \t\n", "en", "z", 3), (6, "é b c", "en", "ü", 4), (6, "ten", "en", "ü", 3)]


def test_query_on_odd_rows(spark, tmp_path):
    documents(spark, EDGE).write.parquet(f"{tmp_path}/documents.parquet")

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(queries.op12_mixing(spark, str(tmp_path)), con, queries.OP12_SQL)
    rows = queries.op12_mixing(spark, str(tmp_path)).collect()
    assert len(rows) == len(EDGE) and all(r.taken <= 3 * r["size"] for r in rows) and {r["size"] for r in rows} == {0, 1, 2, 3, 5000}


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_mixing(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("few", [100_000, 0])
def test_overlapping_sources(spark, monkeypatch, few):
    """Patterns of several sources: quotas are met by documents that belong there, within three copies, whatever the partitions."""
    monkeypatch.setattr(mixing, "MOST_BROADCAST", few)
    r = random.Random(2)
    names = ["a", "b", "c", None]
    rows = [(k, r.sample(names, r.randint(1, 3)) if k % 7 else [], r.randint(0, 50)) for k in range(600)] + [(k, ["d"], 5) for k in range(600, 640)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    weights = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 1.0), (None, 2.0), ("d", 3.0), ("unused", 9.0)], "source string, weight double")
    taken, sources, flow = mix_sources(df, weights)
    got = {t.doc_id: t for t in taken.collect()}
    assert len(got) == 640 and all(0 <= t.taken <= 3 * t["size"] for t in got.values())
    assert all(t.taken == 0 for t in got.values() if not t.pattern)
    into, out = {}, {}
    for f in flow.collect():
        assert f.source in f.pattern
        into[f.source] = into.get(f.source, 0) + f.words
        out[tuple(f.pattern)] = out.get(tuple(f.pattern), 0) + f.words
    quotas = {s.source: s for s in sources.collect()}
    assert into == {k: s.quota for k, s in quotas.items()} and set(quotas) == {"a", "b", "c", None, "d"}
    assert quotas["d"].target == 600 and abs(quotas["a"].target / quotas["b"].target - 5) < 1e-9  # d stops at three times its size
    by_pattern = {}
    for t in got.values():
        by_pattern[tuple(t.pattern)] = by_pattern.get(tuple(t.pattern), 0) + t.taken
    assert {k: v for k, v in by_pattern.items() if v} == out
    again = mix_sources(df.repartition(7), weights)[0]
    assert {t.doc_id: t.taken for t in again.collect()} == {k: t.taken for k, t in got.items()}
    other = mix_sources(df, weights, seed=43)[0]
    assert {t.doc_id: t.taken for t in other.collect()} != {k: t.taken for k, t in got.items()}


def test_too_many_patterns(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["b"], 1)], "doc_id long, sources array<string>, size long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    with pytest.raises(ValueError, match="most_arcs"):
        mix_sources(df, weights, most_arcs=2)


def test_shares_are_given_to_the_others(spark):
    table = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 1), ("c", 2.0, 100), ("d", 1.0, 0)], "source string, weight double, source_size long")
    got = {r.source: r.target for r in targets(table, 111, 3).collect()}
    assert got["b"] == 3 and got["d"] == 0 and got["a"] == 30 and abs(got["c"] - 78) < 1e-9


def test_words(spark):
    texts = [None, "", " a  b\tc\x0b\x0cd\r\ne ", "  \x85", "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.n for r in df.orderBy("k").select(words_of(F.col("t")).alias("n")).collect()] == [0, 0, 5, 2, 1]
