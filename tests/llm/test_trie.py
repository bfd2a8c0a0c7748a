import hashlib
import random
import zlib

import duckdb
import pytest

from flowspark.llm import ordering, queries, trie
from flowspark.llm.trie import conversation_trie
from tests.oracle import connect, rows_of, same

SCHEMA = "conv_id long, turn long, role string, text string, lang string, words string"


def plainly(convs):
    """The trie of {id: [(role, text), ...]}, node by node."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        words = lambda n: len(n[-1][1].split()) if n else 0
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        saved = sum((len(nodes[n]) - 1) * words(n) for n in below)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, convs):
    rows = [(c, k, role, text, "x", None) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def branching(seed, n):
    r = random.Random(seed)
    pool = [("user", "one"), ("user", "one two"), ("assistant", "one"), ("system", "")]
    return {c * 7 - 50: [r.choice(pool[: 1 + k % 4]) for k in range(r.choice([1, 2, 3, 5, 9]))] for c in range(n)}


def test_against_a_plain_trie(spark):
    for seed, n in ((1, 3), (2, 60), (3, 250)):
        convs = branching(seed, n)
        assert got(conversation_trie(table(spark, convs))) == plainly(convs)


def test_hot_keys_and_blocks(spark, monkeypatch):
    """One conversation with most turns, one beginning with most conversations; small blocks and low limits cross their edges."""
    monkeypatch.setattr(ordering, "HOT_ROWS", 20)
    monkeypatch.setattr(ordering, "HOT_KEYS", 20)
    r = random.Random(4)
    convs = {c: [("user", "same")] * r.choice([1, 1, 2, 30]) + [("user", f"{c % 3} x")] * (c % 2) for c in range(120)}
    convs[500] = [("user", "same")] * 700
    df = table(spark, convs)
    assert got(conversation_trie(df)) == plainly(convs)
    turns = trie.numbered_turns(df)
    lengths = turns.groupBy("conv_id").count().withColumnRenamed("count", "turns")
    rows = turns.withColumnRenamed("pos", "depth").join(lengths, "conv_id")
    monkeypatch.setattr(trie, "BLOCK", 16)
    small = trie.prefix_trie(rows, lengths.where("turns = 0"), block=16, ids_a_block=8)
    assert got(small) == plainly(convs)


def test_null_and_repeated_rows(spark):
    rows = [(1, None, "user", "b", None, ""), (1, 0, None, None, None, ""), (1, 0, None, None, None, ""), (2, None, "user", "b", "", ""), (None, 1, "user", "lost", "", ""), (3, 2, "user", "y" * 200_000, "", "")]
    convs = {1: [("user", "b"), ("", ""), ("", "")], 2: [("user", "b")], 3: [("user", "y" * 200_000)]}
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plainly(convs)
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("ids", [range(0, 90), range(5, 60, 3), [7], [40]])
def test_query_rebuilds(spark, tmp_path, ids):
    """Short bases, absent bases, conversations that become turnless."""
    r = random.Random(6)
    rows = [(c, None if k == 0 and c % 5 == 0 else k, r.choice(["user", None]), r.choice(["a b", "c", None, "d " * 5])) for c in ids for k in range(r.choice([1, 2, 3, 6]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got(df) == plainly(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same(df, con, queries.OP13_SQL)


def test_query_and_sql(spark, sf_dir):
    df = queries.op13_prefix_trie(spark, sf_dir)
    same(df, connect(sf_dir), queries.OP13_SQL)
    assert {t for _, t in df.dtypes} == {"bigint", "string"} and sum(rows_of(df).values()) > 0


def test_positions_run_over_partitions(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(10**6), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, k long")
    want, count = {}, {}
    for key, _, k in sorted(rows):
        count[key] = count.get(key, 0) + 1
        want[k] = count[key]
    assert {x.k: x.n for x in ordering.positions(df, "n", ["key"], ["at", "k"]).collect()} == want
    assert sorted(x.n for x in ordering.positions(df, "n", [], ["at", "k"]).collect()) == list(range(1, 3001))
