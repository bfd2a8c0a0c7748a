import duckdb
import numpy as np

import __spark_entry__ as entry
from flowspark.llm import line_dedup
from flowspark.llm.line_dedup import PerfectHash, Shard, drop_common_lines
from tests.oracle import connect, same


def test_perfect_hash_is_minimal_and_shards_count():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert sorted(PerfectHash.build(h).index(h).tolist()) == list(range(len(h)))
        prints, counts = rng.integers(0, 2**64, len(h), np.uint64), np.arange(len(h)) + 1
        shard = Shard.unpack(*Shard.build(h, prints, counts).pack())
        assert (shard.count(h, prints) == counts).all()
        assert not shard.count(h, prints + np.uint64(1)).any()
        other = rng.integers(0, 2**64, 1000, np.uint64)
        assert not shard.count(other, rng.integers(0, 2**64, 1000, np.uint64)).any()


def test_unplaced_keys_are_found(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    h = np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64)
    assert sorted(PerfectHash.build(h).index(h).tolist()) == list(range(5000))


def test_query_matches_sql(spark, sf_dir):
    same(entry.queries()["op8_line_dedup"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op8_line_dedup"])


def test_edge_cases_and_rounds(spark, monkeypatch):
    rows = [(k, f"Common\nline {k}\n common\n COMMON\t\n\n", "a") for k in range(12)] + [(20, None, "b"), (20, None, "b"), (21, "", "c"), (22, "only common\ncommon", None), (None, "common\rx\ncommon", "d"), (23, "x" * 200_000 + "\ncommon", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")

    def brute(least):
        keys = [[x.strip(" \t\n\x0b\x0c\r").lower() for x in (t or "").split("\n")] for _, t, _ in rows]
        found = {k for ks in keys for k in ks if k and sum(k in set(o) for o in keys) >= least}
        return sorted(((i, "\n".join(x for x, k in zip((t or "").split("\n"), ks) if k not in found), len(ks), sum(k in found for k in ks)) for (i, t, _), ks in zip(rows, keys, strict=True)), key=str)

    for size, least in ((100_000, 10), (1, 1), (1, 2)):
        monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", size)
        got = drop_common_lines(df, least_docs=least, shards_a_round=9)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(least)
    assert drop_common_lines(df.limit(0)).count() == 0


def test_repeated_ids_are_documents_of_their_own(spark, tmp_path):
    """Query and SQL agree where ids repeat, with equal texts and others."""
    rows = [(1, "seen\nonly here"), (1, "seen\nonly here"), (1, "seen"), (2, None), (2, "seen")] + [(k, "seen\nodd") for k in (3, 3, 3, 4, 4)] + [(None, "seen\nx"), (None, "seen\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = entry.queries()["op8_line_dedup"](spark, str(tmp_path))
    same(got, con, entry.oracle_sql()["op8_line_dedup"])
    assert got.where("n_dropped = 1").count() == 11 and got.count() == 12
