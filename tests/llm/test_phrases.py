import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from flowspark.llm import phrases, queries
from flowspark.llm.phrases import collocations
from tests.oracle import connect, same

SCHEMA = "doc_id long, text string, lang string, n long, key string, phrase string"


def plainly(rows, most_words, least, percent, most):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", data):
            words = tuple(re.findall(rb"[^ \t]+", piece))
            totals[lang] += len(words)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    c = counts.setdefault(lang, Counter())
                    c[words[i : i + m]] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, docs, words):
    r = random.Random(seed)
    vocabulary = [*"abcdefgh", "Über", "ÜBER", "\x00", "\x01", "a\x00b", "x y", "z" * 300]
    rows = []
    for k in range(docs):
        text = "".join(r.choice(vocabulary if r.random() < 0.6 else ["The", "the"]) + r.choice([" ", " ", " ", " \t ", ". ", ",", "\n", "\r"]) for _ in range(r.randrange(words)))
        rows.append((k, text, r.choice(["en", "en", "de", None, "und", "o\x00"]), 1, "", ""))
    return rows + [(1, None, "en", 1, "", ""), (2, "", None, 1, "", ""), (3, " ,. \n", "fr", 1, "", ""), (4, "again " * 3000, "en", 1, "", ""), (4, "again " * 3000, "en", 1, "", "")]


@pytest.mark.parametrize("most_words, least, percent, most", [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 4, 80, 50), (5, 2, 20, 2000)])
def test_against_plain_counts(spark, monkeypatch, most_words, least, percent, most):
    """Small partitions and stretches: hot first words are salted, prefixes go over batches, partitions have several languages."""
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", 3000)
    rows = corpus(most_words, 80, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(collocations(df, "text", "lang", most_words, least, percent, most, words_a_part=700)) == plainly(rows, most_words, least, percent, most)


def test_prefixes_go_over_batches():
    """One stack over batches of one row gives what one batch gives."""
    keys = sorted((b"\x00".join([b"en", *(random.Random(k).choice([b"a", b"ab", b"b"]) for _ in range(1 + k % 3))]) for k in range(60)), reverse=True)
    whole = [(m.tolist(), p.to_pylist()) for m, p in phrases._prefixes(pa.array(keys, pa.binary()), 3)]
    for k in range(3):
        want = [(i, b"\x00".join(x.split(b"\x00")[: k + 2])) for i, x in enumerate(keys) if x.count(b"\x00") > k]
        assert list(zip(*whole[k], strict=True)) == want


def test_empty_and_wordless_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, 1, "", ""), (2, "one", "en", 1, "", "")], SCHEMA)).collect() == []


def test_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits, and a score just below the next whole number."""
    big = [("en", ["a"], 3_000_000_000_001), ("en", ["b"], 3_000_000_000_000), ("en", ["a", "b"], 3_000_000_000_000)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (spark.createDataFrame(big, "lang string, phrase array<string>, f long"), spark.createDataFrame([("en", 10**13)], "lang string, n long")))
    assert [r.score for r in collocations(spark.createDataFrame([], SCHEMA)).collect()] == [10**6 * 3_000_000_000_000**2 // (3_000_000_000_001 * 3_000_000_000_000)] == [999_999]


def test_query_and_sql(spark, sf_dir):
    df = queries.op11_collocations(spark, sf_dir)
    assert df.count() > 10
    same(df, connect(sf_dir), queries.OP11_SQL)


def test_sql_on_odd_rows(spark, tmp_path):
    rows = [r for r in corpus(9, 60, 40) if "\x00" not in (r[1] or "") + (r[2] or "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(queries.op11_collocations(spark, str(tmp_path)), con, queries.OP11_SQL)
