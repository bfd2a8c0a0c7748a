import math
import random
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from flowspark.llm.suffix_tree import DISCOUNT, END, Table, score_texts, sequence_key, tokens
from tests.oracle import connect, oracle_rows


def test_table_finds_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 50_000))
    table = Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + 2**41) == -1).all() and (Table(keys[:0]).find(keys) == -1).all()


def test_sequence_keys_are_those_of_sql(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**63), 2**63, (2, 50))
    got = spark.createDataFrame(list(zip(range(50), a.tolist(), b.tolist())), "k int, a long, b long").selectExpr("xxhash64(a, b) h").orderBy("k").collect()
    assert [r.h for r in got] == sequence_key(a, b).tolist()


class Plain:
    """The tree with dictionaries of tuples."""

    def __init__(self, texts, depth, least):
        self.n = sum(map(len, texts))
        self.counts = {}
        for size in range(1, depth + 2):
            grams = Counter(tuple(t[k : k + size]) for t in texts for k in range(len(t) - size + 1))
            if size == 1:
                self.words = {g[0]: c for g, c in grams.items()}
            self.counts[size] = {g: c for g, c in grams.items() if c >= least}
        self.depth, self.states = depth, set()
        for size in range(1, depth + 1):
            for s, n in self.counts[size].items():
                children = {g[-1]: c for g, c in self.counts[size + 1].items() if g[:-1] == s}
                if not children:
                    continue
                other = {w: min(1.0, self.p(w, s[1:])) for w in children}
                left, left_before = (max(1e-12, 1 - x) for x in (sum(children.values()) / n, sum(other.values())))
                kl = sum(c / n * math.log(c / n / other[w]) for w, c in children.items())
                kl += left * math.log(left / left_before) if sum(children.values()) / n < 1 - 1e-12 else 0.0
                if 2 * n * kl > len(children) * math.log(n):
                    self.states.add(s)

    def base(self, w):
        return (self.words.get(w, 0) + 0.5) / (self.n + 0.5 * (len(self.words) + 1))

    def p(self, w, history):
        s = tuple(history[-self.depth :]) if history else ()
        while s and s not in self.states:
            s = s[1:]
        if not s:
            return self.base(w)
        n = self.counts[len(s)][s]
        children = {g[-1]: c for g, c in self.counts[len(s) + 1].items() if g[:-1] == s}
        rest = 1 - sum((c - DISCOUNT) / n for c in children.values())
        explicit = (children[w] - DISCOUNT) / n if w in children else 0.0
        return explicit + rest * self.p(w, s[1:])


def corpus(seed, many):
    rng = random.Random(seed)
    follows = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    out = []
    for _ in range(many):
        text = [rng.choice("abcdefghij")]
        for _ in range(rng.randint(0, 30)):
            text.append(rng.choice(follows.get(text[-1], "abc")) if rng.random() < 0.8 else f"rare{rng.randrange(300)}")
        out.append(" ".join(text))
    return out


def test_scores_match_plain_model(spark):
    texts = [None, "", " A\tb ", *corpus(3, 400), "a b c", "a b c"]
    ids = [None, *range(len(texts) - 2), 7]
    df = spark.createDataFrame(list(zip(ids, texts, [1.5] * len(texts), strict=True)), "doc_id long, text string, score double")
    out = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i in ids]
    for depth, least, frequent in ((2, 2, 0), (3, 2, 2000), (1, 5, 50)):
        model = Plain([tokens(t) for t, o in zip(texts, out, strict=True) if not o], depth, least)
        assert model.states
        want = Counter()
        for i, t, o in zip(ids, texts, out, strict=True):
            w = tokens(t)
            base = sum(math.log10(model.base(x)) for x in w)
            score = sum(math.log10(model.p(x, w[:k])) for k, x in enumerate(w))
            want[i, o, len(w), sum(x in model.words for x in w), model.n, round(base, 7), round(score, 7)] += 1
        got = Counter((*tuple(r)[:5], round(r.base_score, 7), round(r.score, 7)) for r in score_texts(df, depth=depth, least=least, frequent=frequent).collect())
        assert got == want
        words = [*model.words, "unseen"]
        for history in (["a"], ["a", "b"], ["zz", "c"], [b"a", b"b", b"c"]):
            history = [h.encode() if isinstance(h, str) else h for h in history]
            assert abs(sum(model.p(x, history) for x in words) - 1) < 1e-9  # one unknown word completes the distribution


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    assert score_texts(df.limit(0)).count() == 0
    got = score_texts(df, kept_out=F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    long = spark.createDataFrame([(2, "w " * 1_200_000), (3, "w x")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in score_texts(long).collect()) == [3, 1_200_001]
    assert END not in tokens("a")[:-1]


def test_query_base_matches_sql_and_model_is_better(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in entry.queries()["op5_suffix_tree"](spark, sf_dir).collect()}
    con = connect(sf_dir)
    names, rows = oracle_rows(con, "SELECT doc_id, text FROM documents")
    assert names == ["doc_id", "text"] and len(got) == len(rows)
    docs = {d: tokens(t) for d, t in rows}
    trained = Counter(w for d, t in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(trained.values()), len(trained)
    for d, t in docs.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 5 == 1, len(t), sum(w in trained for w in t), n)
        assert abs(r.base_score - sum(math.log10((trained[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * max(1, abs(r.base_score))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
