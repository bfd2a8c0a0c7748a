import itertools
import random

import pytest

import __spark_entry__ as entry
from flowspark.llm import decontaminate
from flowspark.llm.decontaminate import MASKS, SHORT_MASKS, contaminated, without_contaminated, words


def plain_overlap(a, b, least=12, percent=80):
    """The longest window of two aligned texts with enough equal tokens, over every alignment: (length, equal) or None."""
    if len(b) < 5:
        return None
    best, need = None, min(least, len(b))
    for shift in range(-len(b) + 1, len(a)):
        low, high = max(0, shift), min(len(a), shift + len(b))
        same = [a[k] == b[k - shift] for k in range(low, high)]
        if 100 * sum(same) < percent * need:
            continue
        for i in range(len(same)):
            for j in range(i + need, len(same) + 1):
                if 100 * sum(same[i:j]) >= percent * (j - i):
                    best = max(best or (0, 0), (j - i, sum(same[i:j])))
    return best


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            found = plain_overlap(words(text), words(item))
            if found:
                out.add((d, i, *found))
    return out


def fixture(rng):
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 9, 14, 30])))) for i in range(12)] + [(None, " ".join(vocabulary[:20])), (99, None), (98, "w1 " * 15)]
    docs = [(None, None), (1, ""), (1, ""), (0, "w1 " * 40)]
    for d in range(2, 80):
        text = rng.choices(vocabulary + ["other"] * 30, k=rng.randint(0, 40))
        if d % 2:
            passage = (rng.choice(items)[1] or "").split()
            for k in rng.sample(range(len(passage)), len(passage) * rng.choice([0, 10, 20, 25]) // 100):
                passage[k] = "changed"
            text[10:10] = passage
        docs.append((d, " ".join(text).upper() if d % 3 == 0 else ", ".join(text)))
    return docs, items


def fits(same, mask):
    return any(all(same[s + k] for k, c in enumerate(mask) if c == "1") for s in range(len(same) - len(mask) + 1))


@pytest.mark.parametrize("size", range(5, 24))
def test_masks_hit_whatever_is_substituted(size):
    bad = size - -(-size * 4 // 5)
    masks = MASKS if size >= 12 else SHORT_MASKS
    for gone in itertools.combinations(range(size), bad):
        assert any(fits([k not in gone for k in range(size)], m) for m in masks), gone


@pytest.mark.parametrize("size", [5, 8, 10, 12, 14, 16, 20])
def test_every_placement_of_substitutions_is_found(size):
    item = [f"i{k}" for k in range(size)]
    bench = decontaminate.Benchmark([(7, " ".join(item))], MASKS, SHORT_MASKS, 12, 0.8)
    docs = []
    for n in range(1 + size - -(-size * 4 // 5)):
        placed = list(itertools.combinations(range(size), n))
        docs += [["x", *("y" if k in gone else w for k, w in enumerate(item)), "x"] for gone in placed[:: max(1, len(placed) // 400)]]
    found = decontaminate._verified(bench, [(k, bench.ids([w.encode() for w in d])) for k, d in enumerate(docs)])
    assert [(k, i) for k, i, _, _ in found] == [(k, 7) for k in range(len(docs))]


def test_matches_brute_force(spark, monkeypatch):
    for seed, block, at_once in ((1, 1 << 24, 1 << 15), (2, 300, 7)):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", at_once)
        docs, items = fixture(random.Random(seed))
        df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, overlap int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item, r.overlap, r.matched) for r in contaminated(df, bench).collect()}
        want = brute(docs, items)
        assert got == want and len(want) > 10
        clean = without_contaminated(df, bench)
        assert clean.columns == df.columns
        assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _ in docs if d not in {w[0] for w in want}), key=str)


def test_empty_tables_and_long_texts(spark):
    bench = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(20)))], "item_id long, text string")
    long = " ".join(["pad"] * 300_000 + [f"T{k}" for k in range(20)])
    df = spark.createDataFrame([(7, long), (8, "pad " * 50)], "doc_id long, text string")
    assert [(r.doc_id, r.item, r.overlap, r.matched) for r in contaminated(df, bench).collect()] == [(7, 1, 20, 20)]
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_query_matches_windows_of_whole_tables(spark, sf_dir):
    """All documents and items by another way: common runs of 4 tokens give the alignments, each is judged window by window."""
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = {}
    for i, b in items:
        for k in range(len(b) - 3):
            runs.setdefault(tuple(b[k : k + 4]), []).append((i, k))
    texts, want = dict(items), {}
    for d, a in docs:
        shifts = {(i, k - at) for k in range(len(a) - 3) for i, at in runs.get(tuple(a[k : k + 4]), ())}
        for i, shift in shifts:
            b = texts[i]
            low, high = max(0, shift), min(len(a), shift + len(b))
            found = plain_overlap(a[low:high], b[low - shift : high - shift]) if len(b) >= 12 else None
            if found:
                want[d, i] = max(want.get((d, i), (0, 0)), found)
    got = {(r.doc_id, r.item_id): (r.overlap, r.matched) for r in entry.queries()["op7_decontaminate"](spark, sf_dir).collect()}
    assert want and set(want) <= set(got) and all(got[k] >= want[k] for k in want)
    for (d, i), stretch in got.items():
        assert plain_overlap(dict(docs)[d], texts[i]) == stretch
