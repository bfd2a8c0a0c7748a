import random

import xxhash

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
import __spark_entry__ as entry
from flowspark.llm import simhash
from flowspark.llm.simhash import _nodes, _sharing, components, fingerprint, index_keys, keep_one_of_near_copies, links, similar, simhash_components, single_linkage


def slow_fingerprint(text, width):
    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if near(a, b):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choices(["A", "b", "é", " ", "\t", "\x0b", " ", "word", "İ"], k=rng.randint(0, 80)))
        assert fingerprint(text, 3)[1] % 2**64 == slow_fingerprint(text, 3)
    long = " ".join(rng.choices("abcdefgh", k=70_000))
    assert fingerprint(long, 3)[1] % 2**64 == slow_fingerprint(long, 3)


def nearby(rng, many, lanes=1):
    out = [[rng.getrandbits(64) for _ in range(lanes)] for _ in range(many)]
    for _ in range(many * 2):
        new = list(rng.choice(out))
        for _ in range(rng.randint(0, 3)):
            new[rng.randrange(lanes)] ^= 1 << rng.randrange(64)
        out.append(new)
    out += [[(1 << k) - 1] * lanes for k in range(65)]
    return sorted({tuple(x - (1 << 64) if x >> 63 else x for x in row) for row in out})


def bits(a, b):
    return sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b, strict=True))


def test_links_match_brute_force(spark):
    rng = random.Random(2)
    fps = nearby(rng, 100)
    nodes = spark.createDataFrame([(f[0], 5, f[0]) for f in fps], "node long, shingles long, f0 long")
    for blocks, tile_rows in ((1, 1 << 17), (1, 20), (4, 3), (8, 1)):
        got = {r.node: r.root for r in components(links(nodes, 2, 1, blocks, tile_rows=tile_rows)).collect()}
        want = roots([f[0] for f in fps], lambda a, b: bits([a], [b]) <= 2)
        assert {n: got.get(n, n) for n in want} == want


def test_bands_match_brute_force(spark):
    rng = random.Random(4)
    fps = [(*f, rng.choice([5, 6, 7, 40, 41, 55])) for f in nearby(rng, 60, 2)]
    nodes = spark.createDataFrame([(k, f[2], f[0], f[1]) for k, f in enumerate(fps)], "node long, shingles long, f0 long, f1 long")
    got = {r.node: r.root for r in components(links(nodes, 3, 2, ratio=0.7, least_cuts=3, tile_rows=10)).collect()}
    near = roots(list(range(len(fps))), lambda a, b: bits(fps[a][:2], fps[b][:2]) <= 3 and min(fps[a][2], fps[b][2]) >= 0.7 * max(fps[a][2], fps[b][2]))
    far = roots(list(range(len(fps))), lambda a, b: bits(fps[a][:2], fps[b][:2]) <= 3)
    for a in near:  # what is near must be linked, what is linked must be within the radius
        assert got.get(a, a) == got.get(near[a], near[a])
        assert far[a] == far[got.get(a, a)]


def test_chain_of_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


def test_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "y"), (3, " \n", "y"), (9, "one two three four", "z"), (8, "One two\tthree four", "z"), (None, "one two three four", "q"), (1, "w " * 90_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 8), (1, 1)], key=str)
    assert simhash_components(df.limit(0)).count() == 0
    kept = keep_one_of_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]


def slow_set(text, width=5):
    words = text.encode().lower().split()
    size = min(width, len(words))
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def similar_sets(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_single_linkage_matches_brute_force():
    rng = random.Random(3)
    for many in (0, 1, 40, 300):
        sets = [set(rng.sample(range(60), rng.randint(1, 30))) for _ in range(many)]
        for k in range(0, many, 2):  # chains of sets that differ a little
            sets[k] = set(sets[k - 1]) ^ {rng.randrange(60)}
        names = rng.sample(range(10**6), many)
        edges = single_linkage(names, [np.array(sorted(s), np.uint64) for s in sets], Fraction(4, 5))
        of = dict(zip(names, sets, strict=True))
        near = lambda a, b: len(of[a] & of[b]) * 5 >= 4 * len(of[a] | of[b]) and bool(of[a] and of[b])
        assert len(edges) < max(1, many) and all(a < b for a, b in edges) and not {a for a, _ in edges} & {b for _, b in edges}
        got = roots(sorted(names), lambda a, b: (a, b) in edges or (b, a) in edges)
        assert got == roots(sorted(names), near)


def test_large_clusters_are_compared_in_blocks(spark):
    rng = random.Random(4)
    base = rng.choices([f"w{k}" for k in range(500)], k=60)
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = "x"
        texts.append(" ".join(words))
    for parts in (1, 4):
        df = spark.createDataFrame([(9, parts, k, t) for k, t in [*enumerate(texts), *enumerate(texts)]], "root long, parts int, node long, text string")
        got = {r.node: r.root for r in components(similar(df, 5, Fraction(4, 5))).collect()}
        want = roots(list(range(40)), lambda a, b: similar_sets(slow_set(texts[a]), slow_set(texts[b])))
        assert {n: got.get(n, n) for n in want} == want and len(set(want.values())) > 1


def test_kept_rows_match_true_similarity(spark, sf_dir, monkeypatch):
    """Whole documents at sf0.01, with texts that repeat a passage of themselves: exact similarity of all pairs that share a
    shingle. What is left out has a chain of similar texts; of pairs at 0.8 or more at most one in a hundred may be missed."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()]
    docs += [(10**6 + d, f"{t} {t[:len(t) // 2]}") for d, t in docs[:200]]
    sets = {d: frozenset(slow_set(t)) for d, t in docs}
    having, near = {}, set()
    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for other in having.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            having[s].append(d)
        near |= {(o, d) for o, n in shared.items() if 5 * n >= 4 * (len(sets[o]) + len(sets[d]) - n)}
    empty = sorted(d for d in sets if not sets[d])
    near |= {(empty[0], d) for d in empty[1:]}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in near:
        ra, rb = sorted((find(a), find(b)))
        up[rb] = ra
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wants = {d for d in sets if find(d) == d}
    for most in (200_000, 0):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        got = {r.doc_id for r in keep_one_of_near_copies(df).collect()}
        assert wants <= got and len(got - wants) <= 0.01 * (len(sets) - len(wants))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, want = [], set()
    for group in range(60):
        text = rng.choices(vocabulary, k=rng.randint(150, 400))
        want.add(len(rows))
        for copy in range(3):
            changed = list(text)
            if copy:
                changed[rng.randrange(len(text))] = "changed"
            rows.append((len(rows), " ".join(changed)))
    got = {r.doc_id for r in keep_one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_passages_are_compared(spark):
    rng = random.Random(9)
    for many in (40, 60, 100, 300):  # whatever the edges of bands
        text = " ".join(rng.choices([f"w{k}" for k in range(4000)], k=many))
        df = spark.createDataFrame([(1, text), (2, " ".join([text] * 2)), (3, " ".join([text] * 5))], "doc_id long, text string")
        assert [r.doc_id for r in keep_one_of_near_copies(df).collect()] == [1]
    words = text.split()
    shingles = {" ".join(words[k : k + 5]) for k in range(296)} | {" ".join((words + words)[k : k + 5]) for k in range(296, 300)}
    assert fingerprint(text + " " + text, 5, (42,), distinct=True)[0] == len(shingles) == 300
    assert fingerprint(" ".join(["a b c d e"] * 30_000), 5, (42,), distinct=True)[0] == 5


def test_rows_with_one_id_or_none_stay_by_their_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(4000)], k=200)) for _ in range(5)]
    near = texts[0].replace(texts[0].split()[100], "changed", 1)
    rows = [(None, texts[1]), (None, texts[2]), (None, texts[2]), (1, texts[0]), (7, texts[3]), (7, near), (7, near), (9, texts[4]), (9, texts[4]), (None, texts[4])]
    got = [tuple(r) for r in keep_one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, texts[1]), (None, texts[2]), (1, texts[0]), (7, texts[3]), (9, texts[4])], key=str)


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: slow_fingerprint(r.text or "", 3) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = roots(sorted(docs), lambda a, b: (docs[a] ^ docs[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op2_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{docs[d]:016x}", want[d]) for d in docs}


LANES = tuple(range(42, 50))


def test_index_finds_similar_sets_and_no_others(spark):
    """Work grows with what is similar: unrelated texts of one length share no key, nearly all similar ones do."""
    rng = random.Random(8)
    alone = [" ".join(rng.choices([f"w{k}" for k in range(5000)], k=60)) for _ in range(300)]
    keys = [set(fingerprint(t, 5, LANES, True, index=True)[9:]) for t in alone]
    assert all(len(k) == index_keys(8) == 12 and all(0 <= x < 1 << 38 for x in k) for k in keys)
    assert sum(map(len, keys)) == len(set.union(*keys))
    missed = 0
    for t in alone:
        words = t.split()
        words[rng.choice([0, 1, 58, 59])] = "other"  # two shingles of 56 change at the ends at most
        missed += not set(fingerprint(" ".join(words), 5, LANES, True, index=True)[9:]) & set(fingerprint(t, 5, LANES, True, index=True)[9:])
    assert missed == 0
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*alone, alone[0] + " x"])], "id long, text string")
    nodes = _nodes(df, F.col("id"), 5, LANES, True, index=True)[1]
    shared, counted = _sharing(nodes, ["node", *(f"f{k}" for k in range(8))], 12)
    assert {r.node for r in shared.select("node").collect()} == {r.node for r in nodes.where("least in (0, 300)").collect()}
    assert 0 < counted.count() <= 12


def test_index_in_tiles_of_all_sizes_matches_brute_force(spark):
    rng = random.Random(9)
    fps = nearby(rng, 150, 2)
    rows = [(k, f[0], f[1], rng.randrange(3), 10 + rng.randrange(60)) for k, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, k0 long, k1 long")
    want = roots(list(range(len(rows))), lambda a, b: bits(fps[a], fps[b]) <= 3 and (rows[a][3] == rows[b][3] or rows[a][4] == rows[b][4]))
    for tile_rows in (1 << 17, 7):
        got = {r.node: r.root for r in components(links(nodes, 3, 2, tile_rows=tile_rows, keys=2)).collect()}
        assert {n: got.get(n, n) for n in want} == want
