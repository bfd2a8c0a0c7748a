import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark.llm.language_id import declared_language, fit, grams, host_of, identify, keep_identified, page_text, sample_of


def test_page_fields(spark):
    html = '<!DOCTYPE html><HTML class=a Lang="FR"><script>var t="</p>";</script><p>Un&amp;deux<br>trois</p>'
    row = spark.createDataFrame([(html, "HTTPS://u:p@M.Example.ORG:80/x")], "html string, url string").select(page_text(F.col("html")), declared_language(F.col("html")), host_of(F.col("url"))).first()
    assert (" ".join(row[0].split()), row[1], row[2]) == ("Un deux trois", "fr", "m.example.org")


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    labels, table = fit(sample_of(train, "lang", 60), "text", "lang")
    got = identify(docs.where("doc_id % 2 = 1"), labels, table, host=F.col("source"), carry=("doc_id", "lang")).collect()
    right = sum(r.lang == r.language for r in got) / len(got)
    assert right > 0.97, right
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_fusion_matches_plain_arithmetic(spark):
    train = spark.createDataFrame([("the of and that with " * 5, "en"), ("der die und nicht sich " * 5, "de")], "text string, lang string")
    labels, table = fit(train, "text", "lang")
    rows = [(1, "the and", "en", "uk", "a.uk"), (2, "die und", "de", "de", "b.de"), (3, "nth", "de", "de", "b.de"), (4, "nth", None, None, None), (5, "##", "de", "de", "b.de"), (5, None, None, "de", "c.de"), (6, "die nicht", "de", "de", "b.de"), (7, "zqx jkvw pyg zzq xkw", "de", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string").withColumn("domain", F.col("suffix"))
    got = identify(df, labels, table, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), domain=F.col("domain"), carry=("id",)).collect()

    def soft(scores):
        powers = [math.exp(s - max(scores)) for s in scores]
        return [p / sum(powers) for p in powers]

    text, counts = [], {}
    total, start = [0.0] * 3, [0.495, 0.495, 0.01]
    for _, t, declared, suffix, host in rows:
        g = grams(t)
        scores = [float(table[g, k].mean(dtype="float64")) * (len(g) / (1 + len(g) / 60)) if len(g) else 0.0 for k in range(3)]
        text.append(scores)
        p = soft([s + math.log(x) for s, x in zip(scores, start, strict=True)]) if len(g) else [0.0] * 3
        for k in range(3):
            total[k] += p[k]
            for name, value in (("declared", declared), ("suffix", suffix), ("host", host), ("domain", suffix)):
                if value is not None:
                    counts.setdefault((name, value), [0.0] * 3)[k] += p[k]
    share = [(t + 3 * x) / (sum(total) + 3) for t, x in zip(total, start, strict=True)]
    want = {}
    for (i, t, declared, suffix, host), scores in zip(rows, text, strict=True):
        s = list(scores)
        for name, value in (("declared", declared), ("suffix", suffix)):
            if value is not None:
                c = counts[name, value]
                s = [s[k] + math.log((c[k] + 5 * share[k]) / ((sum(c) + 5) * share[k])) for k in range(3)]
        above = share
        if suffix is not None:
            c = counts["domain", suffix]
            above = [(c[k] + 5 * share[k]) / (sum(c) + 5) for k in range(3)]
        if host is not None:
            c = counts["host", host]
            above = [(c[k] + 5 * above[k]) / (sum(c) + 5) for k in range(3)]
        post = soft([s[k] + math.log(above[k]) for k in range(3)])
        found = [*labels, None][post.index(max(post))]
        want.setdefault(i, []).append((found, round(max(post), 9)) if len(grams(t)) and found else (None, None))
    have = {}
    for r in got:
        have.setdefault(r.id, []).append((r.language, r.confidence and round(r.confidence, 9)))
    assert have == want
    assert {r.id for r in got if r.rejected} == {i for i, w in want.items() if (None, None) in w} >= {5}


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "der die das und", "de", "s", "x"), (1, "der die das und", "de", "s", "x"), (2, None, None, None, None), (None, "the and of", "en", "s", "y"), (3, "12 !!", "en", None, "z"), (4, "the of and " * 60_000, "en", "s", "w")], "doc_id long, text string, lang string, source string, rejected string")
    kept = keep_identified(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 4, None]
    assert keep_identified(df.limit(0)).count() == 0
    assert identify(df.limit(0), *fit(df, "text", "lang")).count() == 0
    assert [r.rejected for r in identify(df, [], None, carry=("doc_id",)).collect()] == [True] * 6


def test_query_covers_both_tables(spark, sf_dir):
    got = entry.queries()["op9_language_id"](spark, sf_dir).collect()
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    assert len([r for r in got if r.doc_id is not None]) == docs.count()
    assert len([r for r in got if r.page_id is not None]) == pages.count()
    declared = {r.page_id: r.d for r in pages.select("page_id", declared_language(F.col("html")).alias("d")).collect()}
    agree = [r.language == declared[r.page_id] for r in got if r.page_id is not None]
    assert sum(agree) / len(agree) > 0.9


def test_texts_in_no_known_language_are_rejected(spark, sf_dir):
    """Held-out documents stay; other languages and junk go, by the posterior of the class for everything else."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    others = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita",
        "De raad van bestuur heeft gisteren besloten dat er geen nieuwe woningen gebouwd zullen worden",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему",
        "xkqz vbnwq zzxk qwpz mnbv kjhg qzxw plmk zxqv bnkj wqpz xkcd vvqz zzkj",
        "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIGZvciBqdW5r",
    ]
    more = spark.createDataFrame([(-k - 1, t, None, "src1") for k, t in enumerate(others)], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    kept = {r.doc_id for r in keep_identified(both, rows_a_label=60).collect()}
    assert not [d for d in kept if d < 0]
    gone = [r.doc_id for r in docs.collect() if r.doc_id not in kept]
    assert len(gone) <= 0.01 * docs.count()


def test_query_matches_plain_arithmetic(spark, sf_dir):
    """Every row of both tables: the query's fusion done again with dictionaries, from the texts' trigrams on."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    labels, table = fit(sample_of(docs, "lang", 400), "text", "lang")
    rows = [(("d", r.doc_id), r.text, None, None, None if r.source is None else f"source:{r.source}".lower(), None) for r in docs.collect()]
    fields = pages.select("page_id", page_text(F.col("html")).alias("t"), declared_language(F.col("html")).alias("d"), host_of(F.col("url")).alias("h")).collect()
    rows += [(("p", r.page_id), r.t, r.d, r.h and r.h.split(".")[-1], r.h, r.h and ".".join(r.h.split(".")[-2:])) for r in fields]
    n = len(labels) + 1
    start = [0.99 / (n - 1)] * (n - 1) + [0.01]

    def soft(scores):
        powers = [math.exp(s - max(scores)) for s in scores]
        return [p / sum(powers) for p in powers]

    text, sums, total = {}, {}, [0.0] * n
    for key, t, declared, suffix, host, domain in rows:
        g = grams(t)
        text[key] = [float(x) * (len(g) / (1 + len(g) / 60)) for x in table[g].mean(axis=0, dtype="float64")] if len(g) else None
        p = soft([s + math.log(x) for s, x in zip(text[key], start, strict=True)]) if len(g) else [0.0] * n
        total = [a + b for a, b in zip(total, p, strict=True)]
        for kind, value in (("declared", declared), ("suffix", suffix), ("host", host), ("domain", domain)):
            if value is not None:
                sums[kind, value] = [a + b for a, b in zip(sums.get((kind, value), [0.0] * n), p, strict=True)]
    share = [(t + n * x) / (sum(total) + n) for t, x in zip(total, start, strict=True)]
    mix = lambda c, above: [(a + 5 * b) / (sum(c) + 5) for a, b in zip(c, above, strict=True)]
    got = {("p", r.page_id) if r.doc_id is None else ("d", r.doc_id): r for r in entry.queries()["op9_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for key, _, declared, suffix, host, domain in rows:
        s = text[key] or [0.0] * n
        for kind, value in (("declared", declared), ("suffix", suffix)):
            if value is not None:
                s = [a + math.log(b / c) for a, b, c in zip(s, mix(sums[kind, value], share), share, strict=True)]
        above = share if domain is None else mix(sums["domain", domain], share)
        post = soft([a + math.log(b) for a, b in zip(s, above if host is None else mix(sums["host", host], above), strict=True)])
        want = [*labels, None][post.index(max(post))] if text[key] else None
        assert got[key].language == want and got[key].rejected == (want is None)
        assert want is None or abs(got[key].confidence - max(post)) < 1e-6
