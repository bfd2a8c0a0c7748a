import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flowspark.llm.decontaminate import words
from tests.llm.test_simhash import roots, similar_sets, slow_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(docs, items):
    """The stages over plain rows (doc_id, text)."""
    docs = [(d, t or "") for d, t in docs if any(c.isalpha() for c in t or "")]
    keys = {d: [x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")] for d, t in docs}
    found = {}
    for ks in keys.values():
        for k in set(ks):
            found[k] = found.get(k, 0) + 1
    docs = [(d, "\n".join(x for x, k in zip(t.split("\n"), keys[d], strict=True) if not k or found[k] < 10)) for d, t in docs]
    sets = {d: slow_set(t) for d, t in docs}
    up = roots(sorted(sets), lambda a, b: similar_sets(sets[a], sets[b]))
    docs = [(d, t) for d, t in docs if up[d] == d]
    joined = [b" " + b" ".join(words(i)) + b" " for i in items]
    docs = [(d, t) for d, t in docs if not any(i in b" " + b" ".join(words(t)) + b" " for i in joined)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for d, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        out[d] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and got == want
    assert len(got) < len(docs)


def test_line_dedup_keeps_columns_of_its_own_names(spark, sf_dir):
    df = spark.createDataFrame([(1, "a\nb", "en", "s", 3, 77, "x")], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string")
    assert [tuple(r) for r in corpus_pipeline.line_dedup(spark, df, sf_dir).collect()] == [(1, "a\nb", "en", "s", 3, 77, "x")]


def test_stages_take_edge_cases(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the of and to in " * 9, "en", "s", 5), (3, "the of and to in " * 9, "en", "s", 5), (None, "der die das und", "de", None, 4), (4, "x " * 200_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == COLUMNS
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()
