import hashlib
import random

import public_tokenizers
import regex
from tokenizers import Tokenizer

import __spark_entry__ as entry
from flowspark.llm.bpe import PATTERN, Decoder, Encoder, Merges, Transducer, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    MERGES = Merges(f.read())


def ids_of(packed):
    return list(memoryview(packed).cast("I")) if packed else []


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_lookahead_is_bounded():
    assert 16 < MERGES.lookahead < 20_000


def test_random_texts_and_small_windows():
    rng = random.Random(7)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "é", "ß", "1", "22", "!", "<|endoftext|>", "<|endo", " ", " ", "\x1c", "\x85", "日本", "🙂", "́", "ll", "'ll", ".", "a" * 70, " " * 60, "\n" * 50, "!" * 55, "7" * 80]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        want = expected(text)
        assert ids_of(Encoder(MERGES).encode(text)) == want, text
        small = Encoder(MERGES, window=rng.randint(1, 12))
        out = b""
        at = 0
        while at < len(text):
            n = rng.randint(1, 9)
            out += small.feed(text[at : at + n])
            at += n
        out += small.finish()
        assert ids_of(out) == want, text
        assert Decoder(MERGES.bytes_of).decode(out) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_runs_are_exact():
    rng = random.Random(3)
    for unit in ("a", "ab", "the", "ing", " ", "=", "9", "é", "ation"):
        text = unit * 30_000
        assert ids_of(Encoder(MERGES, window=500).encode(text)) == expected(text)
    for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèàü"):
        text = "".join(rng.choices(letters, k=60_000))
        assert ids_of(Encoder(MERGES, window=700).encode(text + " x")) == expected(text + " x")
    stream, text = Transducer(MERGES), "".join(rng.choices("etaoin", k=50_000))
    out = b"".join(stream.feed(text[k : k + 777].encode()) for k in range(0, len(text), 777))
    assert len(stream.held) <= 2 * max(MERGES.lookahead, 1024) + 1024
    assert ids_of(out + stream.finish()) == expected(text)


def test_decoder_replaces_broken_bytes():
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randint(0, 9))] + [rng.randrange(50_257) for _ in range(3)]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoder = Decoder(MERGES.bytes_of)
        pieces = "".join(decoder.feed(packed[k : k + 4]) for k in range(0, len(packed), 4)) + decoder.feed(b"", True)
        assert pieces == Decoder(MERGES.bytes_of).decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", None), (None, "a <|endoftext|> b", "y"), (4, "word " * 50_000, "z")], "doc_id long, text string, ids string")
    coded = bpe_encode(df, PATH)
    assert coded.columns == ["doc_id", "ids"]
    back = sorted(((r.doc_id, r.text) for r in bpe_decode(coded, PATH).collect()), key=str)
    assert back == sorted([(1, ""), (1, ""), (2, ""), (None, "a <|endoftext|> b"), (4, "word " * 50_000)], key=str)
    assert bpe_decode(bpe_encode(df.limit(0), PATH), PATH).count() == 0


def test_query_matches_library(spark, sf_dir):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op4_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = expected(r.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_merging_many_is_merging_each():
    rng = random.Random(11)
    words = [b"", b"a", b"aaaa", b"the" * 21, bytes(range(64)), bytes(range(192, 256))]
    for letters in (b"ab", b"etaoinshr ", bytes(range(256)), "éèàüß日本".encode()):
        words += [bytes(rng.choices(letters, k=rng.randint(1, 64))) for _ in range(400)]
    assert [ids_of(p) for p in MERGES.merge_many(words)] == [MERGES.merge(w) for w in words]


def test_ascii_texts_are_split_alike():
    rng, encoder = random.Random(12), Encoder(MERGES)
    alphabet = [*map(chr, range(128)), " ", " ", "'s", "'ll", "'t", "\r\n", "word", "12"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert encoder.split(text) == regex.findall(PATTERN, text)


def test_new_words_are_merged_together(monkeypatch):
    """Also with more of them than the table keeps, and beside special tokens and long texts."""
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9))) for _ in range(800)) for _ in range(150)]
    merged = []
    plain = Merges.merge
    monkeypatch.setattr("flowspark.llm.bpe.CACHE", 1000)
    monkeypatch.setattr("flowspark.llm.bpe.AT_ONCE", 50_000)
    monkeypatch.setattr(Merges, "merge", lambda self, data: merged.append(data) or plain(self, data))
    got = list(Encoder(MERGES).encode_many(texts))
    assert not merged and [ids_of(p) for p in got] == [expected(t) for t in texts]
    texts += ["", "a <|endoftext|> b", "x" * 70_000, " ".join(texts[:30])]
    assert [ids_of(p) for p in Encoder(MERGES).encode_many(texts)] == [expected(t) for t in texts]
