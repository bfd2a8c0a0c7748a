import hashlib

import pytest

import __spark_entry__ as entry
from flowspark.llm import pii
from flowspark.llm.pii import FEMALE, MALE, _iban_rest, _luhn, clashing, mentions, normal, replace_pii, replaced, surrogate

KEY = b"test key"


def found(text):
    return [(k, v) for _, _, k, v in mentions(text)]


def test_detection():
    text = 'Ask reç.55@mail4.example.com. or +1 (017) 555-7713, 9807915762804490 at 97.51.17.173: token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Frau Erika Mustermann und Dr. Smith; 078-05-1120, 4111 1111 1111 1111'
    assert found(text) == [
        ("email", "reç.55@mail4.example.com"), ("phone", "+1 (017) 555-7713"), ("card", "9807915762804490"), ("ip", "97.51.17.173"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("person", "Erika Mustermann"), ("person", "Smith"), ("ssn", "078-05-1120"), ("card", "4111 1111 1111 1111"),
    ]
    assert found("In 2024, 12345 of 3.14 and 300.1.1.1, v1.2.3.4.5, Mr and a@b; the 'quoted words' stay") == []


def test_surrogates_keep_kind_and_format(spark):
    text = 'A.b@X.example.com a.B@x.example.com +1 (017) 555-7713 +10175557713 4111 1111 1111 1111 4111-1111-1111-1112 192.168.4.5 10.1.2.3 8.8.8.8 "04dbebab91ab85687d33eeaaf9ac699e1188f962" Frau Müller-Lüdenscheid, Mr. ИВАНОВ Mrs. Иванова'
    df = spark.createDataFrame([(1, text, "x"), (2, text, "y")], "doc_id long, text string, found string")
    rows = replace_pii(df, KEY).collect()
    assert rows[0].text == rows[1].text and rows[0].n_found == 13
    old, new = found(text), found(rows[0].text)
    assert [k for k, _ in old] == [k for k, _ in new]
    assert not {v for _, v in old} & {v for _, v in new}
    assert new[0][1].lower() == new[1][1].lower() and normal(*new[2]) == normal(*new[3])
    for (kind, a), (_, b) in zip(old, new, strict=True):
        if kind in ("phone", "card", "secret"):
            assert len(a) == len(b) and [c.isdigit() for c in a] == [c.isdigit() for c in b] or kind == "secret"
        if kind == "card":
            assert (_luhn(normal(kind, a)) == 0) == (_luhn(normal(kind, b)) == 0)
        if kind in ("person", "email"):
            assert kind == "email" or len(a) == len(b)
    addresses = [v for k, v in new if k == "ip"]
    assert addresses[0].startswith("192.168.") and addresses[1].startswith("10.") and not addresses[2].startswith(("10.", "192.168."))
    people = [v for k, v in new if k == "person"]
    assert people[0][0].isupper() and "-" in people[0] and people[1].isupper() and people[1][-1] == "В" and people[2][-1] == "а"
    assert all("Ѐ" <= c <= "ӿ" for c in people[1] + people[2])


@pytest.mark.parametrize("most", [100_000, 0])
def test_clashes_are_resolved(spark, monkeypatch, most):
    def weak(key, kind, norm, draw):  # few draws, so that they clash
        return f"9{int(hashlib.md5(f'{norm} {draw}'.encode()).hexdigest(), 16) % 300:09d}"

    monkeypatch.setattr(pii, "surrogate", weak)
    rows = [(k, f"call 900-000-{k:04d} or (900) 000-{k + 1:04d}") for k in range(25)]
    df = spark.createDataFrame([*rows, (99, None), (None, ""), (3, rows[3][1])], "doc_id long, text string")
    later = clashing(pii.entities(df, "text"), KEY).collect()
    assert later
    out = {r.doc_id: r.text for r in replace_pii(df, KEY, most_broadcast=most).collect()}
    of = {}
    for k, text in rows:
        for (_, a), (_, b) in zip(found(text), found(out[k]), strict=True):
            a, b = normal("phone", a), normal("phone", b)
            assert of.setdefault(a, b) == b
    assert len(set(of.values())) == len(of) == 26 and not set(of) & set(of.values())
    assert out[99] is None and out[None] == ""


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "9" * 100_000), (2, "a@" * 50_000), (3, "1." * 50_000), (4, "nothing here")], "doc_id long, text string")
    assert {r.doc_id: r.n_found for r in replace_pii(df, KEY).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert replace_pii(df.limit(0), KEY).count() == 0


def test_query_leaves_no_entity_and_clean_texts_alone(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op3_pii"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    pairs, before = {}, {normal(k, v) for t in docs.values() for k, v in found(t)}
    assert len(before) > 10
    for d, t in docs.items():
        old, new = found(t), found(got[d].text)
        assert [k for k, _ in old] == [k for k, _ in new] and got[d].n_found == len(old)
        if not old:
            assert got[d].text == t
        for (k, a), (_, b) in zip(old, new, strict=True):
            assert pairs.setdefault((k, normal(k, a)), normal(k, b)) == normal(k, b)
            assert normal(k, b) not in before
    assert len(set(pairs.values())) == len(pairs)


def new(text):
    return replaced(text, KEY, lambda unit: 0)[0]


def test_names_keep_coreference():
    """By another way: words of names and their places are written down here."""
    text = "Frau Erika Mustermann came. Frau Mustermann left, and Erika stayed. MR JOHN SMITH met John Smith; Smith, John. Mr. Smith The end of the smithy. erika@x.org"
    places = {w: [k for k in range(len(text)) if text.startswith(w, k)] for w in ("Erika", "Mustermann")}
    out = new(text)
    assert "Mustermann" not in out and "Erika " not in out and "SMITH" not in out and "Smith" not in out and "John" not in out
    for word, at in places.items():
        assert len(at) == 2 and len({out[a : a + len(word)] for a in at}) == 1
    first = out.index("MR ") + 3
    john, smith = out[first : first + 4], out[first + 5 : first + 10]
    assert out[first + 11 :].startswith(f"met {john.capitalize()} {smith.capitalize()}; {smith.capitalize()}, {john.capitalize()}. Mr. {smith.capitalize()} The end of the smithy. ")


def test_gender_length_and_script():
    for title, names, endings in (("Mr.", MALE, ("o", "us", "an", "er")), ("Ms.", FEMALE, ("a", "ia", "ina", "ella"))):
        for name in names:
            made = surrogate(KEY, "person", name, 0)
            assert len(made) == len(name) and made.endswith(endings)
            assert new(f"{title} {name.capitalize()}") == f"{title} {made.capitalize()}"
    assert [len(surrogate(KEY, "person", "li", d)) for d in (0, 1, 5)] == [2, 3, 4]
    text = new("Prof. 王 小明, Dr. Иванова")
    assert "王" not in text and "小明" not in text and text.endswith("а") and all(c > "\u3000" for c in text[6:].split(",")[0].replace(" ", ""))


def test_secrets_of_any_length_phones_and_other_numbers():
    for secret in ("A1b2" * 100, "ab.CD.12" * 60):
        out = new(f'key = "{secret}"')
        assert len(out) == len(secret) + 8 and out[7:-1] != secret and [c == "." for c in out[7:-1]] == [c == "." for c in secret]
    assert "0f" * 100 not in new("sum " + "0f" * 100) and len(new("sum " + "0f" * 100)) == 204
    for text, form in (("call 555.123.4567 now", "call ddd.ddd.dddd now"), ("555 123 4567", "ddd ddd dddd"), ("٣٥٥-١٢٣-٤٥٦٧", None)):
        out = new(text)
        assert out != text and (form is None or "".join("d" if c.isdigit() else c for c in out) == form)
    assert new("fe80::1:2").startswith("fe80") and new("2001:db8::17 x").startswith("2001:db8:") and new("2a00:1450::68 x")[0] in "23"
    iban = new("to DE89 3704 0044 0532 0130 00.")
    assert iban != "to DE89 3704 0044 0532 0130 00." and iban.startswith("to DE") and _iban_rest(iban[3:-1].replace(" ", "")) == 1 and len(iban) == 31
    for text in ("12:30:45 and 10:20", "std::vector", "1234567890" * 5, '"documentation.example.org"', "2024 100 2000 10", "Dr. who"):
        assert new(text) == text


def test_entities_in_a_very_long_text(spark):
    long = "word " * 200_000 + "Mr. Smith mails a.b@example.com. " + "word " * 200_000 + "Smith"
    out = replace_pii(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"), KEY).collect()
    assert out[0].text == out[1].text and out[0].n_found == 3 and "Smith" not in out[0].text and "a.b@example" not in out[0].text
    assert out[0].text.count("word ") == 400_000


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 1000])
def test_permutation_of_a_range(size):
    for label in ("a", "b"):
        out = [pii._permuted(KEY, label, x, size, False) for x in range(size)]
        assert sorted(out) == list(range(size)) and [pii._permuted(KEY, label, y, size, True) for y in out] == list(range(size))
    if size > 1:
        moved = [pii._shifted(KEY, "a", x, size) for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(x != y for x, y in enumerate(moved))


def test_a_full_range_of_addresses(spark):
    """All of 192.168.0.0/16 and a few others: surrogates are a permutation of the range, others still avoid the corpus."""
    rows = [(k, " ".join(f"192.168.{k}.{j}" for j in range(256)) + f" and 10.0.0.{k} and 8.8.{k}.8", "x") for k in range(256)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `later draws` string").repartition(8)
    out = {r.doc_id: r for r in replace_pii(df, KEY).collect()}
    pairs = {}
    for k, text, _ in rows:
        assert out[k]["later draws"] == "x" and out[k].n_found == 258
        for (_, a), (_, b) in zip(found(text), found(out[k].text), strict=True):
            assert pairs.setdefault(a, b) == b != a
    local = {a: b for a, b in pairs.items() if a.startswith("192.168.")}
    assert len(local) == 65_536 == len(set(local.values())) and all(b.startswith("192.168.") for b in local.values())
    rest = [b for a, b in pairs.items() if a not in local]
    assert len(rest) == 512 == len(set(rest)) and not set(rest) & set(pairs)


def test_full_ranges_of_other_kinds():
    for kind, norm in (("phone", "0171234567"), ("phone", "4917123456789"), ("phone", "10171234567"), ("ssn", "078051120"), ("ip", "8.8.8.8"), ("ip", "10.1.2.3"), ("ip", "172.20.0.1"), ("ip", "127.0.0.1")):
        made = surrogate(KEY, kind, norm, pii.DENSE)
        assert made != norm and len(made) == len(norm) or kind == "ip"
        assert pii.closed_range(kind, made) == pii.closed_range(kind, norm) and made != norm
    assert pii.closed_range("person", "smith") is None
