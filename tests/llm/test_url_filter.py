import random

import pytest

import __spark_entry__ as entry
from flowspark.llm.url_filter import Trie, judge_urls
from tests.oracle import connect, same


def brute(rules, host, path):
    best = None
    for action, h, p in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (0 if h == "" else len(h.split(".")), len(p), action == "allow")
            best = max(best, (rank, action, h + p)) if best else (rank, action, h + p)
    return best and best[1:]


def test_trie_matches_brute_force():
    rng = random.Random(1)
    labels, segments = ["a", "b", "com", "", "x-y"], ["", "p", "pq", "q"]
    for _ in range(300):
        rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels[:3], k=rng.randint(0, 3))), rng.choice(["", "/"]) + "/".join(rng.choices(segments, k=rng.randint(0, 3)))) for _ in range(rng.randint(0, 6))]
        trie = Trie(rules)
        for _ in range(20):
            host, path = ".".join(rng.choices(labels, k=rng.randint(0, 4))), rng.choice(["", "/"]) + "/".join(rng.choices(segments, k=rng.randint(0, 4)))
            assert trie.match(host, path) == brute(rules, host, path), (rules, host, path)


def test_join_agrees_and_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Net", "HTTP://a.net/", "http://a.net?x=/en/", "http://b.a.net/en/x#y", "x://y://z/q", "http://a.net/en", "http://ünï.net/", "http://a.net/" + "e/" * 50_000]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate([*urls, *urls[:6]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "a.net", "/en/"), ("block", "A.NET", "/e"), ("block", None, "/q")], "action string, host string, path string")
    small, joined = (judge_urls(df, rules, carry=("page_id",), most_rules=most).collect() for most in (100, 2))
    assert sorted(small) == sorted(joined)
    got = {r.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in small}
    assert got[0] == ("", "", None, "allow") and got[4] == ("a.net", "", None, "allow") and got[6] == ("a.net", "", None, "allow")
    assert got[7] == ("b.a.net", "/en/x", "a.net/en/", "allow") and got[8] == ("y:", "//z/q", None, "allow") and got[9] == ("a.net", "/en", "a.net/e", "block")
    assert len(small) == len(urls) + 6
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def test_query_matches_sql(spark, sf_dir):
    same(entry.queries()["op10_url_filter"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op10_url_filter"])


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="rule"):
        judge_urls(spark.createDataFrame([("http://a/", 1)], "url string, rule int"), spark.createDataFrame([], "action string, host string, path string"), carry=("rule",))
