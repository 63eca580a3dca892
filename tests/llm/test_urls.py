import random

from tapeloom.llm.urls import RULES, filtered, rule_table

PAGES = "page_id bigint, url string, host string, rule string, stack string, part int"


def split(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].encode().lower().decode(), tail[:stop]


def judge(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def run(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "h", "r", "s", 1) for k, u in enumerate(urls)], PAGES).repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filtered(pages, rule_table(spark, rules)).collect()}
    assert got == {k: judge(u, rules) for k, u in enumerate(urls)}


def test_the_fixed_rules(spark):
    run(spark, [
        "http://WWW.Example.com/en/1?x#y", "http://example.com/en/", "http://a.www.example.com/en/", "http://xexample.com/en/", "http://net/es/1",
        "http://a.net/fr", "http://com", "http://com/", "http://.com/", "http://com./", "http://www.example.com?en/", None, "", "no scheme/en/", "://", "a://b://com/",
        "http://É.com/ö", "http://com/\n/x", "http://example.com/en/" + "z" * 20_000, "http://" + "a." * 300 + "com/", "http://example.com/en/",
    ], RULES)


def test_nested_rules_against_all_pairs(spark):
    rng = random.Random(8)
    names, paths = ["a", "b", "a.b", "b.a", "a.b.a"], ["", "/", "/x", "/x/", "/x/y", "/xy"]
    rules = list({(rng.choice(names), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(*k, v) for k, v in rules]
    urls = ["h://" + rng.choice(["", "c.", "b."]) + rng.choice(names) + rng.choice(paths) + rng.choice(["", "y", "/z", "?x"]) for _ in range(300)]
    run(spark, urls, rules)


def test_nothing(spark):
    pages = spark.createDataFrame([], PAGES)
    assert filtered(pages, rule_table(spark)).count() == 0
    one = spark.createDataFrame([(None, "http://com/", "h", "r", "s", 1)] * 2, PAGES)
    assert [tuple(r) for r in filtered(one, rule_table(spark)).collect()] == [(None, "com", "/", "com/", "allow")] * 2
    assert [r.rule for r in filtered(one, rule_table(spark).limit(0)).collect()] == [None, None]
