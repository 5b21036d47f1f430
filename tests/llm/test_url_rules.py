import random

from cellseason.llm.url_rules import judge_urls

from .helpers import clashing


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:host_end], rest[host_end:]
    path_end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:path_end]


def expected(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    if best and len({v for h, p, v in rules if h + p == best[2]}) > 1:
        best = (*best[:3], "block")
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, urls, rules):
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert [c for c in got[0].asDict()] == ["page_id", "host", "path", "rule", "verdict"]
    return {r.page_id: tuple(r)[1:] for r in got}


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels, steps = ["a", "b", "net", "org", "ab", "é"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = sorted({(host(), rng.choice(steps), rng.choice(["allow", "block"])) for _ in range(150)})
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host().upper() if rng.random() < .2 else host()}{rng.choice(steps)}{rng.choice(['', '/c', '?q=/a', '#f', 'b/c?x'])}" for _ in range(1500)]
    urls += urls[:50] + [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://net", "http://net\n.x/\ny", "http://" + "a." * 3000 + "net/a"]
    got = judged(spark, urls, rules)
    assert len(got) == len(urls)
    assert {i: got[i] for i in got} == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_nested_rules_and_ties(spark):
    rules = [("net", "/", "block"), ("a.net", "/", "allow"), ("a.net", "/x/", "block"), ("a.net", "/x/y/", "allow"), ("a.net", "/x/y/", "block"), ("b.a.net", "", "allow"), (None, None, "block")]
    got = judged(spark, ["http://net/", "http://a.net/", "http://c.a.net/x/", "http://a.net/x/y/z", "http://b.a.net", "http://b.a.net/x/q", "http://xnet/", None], rules)
    assert [got[i][2:] for i in range(8)] == [("net/", "block"), ("a.net/", "allow"), ("a.net/x/", "block"), ("a.net/x/y/", "block"), ("b.a.net", "allow"),
                                             ("a.net/x/", "block"), (None, "allow"), ("", "block")]


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "a", "/b", None, "allow")]
    some = spark.createDataFrame([("a", "/", "block")], none.schema)
    assert judge_urls(pages.limit(0), some).collect() == []
