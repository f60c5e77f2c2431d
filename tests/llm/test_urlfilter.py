import random

from pyspark.sql import functions as F

from shardloom.llm import urlfilter
from shardloom.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, path string, score string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:cut].translate(up), tail[:end]


def rule(host, path):
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def urls():
    rng = random.Random(4)
    good = [f"https://{rng.choice(['www', 'm', 'blog'])}.site{rng.randrange(20)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(999)}" for _ in range(400)]
    bad = [f"http://{rng.choice(['casino-win', 'free-bets', 'adult-x'])}.example.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'fr'])}/{rng.randrange(999)}?page=2&ref=x" for _ in range(120)]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/EN/7", "http://Ex\u00c4MPLE.com/en/7", "x://com/en/", "http://notcom/en/1", "http://a.example.com/en/7?x#y", "http://b.net#/de/", "http://b.net?/de/", "a://b://c/d", "http://a.net/de/8", "http://example.net/de/8\n9"]
    return [*good, *bad, *odd, good[0]]


def test_rules_and_trees(spark):
    rows = urls()
    df = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in enumerate(rows)], SCHEMA)
    got = {r.page_id: r for r in urlfilter.judge(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    right = total = 0
    for i, u in enumerate(rows):
        r, (host, path) = got[i], parts(u)
        assert (r.host, r.path) == (host, path), u
        best = rule(host, path)
        assert r.rule == (best.name if best else None), u
        assert 0 <= r.score <= 1 and r.verdict == (best.verdict if best else "block" if r.score >= 0.5 else "allow")
        if host and i < 520:
            total += 1
            right += (r.score >= 0.5) == (i >= 400)
    assert right / total > 0.97
    assert got[520].verdict == "allow"


def test_one_class_and_empty(spark):
    one = spark.createDataFrame([(1, "http://plain.example.fr/x", "", "", "")], SCHEMA)
    assert urlfilter.judge(one, URL_RULES).first().verdict == "allow"
    assert urlfilter.judge(one.limit(0), []).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(i, u, "c", "c", "c") for i, u in enumerate(urls())], SCHEMA).select("page_id", F.col("url"))
    plan = urlfilter.judge(df, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
