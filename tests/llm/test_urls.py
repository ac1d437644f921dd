"""Parsing and rules against plain Python; the model on labels it has not seen."""

from pyspark.sql import functions as F

from tableloom.llm import urls
from tableloom.llm.queries import URL_RULES, op4_urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[cut:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:stop]


def best_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), r.text), default=None)


ODD = [None, "", "example.org/es/1", "http://Example.ORG/es/1", "http://xexample.org/es/1", "https://a.example.org/en/12?x=1#y",
       "http://org", "http://org/", "http://é.ORG/Ä?q", "://com/fr/", "http://x.com/de/a://b", "http://x.com?u=/de/", "x://#",
       "http://x.com/DE/", "http://x.com/fr", "http://a\nb.com/fr/\n1", "http://" + "a" * 20_000 + ".com/de/"]


def test_odd_urls(spark):
    df = spark.createDataFrame([(u, "x", 1) for u in ODD + ODD[:3]], "url string, host string, verdict int")
    out = urls.judge(df, URL_RULES).collect()
    assert len(out) == len(ODD) + 3
    for r in out:
        host, path = parse(r.url)
        rule = best_rule(host, path, URL_RULES)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule.text if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_query(spark):
    for r in op4_urls(spark, "/root/testdata/sf0.01").collect():
        rule = best_rule(r.host, r.path, URL_RULES)
        assert r.rule == (rule.text if rule else None) and (rule is None or r.verdict == rule.verdict)


def test_model_judges_unseen_urls(spark):
    good = [(f"http://news{i}.site.com/articles/2024/story-{i * 7}.html", 0) for i in range(120)]
    bad = [(f"http://free-casino{i}.win/bonus/spin?id={i}", 1) for i in range(120)]
    labelled = spark.createDataFrame(good[:80] + bad[:80], "url string, blocked int")
    rest = spark.createDataFrame(good[80:] + bad[80:], "url string, truth int")
    out = urls.judge(rest, [], labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(r.truth) for r in out) >= 0.95 * len(out)
    one = urls.judge(rest, [], labelled=labelled.filter("blocked = 1")).filter(F.col("verdict") == "allow")
    assert one.count() == 0


def test_ngrams_do_not_cross_texts():
    row, feature = urls.ngrams(["ab", "cd"], 0)
    alone = [set(urls.ngrams([t], 0)[1].tolist()) for t in ("ab", "cd")]
    assert [set(feature[row == i].tolist()) for i in (0, 1)] == alone
    assert urls.ngrams(["ab"], 0)[1].tolist() != urls.ngrams(["ab"], 1)[1].tolist()
    assert urls.ngrams([], 0)[0].tolist() == []
