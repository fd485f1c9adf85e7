import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cellcast.llm import urls


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


ODD = [None, "", "no scheme", "http://", "http:///x", "http://A.COM", "http://a.com/", "ftp://x.NET/es/?q=1#f",
       "http://net/fr/a", "http://example.com/en/x", "http://www.example.com/en/x", "http://example.com/en",
       "http://com/x?u=http://net/es/", "http://ÄB.com/É", "a://b://c/d", "://x.org/y", "http://x.net?/es/",
       "http://x.net\n.com/a", "http://e.org/" + "a1b2" * 20_000, "http://xnet/es/"]


def test_rules_and_parts(spark, clashing):
    df = clashing(spark.createDataFrame([(k, u) for k, u in enumerate(ODD + ODD[:3])],
                                        "page_id long, url string"))
    got = urls.judge_urls(df).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        host, path, rule, verdict = slow(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_entropy(spark):
    for text in ("", "aaaa", "abab", "http://x.org/aé漢"):
        n = len(text)
        want = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0
        got = spark.range(1).select(urls.entropy(F.lit(text))).first()[0]
        assert abs(got - want) < 1e-9


def test_trees_learn_from_labelled_urls(spark):
    rows = [(f"http://shop{k}.good.org/page/{k}", "allow") for k in range(300)] + [
        (f"http://x9{k}7z3.bad{k % 7}.biz/a1b2c3/?p={k}&q=1&r=2", "block") for k in range(300)]
    model = urls.fit_urls(spark.createDataFrame(rows, "url string, verdict string"))
    fresh = spark.createDataFrame([("http://shop9000.good.org/page/1",), (
        "http://x123z9.bad3.biz/a9b9c9/?p=1&q=1&r=2",)], "url string")
    got = urls.judge_urls(fresh, rules=(), model=model).collect()
    assert [r.verdict for r in got] == ["allow", "block"]


def test_one_kind_of_label_or_none(spark):
    fresh = spark.createDataFrame([("http://a.org/",)], "url string")
    for label, want in (("block", "block"), ("allow", "allow"), (None, "allow")):
        labelled = spark.createDataFrame([("http://b.org/", label)], "url string, verdict string")
        assert urls.judge_urls(fresh, (), urls.fit_urls(labelled)).first().verdict == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    plan = urls.judge_urls(df)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "Arrow" not in plan and "InPandas" not in plan
