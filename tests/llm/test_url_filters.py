import random
import re

import pytest
from pyspark.sql import functions as F

from askframe.llm import url_filters as U


def brute(url, rules):
    """Every rule tried: the longest that fits wins, then the longer host, then block."""
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, won[3], won[4]


URLS = [None, "", "no scheme", "http://", "http:///en/", "http://com", "http://com/", "http://a.com", "http://a.com/", "http://A.COM/x",
        "http://notcom/", "http://example.com/en/", "http://example.com/en", "http://EXAMPLE.com/EN/", "http://www.example.com/en/x?q#f",
        "http://x.www.example.com/en/1", "http://xexample.com/en/", "http://blog.example.com/en/?a=://b/", "http://a.net/es/1", "http://net/fr/",
        "http://a.net/de/1", "http://a.net?x/es/", "http://a.com:80/", "x://y://com/", "http://É.com/", "http://a..com//en/", "http://com./",
        "http://a.com/\n/x", "http://" + "a." * 500 + "com/" + "d/" * 2000]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {x["page_id"]: tuple(x)[2:] for x in U.judge_urls(pages, r).collect()}


def test_fixed_rules_equal_brute_force(spark):
    assert judged(spark, URLS, U.RULES) == {i: brute(u, U.RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("shuffled", [False, True])
def test_random_rules_equal_brute_force(spark, shuffled):
    rng = random.Random(4)
    label, part = ["a", "b", "ab", "com", "net"], ["x/", "y/", "xy/", "x", ""]
    host = lambda n: ".".join(rng.choice(label) for _ in range(rng.randint(1, n)))
    path = lambda n: rng.choice(["/", "", "/"]) + "".join(rng.choice(part) for _ in range(rng.randint(0, n)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(2), path(2)) for _ in range(40))}.values())
    urls = [f"http://{host(4)}{path(4)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    urls += [urls[0]] * 300
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if shuffled:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert judged(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_shared_prefix_is_confirmed_by_the_digest(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX", 1)  # one hex digit: most meetings are false
    assert judged(spark, URLS, U.RULES) == {i: brute(u, U.RULES) for i, u in enumerate(URLS)}


def test_no_rules_empty_table_and_columns(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "x")], "page_id long, url string, digits string")
    assert [tuple(r) for r in U.judge_urls(pages, none, default="block").collect()] == [(1, "http://a.com/", "x", "a.com", "/", None, "block")]
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages.limit(0), rules).collect() == []
    assert U.judge_urls(pages, rules).first()["digits"] == "x"
    with pytest.raises(ValueError):
        U.judge_urls(pages.withColumn("Rule", F.lit(1)), rules)


def test_query(spark, tables):
    folder = tables(pages=[(i, u, "") for i, u in enumerate(URLS)] + [(None, "http://a.com/", None), (3, URLS[3], "")])
    got = sorted(map(tuple, U.op12(spark, folder).collect()), key=str)
    want = [(i, *brute(u, U.RULES)) for i, u in enumerate(URLS)] + [(None, "a.com", "/", "com/", "allow"), (3, *brute(URLS[3], U.RULES))]
    assert got == sorted(want, key=str)
