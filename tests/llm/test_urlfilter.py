import random

from pyspark.sql import functions as F

from locusgrid.llm import urlfilter as U
from locusgrid.llm.catalog import URL_RULES


def slow(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_rules_match_brute_force(spark):
    urls = [None, "", "nothing", "http://", "http://com", "http://COM/", "x://a.com?/en/", "x://net/es/", "x://b.net/es/x?q#f",
            "x://example.com/en/", "x://www.Example.com/en/1", "x://a.www.example.com/en/", "x://notexample.com/en/",
            "x://com.org/", "x://é.net/fr/é", "x://net./fr/", "x://a..net/fr/", "x://h/\n/en/", "a://b://net/fr/"]
    r = random.Random(1)
    urls += [f"http://{'.'.join(r.choices(['a', 'www', 'example', 'com', 'net'], k=r.randint(1, 4)))}"
             f"{r.choice(['', '/', '/en/', '/es/x', '/fr/', '/EN/'])}{r.choice(['', '?/en/', '#x'])}" for _ in range(300)]
    rows = [(None if i == 3 else i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string").withColumns(
        {c: F.lit(1) for c in ("host", "path", "rule", "verdict", "d", "key")})
    got = sorted(str(tuple(x)) for x in U.judge(df, URL_RULES).collect())
    assert got == sorted(str((i, *slow(u, URL_RULES))) for i, u in rows + rows[:5])
    assert U.judge(df.limit(0), URL_RULES).count() == 0
    assert {x.verdict for x in U.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "key string").cache()
    listed = [f"k{i}" for i in range(0, 5000, 13)] + ["elsewhere"]
    cascade = U.cascade(listed, keys)
    got = cascade.listed([f"k{i}".encode() for i in range(5000)])
    assert [bool(x) for x in got] == [i % 13 == 0 for i in range(5000)] and len(cascade) > 1
    assert not U.cascade([], keys).listed([b"k1"]).any()


def test_shards_are_exact(spark, monkeypatch):
    keys = U.stored(spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string"), "keys")
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    shards = U.sharded(listed, keys, most=100)
    assert len(shards) == 5
    names = [f"k{i}".encode() for i in range(3000)]
    assert [bool(x) for x in shards.listed(names)] == [i % 7 == 0 for i in range(3000)]


def test_hosts_of_many_labels_have_few_keys(spark):
    host = ".".join(["a"] * 50_000) + ".www.example.com"
    assert sum(map(len, U.keys_of(host, "/en/x", (1, 4), 3))) < 200
    pages = spark.createDataFrame([(1, f"http://{host}/en/"), (2, f"http://{host}.net/es/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, URL_RULES).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block")}
