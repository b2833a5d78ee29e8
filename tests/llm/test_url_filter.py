import random

import numpy as np
from pyspark.sql import functions as F

from fiberlake.llm import url_filter as uf


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["example.com", "Example.COM", "a.example.com", "xexample.com", "com", "b.net", "example.net", "z.org", "", "com:80", "..com"]
    paths = ["/en/7", "/en/71", "/en/", "/en", "/de/8", "/de/x", "/es/1?q=/en/", "#/en/", "?x", "", "/EN/7", "/en/7\n9"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "example.com/en/7", "://com/en/", "http://x://com/en/", "http://com" + "/en/" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, uf.RULES).collect()}
    assert got == {i: brute(u, uf.RULES) for i, u in enumerate(urls)}
    assert uf.judge(pages.limit(0), uf.RULES).count() == 0
    assert {r.verdict for r in uf.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_the_universe(spark):
    universe = [f"key {i}" for i in range(5000)]
    listed = universe[::7] + [f"other {i}" for i in range(50)]
    tables = [spark.createDataFrame([(k,) for k in x], "key string") for x in (listed, universe)]
    for limit in (uf.MAX_BROADCAST_BITS, 6000):
        cascades = uf.build(*tables, max_bits=limit)
        found = np.zeros(len(universe), bool)
        for c in cascades:
            found |= c.member(uf.key_hashes(universe))
        assert found.tolist() == [k in set(listed) for k in universe]
        assert (len(cascades) > 1) == (limit == 6000)
        assert max(len(c.levels[0]) for c in cascades) > 2
