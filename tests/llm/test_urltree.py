"""The URL filter against a plain version of its tree, and its rules against plain string operations."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stepwell.llm import queries, urltree

SF = "/root/testdata/sf0.01"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(host, path, rules):
    fits = [(h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def shape(path):
    for c in "{}*|":
        path = path.replace(c, f"%{ord(c):X}")
    return tuple(re.sub("[0-9]+", "{n}", path).split("/", urltree.MOST_DEPTH + 1)[1 : urltree.MOST_DEPTH + 1])


def grown(rows, depth=0):
    """rows: (shape, blocked) of a node's urls; template by shape."""
    out = {s: "" for s, _ in rows if len(s) <= depth}
    going = [(s, b) for s, b in rows if len(s) > depth]
    count = Counter(s[depth] for s, _ in going)
    own = lambda seg: seg if count[seg] >= urltree.LEAST_URLS and count[seg] >= urltree.LEAST_SHARE * len(rows) else "*"
    branches = defaultdict(lambda: Counter(n=0))
    for s, b in going:
        x = branches[own(s[depth])]
        x["n"] += 1
        x["blocked"] += b is True
        x["allowed"] += b is False
        x["ending"] += len(s) == depth + 1
        x["numbered"] += len(s) > depth + 1 and "{n}" in s[depth + 1]
    to = urltree.merged([{"name": k, **{c: v[c] for c in ("n", *urltree.SHARES)}} for k, v in branches.items()])
    for group in {b for b, _ in to.values()}:
        part = [(s, b) for s, b in going if to[own(s[depth])][0] == group]
        out |= {s: f"/{group}{t}" for s, t in grown(part, depth + 1).items()}
    return out


def plain(pages, rules):
    own = [(key, *split(url)) for key, url in pages]
    judged = [(*o, *rule_of(*o[1:], rules)) for o in own]
    labelled = Counter(v for *_, v in judged if v)
    prior = labelled["block"] / max(1, sum(labelled.values()))
    by_host = defaultdict(list)
    for _, host, path, _, verdict in judged:
        by_host[host].append((shape(path), None if verdict is None else verdict == "block"))
    rejected = {}
    for host, rows in by_host.items():
        template, sums = grown(rows), defaultdict(Counter)
        for s, b in rows:
            sums[template[s]][b] += 1
        for s, t in template.items():
            n, bad = sums[t][True] + sums[t][False], sums[t][True]
            rejected[host, s] = bad > 0 and (bad + urltree.PRIOR_WEIGHT * prior) / (n + urltree.PRIOR_WEIGHT) >= urltree.REJECT
    return [(key, host, path, rule, verdict or ("block" if rejected[host, shape(path)] else "allow")) for key, host, path, rule, verdict in judged]


def got(frame):
    return Counter(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in frame.collect())


def test_query_equals_the_plain_version(spark):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert got(queries.op12_urls(spark, SF)) == Counter(plain(pages, queries.URL_RULES))


def test_templates_of_mixed_hosts(spark, monkeypatch):
    monkeypatch.setattr(urltree, "HOT_PART", 20)
    rng = random.Random(4)
    slug = lambda: "".join(rng.choices("abcdefgh", k=6))
    urls = []
    for _ in range(900):
        kind = rng.choice(["/go/{0}", "/tag/{0}/{1}", "/tag/{0}", "/a/b/{1}.html", "/x/{0}/{1}/{0}/end", "", "/"])
        urls.append(f"http://{rng.choice(['Hot.org', 'hot.org', 'b.net'])}{kind.format(slug(), rng.randrange(999))}{rng.choice(['', '?q=/1', '#f'])}")
    urls += [f"http://hot.org/bad/{slug()}" for _ in range(60)] + [f"http://hot.org/bad/{slug()}z" for _ in range(60)] + ["http://c.d/" + "/".join("deep" * 30), None, "", "no scheme", "x://", "a://b://c/d", "u://{*|}/{a}/*"]
    rules = [("block", "hot.org", "/bad/a"), ("block", "hot.org", "/bad/b"), ("block", "hot.org", "/bad/c"), ("block", "hot.org", "/bad/d"), ("allow", "b.net", "/go/"), ("block", "hot.org", "/go/a")]
    pages = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])] * 2 + [(None, urls[5])]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' as host", "1 as n", "2 as rule", "3 as shape").repartition(5)
    found = got(urltree.judge(frame, rules))
    assert found == Counter(plain(pages, rules))
    assert {v for (_, h, p, r, v) in found if p.startswith("/bad/") and r is None} == {"block"}
    assert {v for (_, h, p, r, v) in found if p.startswith("/tag/")} == {"allow"}


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urltree.judge(empty, queries.URL_RULES).collect() == []
    assert got(urltree.judge(spark.createDataFrame([(1, "a://b/c")], "page_id long, url string"), [])) == Counter([(1, "b", "/c", None, "allow")])


def test_hot_and_cold_keys_are_looked_up_alike(spark, monkeypatch):
    monkeypatch.setattr(urltree, "HOT_PART", 4)
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, x long")
    table = spark.createDataFrame([("a", 7, 50), ("b", 8, 1)], "k string, v long, w long")
    out = urltree.looked_up(rows, table, ["k"], "w", 52)
    assert {(r["k"], r["v"]): r["n"] for r in out.groupBy("k", "v").agg(F.count("*").alias("n")).collect()} == {("a", 7): 50, ("b", 8): 1, ("c", None): 1}
