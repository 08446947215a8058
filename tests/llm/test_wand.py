"""Ranked search against scoring every document, and its blocks against all ways to cut."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from stepwell.llm import queries, wand

from ..oracle import compare, connection

SF = "/root/testdata/sf0.001"
TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    counts = [(key, Counter(words(text))) for key, text in docs]
    with_terms = [c for _, c in counts if c]
    n_docs, total = len(with_terms), sum(sum(c.values()) for c in with_terms)
    df = Counter(t for c in with_terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(spark, tmp_path, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as term", "2 as shard").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "'x' as w")
    index = wand.build(d, str(tmp_path / "index"))
    return sorted((tuple(r) for r in wand.search(index, q, k).collect()), key=repr)


def test_terms():
    texts = ["Äb-C 9_x", "", "z", " \x7fé\x80ü A", "end"]
    of, found = wand.terms(pa.array(texts))
    assert [(i, t.decode()) for i, t in zip(of.tolist(), found.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert len(wand.terms(pa.array([], pa.string()))[1]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_blocks_have_the_least_cost(seed, monkeypatch):
    monkeypatch.setattr(wand, "MOST_BLOCK", 4)
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 10, 12)
    starts = np.cumsum(sizes) - sizes
    u = rng.integers(1, 1000, sizes.sum())
    number, ends, tops = wand.cut(u, starts, sizes)
    at = np.cumsum(number) - number
    for i, n in enumerate(sizes):
        own = u[starts[i] : starts[i] + n]
        cost = lambda e: sum(own[a:b].max() * (b - a) + wand.BLOCK_COST * own.mean() for a, b in zip([0, *e], e))  # noqa: E731, B023
        ways = [[*inner, int(n)] for k in range(n) for inner in itertools.combinations(range(1, n), k)]
        mine = ends[at[i] : at[i] + number[i]].tolist()
        assert mine[-1] == n
        assert math.isclose(cost(mine), min(cost(w) for w in ways if all(b - a <= 4 for a, b in zip([0, *w], w))))
        assert tops[at[i] : at[i] + number[i]].tolist() == [own[a:b].max() for a, b in zip([0, *mine], mine)]


def test_equals_scoring_every_document(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 300])))) for i in range(700)]
    docs += [(900, None), (901, ""), (902, "!?"), (None, docs[3][1]), (903, docs[3][1]), (904, docs[3][1]), (904, docs[3][1]), (905, "w1 " * 50_000), (906, "É Ünï w1 W1")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30])))) for i in range(25)] + [(50, None), (51, "absent"), (52, "ünï É w1 w1")]
    for k in (1, 20):
        assert got(spark, tmp_path / str(k), docs, items, k) == plain(docs, items, k)


def test_many_shards_and_blocks_of_queries(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randrange(1, 30)))) for i in range(3000)]
    monkeypatch.setattr(wand, "BLOCK_TERMS", 3)
    items = [(1, "a b"), (2, "c d d"), (3, "h")]
    assert got(spark, tmp_path, docs, items) == plain(docs, items)


def test_empty_tables(spark, tmp_path):
    assert got(spark, tmp_path / "a", [], [(1, "a")]) == []
    assert got(spark, tmp_path / "b", [(1, "a")], []) == []


def test_skips_blocks(monkeypatch):
    n = 5000
    texts = pa.array(["rare " * (1 + 400 * (i % 977 == 0)) + "common " * 60 for i in range(n)])
    batch = wand._shard("0", pa.array(range(n), pa.int64()), texts, n, 61 * n)
    lists = wand.Lists(pa.Table.from_batches([batch]))
    read = []
    monkeypatch.setattr(wand.np, "repeat", lambda a, size, repeat=np.repeat: read.append(int(np.sum(size))) or repeat(a, size))
    docs, scores = lists.best([(b"rare", 7)], 3)
    assert docs.tolist() == [0, 977, 1954] and sum(read) < n // 4


def test_query_equals_sql(spark):
    assert compare(connection(SF), queries.op11_wand(spark, SF), queries.OP11_SQL) == ""
