"""The tolerant as-of join against a plain loop."""

import random
from collections import Counter

import pytest

from stepwell.llm import asof, queries

from ..oracle import compare, connection

SF = "/root/testdata/sf0.001"
CLICKS, ORDERS = "id long, client long, us long", "client long, us long, sale long, priority int, cents long"


def plain(clicks, orders, tolerance):
    out = []
    for id_, client, us in clicks:
        before = [o for o in orders if None not in (client, us, o[0], o[1]) and o[0] == client and 0 <= us - o[1] <= tolerance]
        if not before:
            out.append((id_, client, us, None, None, None, 0))
            continue
        at = max(o[1] for o in before)
        tied = [o for o in before if o[1] == at]
        low = -(10**30)
        best = max(tied, key=lambda o: (low if o[3] is None else -o[3], low if o[2] is None else o[2], low if o[4] is None else o[4]))
        out.append((id_, client, us, best[2], us - at, best[4], len(tied)))
    return out


def got(spark, clicks, orders, tolerance, extra=False):
    c, o = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(orders, ORDERS)
    if extra:
        c, o = c.selectExpr("*", "'x' as kind", "1 as tied", "2 as pid", "3 as state"), o.selectExpr("*", "'x' as id", "1 as tied")
    return [tuple(r) for r in asof.matches(c, o, tolerance).collect()]


@pytest.mark.parametrize("hot", [False, True])
def test_equals_a_plain_loop(spark, hot):
    rng = random.Random(3)
    pick = lambda: rng.choice([7, 7, 7, 7, None] if hot else [1, 2, 3, 4, None])
    clicks = [(i, pick(), rng.choice([None, *range(0, 400)])) for i in range(600)]
    orders = [(pick(), rng.choice([None, *range(50, 350, 3)]), rng.choice([None, i, -i]), rng.choice([None, 1, 2]), rng.choice([None, i])) for i in range(150)]
    for tolerance in (0, 5, 1000):
        assert Counter(got(spark, clicks, orders, tolerance, extra=hot)) == Counter(plain(clicks, orders, tolerance))


def test_a_match_crosses_partitions_without_orders(spark):
    clicks, orders = [(i, 1, 10 + i) for i in range(500)], [(1, 5, 9, 1, 100), (1, 5, 8, None, 7), (0, 600, 3, 1, 1)]
    assert {r[3:] for r in got(spark, clicks, orders, 10_000)} == {(9, 5 + i, 100, 2) for i in range(500)}


def test_empty_tables_repeated_rows_and_ties_at_the_edge(spark):
    assert got(spark, [], [(1, 1, 1, 1, 1)], 9) == []
    assert got(spark, [(1, 1, 1)], [], 9) == [(1, 1, 1, None, None, None, 0)]
    order = (1, 10, 5, 1, 1)
    assert got(spark, [(1, 1, 10), (1, 1, 10)], [order, order], 0) == [(1, 1, 10, 5, 0, 1, 2)] * 2


def test_query_equals_sql(spark):
    assert compare(connection(SF), queries.op13_asof(spark, SF), queries.OP13_SQL) == ""
