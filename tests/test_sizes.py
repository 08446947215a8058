"""What a task holds or a shuffle moves must not grow with the tables."""

import numpy as np

from stepwell.operators import retrieval as R
from stepwell.operators import selection, statistics
from stepwell.plans import registry

SF = "/root/testdata/sf0.001"


def test_dense_tiles_meet_ties(spark, monkeypatch):
    """Tiles smaller than the tables give what all scores at once give, and no score array is larger than a tile and the best so far."""
    v = np.random.default_rng(1).integers(-2, 3, (300, 4)).astype(float)
    monkeypatch.setattr(R, "TILE_QUERIES", 7)
    monkeypatch.setattr(R, "TILE_UNITS", 11)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "unit long, v array<double>").repartition(2)
    got = {(r.qid, r.unit, r.rank) for r in R.dense_top(rows.selectExpr("unit as qid", "v as q").where("qid % 5 = 0"), rows, 6).collect()}
    want = set()
    for q in range(0, 300, 5):
        order = sorted((u for u in range(300) if u != q), key=lambda u: (-(v[q] @ v[u]), u))[:6]
        want |= {(q, u, i + 1) for i, u in enumerate(order)}
    assert got == want


def test_a_task_orders_so_many_lines(spark, monkeypatch):
    monkeypatch.setattr(registry, "STEP_BYTES", 4096)
    size = int(registry.table(spark, SF, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert registry.steps(spark, SF).rdd.getNumPartitions() == -(-size // 4096) > 4


def test_okapi_moves_texts_once(spark):
    """No row for each word of a text is shuffled: tokens are dealt by question alone."""
    docs = spark.createDataFrame([(1, 1, "a b"), (1, 2, "b c c")], "qid long, doc long, text string")
    plan = selection.okapi(docs, docs.where("doc = 1").select("qid", "text"))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("term" in line for line in moved)


def test_replicates_are_summed_in_columns(spark):
    """An id makes a row for each block of replicates, not for each of them, and its draws are compiled expressions."""
    rows = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(50)], "qid long, num double, den double")
    out = statistics.bootstrap(rows, "qid", "num", "den", 10, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and out.first()["ci_low"] <= out.first()["observed"] <= out.first()["ci_high"]


def test_the_best_of_bm25_are_kept_where_documents_lie(spark, monkeypatch):
    """Blocks and tiles smaller than the tables give what all scores give, ties by document, and no row for a pair is shuffled before the best are taken."""
    docs = spark.createDataFrame([(i, None if i == 7 else " ".join(f"w{i % m}" for m in (2, 3, 5, 7)) + (" W1 x" if i % 4 == 0 else "")) for i in range(60)], "doc long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "w1 w1 w4"), (1, "none of it"), (2, ""), (3, None), (4, "w0 x w6"), (5, "w2")], "qid long, text string")
    monkeypatch.setattr(R, "TILE_QUERIES", 2)
    monkeypatch.setattr(R, "TILE_PARTS", 20)
    monkeypatch.setattr(R, "BLOCK_BYTES", 60)
    out = R.bm25_top(docs, asked, 6)
    want = {tuple(r) for r in R.top_k(R.bm25(docs, asked), 6).select("qid", "doc", "score", "rank").collect()}
    assert {tuple(r) for r in out.select("qid", "doc", "score", "rank").collect()} == want and len({w[0] for w in want}) == 3
    moved = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "qid" in moved[0]
