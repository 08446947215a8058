import json

from pyspark.sql import functions as F

from stepwell.functions import answers as A
from stepwell.functions import text as T
from stepwell.operators import retrieval as R
from stepwell.operators import scorers, statistics, teacher
from stepwell.operators import trajectories as J
from stepwell.operators import units as U
from stepwell.plans import registry, retrieval, steps  # noqa: F401  they register their queries
from stepwell.sources import cache
from stepwell.sources import json as sources
from stepwell.streaming import state

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_answer_f1(spark):
    r = one(spark, F.round(A.f1(F.lit("the cat sat"), F.lit("cat")), 6), A.official_f1(F.lit("yes it is"), F.lit("yes")), A.exact_match(F.lit("The cat!"), F.lit("cat")), A.f1(F.lit(""), F.lit("the")))
    assert tuple(r) == (0.666667, 0.0, 1, 1.0)


def test_jaccard_of_empty(spark):
    none = F.array().cast("array<string>")
    assert tuple(one(spark, T.jaccard(none, none), T.jaccard(none, none, 0.0))) == (1.0, 0.0)


def test_deficit(spark):
    assert tuple(one(spark, J.deficit(F.lit(0.0), F.lit(1.0)), J.deficit(F.lit(1.0), F.lit(1.0)), J.deficit(F.lit(0.0), F.lit(0.0)))) == (0.666667, 0.333333, 0.0)


def test_stop_labels(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "t int").select(J.stop_label(F.lit(True), F.lit(3), F.col("t"), F.lit(False)).alias("s"))
    assert [r.s for r in rows.collect()] == ["near-terminal", "near-terminal", "terminal"]


def test_percentile_and_minmax(spark):
    assert spark.range(1, 101).agg(statistics.percentile("id", 0.025)).first()[0] == 3.475
    scores = spark.createDataFrame([(1, 2.0), (1, 2.0)], "qid int, s double").select(R.minmax_over("s", "qid").alias("m"))
    assert [r.m for r in scores.collect()] == [0.0, 0.0]


def test_json_replies(spark):
    raw = F.lit('```json\n{"answer": "x"}\n```')
    assert one(spark, T.json_answer(raw))[0] == "x"
    assert one(spark, T.json_answer(F.lit('so {"answer": "y"} then')))[0] == "y"
    assert one(spark, T.json_answer(F.lit("plain\nmore")))[0] == "plain"
    assert one(spark, T.json_indices(F.lit('{"indices": [3, 1, 3, 9]}'), F.lit(4)))[0] == [2, 0]


def test_units_and_anchors(spark):
    docs = spark.createDataFrame([(1, "A cat. It sat!  Then? ")], "doc_id long, text string")
    assert [r.text for r in U.units(docs).orderBy("sent_id").collect()] == ["A cat.", "It sat!", "Then?"]
    assert one(spark, T.anchors(F.lit("The Green River runs north")))[0] == ["the green river", "green", "river", "runs", "north"]
    assert one(spark, T.unit_chunk(F.lit("q::a::b::7")))[0] == "q::a::b"
    facts = spark.createDataFrame([("q", "T", 0)], "qid string, title string, sent_id int")
    samples = spark.createDataFrame([("q", [("T", ["One.", " ", "Two."])])], "qid string, context array<struct<title:string,sentences:array<string>>>")
    found = U.with_support(U.context_units(samples), facts).orderBy("sent_id").collect()
    assert [(r.sent_id, r.is_supporting) for r in found] == [(0, True), (2, False)]
    assert U.unresolved_facts(U.context_units(samples), facts).count() == 0


def test_mmr_keeps_a_small_pool_and_spreads_a_large_one(spark):
    rows = [(1, i, i, t, r) for i, (t, r) in enumerate([("a b c", 3.0), ("a b c", 2.9), ("x y z", 1.0)])]
    pool = spark.createDataFrame(rows, "qid int, unit int, doc int, text string, relevance double")
    assert [r.unit for r in R.mmr(pool, 3).orderBy("pos").collect()] == [0, 1, 2]
    assert [r.unit for r in R.mmr(pool, 2, 0.5).orderBy("pos").collect()] == [0, 2]


def test_rollout_against_a_plain_version(spark):
    got = registry.QUERIES["teacher_rollout"](spark, SF).toPandas()
    rows = J.keep_first(registry.steps(spark, SF), ["qid", "unit"], ["t"]).toPandas().sort_values(["qid", "unit"])
    for qid, group in list(rows.groupby("qid"))[:200]:
        pool, covered, recent, want, idle = group.to_dict("records"), set(), [], [], 0
        roles = set(group.role)
        while pool and len(want) < 8 and covered != roles and idle < 2:
            best = max(pool, key=lambda r: (round((r["role"] not in covered) + r["score"] / 1e7 - 0.05 * (r["doc"] in recent[-2:]), 9), -pool.index(r)))
            idle = 0 if best["role"] not in covered else idle + 1
            covered.add(best["role"])
            recent.append(best["doc"])
            want.append(best["unit"])
            pool.remove(best)
        assert list(got[got.qid == qid].sort_values("t").unit) == want


def test_legality_and_retention(spark):
    schema = "qid int, note_id string, pos int, type string, text string, sources array<string>, visible array<string>, existing array<string>"
    row = lambda i, n, kind, text, src, old=None: (1, n, i, kind, text, src, ["u", "v"], old)
    rows = [row(0, "a", "bridge_note", "One two three.", ["u"]), row(1, "b", "bridge_note", "one two three", ["u"]), row(2, "c", "odd", "x", []), row(3, "d", "bridge_note", "Two. Sentences", ["u", "u"]), row(4, "e", "bridge_note", " ", ["w"]), row(5, "f", "verification_note", "known", ["v"], ["Known!"])]
    got = {r.note_id: r.reasons for r in teacher.legality(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "a": [], "b": ["duplicate_in_harvest"], "c": ["invalid_source_count", "invalid_type"], "d": ["duplicated_source_ids", "not_single_sentence"],
        "e": ["empty_text", "invisible_source_ids", "not_single_sentence"], "f": ["duplicate_with_state"],
    }
    notes = [(q, n, kind, p, 1, face, close, "repair_after_false_stop" if q == 4 else "normal", sub) for q, sub in enumerate(["late_verification", "early_bridge", "trigger_only_candidate", None, None]) for n, kind, p, face, close in [("a", "verification_note", 1, False, 9), ("b", "bridge_note", 2, True, 1), ("c", "bridge_note", 3, True, 5)]]
    kept = teacher.retention(spark.createDataFrame(notes, "qid int, note_id string, type string, priority int, sources int, answer_facing boolean, closure int, mode string, subtype string")).where("kept").collect()
    assert sorted((r.qid, r.note_id) for r in kept) == [(0, "b"), (0, "c"), (1, "b"), (4, "b"), (4, "c")]


def test_scorers(spark):
    assert one(spark, scorers.linear(F.array(F.lit(1.0), F.lit(2.0)), [3.0, 4.0], 1.0))[0] == 12.0
    assert one(spark, scorers.interaction(F.array(F.lit(1.0)), F.array(F.lit(3.0))))[0] == [1.0, 3.0, 3.0, 2.0]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sources.write_jsonl(df, str(tmp_path / "rows")) == 2
    assert sources.read_jsonl(spark, str(tmp_path / "rows"), "k int, v string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n\n{bad\n')
    assert sources.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int", strict=False).collect()[-1]["_corrupt_record"] == "{bad"
    (tmp_path / "doc.json").write_text(json.dumps({"results": [{"k": 5}, {"k": 6}]}))
    assert sorted(r.k for r in sources.read_local(spark, str(tmp_path / "doc.json"), "k int").collect()) == [5, 6]
    sources.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert sources.config_differences({"a": {"b": 1}}, {"a": {"b": 2}, "c": 3}, {"c"}) == {"a.b": (1, 2)}


def test_cache_keeps_successes_only_and_asks_once(spark, tmp_path):
    rows = spark.createDataFrame([("p1",), ("p2",), ("p1",)], "prompt string").withColumn("key", cache.request_key("prompt"))
    path = str(tmp_path / "cache")
    assert cache.resume(rows, path).count() == 0
    assert cache.resume(rows, path, lambda ps: [p.upper() for p in ps]).count() == 3
    assert cache.Cache(spark, path).read().count() == 2

def test_cache_commits_each_key_once(spark, tmp_path):
    rows = lambda *ps: spark.createDataFrame([(p,) for p in ps], "prompt string").withColumn("key", cache.request_key("prompt"))
    path = str(tmp_path / "cache")
    store = cache.Cache(spark, path)
    answers = lambda: sorted(r["answer"] for r in store.read().collect())

    rows("x").select("key", F.lit("half").alias("answer")).write.parquet(f"{path}/runs/broken.0")  # a run that never came to its commit
    assert answers() == []
    cache.resume(rows("a", "b"), path, lambda ps: [f"1{p}" for p in ps], "one")
    cache.resume(rows("a", "b", "c"), path, lambda ps: [f"2{p}" for p in ps], "one")  # the run is there already
    assert answers() == ["1a", "1b"]
    # another run comes between the reading and the commit of this one
    known = store.commits()
    made = cache.complete(cache.misses(rows("b", "c", "d"), store.read(known)), lambda ps: [f"3{p}" for p in ps])
    cache.resume(rows("c", "e"), path, lambda ps: [f"4{p}" for p in ps], "between")
    store.add(made, "slow", known)
    assert answers() == ["1a", "1b", "3d", "4c", "4e"]
    store.add(made, "slow", known)
    assert len(store.commits()) == 3 and len(answers()) == 5


def test_cache_with_runs_in_parallel(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "cache")
    rows = spark.range(40).selectExpr("cast(id as string) prompt").withColumn("key", cache.request_key("prompt"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: cache.resume(rows.where(f"prompt % 4 <> {i}"), path, lambda ps: list(ps), f"r{i}").count(), range(4)))
    kept = cache.Cache(spark, path).read()
    assert kept.count() == kept.select("key").distinct().count() == 40


def test_mmr_selection_asks_all_items(spark):
    from stepwell.plans import retrieval

    asked = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    assert len(asked) > 20 and {r.qid for r in retrieval.mmr_selection(spark, SF).select("qid").distinct().collect()} == asked


def test_quota_sample_fills_up_from_other_strata(spark):
    import hashlib

    key = lambda seed, i: hashlib.sha256(f"{seed}::{i}".encode()).hexdigest()
    stratum = {i: "a" if i < 4 else "b" if i < 50 else "c" for i in range(60)}
    rows = spark.createDataFrame([(s, i) for i, s in stratum.items()], "stratum string, id long")
    want = [i for s, n in {"a": 10, "b": 6}.items() for i in sorted((i for i in stratum if stratum[i] == s), key=lambda i: key(3, i))[:n]]
    want += sorted(set(stratum) - set(want), key=lambda i: key(4, i))[: 16 - len(want)]
    assert [r.id for r in R.quota_sample(rows, "stratum", "id", {"a": 10, "b": 6}, 3).collect()] == sorted(want, key=lambda i: key(5, i))


def test_sentences_keep_numbers_at_their_ends(spark):
    """A sentence was trimmed of its own place instead of white space."""
    assert one(spark, T.sentences(F.lit(" 0 a. 1 b 1! 3 c 2 ")))[0] == ["0 a.", "1 b 1!", "3 c 2"]
