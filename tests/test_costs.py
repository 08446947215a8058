"""What a row costs must not depend on how often an expression names a value: plans that work out each thing once."""

import re

from pyspark.sql import functions as F

from stepwell.operators import online, teacher
from stepwell.plans import audits, diagnosis, registry, shown

SF = "/root/testdata/sf0.001"


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_measured_once(spark):
    """Texts are measured below the join with the contexts that have them."""
    plan = optimized(diagnosis.context_sizes(spark, SF))
    above, below = plan.split("Join", 1)
    assert r"\S+" in below and r"\S+" not in above


def test_a_part_is_scored_once(spark):
    plan = optimized(shown.reference_scores(spark, SF))
    above, below = plan.split("Join", 1)
    assert "translate(" in below and "translate(" not in above


def test_a_policy_values_a_candidate_once(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 0), (1, 2, 1.5, 0), (1, 3, 1.5, 1)], "qid long, unit long, score double, doc long")
    out = online.rollout(rows, 3, online.repeated_doc_policy(0.75))
    assert optimized(out).count("0.75") == 1
    assert [(r.t, r.unit, r.value) for r in out.orderBy("t").collect()] == [(0, 1, 2.0), (1, 3, 1.5), (2, 2, 0.75)]
    assert [r.unit for r in online.rollout(rows, 3, online.repeated_doc_policy(0.75), 1.0).orderBy("t").collect()] == [1, 3]


def test_states_of_coverage_are_made_once(spark):
    """The pools are joined to the steps; the state before is a row of the same table."""
    from stepwell.plans import online as queries

    assert len(re.findall(r"\bJoin ", optimized(queries.coverage_students(spark, SF)))) == 1


def test_a_note_is_cut_into_words_once(spark):
    notes = spark.createDataFrame([(1, "0", 0, "bridge_note", "A note.", ["a"], ["a"], ["Another."]), (1, "1", 1, "bridge_note", "a note", ["a"], ["a"], ["Another."])], "qid long, note_id string, pos long, type string, text string, sources array<string>, visible array<string>, existing array<string>")
    out = teacher.legality(notes)
    assert optimized(out).count("([a-z0-9]+)") == 2  # of the note, and of a text of the state
    assert [(r.legal, r.reasons) for r in out.orderBy("note_id").collect()] == [(True, []), (False, ["duplicate_in_harvest"])]


def test_candidates_are_composed_without_joins(spark):
    plan = audits.composed_candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_a_document_is_searched_for_phrases_once(spark):
    """The question and the answer are made of one list of phrases, and rules on the question don't make it anew."""
    from stepwell.plans import rollouts

    assert len(re.findall(r"regexp_extract_all\(text#\d+", optimized(rollouts.rule_made_notes(spark, SF)))) == 1


def test_picks_of_a_unit_are_gathered_once(spark):
    """One filter finds a unit's picks; the others drop empty documents."""
    rows = spark.createDataFrame([(1, 0, "u", "d", "", "x"), (1, 1, "v", "e", "", "y"), (1, 2, "u", "f", "", "z")], "qid long, t int, unit string, doc string, title string, text string")
    out = online.states(rows)
    assert optimized(out).count("filter(") == 3
    s = out.first()["state"]
    assert (s["H_t"], s["A_t"]["unit_doc"], s["K_t"]) == (["u", "v"], {"u": "f", "v": "e"}, "Evidence:\n[1] e: y\n[2] d: x")


def test_the_front_end_sends_no_pool_through_the_driver(spark):
    from stepwell.plans import gating

    out = gating.rebuilt_candidates(spark, SF)
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [qid" in plan and not re.search(r"BroadcastHashJoin \[qid#\d+L?, (unit|doc)", plan)


def test_records_shuffle_texts_packed(spark):
    from stepwell.operators import repair

    runs = spark.createDataFrame([(1, "success", ["a", "b", "c", "a"]), (2, "abort", []), (3, "abort", None)], "qid long, status string, units array<string>")
    units = spark.createDataFrame([("a", "d", "é\n x"), ("b", None, ""), ("d", "d", "unread")], "unit string, doc string, text string")
    out = repair.debug_records(runs, units)
    assert "_packed(cast(text" in optimized(out)
    want = [(1, "success", "[1] d: é\n x\n[2] ?: \n[3] ?: [missing]\n[4] d: é\n x", ["missing_unit"]), (2, "abort", "", ["no_selected_chunks"]), (3, "abort", "", ["no_selected_chunks"])]
    assert [tuple(r) for r in out.orderBy("qid").collect()] == want


def test_records_shuffle_places_of_texts(spark):
    """Texts are written once and read where a record is made; a text that is null or isn't there is missing, as when texts are shuffled."""
    from stepwell.operators import repair
    from stepwell.plans import repairs
    from stepwell.sources.tables import placed

    runs = spark.createDataFrame([(1, "success", ["a", "b", "c", "a", "e"]), (2, "abort", []), (3, "abort", None), (4, "abort", ["b"])], "qid long, status string, units array<string>")
    units = spark.createDataFrame([("a", "d", "é\n x" * 300), ("b", None, ""), ("d", "d", "unread"), ("e", "e", None)], "unit string, doc string, text string").repartition(3)
    got, want = (sorted(map(tuple, repair.debug_records(runs, u).collect())) for u in (placed(units), units))
    assert got == want and got[0][2:] == ("[1] d: " + "é\n x" * 300 + "\n[2] ?: \n[3] ?: [missing]\n[4] d: " + "é\n x" * 300 + "\n[5] e: [missing]", ["missing_unit"]) and got[3][2:] == ("[1] ?: ", [])
    assert repair.debug_records(runs, placed(units.where("false"))).count() == 4
    plan = repairs.debug_records(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "_packed(" not in plan and "documents.parquet" not in plan


def test_a_task_holds_few_records(spark, monkeypatch):
    """Records are handed on by their bytes, in their order and whole."""
    from stepwell.operators import repair
    from stepwell.sources.tables import placed

    units = spark.createDataFrame([(f"u{i}", None, str(i) * 200) for i in range(10)], "unit string, doc string, text string")
    runs = spark.createDataFrame([(q, "success", [f"u{(q + i) % 12}" for i in range(q % 4)]) for q in range(200)], "qid long, status string, units array<string>").coalesce(1)
    monkeypatch.setattr(repair, "READ_BYTES", 1500)
    got, want = (sorted(map(tuple, repair.debug_records(runs, u).collect())) for u in (placed(units), units))
    assert got == want and len(got) == 200


def test_questions_are_read_once(spark):
    """A text's fields and a list's items are read by one expression each, an item's kind isn't found from its schema, and a question's lines are shuffled once."""
    from stepwell.plans import rollouts
    from stepwell.sources import layouts

    rows = rollouts.mixed_layouts(spark, SF)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plan = optimized(layouts.projected(spark.createDataFrame([("{}",)], "value string")))
    assert "schema_of_variant" not in plan and "SchemaOfVariant" not in plan and plan.count("try_variant_get(") <= 12


def test_items_by_key_are_sorted_without_comparing_expressions(spark):
    from stepwell.functions.arrays import by_key

    out = spark.createDataFrame([(["b", None, "a", "c"],), ([],), (None,)], "u array<string>").select(by_key(F.col("u"), lambda x: F.coalesce(x, F.lit("a"))).alias("u"))
    assert "array_sort(" not in optimized(out)
    assert [r.u for r in out.collect()] == [[None, "a", "b", "c"], [], None]
