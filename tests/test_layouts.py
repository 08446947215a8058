"""Questions in all layouts, with what they may lack."""

import json

from stepwell.sources import layouts


def got(spark, *rows):
    frame = spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string")
    return [(r["qid"], [tuple(f) for f in r["facts"]], [(b["title"], b["sentences"]) for b in r["context"]], r["problem"]) for r in layouts.projected(frame).collect()]


def row(facts, context, **more):
    return {"id": "q", "question": " Who? ", "answer": "x", "context": context, **({"supporting_facts": facts} if facts is not None else {}), **more}


def test_three_layouts_are_one(spark):
    columns = row({"title": ["A", "B", "A"], "sent_id": [1, 0, 1]}, {"title": ["A", "B"], "sentences": [["One.", "Two."], ["Three."]]})
    pairs = row([["A", 1], ["B", "0"], ["A", "made by", "B"], ["", 1], 5], [["A", "One. Two."], ["B", ["Three.", " "]], ["C", []], 7, ["D"]])
    objects = row(None, [{"title": "A", "sentences": ["One.", "Two."]}, {"doc_title": "B", "paragraph_text": "Three."}, {"sentences": ["no title"]}], evidence=[{"title": "A", "sentence_id": 1}, {"name": "B"}])
    assert got(spark, columns, pairs, objects) == [("q", [("A", 1), ("B", 0)], [("A", ["One.", "Two."]), ("B", ["Three."])], None)] * 3


def test_problems(spark):
    ok = [["A", ["One.", "Two."]]]
    found = got(spark, row([["A", 0]], ok, id=None), row([], ok), row([["A", 2]], ok), row([["A", 0], ["A", 1]], ok), row({"title": ["A"], "sent_id": []}, ok), row([["A", 0]], {"title": ["A"], "sentences": []}), "{broken", None, row([["A", 0]], "text"))
    assert [p for *_, p in found] == ["missing_qid_question_or_answer", "no_supporting_facts", "support_sentence_missing", "no_distractor_sentences", "no_supporting_facts", "support_sentence_missing", "missing_qid_question_or_answer", "missing_qid_question_or_answer", "support_sentence_missing"]


def test_evaluation_set(spark):
    import hashlib

    rows = [row([["A", 0], ["B", 1]], [["A", ["a0", "a1"]], ["B", ["b0", "b1"]], ["A", ["again"]]]), row([], [])]
    made = layouts.sentence_evaluation_set(layouts.projected(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")), 3, 9)
    assert sorted((r["unit_id"], r["text"]) for r in made["raw_units"].collect()) == [("q::A::0", "again"), ("q::A::1", "a1"), ("q::B::0", "b0"), ("q::B::1", "b1")]
    key = lambda n: lambda u: hashlib.sha256(f"{n}::q::{u}".encode()).hexdigest()
    units, want = ["q::A::0", "q::A::1", "q::B::0", "q::B::1"], []
    for t, gold in enumerate(["q::A::0", "q::B::1"]):
        open_ = [u for u in units if u not in ["q::A::0"][:t]]
        kept = open_ if len(open_) <= 3 else [gold, *sorted((u for u in open_ if u != gold), key=key(9 + t))[:2]]
        want.append((t, gold, ["q::A::0"][:t], sorted(kept, key=key(9 + t + (len(open_) > 3)))))
    assert sorted((r["t"], r["positive"], r["context"], r["candidates"]) for r in made["samples"].collect()) == want
    assert made["queries"].count() == 1 and made["targets"].count() == 2


def test_forms_among_one_another(spark):
    """Texts beside lists in columns, nulls, and items of all forms in one list."""
    columns = row({"titles": ["A", "B"], "sentence_id": [0, "1"]}, {"title": None, "titles": ["A", "B", "A"], "sentences": ["One. Two.", ["x", None, " ", "y"], None]})
    listed = row([{"title": "A", "sent_id": None, "sentence_id": 1}, ["B", "0"], None, ["B", None], ["C"]], [{"title": "A", "sentences": None, "text": "unread"}, {"title": None, "name": "A", "text": "One. Two."}, ["B", "Three."], None, 5, ["C"], [None, "x"]])
    assert got(spark, columns, listed, row([["A", 0]], {"title": ["A"], "sentences": [["One."], ["Two."]]})) == [
        ("q", [("A", 0), ("B", 1)], [("A", ["One.", "Two."]), ("B", ["x", "y"]), ("A", [])], None),
        ("q", [("A", 1), ("B", 0)], [("A", ["One.", "Two."]), ("B", ["Three."])], None),
        ("q", [("A", 0)], [], "support_sentence_missing"),
    ]
