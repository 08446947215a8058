from pyspark.sql import functions as F

from stepwell.operators import adapters, datasets, diagnostics, online
from stepwell.operators import gates as G
from stepwell.operators import selection as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_clues(spark):
    q = F.lit('Who directed "Blue Stone" in Paris before 1990?')
    clues = one(spark, G.question_clues(q))[0]
    assert [(c.kind, c.text) for c in clues][:2] == [("entity", "Blue Stone"), ("entity", "Paris")]
    assert [c.text for c in clues if c.kind == "relation"] == ["directed", "before", "1990"] and clues[-1].text == "person"
    state = one(spark, G.clue_state(G.question_clues(q), F.lit("The director of Blue Stone was born in 1990.")))[0]
    assert {c.text: c.covered for c in state} | {"Blue Stone": True, "Paris": False, "1990": True, "person": True} == {c.text: c.covered for c in state}
    assert "[covered] entity: Blue Stone" in one(spark, G.render_clues(G.clue_state(G.question_clues(q), F.lit("Blue Stone"))))[0]


def test_signals_and_mismatch(spark):
    assert tuple(one(spark, G.answer_signal(F.lit("the river Main"), F.lit("river")), G.answer_signal(F.lit("in 1987"), F.lit("year")), G.answer_signal(F.lit("x"), F.lit("generic")))) == (True, True, False)
    q = F.lit("What year was it?")
    assert tuple(one(spark, G.focus_mismatch(q, F.lit("Paris")), G.focus_mismatch(q, F.lit("1999")), G.focus_mismatch(q, F.lit("")))) == (True, False, False)


def test_notes_and_names(spark):
    v = G.note_value(F.lit("bridge_note"), F.lit("The Green River is long."), F.lit("Which river is Green River?"), F.lit("Green River"), F.lit("bridge_query_entity_to_answer_candidate"), F.lit(2))
    assert one(spark, v)[0] == 4 + 3 + 2 + 3 + 2
    assert tuple(one(spark, G.status_name(F.lit(" Stalled ")), G.status_name(F.lit("?")), G.role_name(F.lit("disambiguation")), G.is_stalled(F.lit("failed"), F.lit("oscillation")))) == ("failed_stalled", None, "k_dis", True)
    assert tuple(one(spark, G.answer_visible(F.lit("yes"), F.lit("yes")), G.loosely_visible(F.lit("big red car"), F.lit("a car, red and big")), G.relevance(F.lit("Where is the station?"), F.lit("x1"), F.lit("two stations"))))[:2] == (False, True)


def test_gates(spark):
    texts, anchors = F.array(F.lit("green hills of xanadu"), F.lit("xanadu has a river")), F.array(F.lit("green"))
    assert tuple(one(spark, G.answer_ready(texts, anchors, F.lit("river")), G.bridge_gap(texts, anchors, F.lit("river")))) == (False, True)
    assert tuple(one(spark, G.deficit_stop(F.array(F.lit(0.1), F.lit(0.1)), F.lit(1)), G.deficit_stop(F.array(F.lit(0.1)), F.lit(0)))) == (True, False)
    assert one(spark, G.slot_summary(F.lit("e" * 100), F.lit(""), F.lit("goal")))[0] == "e" * 80 + " | need: goal"


def test_bridges_hints_and_best_units(spark):
    question = F.lit("Which river flows through the Green Valley of Oakland?")
    texts = F.array(F.lit("Green Valley is near Oakland Bridge."), F.lit("The Oakland Bridge spans the Salmon River."), F.lit("Nothing here."))
    none = F.array().cast("array<string>")
    assert tuple(one(spark, S.bridgeable(question, texts, none), S.bridgeable(question, F.slice(texts, 3, 1), none), S.bridgeable(F.lit("Who sang it?"), texts, none))) == (True, False, False)
    hint = lambda c: S.target_hint(F.lit(c), F.lit("Salmon River"), F.lit("The Salmon River meets Mill Creek."))
    assert tuple(one(spark, hint("on the salmon river"), hint("mill creek alone"), hint("salmon only"), hint(""), hint("the salmon and a mill"))) == (True, True, False, False, True)
    unit = lambda u, text, sent: F.struct(F.lit(u).alias("unit"), F.lit("Doc").alias("doc"), F.lit(text).alias("text"), F.lit(sent).alias("sent"))
    assert one(spark, S.best_unit(question, F.array(unit("a", "Oakland town", 0), unit("b", "the Salmon river", 3), unit("c", "the Salmon river", 1))))[0] == "c"
    assert one(spark, S.hard_record(F.lit(None).cast("int"), F.lit(1), 3, 5), S.hard_record(F.lit(4), F.lit(1), 3, 5))[:] == (False, True)


def test_seed_units_against_a_plain_version(spark):
    """The best atom of a shortlisted chunk by BM25 within the chunk plus the coarse score."""
    import math
    import random
    import re

    rng, words = random.Random(5), "red blue green stone river house garden road".split()
    chunks = [(q, f"c{c}", *(" ".join(rng.choices(words, k=k)) for k in (6, 30))) for q in range(4) for c in range(7)]
    atoms = [(q, c, f"{c}::{i}", " ".join(rng.choices(words, k=8))) for q, c, _, _ in chunks for i in range(4)]
    asked = [(q, " ".join(rng.choices(words, k=3))) for q in range(4)]

    def bm25(texts, question):
        docs = [re.findall("[a-z0-9]+", x.lower()) for x in texts]
        n, avg = len(docs), sum(map(len, docs)) / len(docs)
        score = lambda d: sum(math.log(1 + (n - (df := sum(t in x for x in docs)) + 0.5) / (df + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in set(question.split()) if t in d)
        return [score(d) for d in docs]

    want = {}
    for q, question in asked:
        own = [c for c in chunks if c[0] == q]
        coarse = {c[1]: (a + b) / 2 for c, a, b in zip(own, bm25([c[2] for c in own], question), bm25([c[3] for c in own], question))}
        best = []
        for c in sorted(coarse, key=lambda c: (-coarse[c], c))[:4]:
            mine = [a for a in atoms if a[0] == q and a[1] == c]
            best.append(min((-(s + coarse[c]), a[2]) for a, s in zip(mine, bm25([a[3] for a in mine], question))))
        want[q] = [u for _, u in sorted(best)[:2]]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = S.seed_units(frame(chunks, "qid int, chunk string, summary string, text string"), frame(atoms, "qid int, chunk string, unit string, text string"), frame(asked, "qid int, text string"), 4, 2).collect()
    assert {q: [r.unit for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] for q, _ in asked} == want


def test_rollout_follows_its_own_picks(spark):
    """A policy that reads the whole state, against a plain loop."""
    import random

    rng = random.Random(6)
    rows = [(q, u, rng.randrange(4), float(rng.randrange(1000))) for q in range(30) for u in range(rng.randint(1, 9))]
    policy = lambda picks, c: c["score"] * F.when(F.size(F.filter(picks, lambda p: p["candidate"]["doc"] == c["doc"])) > 0, 0.4).otherwise(1.0) + F.size(picks) * c["unit"]
    got = online.rollout(spark.createDataFrame(rows, "qid int, unit int, doc int, score double"), 4, policy, least=100.0).collect()
    for q in range(30):
        left, taken = sorted(r for r in rows if r[0] == q), []
        while left and len(taken) < 4:
            value = {r: r[3] * (0.4 if any(x[2] == r[2] for x in taken) else 1.0) + len(taken) * r[1] for r in left}
            best = max(left, key=lambda r: (round(value[r], 9), -r[1]))
            if value[best] < 100:
                break
            taken.append(best)
            left.remove(best)
        assert [r.unit for r in sorted((r for r in got if r.qid == q), key=lambda r: r.t)] == [r[1] for r in taken]


def test_initial_state_and_forbidden_fields(spark):
    s = one(spark, online.initial_state().alias("s"))[0]
    assert (s.H_t, s.K_t, s.S_t.last_updated_step, s.S_t.last_added_unit_id, s.A_t.unit_doc) == ([], "", -1, None, {})
    schema = spark.createDataFrame([], "qid string, steps array<struct<t:int, debug:struct<gold:string>>>, m map<string,struct<gold:int>>").schema
    assert adapters.forbidden_paths(schema, {"gold", "debug"}) == ["$.steps[].debug", "$.steps[].debug.gold", "$.m[].gold"]
    assert adapters.carried({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    report = diagnostics.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string").orderBy("x"))
    assert report.split("\n") == ["| x | y |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |"]


def test_clue_states_replace_notebooks(spark):
    rows = spark.createDataFrame([(1, 0, "Who directed Blue Stone?", None), (1, 1, "Who directed Blue Stone?", "Blue Stone was directed by Ann.")], "qid int, t int, question string, evidence string")
    got = {r.t: r.notebook for r in datasets.clue_states(rows).collect()}
    assert "[unresolved] entity: Blue Stone" in got[0] and "[covered] entity: Blue Stone" in got[1]
