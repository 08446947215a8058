"""Notes made by rule from visible evidence, and what becomes of proposed notes: ids, legality, value, retention, influence.

All are expressions over arrays, for a question sees few units and notes. A unit is a struct with
unit, chunk, doc and text; a note has unit, type, text, sources and priority.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import best, by_key, let, none_of
from . import gates
from .repair import FALSE_STOP_ERRORS, INFLUENCE, LINKS
from .teacher import DUPLICATE, LAST, LEGAL_TYPES, MOST_KEPT, MOST_SOURCES, MOST_TOKENS

NOTE = "struct<unit:string,type:string,text:string,sources:array<string>,priority:int>"
#: Notes of a harvest, and units that a repair looks at anew.
MOST_NOTES, MOST_CARRIED, MOST_ANCHORS = 4, 3, 8
#: What links a candidate to the focus of a repair, and the first three of them that count as a link.
CONTINUITY = {"repair_carryover_candidate": 0.45, "shares_source_with_repair_focus": 0.25, "shares_repair_focus_anchor": 0.18, "supports_answer_type_closure": 0.15, "extends_closure_chain": 0.12}
FOCUS_LINKS = tuple(CONTINUITY)[:3]


def whole(unit: Column) -> Column:
    """A unit's document and text."""
    return F.concat_ws(" ", unit["doc"], unit["text"])


def sentence_number(unit_id: Column) -> Column:
    """The last part of a unit id; 0 where it is no number."""
    return F.coalesce(F.substring_index(unit_id, "::", -1).try_cast("int"), F.lit(0))


def rule_notes(question: Column, gold: Column, units: Column, repair: Column) -> Column:
    """The note that visible units give without a model, as an array of one or none (``NOTE`` without unit).

    The unit that bears the gold answer (its document by name first, then its text; then by
    anchors of the question, answer type and place) becomes a verification note, with the unit
    that speaks of an entity of the question beside it as a second source. Where none bears it, or
    it is yes or no, the unit nearest to the question becomes a bridge note (a verification note in
    a repair). A null question or answer is an empty one.
    """
    asked = F.struct(F.coalesce(question, F.lit("")).alias("text"), T.normalize(F.coalesce(gold, F.lit(""))).alias("gold"))
    of_question = lambda a: F.struct(T.focus_kind(a["text"]).alias("kind"), T.anchors(a["text"]).alias("anchors"), T.tokens(a["text"]).alias("words"), T.normalize(a["text"]).alias("norm"), a["gold"].alias("gold"))

    def profile(u: Column, q: Column) -> Column:
        def of(x: Column) -> Column:
            return F.struct(
                u["unit"].alias("unit"), u["doc"].alias("doc"), u["text"].alias("raw"), (x["title"] == q["gold"]).cast("int").alias("named"), F.contains(T.normalize(x["whole"]), q["gold"]).cast("int").alias("bears"),
                F.contains(q["norm"], x["title"]).cast("int").alias("asked"), F.size(F.array_intersect(T.anchors(x["whole"]), q["anchors"])).alias("hits"), gates.answer_signal(x["whole"], q["kind"]).cast("int").alias("signal"),
                F.size(F.array_intersect(T.tokens(x["whole"]), q["words"])).alias("shared"), sentence_number(u["unit"]).alias("place"),
            )

        return let(F.struct(T.normalize(F.coalesce(u["doc"], F.lit(""))).alias("title"), whole(u).alias("whole")), of)

    def note(kind: Column, of: Column, sources: Column) -> Column:
        # the text of a note is only made of the unit that was chosen
        made = F.struct(F.array_distinct(F.filter(sources, lambda s: F.trim(s) != "")).alias("sources"), T.note_text(of["doc"], of["raw"]).alias("text"))
        fits = lambda n: (T.normalize(n["text"]) != "") & F.size(n["sources"]).between(1, MOST_SOURCES)
        return let(made, lambda n: F.when(fits(n), F.struct(kind.alias("type"), n["text"].alias("text"), n["sources"].alias("sources"), F.lit(1).alias("priority"))))

    def made(q: Column, ps: Column) -> Column:
        bearing = best(F.filter(ps, lambda p: (p["named"] + p["bears"]) > 0), lambda p: F.struct(p["named"], p["bears"], p["hits"], p["signal"], -p["place"]))
        beside = lambda b: best(F.filter(ps, lambda p: p["unit"] != b["unit"]), lambda p: F.struct(p["asked"], p["hits"], p["signal"]))
        sources = lambda b: let(beside(b), lambda c: F.when(c["asked"] > 0, F.array(b["unit"], c["unit"])).otherwise(F.array(b["unit"])))
        checked = let(bearing, lambda b: F.when(b.isNotNull() & ~q["gold"].isin("", "yes", "no"), note(F.lit("verification_note"), b, sources(b))))
        nearest = let(best(ps, lambda p: F.struct(p["signal"], p["hits"], p["shared"])), lambda b: note(F.when(repair, "verification_note").otherwise("bridge_note"), b, F.array(b["unit"])))
        return F.array_compact(F.array(F.coalesce(checked, nearest)))

    return let(asked, lambda a: let(of_question(a), lambda q: let(F.transform(units, lambda u: profile(u, q)), lambda ps: made(q, ps))))


def harvested(qid: Column, proposals: Column, visible: Column, start: Column) -> Column:
    """The valid ones of proposed notes (type, text, sources, priority), with ids from ``start`` on, by priority and id, ``MOST_NOTES`` at most.

    A valid note has a known type, a text, and one to three different sources, all visible.
    """
    sources = lambda n: F.coalesce(n["sources"], none_of("string"))
    fits = lambda n: (
        F.coalesce(n["type"].isin(*LEGAL_TYPES), F.lit(False)) & (F.trim(F.coalesce(n["text"], F.lit(""))) != "") & F.size(sources(n)).between(1, MOST_SOURCES)
        & (F.size(F.array_distinct(sources(n))) == F.size(sources(n))) & (F.size(F.array_except(sources(n), visible)) == 0)
    )
    id_ = lambda i: F.concat(qid.cast("string"), F.lit("::derived::"), (start + i).cast("string"))
    numbered = F.transform(F.filter(proposals, fits), lambda n, i: F.struct(id_(i).alias("unit"), n["type"].alias("type"), F.trim(n["text"]).alias("text"), n["sources"].alias("sources"), n["priority"].alias("priority")))
    return F.slice(by_key(numbered, lambda n: F.struct(n["priority"], n["unit"])), 1, MOST_NOTES)


def judged(notes: Column, visible: Column, existing: Column) -> Column:
    """The notes in their order with ``faults`` (sorted): by themselves, against the state's note texts, and against those accepted before them."""
    bare = lambda x: T.normalize(F.coalesce(x, F.lit("")))
    same = lambda a, b: (a == b) | (T.jaccard(T.tokens(a), T.tokens(b)) > DUPLICATE)

    def own(n: Column) -> Column:
        rules = {
            "duplicate_with_state": F.exists(existing, lambda x: same(bare(x), bare(n["text"]))), "duplicated_source_ids": F.size(n["sources"]) != F.size(F.array_distinct(n["sources"])), "empty_text": bare(n["text"]) == "",
            "invalid_source_count": ~F.size(n["sources"]).between(1, MOST_SOURCES), "invalid_type": ~F.coalesce(n["type"].isin(*LEGAL_TYPES), F.lit(False)), "invisible_source_ids": F.size(F.array_except(n["sources"], visible)) > 0,
            "not_single_sentence": T.sentence_count(F.trim(n["text"])) != 1, "too_long": T.token_count(n["text"]) > MOST_TOKENS,
        }
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))

    fields = lambda n: [n[c].alias(c) for c in ("unit", "type", "text", "sources", "priority")]
    with_own = F.transform(notes, lambda n: F.struct(*fields(n), own(n).alias("faults")))
    start = F.struct(none_of("string").alias("kept"), F.slice(with_own, 1, 0).alias("out"))

    def fold(state: Column, n: Column) -> Column:
        again = F.exists(state["kept"], lambda k: same(k, bare(n["text"])))
        faults = F.when(again, F.array_sort(F.array_union(n["faults"], F.array(F.lit("duplicate_in_harvest"))))).otherwise(n["faults"])
        return F.struct(F.when(F.size(faults) == 0, F.concat(state["kept"], F.array(bare(n["text"])))).otherwise(state["kept"]).alias("kept"), F.concat(state["out"], F.array(F.struct(*fields(n), faults.alias("faults")))).alias("out"))

    return F.aggregate(with_own, start, fold, lambda s: s["out"])


def valued(notes: Column, question: Column, gold: Column, goal: Column) -> Column:
    """The notes with closure (their value) and answer_facing."""
    value = lambda n: gates.note_value(n["type"], n["text"], question, gold, goal, F.size(n["sources"])).cast("int")
    fields = lambda n: [n[c].alias(c) for c in ("unit", "type", "text", "sources", "priority")]
    return F.transform(notes, lambda n: let(value(n), lambda v: F.struct(*fields(n), v.alias("closure"), (v >= 5).alias("answer_facing"))))


def retained(notes: Column, repair: Column, subtype: Column) -> Column:
    """The valued notes that are kept: the two that close most in a repair or late verification, the first bridge of an early bridge, none else."""
    priority = lambda n: F.coalesce(n["priority"], F.lit(LAST))
    closing = by_key(notes, lambda n: F.struct(~n["answer_facing"], -n["closure"], priority(n), -F.size(n["sources"]), n["unit"]))
    bridging = by_key(notes, lambda n: F.struct(n["type"] != "bridge_note", priority(n), -F.size(n["sources"]), n["unit"]))
    late = repair | F.coalesce(subtype == "late_verification", F.lit(False))
    return F.when(late, F.slice(closing, 1, MOST_KEPT)).when(subtype == "early_bridge", F.slice(bridging, 1, 1)).otherwise(F.slice(notes, 1, 0))


def _own_sources(candidate: Column) -> Column:
    """What a candidate (unit, note flag, sources) stands on: a note its sources, a raw unit itself."""
    return F.when(candidate["is_note"], F.coalesce(candidate["sources"], none_of("string"))).otherwise(F.array(candidate["unit"]))


def note_profiles(notes: Column, registry: Column, question: Column) -> Column:
    """What retained repair notes speak of: sources, docs, anchors, answer_facing and whether they show the answer type; their sources' texts are looked up in ``registry`` (units)."""

    def profile(n: Column) -> Column:
        read = F.filter(registry, lambda u: F.array_contains(n["sources"], u["unit"]))
        text = F.concat_ws(" ", n["text"], F.array_join(F.transform(read, whole), " "))
        facing = F.coalesce(n["answer_facing"], F.lit(False))
        return F.struct(n["sources"].alias("sources"), F.transform(read, lambda u: u["doc"]).alias("docs"), T.anchors(text).alias("anchors"), facing.alias("answer_facing"), gates.answer_signal(text, T.focus_kind(question)).alias("focus"))

    return F.transform(notes, profile)


def influence(candidate: Column, profiles: Column, question: Column, error: Column, goal: Column) -> Column:
    """(bonus, reasons, linked) of a candidate (unit, is_note, type, doc, text, sources, answer_facing, closure) by the repair notes' profiles.

    Each note adds what holds for it; anchors and the answer type are read off the candidate's text.
    """
    told = F.struct(T.anchors(whole(candidate)).alias("anchors"), gates.answer_signal(whole(candidate), T.focus_kind(question)).alias("signal"), _own_sources(candidate).alias("sources"))
    check, bridge = F.coalesce(candidate["type"] == "verification_note", F.lit(False)), F.coalesce(candidate["type"] == "bridge_note", F.lit(False))
    facing, closes = F.coalesce(candidate["answer_facing"], F.lit(False)), candidate["is_note"] & (F.coalesce(candidate["closure"], F.lit(0)) > 0)
    aim = F.coalesce(goal, F.lit(""))

    def holds(c: Column, p: Column) -> list[Column]:
        found = {
            "shares_source_with_repair_note": F.arrays_overlap(c["sources"], p["sources"]), "shares_bridge_anchor": F.arrays_overlap(c["anchors"], p["anchors"]),
            "same_doc_as_repair_source": ~candidate["is_note"] & (F.coalesce(candidate["doc"], F.lit("")) != "") & F.array_contains(p["docs"], candidate["doc"]),
            "matches_answer_type_fix": c["signal"] & (p["focus"] | p["answer_facing"] | aim.isin("answer_focus_verification", "target_type_disambiguation")),
            "supports_recent_false_stop_correction": F.coalesce(F.lower(error).isin(*FALSE_STOP_ERRORS), F.lit(False)) & (c["signal"] | check | facing), "extends_answer_facing_chain": facing | closes,
            "bridge_to_answer_candidate": (aim == "bridge_query_entity_to_answer_candidate") & bridge, "supports_answer_type_fix": (aim == "target_type_disambiguation") & check, "answer_focus_verification": (aim == "answer_focus_verification") & (check | c["signal"]),
        }
        return [F.when(F.coalesce(found[k], F.lit(False)), F.lit(k)) for k in INFLUENCE]

    reasons = let(told, lambda c: F.flatten(F.transform(profiles, lambda p: F.array_compact(F.array(*holds(c, p))))))
    return let(reasons, lambda rs: _scored(rs, INFLUENCE, LINKS))


def _scored(reasons: Column, weights: dict[str, float], links: tuple[str, ...]) -> Column:
    """(bonus, reasons, linked) of reasons that may repeat; a reason counts as often as it is given."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    bonus = F.aggregate(reasons, F.lit(0.0), lambda s, r: s + F.coalesce(table[r], F.lit(0.0)))
    return F.struct(F.round(bonus, 9).alias("bonus"), F.array_distinct(reasons).alias("reasons"), F.arrays_overlap(reasons, F.array(*map(F.lit, links))).alias("linked"))


def repair_focus(selected: Column, kept: Column, registry: Column, question: Column, goal: Column) -> Column:
    """What a repair goes on with: (sources, anchors, carried) of the selected candidate, the retained notes and the units near them.

    ``carried`` are the sources, then the notes, then the units of the same documents, anchors or
    answer type by score; ``MOST_CARRIED`` in all.
    """
    sources = F.array_distinct(F.filter(F.concat(F.flatten(F.transform(kept, lambda n: n["sources"])), _own_sources(selected)), lambda s: F.trim(s) != ""))
    read = lambda ids: F.filter(registry, lambda u: F.array_contains(ids, u["unit"]))
    anchors = lambda ids: F.array_union(F.flatten(F.transform(read(ids), lambda u: T.anchors(whole(u)))), T.anchors(whole(selected)))
    docs = lambda ids: F.filter(F.transform(read(ids), lambda u: u["doc"]), lambda d: F.coalesce(d, F.lit("")) != "")
    told = let(sources, lambda ids: F.struct(ids.alias("ids"), F.array_distinct(anchors(ids)).alias("anchors"), docs(ids).alias("docs")))
    kind, bridging = T.focus_kind(question), F.coalesce(goal == "bridge_query_entity_to_answer_candidate", F.lit(False))

    def score(u: Column, s: Column) -> Column:
        own = T.anchors(whole(u))
        one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
        return one(F.array_contains(s["docs"], u["doc"]), 3) + one(F.arrays_overlap(own, s["anchors"]), 2) + one(gates.answer_signal(whole(u), kind), 2) + one(bridging & (F.size(own) > 0), 1)

    def whole_focus(s: Column) -> Column:
        notes = F.transform(kept, lambda n: n["unit"])
        others = F.filter(registry, lambda u: ~F.array_contains(F.concat(s["ids"], notes), u["unit"]))
        scored = F.filter(F.transform(others, lambda u: F.struct((-score(u, s)).alias("less"), u["unit"].alias("unit"))), lambda x: x["less"] < 0)
        near = F.transform(F.slice(F.array_sort(scored), 1, MOST_CARRIED), lambda x: x["unit"])
        carried = F.slice(F.array_distinct(F.concat(s["ids"], notes, near)), 1, MOST_CARRIED)
        return F.struct(s["ids"].alias("sources"), F.slice(F.array_sort(s["anchors"]), 1, MOST_ANCHORS).alias("anchors"), carried.alias("carried"))

    return let(told, whole_focus)


def continuity(candidate: Column, focus: Column, question: Column) -> Column:
    """(bonus, reasons, linked) of a candidate by the focus of a repair; nothing without one."""
    closes = F.coalesce(candidate["type"].isin(*LEGAL_TYPES), F.lit(False)) & (F.coalesce(candidate["closure"], F.lit(0)) > 0)
    holds = {
        "repair_carryover_candidate": F.array_contains(focus["carried"], candidate["unit"]), "shares_source_with_repair_focus": F.arrays_overlap(_own_sources(candidate), focus["sources"]),
        "shares_repair_focus_anchor": F.arrays_overlap(T.anchors(whole(candidate)), focus["anchors"]), "supports_answer_type_closure": gates.answer_signal(whole(candidate), T.focus_kind(question)), "extends_closure_chain": closes,
    }
    reasons = F.array_compact(F.array(*(F.when(focus.isNotNull() & F.coalesce(holds[k], F.lit(False)), F.lit(k)) for k in CONTINUITY)))
    return let(reasons, lambda rs: _scored(rs, CONTINUITY, FOCUS_LINKS))
