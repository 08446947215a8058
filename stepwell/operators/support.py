"""What the evidence read so far supports, worked out from texts and states: probes, failure signals, and the value of a candidate's next state.

Targets are an array of (chunk, doc, text, role, weight); chunks of (chunk, doc, text); raw units
of (unit, chunk, doc, text); notes of a state carry what `notes.valued` and the step give them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import by_key, last, let, none_of
from . import gates
from .online import NOTE_CHARS, NOTES_SHOWN, RAW_CHARS, RAW_SHOWN, REPEAT_RATIO, active_notes
from .repair import support_probe
from .trajectories import ALPHA, kappa

ROLES = ("bridge", "distinguish", "support")
#: Weight of the context's gain, of a repetition, of a candidate's place, and of a target that isn't covered yet.
CONTEXT_WEIGHT, REPEAT_WEIGHT, PLACE_WEIGHT, UNCOVERED_BONUS = 1.5, 0.20, 1e-4, 5.0


def target_name(chunk: Column) -> Column:
    """The last part of a target's id."""
    return F.element_at(F.split(chunk, "::"), -1)


def missing_targets(targets: Column, evidence: Column, docs: Column) -> Column:
    """The names of the targets that no selected document (``docs``) is of and whose text isn't in the evidence."""
    met = lambda t: ((F.coalesce(F.trim(t["doc"]), F.lit("")) != "") & F.array_contains(docs, F.trim(t["doc"]))) | F.coalesce(T.contains_answer(t["text"], evidence), F.lit(False))
    return F.transform(F.filter(targets, lambda t: ~met(t)), lambda t: target_name(t["chunk"]))


def probe_support(question: Column, gold: Column, predicted: Column, notebook: Column, chunks: Column, targets: Column) -> Column:
    """(rule, sufficient, reasons): whether the notebook and the selected chunks support an answer; a rule of ``requires_llm_judge`` is for a judge.

    A null prediction has none; a null notebook is empty.
    """
    read = F.array_join(F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    own = F.coalesce(notebook, F.lit(""))
    docs = F.array_distinct(F.filter(F.transform(chunks, lambda c: F.trim(F.coalesce(c["doc"], F.lit("")))), lambda d: d != ""))

    def of(e: Column) -> Column:
        visible = T.contains_answer(gold, own) | T.contains_answer(gold, e["read"])
        lacking = missing_targets(targets, F.concat(own, F.lit("\n"), e["read"]), e["docs"])
        right = F.coalesce(T.answer_correct(gold, predicted), F.lit(False))
        return let(lacking, lambda m: F.struct(*(c.alias(k) for k, c in support_probe(predicted.isNotNull(), T.is_yes_no(question), F.size(targets), m, F.coalesce(visible, F.lit(False)), T.number_like(gold), right).items())))

    return let(F.struct(read.alias("read"), docs.alias("docs")), of)


def right_in_context(gold: Column, predicted: Column, notebook: Column) -> Column:
    """The predicted answer fits the gold one, which stands in the notebook."""
    return F.coalesce(T.contains_answer(gold, notebook) & T.answer_compatible(gold, predicted) & ~T.answer_conflicts(gold, predicted), F.lit(False))


def answered(question: Column, gold: Column, predicted: Column, notebook: Column, chunks: Column, targets: Column) -> Column:
    """(answer, correct, sufficient, stop): a stop probe.

    The gold answer takes the place of a missing or conflicting prediction where it stands in the
    notebook and the evidence supports it. What needs a judge counts as not supported.
    """
    conflict = predicted.isNull() | (~F.coalesce(T.answer_correct(gold, predicted), F.lit(False)) & T.answer_conflicts(gold, predicted))
    fills = T.contains_answer(gold, notebook) & conflict & probe_support(question, gold, gold, notebook, chunks, targets)["sufficient"]
    filled = F.when(F.coalesce(fills, F.lit(False)), gold).otherwise(predicted)

    def judged(answer: Column) -> Column:
        right = F.coalesce(T.answer_correct(gold, answer), F.lit(False)) | right_in_context(gold, answer, notebook)
        enough = probe_support(question, gold, answer, notebook, chunks, targets)["sufficient"]
        return F.struct(answer.alias("answer"), right.alias("correct"), enough.alias("sufficient"), (answer.isNotNull() & right & enough).alias("stop"))

    return let(filled, judged)


def closed(question: Column, gold: Column, notebook: Column, chunks: Column, targets: Column, covered: Column) -> Column:
    """Whether a state closes its question without a model: all targets are covered, or the probe of the gold answer holds."""
    complete = (F.size(targets) > 0) & (F.size(F.array_except(F.transform(targets, lambda t: t["chunk"]), covered)) == 0)
    probe = answered(question, gold, F.when(T.is_yes_no(question), gold), notebook, chunks, targets)
    return (complete & gold.isNotNull()) | (~complete & F.coalesce(probe["stop"], F.lit(False)))


def probe_error(gold: Column, probe: Column) -> Column:
    """What went wrong in a probe (answer, correct, sufficient, stop); null without one."""
    return (
        F.when(probe.isNull(), F.lit(None).cast("string"))
        .when(probe["answer"].isNull(), "missing_pred_answer")
        .when(~probe["correct"] & T.answer_conflicts(gold, probe["answer"]), "answer_conflict")
        .when(~probe["sufficient"], "support_insufficient")
        .when(~probe["stop"], "false_stop")
        .otherwise("unknown")
    )


def failure_signals(question: Column, probes: Column, delta: Column, repeat_ratio: Column) -> Column:
    """Flags of the last two probes (answer, correct, sufficient, stop) and of the last step, as a struct of eight fields; the mismatch is read off the last answer."""
    recent = last(probes, 2)
    false = F.size(F.filter(recent, lambda p: ~p["stop"]))
    newest = F.try_element_at(recent, F.lit(-1))
    return F.struct(
        (false > 0).alias("recent_false_stop"), false.alias("false_stop_count_recent"), delta.cast("int").alias("last_delta_covered_targets"), repeat_ratio.cast("double").alias("last_retrieval_repeat_ratio"),
        newest["answer"].alias("last_probe_pred_answer"), newest["correct"].alias("last_probe_answer_correct"), F.coalesce(gates.focus_mismatch(question, newest["answer"]), F.lit(False)).alias("answer_focus_mismatch"),
        ((delta == 0) & F.coalesce(repeat_ratio >= REPEAT_RATIO, F.lit(False))).alias("stagnation"),
    )


def rendered(raw: Column, notes: Column, registry: Column) -> Column:
    """The notebook of a state: the sources of its active notes and the newest raw units, then the notes.

    ``raw``: array of (unit, step); ``notes``: the state's notes in the order they came; texts of
    units are looked up in ``registry``.
    """
    keyed = F.transform(notes, lambda n: F.struct(*(n[c].alias(c) for c in ("added_step", "type", "force", "answer_facing", "mode", "bucket", "closure")), n["unit"].alias("unit_id")))
    active = lambda ids: F.flatten(F.transform(ids, lambda i: F.slice(F.filter(notes, lambda n: n["unit"] == i), 1, 1)))
    newest = F.transform(by_key(raw, lambda r: -r["step"]), lambda r: r["unit"])
    text_of = lambda u: F.get(F.filter(registry, lambda x: x["unit"] == u), F.lit(0))["text"]

    def lines(shown: Column) -> Column:
        sources = F.array_distinct(F.flatten(F.transform(shown, lambda n: n["sources"])))
        more = F.slice(F.array_except(newest, sources), 1, F.greatest(RAW_SHOWN - F.size(sources), F.lit(0)))
        texts = F.filter(F.transform(F.slice(F.concat(sources, more), 1, RAW_SHOWN), text_of), lambda x: x.isNotNull())
        read = F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), T.shorten(x, RAW_CHARS)))
        label = lambda n: F.when(n["type"] == "bridge_note", "bridge").otherwise("verification")
        noted = F.transform(F.slice(shown, 1, NOTES_SHOWN), lambda n: F.concat(F.lit("["), label(n), F.lit("] "), T.shorten(n["text"], NOTE_CHARS)))
        empty = none_of("string")
        return F.trim(F.array_join(F.concat(F.when(F.size(read) > 0, F.concat(F.array(F.lit("Evidence:")), read)).otherwise(empty), F.when(F.size(noted) > 0, F.concat(F.array(F.lit(""), F.lit("Notes:")), noted)).otherwise(empty)), "\n"))

    return let(active_notes(keyed), lambda ids: let(active(ids), lines))


def role_totals(targets: Column) -> Column:
    """The weight of the targets of each role, as a struct."""
    total = lambda r: F.aggregate(F.filter(targets, lambda t: t["role"] == r), F.lit(0.0), lambda s, t: s + t["weight"])
    return F.struct(*(total(r).alias(r) for r in ROLES))


def role_scores(targets: Column, covered: Column) -> Column:
    """The covered share of each required role, an array in the roles' order; a role weighs 1 at least."""
    of = lambda r: F.filter(targets, lambda t: t["role"] == r)
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + t["weight"])
    share = lambda r: F.when(sum_(of(r)) > 0, sum_(F.filter(of(r), lambda t: F.array_contains(covered, t["chunk"]))) / F.greatest(sum_(of(r)), F.lit(1.0)))
    return F.array_compact(F.array(*(share(r) for r in ROLES)))


def context_value(gold: Column, notebook: Column, targets: Column, covered: Column, bridged: Column) -> Column:
    """How far a state answers, supports and distinguishes, a third each; ``bridged``: it has a bridge note."""
    has = lambda r: F.forall(F.filter(targets, lambda t: t["role"] == r), lambda t: F.array_contains(covered, t["chunk"]))
    visible = F.coalesce(T.contains_answer(gold, notebook), F.lit(False))
    return gates.context_answerability(visible, visible & has("support") & (has("bridge") | bridged), has("distinguish"))


def utility(candidate: Column, state: Column, gold: Column, targets: Column, registry: Column) -> Column:
    """The value of a candidate: what its next state gains by role and in context, over its cost.

    ``state``: struct of raw (unit, step), notes, covered, taken (ids so far) and notebook. The
    candidate (unit, is_note, chunk, and of a note type, text, sources and its marks) is written
    into a state of its own, which is rendered and valued as the present one is.
    """
    hit = F.filter(targets, lambda t: (t["chunk"] == candidate["chunk"]) & ~F.array_contains(state["covered"], t["chunk"]))
    new = F.when(~candidate["is_note"], F.slice(hit, 1, 1)).otherwise(F.slice(targets, 1, 0))
    bridged = lambda notes: F.exists(notes, lambda n: n["type"] == "bridge_note")

    def gain(t: Column) -> Column:
        total = F.aggregate(F.filter(targets, lambda x: x["role"] == t["role"]), F.lit(0.0), lambda s, x: s + x["weight"])
        return F.when(total > 0, t["weight"] / (total + 2 * ALPHA)).otherwise(0.0)

    def valued(n: Column) -> Column:
        covered = F.concat(state["covered"], F.transform(n["new"], lambda t: t["chunk"]))
        after = context_value(gold, rendered(n["raw"], n["notes"], registry), targets, covered, bridged(n["notes"]))
        before = context_value(gold, state["notebook"], targets, state["covered"], bridged(state["notes"]))
        by_role = F.aggregate(F.transform(n["new"], gain), F.lit(0.0), lambda s, g: s + g)
        return (by_role + CONTEXT_WEIGHT * (after - before)) / kappa(F.when(candidate["is_note"], candidate["type"]), F.lit("sentence"))

    return let(F.struct(new.alias("new"), with_raw(state, candidate).alias("raw"), with_note(state, candidate).alias("notes")), valued)


def with_raw(state: Column, candidate: Column) -> Column:
    """The state's raw units after a candidate is taken."""
    known = F.exists(state["raw"], lambda r: r["unit"] == candidate["unit"])
    return F.when(candidate["is_note"] | known, state["raw"]).otherwise(F.concat(state["raw"], F.array(F.struct(candidate["unit"].alias("unit"), F.size(state["taken"]).alias("step")))))


def as_note(candidate: Column, step: Column) -> Column:
    """A candidate as a note of a state."""
    fields = ("unit", "type", "text", "sources", "force", "answer_facing", "mode", "bucket", "closure")
    return F.struct(*(candidate[c].alias(c) for c in fields[:4]), step.cast("int").alias("added_step"), *(candidate[c].alias(c) for c in fields[4:]))


def with_note(state: Column, candidate: Column) -> Column:
    """The state's notes after a candidate is taken."""
    known = F.exists(state["notes"], lambda n: n["unit"] == candidate["unit"])
    return F.when(~candidate["is_note"] | known, state["notes"]).otherwise(F.concat(state["notes"], F.array(as_note(candidate, F.size(state["taken"])))))
