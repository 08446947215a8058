"""Clues, answer-type signals, probes and note values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms that show an answer type.
SIGNAL_TERMS = {
    "river": "river stream creek tributary".split(),
    "university": "university college school institute".split(),
    "county": ["county"],
    "city": "city town municipality".split(),
    "state": "state province territory".split(),
    "math_branch": ["calculus", "analysis", "geometry", "algebra", "topology", "trigonometry", "number theory", "probability", "statistics", "logic", "mathematics"],
    "profession": "novelist writer author actor actress singer composer poet journalist politician lawyer scientist".split(),
    "plant": ["plant", "genus", "species", "flowering plant", "shrub", "tree"],
}
#: Patterns that show an answer type.
SIGNAL_PATTERNS = {
    "year": r"\b(?:1[5-9]\d{2}|20\d{2})(?:\s*[–-]\s*(?:1[5-9]\d{2}|20\d{2}))?\b",
    "duration": r"\b\d+(?:\s*[–-]\s*\d+)?\s+(?:hour|hours|day|days|week|weeks|month|months|year|years)\b",
    "person": r"\b(born|actor|actress|writer|author|politician|scientist)\b",
}
#: Patterns over evidence for the clue of an answer type.
CLUE_PATTERNS = {
    "number": r"\b\d+(?:[.,]\d+)?\b",
    "date or time": r"\b(?:1[0-9]{3}|20[0-9]{2}|january|february|march|april|may|june|july|august|september|october|november|december)\b",
    "location": r"\b(?:in|at|near|from|city|country|state|province|district|county|island|river|mountain)\b",
    "person": r"\b(?:born|died|actor|actress|author|director|president|king|queen|professor|scientist|he|she|his|her)\b",
}
MAX_ENTITIES, MAX_RELATIONS = 4, 8


def answer_signal(text: Column, kind: Column) -> Column:
    """Whether a text shows the answer type of a question kind."""
    low = F.lower(text)
    rules = {**{k: low.rlike(p) for k, p in SIGNAL_PATTERNS.items()}, **{k: low.rlike("|".join(t)) for k, t in SIGNAL_TERMS.items()}}
    return F.coalesce(reduce(lambda out, kv: out.when(kind == kv[0], kv[1]), rules.items(), F.when(kind.isNull(), F.lit(False))).otherwise(F.lit(False)), F.lit(False))


def focus_mismatch(question: Column, answer: Column) -> Column:
    """Whether an answer lacks the type its question asks for; false for a null or empty one."""
    kind, low = T.focus_kind(question), F.lower(F.trim(answer))
    typed = kind.isin("river", "university", "county", "city", "state", "profession", "plant")
    wrong = F.when(kind == "yes_no", ~low.isin("yes", "no")).when(kind == "year", ~T.number_like(answer)).when(typed, ~answer_signal(answer, kind)).otherwise(F.lit(False))
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(False)).otherwise(wrong)


def question_clues(question: Column) -> Column:
    """Array of (kind, text, tokens): entity phrases, relation words, the answer type."""
    stop = F.array(*map(F.lit, T.STOPWORDS))
    q = F.trim(F.regexp_replace(question, r"\s+", " "))
    quoted = F.regexp_extract_all(q, F.lit(r"""["']([^"']{2,80})["']"""), F.lit(1))
    named = F.regexp_extract_all(q, F.lit(r"\b((?:[A-Z][A-Za-z0-9'’-]*)(?:\s+(?:[A-Z][A-Za-z0-9'’-]*|of|the|and|de)){0,5})\b"), F.lit(1))
    phrases = F.transform(F.concat(quoted, named), lambda p: F.struct(p.alias("text"), T.clue_tokens(p).alias("tokens")))
    telling = F.filter(phrases, lambda p: F.exists(p["tokens"], lambda t: ~F.array_contains(stop, t)))
    start = F.slice(telling, 1, 0)
    once = F.aggregate(telling, start, lambda kept, p: F.when(F.exists(kept, lambda k: k["tokens"] == p["tokens"]), kept).otherwise(F.concat(kept, F.array(p))))
    entities = F.slice(once, 1, MAX_ENTITIES)
    used = F.flatten(F.transform(entities, lambda p: p["tokens"]))
    words = F.slice(F.array_distinct(F.filter(T.clue_tokens(q), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~F.array_contains(used, t))), 1, MAX_RELATIONS)
    return F.concat(
        F.transform(entities, lambda p: F.struct(F.lit("entity").alias("kind"), p["text"].alias("text"), p["tokens"].alias("tokens"))),
        F.transform(words, lambda w: F.struct(F.lit("relation").alias("kind"), w.alias("text"), F.array(w).alias("tokens"))),
        F.array(F.struct(F.lit("answer_type").alias("kind"), T.answer_type(q).alias("text"), F.slice(F.array(F.lit("")), 1, 0).alias("tokens"))),
    )


def clue_state(clues: Column, evidence: Column) -> Column:
    """The clues with covered and coverage_score; ``evidence`` is the text read so far."""
    have, low = T.clue_tokens(evidence), F.array_join(T.clue_tokens(evidence), " ")

    def score(c: Column) -> Column:
        typed = reduce(lambda out, kv: out.when(c["text"] == kv[0], (evidence if kv[0] == "number" else low).rlike(kv[1])), CLUE_PATTERNS.items(), F.when(low == "", F.lit(False))).otherwise(F.lit(False))
        share = F.size(F.filter(c["tokens"], lambda t: F.array_contains(have, t))) / F.greatest(F.size(c["tokens"]), F.lit(1))
        return F.when(c["kind"] == "answer_type", typed.cast("double")).otherwise(F.round(share, 6))

    scored = F.transform(clues, lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text"), score(c).alias("coverage_score")))
    return F.transform(scored, lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text"), c["coverage_score"].alias("coverage_score"), (c["coverage_score"] == 1.0).alias("covered")))


def render_clues(state: Column) -> Column:
    lines = F.transform(state, lambda c: F.concat(F.lit("["), F.when(c["covered"], "covered").otherwise("unresolved"), F.lit("] "), c["kind"], F.lit(": "), c["text"]))
    open_ = F.transform(F.filter(state, lambda c: ~c["covered"]), lambda c: c["text"])
    last = F.concat(F.lit("Unresolved clues: "), F.when(F.size(open_) > 0, F.array_join(open_, ", ")).otherwise("none"))
    return F.array_join(F.concat(F.array(F.lit("Textual clue state:")), lines, F.array(last)), "\n")


def answer_ready(texts: Column, anchors: Column, kind: Column) -> Column:
    """Whether one of the first five texts has both a query anchor and the answer type."""
    return F.exists(F.slice(texts, 1, 5), lambda t: F.arrays_overlap(T.anchors(t), anchors) & answer_signal(t, kind))


def bridge_gap(texts: Column, anchors: Column, kind: Column, state_anchors: Column | None = None) -> Column:
    """Whether one of the first five texts has only a query anchor, another only the answer type, and two of them share an anchor, or one does with the state's."""
    told = F.transform(F.slice(texts, 1, 5), lambda t: F.struct(T.anchors(t).alias("a"), answer_signal(t, kind).alias("typed")))
    touch = lambda x: F.arrays_overlap(x["a"], anchors)
    of_state = (lambda x: F.arrays_overlap(x["a"], state_anchors)) if state_anchors is not None else (lambda x: F.lit(False))
    shared = lambda xs: F.exists(F.transform(xs, lambda x, i: of_state(x) | F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: F.arrays_overlap(x["a"], y["a"]))), lambda s: s)
    whole = lambda xs: (F.size(xs) >= 2) & F.exists(xs, lambda x: touch(x) & ~x["typed"]) & F.exists(xs, lambda x: x["typed"] & ~touch(x)) & shared(xs)
    return F.transform(F.array(told), whole)[0]


def recent_note(types: Column, kind: str, window: int = 2) -> Column:
    return F.array_contains(F.slice(types, F.greatest(F.size(types) - window + 1, F.lit(1)), window), kind)


def answer_visible(answer: Column, text: Column) -> Column:
    """The answer stands in the text; never for yes or no."""
    a = F.lower(F.trim(answer))
    return (a != "") & ~a.isin("yes", "no") & F.contains(F.lower(text), a)


def loosely_visible(answer: Column, text: Column) -> Column:
    """The normalised answer stands in the text, or all of its two or more tokens do."""
    words = T.tokens(answer)
    return T.contains_answer(answer, text) | ((F.size(words) >= 2) & (F.size(F.array_except(words, T.tokens(text))) == 0))


def derive_goal(mismatch: Column, bridge: Column, kind: Column, touches: Column, signal: Column) -> Column:
    """What notes are to be derived for: ``bridge``: two units can be bridged; ``touches``: one touches the question; ``signal``: one shows the answer type."""
    return (
        F.when(mismatch, "answer_focus_verification")
        .when(bridge & touches & signal, "bridge_query_entity_to_answer_candidate")
        .when(~kind.isin("generic", "yes_no") & ~signal, "target_type_disambiguation")
        .otherwise("generic_bridge_or_verification")
    )


def note_value(kind: Column, text: Column, question: Column, answer: Column, goal: Column, sources: Column) -> Column:
    """The closure value of a note; it faces the answer from 5 on."""
    shared = F.size(F.array_intersect(T.anchors(question), T.anchors(text)))
    fits = (goal.isin("answer_focus_verification", "target_type_disambiguation") & (kind == "verification_note")) | ((goal == "bridge_query_entity_to_answer_candidate") & (kind == "bridge_note"))
    by_kind = F.when(fits, 4).when(kind == "verification_note", 2).otherwise(1)
    one = lambda c, n: F.when(c, n).otherwise(0)
    hedged = F.lower(text).rlike("need to|insufficient")
    return by_kind + one(answer_signal(text, T.focus_kind(question)), 3) + F.least(F.lit(2), shared) + one(T.contains_answer(answer, text), 3) + one((goal == "bridge_query_entity_to_answer_candidate") & (sources >= 2), 2) - one(hedged, 2)


#: What a candidate loses for each recent unit it is like, and for the rest only after steps without progress.
REPEATS = {"same_doc": 0.05, "near_copy": 0.10}
STALLED_REPEATS = {"same_unit": 0.20, "same_parent": 0.10, "same_doc": 0.10}
AFTER_NO_PROGRESS, STALL_WINDOW, REPEAT_RATIO, NEAR_COPY = 1.5, 2, 0.75, 0.90


def repeat_penalty(candidate: Column, recent: Column, progress: Column, repeat_ratio: Column) -> Column:
    """What repetition costs a candidate (unit, parent, doc, text), by the last two units taken, the progress flags so far and the share of repeated candidates."""
    last = F.slice(recent, F.greatest(F.size(recent) - 1, F.lit(1)), 2)
    has = lambda c: F.exists(last, lambda r: r[c] == candidate[c])
    alike = lambda r: T.jaccard(T.tokens(r["text"]), T.tokens(candidate["text"])) >= NEAR_COPY
    for_each = REPEATS["same_doc"] * F.size(F.filter(last, lambda r: r["doc"] == candidate["doc"])) + REPEATS["near_copy"] * F.size(F.filter(last, alike))
    tail = F.slice(progress, F.greatest(F.size(progress) - STALL_WINDOW + 1, F.lit(1)), STALL_WINDOW)
    stalled = (F.size(progress) >= STALL_WINDOW) & F.forall(tail, lambda x: x == 0)
    often = F.coalesce(repeat_ratio >= REPEAT_RATIO, F.lit(False))
    extra = F.when(has("unit"), STALLED_REPEATS["same_unit"]).otherwise(0.0) + F.when(has("parent"), STALLED_REPEATS["same_parent"]).otherwise(0.0) + F.when(often & has("doc"), STALLED_REPEATS["same_doc"]).otherwise(0.0)
    whole = for_each + F.when(stalled, extra).otherwise(0.0)
    idle = F.coalesce(F.try_element_at(progress, F.lit(-1)) == 0, F.lit(False))
    return F.when(F.size(last) == 0, 0.0).otherwise(F.round(whole * F.when(idle, AFTER_NO_PROGRESS).otherwise(1.0), 9))


def context_answerability(answered: Column, supported: Column, distinguished: Column) -> Column:
    return (answered.cast("int") + supported.cast("int") + distinguished.cast("int")) / 3.0


def role_gain(before: Column, after: Column, n: Column, alpha: float = 1.0) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise((after - before) / (n + 2 * alpha))


def hard_score(t: Column, role: Column, candidates: Column, same_role: Column, unlabeled: Column, same_doc: Column) -> Column:
    """The difficulty of a sample: points for the second step, the role, the number and kind of its candidates (fixed values)."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    by_role = F.when(role == "bridge", 4).when(role == "distinguish", 2).when(role == "support", 1).otherwise(0)
    by_count = F.when(candidates >= 10, 4).when(candidates == 9, 3).when(candidates == 8, 1).otherwise(0)
    return one(t == 1, 4) + by_role + by_count + one(same_role >= 2, 3) + one(unlabeled >= 3, 2) + one(same_doc, 3)


def status_name(value: Column) -> Column:
    """Aliases of trajectory statuses; null for an unknown one."""
    x = F.lower(F.trim(value))
    return (
        F.when(x.isin("success", "terminal", "terminated"), "success")
        .when(x.isin("failed_but_progressive", "failed-progressive", "failed_progress", "failed-progress", "progressive_failure"), "failed_but_progressive")
        .when(x.isin("failed_stalled", "failed-stall", "failed_stall", "stall", "stalled"), "failed_stalled")
    )


def is_stalled(status: Column, reason: Column) -> Column:
    return F.concat_ws(" ", status, reason).rlike("(?i)stall|no_progress|oscill")


def role_name(role: Column) -> Column:
    """The ledger's column of a role."""
    low = F.lower(F.trim(role))
    return F.when(low == "bridge", "k_br").when(low.isin("distinguish", "disambiguation"), "k_dis").when(low == "support", "k_sup")


def top1_error(positive: Column, predicted: Column, kept: Column, doc: Column, predicted_doc: Column, visible: Column) -> Column:
    """Why the first choice is wrong."""
    return (
        F.when(F.coalesce(predicted, F.lit("")) == "", "no_prediction")
        .when(predicted == positive, "correct")
        .when(~kept, "gold_missing_after_compression")
        .when((doc != "") & (doc == predicted_doc), "same_doc_wrong_sentence")
        .when(T.title_overlap(doc, predicted_doc) >= 0.35, "same_entity_or_title_overlap")
        .when(visible, "answer_string_visible_but_not_gold")
        .otherwise("other_distractor")
    )


def case_mechanism(events: Column, source: Column) -> Column:
    """How a case was closed; ``events``: array of (position, note_type)."""
    return (
        F.when(F.size(events) == 0, "raw_or_stop_closure")
        .when(F.exists(events, lambda e: (e["position"] == "early") & (e["note_type"] == "bridge_note")), "early_bridge_scaffold")
        .when(F.forall(events, lambda e: e["note_type"] == "verification_note"), "late_verification_repair")
        .when(F.contains(source, F.lit("fallback")), "mixed_with_stop_fallback")
        .otherwise("mixed_or_unknown")
    )


def question_context(question: Column, notebook: Column) -> Column:
    return F.when(F.coalesce(F.trim(notebook), F.lit("")) == "", F.concat(F.lit("Question: "), question)).otherwise(F.concat(F.lit("Question: "), question, F.lit("\nNotebook:\n"), notebook))


def slot_summary(evidence: Column, note: Column, goal: Column) -> Column:
    """Evidence to 80 characters, note to 70, the need; 160 in all."""
    parts = F.concat_ws(" | ", F.nullif(T.shorten(evidence, 80), F.lit("")), F.nullif(T.shorten(note, 70), F.lit("")), F.concat(F.lit("need: "), goal))
    return T.shorten(parts, 160)


def deficit_stop(deficits: Column, t: Column, threshold: float = 0.12, least: int = 1, mode: str | int = "mean") -> Column:
    """Whether the deficit has fallen to the threshold after the least number of steps: the mean of all heads, the largest, or the one at a place."""
    mean = F.aggregate(deficits, F.lit(0.0), lambda s, x: s + x) / F.size(deficits)
    value = {"mean": mean, "max": F.array_max(deficits)}[mode] if isinstance(mode, str) else F.get(deficits, F.lit(mode))
    return (t >= least) & (value <= threshold)


def lexical(text: Column) -> Column:
    """Lower case, other signs to spaces, articles dropped."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def relevance(question: Column, answer: Column, text: Column) -> Column:
    """Question words found in a text (as part of a word from four letters on), and 3 for a visible answer."""
    stop = F.array(*map(F.lit, T.STOPWORDS))
    words = F.array_distinct(F.filter(F.regexp_extract_all(lexical(question), F.lit("([a-z]{2,})"), F.lit(1)), lambda w: ~F.array_contains(stop, w)))
    low, have = lexical(text), F.split(lexical(text), " ")
    hits = F.size(F.filter(words, lambda w: F.array_contains(have, w) | ((F.length(w) >= 4) & F.contains(low, w))))
    return hits + F.when(loosely_visible(answer, text), 3).otherwise(0)
