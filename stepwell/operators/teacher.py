"""Gates, probes and the rollout that produces teacher trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let

#: Fixed values of the gates.
COMPLETE, NEAR_COMPLETE, SEMANTIC, REDUNDANT, SIMILAR = 0.70, 0.55, 0.50, 0.90, 0.85
MAX_STEPS, STALL_WINDOW, REPEAT_RATIO = 8, 2, 0.60


def raw_complete(scores: Column, level: float = COMPLETE) -> Column:
    """All required role scores reach a level; true without any."""
    return F.forall(scores, lambda x: x >= level)


def cheap_stop(scores: Column, need_note: Column, failed: Column) -> Column:
    return raw_complete(scores) & ~need_note & ~failed


def near_complete(scores: Column) -> Column:
    """All required role scores come close; false without any."""
    return (F.size(scores) > 0) & raw_complete(scores, NEAR_COMPLETE)


def no_note_needed(recent_check: Column, redundant: Column, recent_bridge: Column) -> Column:
    return recent_check | (redundant & recent_bridge)


def legacy_stop(scores: Column, no_note: Column, progress: Column) -> Column:
    """The gate that controls by default: complete, and no note is needed or the last step made no progress."""
    stalled = F.coalesce(F.try_element_at(progress, F.lit(-1)) == 0, F.lit(False))
    return raw_complete(scores) & (no_note | (stalled & near_complete(scores)))


def need_note(mean_score: Column, bridgeable: Column, recent_check: Column, failure: Column) -> Column:
    return (mean_score >= SEMANTIC) & bridgeable & (~recent_check | failure)


def redundant_pool(pool: Column, recent: Column) -> Column:
    """Two or more of the first three texts' token arrays are near copies of one of the last two selected."""
    last = F.slice(recent, F.greatest(F.size(recent) - 1, F.lit(1)), 2)
    return F.size(F.filter(F.slice(pool, 1, 3), lambda x: F.exists(last, lambda y: T.jaccard(x, y) >= REDUNDANT))) >= 2


def note_subtype(late_check: Column, t: Column, bridge: Column, triggered: Column) -> Column:
    return F.when(late_check, "late_verification").when((t <= 1) & bridge, "early_bridge").when(triggered, "trigger_only_candidate")


#: Note types and limits of a note.
LEGAL_TYPES, MOST_SOURCES, MOST_TOKENS, DUPLICATE = ("bridge_note", "verification_note"), 3, 45, 0.90


def legality(notes: DataFrame) -> DataFrame:
    """Notes with legal and reasons (sorted).

    ``notes``: qid, note_id, pos, type, text, sources, and of the state: visible (unit ids) and
    existing (texts of its notes). Whether a note repeats an earlier one depends on which of
    those were accepted, so a question's few notes are folded in order of ``pos``.
    """
    bare = lambda x: T.normalize(F.coalesce(x, F.lit("")))
    worded = lambda x: F.struct(x.alias("norm"), T.tokens(x).alias("words"))
    same = lambda a, b: (a["norm"] == b["norm"]) | (T.jaccard(a["words"], b["words"]) > DUPLICATE)
    text, own_words = F.col("_text"), F.struct(F.col("_norm").alias("norm"), F.col("_words").alias("words"))
    rules = {
        "duplicate_with_state": F.exists(F.coalesce("existing", F.array().cast("array<string>")), lambda x: let(bare(x), lambda b: let(worded(b), lambda w: same(w, own_words)))),
        "duplicated_source_ids": F.size("sources") != F.size(F.array_distinct("sources")),
        "empty_text": F.col("_norm") == "",
        "invalid_source_count": ~F.size("sources").between(1, MOST_SOURCES),
        "invalid_type": ~F.coalesce(F.col("type").isin(*LEGAL_TYPES), F.lit(False)),
        "invisible_source_ids": F.size(F.array_except("sources", "visible")) > 0,
        "not_single_sentence": T.sentence_count(text) != 1,
        "too_long": T.token_count(text) > MOST_TOKENS,
    }
    own = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))  # rules stand by name, so sorted
    rows = notes.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("visible", F.coalesce("visible", F.array().cast("array<string>")))
    # a note is normalised and cut into words once, and not for each other note that it is compared with
    rows = rows.withColumn("_text", F.trim(F.coalesce("text", F.lit("")))).withColumn("_norm", bare(F.col("_text"))).withColumn("_words", T.tokens(F.col("_norm")))
    judged = rows.select("qid", F.struct("pos", "note_id", F.col("_norm").alias("norm"), own.alias("why"), F.col("_words").alias("words")).alias("n"))
    listed = judged.groupBy("qid").agg(F.sort_array(F.collect_list("n")).alias("ns"))  # no nulls, and sort_array compares without a lambda
    start = F.struct(F.array().cast("array<struct<norm:string,words:array<string>>>").alias("kept"), F.array().cast("array<struct<note_id:string,legal:boolean,reasons:array<string>>>").alias("out"))

    def fold(state: Column, n: Column) -> Column:
        again = F.exists(state["kept"], lambda k: same(k, n))
        reasons = F.when(again, F.sort_array(F.array_union(n["why"], F.array(F.lit("duplicate_in_harvest"))))).otherwise(n["why"])

        def written(why: Column) -> Column:
            legal = F.size(why) == 0
            one = F.struct(n["note_id"].cast("string").alias("note_id"), legal.alias("legal"), why.alias("reasons"))
            return F.struct(F.when(legal, F.concat(state["kept"], F.array(F.struct(n["norm"].alias("norm"), n["words"].alias("words"))))).otherwise(state["kept"]).alias("kept"), F.concat(state["out"], F.array(one)).alias("out"))

        return let(reasons, written)

    return listed.select("qid", F.explode(F.aggregate("ns", start, fold, lambda s: s["out"])).alias("o")).select("qid", "o.*")


def stop_probe(answered: Column, correct: Column, sufficient: Column) -> dict[str, Column]:
    stop = answered & correct & sufficient
    return {"teacher_stop": stop, "false_stop": ~stop}


#: Fixed value: most notes kept for the state.
MOST_KEPT = 2
LAST = 10**9


def retention(notes: DataFrame) -> DataFrame:
    """Legal notes with ``kept``; the others are auxiliary.

    ``notes``: qid, note_id, type, priority, sources (their number), answer_facing, closure, and
    the question's mode and subtype. Repair after a false stop and late verification keep the
    two best by what they close, an early bridge keeps one, and any other subtype none.
    """
    priority, first_id = F.coalesce("priority", F.lit(LAST)), F.col("note_id")
    by = lambda *order: F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    closing = by(F.desc("answer_facing"), F.desc("closure"), priority, F.desc("sources"), first_id)
    bridging = by(F.desc(F.col("type") == "bridge_note"), priority, F.desc("sources"), first_id)
    repair = F.coalesce(F.col("mode") == "repair_after_false_stop", F.lit(False)) | F.coalesce(F.col("subtype") == "late_verification", F.lit(False))
    ranked = notes.withColumn("_c", closing).withColumn("_b", bridging)
    kept = F.when(repair, F.col("_c") <= MOST_KEPT).when(F.col("subtype") == "early_bridge", F.col("_b") == 1).otherwise(F.lit(False))
    return ranked.withColumn("kept", kept).drop("_c", "_b")


def rollout(candidates: DataFrame) -> DataFrame:
    """Greedy trajectories: (qid, t, unit, gain, terminal_status).

    ``candidates``: qid, unit, role, weight, score, doc. At most ``MAX_STEPS`` times the unit of
    largest utility is taken: the weight of a role not covered yet, plus the score, minus a
    penalty for a document used in the last two steps. It ends as success when all roles with
    candidates of positive weight are covered, as stalled after two steps without progress, else
    at an empty pool or the step limit. A qid's candidates are a short list.
    """

    def one(pool: list) -> list[tuple]:
        need = {r.role for r in pool if r.weight > 0}
        covered, recent, flags, out, how = set(), [], [], [], "max_steps"
        for t in range(MAX_STEPS):
            if not pool:
                how = "empty_candidate_pool"
                break
            value = [round((r.weight if r.role not in covered else 0.0) + 0.01 * r.score - (0.05 if r.doc in recent[-2:] else 0.0), 9) for r in pool]
            at = value.index(max(value))
            best = pool.pop(at)
            new = best.role not in covered and best.weight > 0
            out.append((best.qid, t, best.unit, round(value[at], 6)))
            covered |= {best.role} if new else set()
            recent.append(best.doc)
            flags.append(new)
            if need and need <= covered:
                how = "success"
                break
            if len(flags) >= STALL_WINDOW and not any(flags[-STALL_WINDOW:]):
                how = "stalled"
                break
        return [(*o, how) for o in out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # the rows of one qid, which may span batches
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if held and held[0].qid != r.qid:
                    out += one(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["qid", "t", "unit", "gain", "terminal_status"])
        yield pd.DataFrame(one(held) if held else [], columns=["qid", "t", "unit", "gain", "terminal_status"])

    k = {f.name: f.dataType.simpleString() for f in candidates.schema}
    dealt = candidates.repartition("qid").sortWithinPartitions("qid", "unit")
    return dealt.mapInPandas(run, f"qid {k['qid']}, t int, unit {k['unit']}, gain double, terminal_status string")
