"""Audits of runs and trajectories: causes, interventions, agreement, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import question_context

#: Fixed values of the stall causes: repeat ratio, and coverage that should have opened the stop gate.
REPEAT_RATIO, HIGH_COVERAGE = 0.60, 0.8


def decide(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda out, r: out.when(F.coalesce(r[0], F.lit(False)), F.lit(r[1])), rules, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(otherwise))


def closure_success(em: Column, covered: Column, count: Column, budgets: list[int]) -> dict[str, Column]:
    """For each budget whether a right answer came with full coverage from so many units at most."""
    return {f"success_{b}": ((em == 1) & covered & (count <= b)).cast("int") for b in budgets}


def title_metrics(predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall, F1, equality and coverage of titles as sets; empty ones left out."""
    p, g = (F.array_distinct(F.filter(x, lambda t: F.coalesce(t, F.lit("")) != "")) for x in (predicted, gold))
    hit = F.size(F.array_intersect(p, g))
    precision, recall = F.when(F.size(p) > 0, hit / F.size(p)).otherwise(0.0), F.when(F.size(g) > 0, hit / F.size(g)).otherwise(0.0)
    return {
        "precision": precision, "recall": recall, "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
        "em": ((F.size(p) == F.size(g)) & (hit == F.size(g))).cast("double"), "coverage": (hit == F.size(g)).cast("double"),
    }


def alignment_at(steps: DataFrame, k: int) -> DataFrame:
    """(qid, hits, steps): steps whose gold unit is among the first k: by ``rank``, or without one by ``selected`` holding ``positive``."""
    hit = F.when(F.col("rank").isNotNull(), F.col("rank") <= k).otherwise(F.coalesce(F.array_contains(F.slice("selected", 1, k), F.col("positive")), F.lit(False)))
    return steps.groupBy("qid").agg(F.sum(hit.cast("long")).alias("hits"), F.count(F.lit(1)).alias("steps"))


def context_sizes(selected: DataFrame, units: DataFrame) -> DataFrame:
    """Mean units, characters and white-space tokens of the contexts that (qid, pos, unit) make of (unit, text), lines joined."""
    # a text is measured once, however many contexts have it, and no context moves it
    sized = units.select("unit", F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).alias("tokens"))
    per = selected.join(sized, "unit").groupBy("qid").agg(F.count(F.lit(1)).alias("units"), (F.sum("chars") + F.count(F.lit(1)) - 1).alias("chars"), F.sum("tokens").alias("tokens"))
    return per.agg(*(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("units", "chars", "tokens")), F.count(F.lit(1)).alias("contexts"))


def shuffled_lines(notebook: Column, seed: int, qid: Column, t: Column) -> Column:
    """A notebook's lines in a hash order of seed, question, step and line number, under its header; two lines or fewer stay."""
    lines = F.filter(F.split(notebook, "\n"), lambda x: F.trim(x) != "")
    header = F.lower(F.trim(lines[0])).startswith("evidence")
    body = F.when(header, F.slice(lines, 2, F.size(lines))).otherwise(lines)
    keyed = F.transform(body, lambda x, i: F.struct(F.sha2(F.concat_ws("::", F.lit(str(seed)), qid.cast("string"), t.cast("string"), i.cast("string")), 256).alias("k"), x.alias("x")))
    mixed = F.transform(F.array_sort(keyed), lambda x: x["x"])
    none = F.slice(lines, 1, 0)
    return F.when(F.size(lines) <= 2, notebook).otherwise(F.array_join(F.concat(F.when(header, F.slice(lines, 1, 1)).otherwise(none), mixed), "\n"))


#: The ways to alter a state's notebook.
CONDITIONS = ("correct", "query_only", "empty", "frozen", "shuffled", "other_question", "previous_evidence_only")


def interventions(rows: DataFrame, seed: int) -> DataFrame:
    """(qid, t, condition, context) of (qid, t, question, notebook, other, previous): each state under every condition.

    ``frozen`` is the notebook of the question's first step; ``other`` and ``previous`` may be null.
    """
    first = F.first("notebook").over(Window.partitionBy("qid").orderBy("t"))
    none = F.lit("")
    books = [F.col("notebook"), none, none, F.col("frozen"), shuffled_lines(F.col("notebook"), seed, F.col("qid"), F.col("t")), F.coalesce("other", none), F.coalesce("previous", none)]
    contexts = [F.col("question") if c == "query_only" else question_context(F.col("question"), b) for c, b in zip(CONDITIONS, books)]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), x.alias("context")) for c, x in zip(CONDITIONS, contexts))))
    return rows.withColumn("frozen", first).select("qid", "t", each.alias("e")).select("qid", "t", "e.*")


def state_necessity(ranks: DataFrame) -> DataFrame:
    """What the state does to the gold rank from the second step on, of (t, correct, query): ranks with it and with the question alone."""
    some = ranks.where("t >= 1 and correct is not null and query is not null")
    n = lambda c: F.sum(c.cast("long"))
    better, c, q = {}, F.col("correct"), F.col("query")
    for k in (1, 5):
        better[f"rescued_at_{k}"], better[f"harmed_at_{k}"] = n((c <= k) & (q > k)), n((c > k) & (q <= k))
    return some.agg(F.count(F.lit(1)).alias("eligible"), *(v.alias(k) for k, v in better.items()), n(c < q).alias("rank_improved"), n(c > q).alias("rank_degraded"), F.round(F.avg(q - c), 6).alias("mean_gain"))


def stall_cause(progressed: Column, deltas: Column, ratios: Column, positives: Column, needs: Column, triggers: Column, stops: Column, probes: Column, coverage: Column) -> Column:
    """Why a trajectory stalled, by the values of its last steps (arrays), its stop probes and the share of targets covered."""
    plateau = (F.size(deltas) > 0) & F.forall(deltas, lambda d: d <= 0)
    named = F.filter(positives, lambda p: F.coalesce(p.cast("string"), F.lit("")) != "")
    loops = F.exists(ratios, lambda r: F.coalesce(r >= REPEAT_RATIO, F.lit(False))) & (F.size(F.array_distinct(named)) < F.size(named))
    any_ = lambda flags: F.exists(flags, lambda f: F.coalesce(f, F.lit(False)))
    closed = plateau & (probes == 0) & ~any_(stops)
    return decide(
        [
            (~progressed, "stalled_without_progress"), (plateau & loops, "stalled_retrieval_looping"), (closed & (coverage >= HIGH_COVERAGE), "stalled_stop_gate_too_conservative"),
            (closed & ~any_(needs), "stalled_need_derived_not_opened"), (plateau & any_(triggers), "stalled_need_derived_opened_but_no_effect"),
        ],
        "stalled_after_progress",
    )


def note_role(kind: Column, note_has_gold: Column, source_has_gold: Column, novel: Column, next_in_pool: Column, next_raw: Column, next_delta: Column) -> Column:
    """What a derived note did for the next step."""
    check, bridge = kind == "verification_note", kind == "bridge_note"
    return decide(
        [
            (check & note_has_gold & ~source_has_gold, "answer_facing_verification"), (check & (F.size(novel) > 0), "abstractive_verification"), (check, "verification_without_new_surface_signal"),
            (bridge & next_raw & ~next_in_pool, "bridge_scaffold_for_new_raw"), (bridge & next_raw & (next_delta > 0), "bridge_scaffold_for_progress"), (bridge, "bridge_contextualization"),
        ],
        "unknown",
    )


def repair_bottlenecks(cases: DataFrame, attempts: DataFrame) -> DataFrame:
    """(qid, bottleneck) of cases (qid, failure) by their repair attempts.

    ``attempts``: qid, the counts harvested, legal, retained and delta, and the flags considered,
    selected, dropped, continued and kept_options.
    """
    flags = [F.bool_or(F.col(c) > 0).alias(c) for c in ("harvested", "legal", "retained", "delta")] + [F.bool_or(c).alias(c) for c in ("considered", "selected", "dropped", "continued", "kept_options")]
    seen = cases.join(attempts.groupBy("qid").agg(*flags), "qid", "left")
    none, has = F.col("harvested").isNull(), {c: F.col(c) for c in ("harvested", "legal", "retained", "delta", "considered", "selected", "dropped", "continued", "kept_options")}
    rules = [
        (none & (F.col("failure") == "stop_gate_too_conservative"), "stop_gate_not_reopened"), (none & (F.col("failure") == "answer_wrong_after_sufficient_evidence"), "answer_focus_not_fixed"),
        (none, "no_repair_attempt"), (~has["harvested"] | ~has["legal"], "repair_note_low_closure_value"), (~has["retained"], "repair_note_good_but_not_retained"),
        (~has["considered"], "repair_note_retained_but_not_used"), (has["dropped"], "repair_linked_candidate_dropped_from_pool"), (~has["selected"], "teacher_select_not_using_repair"),
        (has["continued"] & has["kept_options"] & ~has["delta"], "closure_continuation_not_catching_answer_hop"), (~has["delta"], "repair_note_selected_but_no_closure_gain"),
    ]
    return seen.select("qid", decide(rules, "repair_note_low_closure_value").alias("bottleneck"))


def anchor_conditioning(steps: DataFrame) -> DataFrame:
    """Step metrics by whether a step's anchor is the positive unit of the step before: (anchor_gold, states, share, step_at_1, step_at_5, mrr)."""
    w = Window.partitionBy("qid").orderBy("t")
    some = steps.withColumn("gold", F.col("anchor").eqNullSafe(F.lag("positive").over(w))).where("t >= 1")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    per = some.groupBy(F.col("gold").alias("anchor_gold")).agg(F.count(F.lit(1)).alias("states"), rate(F.col("rank") == 1).alias("step_at_1"), rate(F.col("rank") <= 5).alias("step_at_5"), rate(1 / F.col("rank")).alias("mrr"))
    total = F.sum("states").over(Window.partitionBy())  # of two rows at most
    return per.withColumn("share", F.round(F.col("states") / total, 6))


def gate_passes(step_low: Column, mrr_low: Column, coverage_high: Column) -> Column:
    """Whether a model may replace another: a lower end of step@1 or MRR is above 0, and coverage isn't surely lower."""
    return ((step_low > 0) | (mrr_low > 0)) & (coverage_high >= 0)


def clue_breaks(steps: DataFrame) -> DataFrame:
    """(qid, t, reason) where the clue states of (qid, t, question, before, after) break a rule; before and after are arrays of coverage.

    A step never loses coverage, starts where the one before ended, keeps the question, and the first starts from nothing.
    """
    w = Window.partitionBy("qid").orderBy("t")
    rows = steps.select("*", F.lag("after").over(w).alias("_a"), F.first("question").over(w).alias("_q"))
    falls = ~F.forall(F.arrays_zip(F.col("before").alias("b"), F.col("after").alias("a")), lambda z: F.coalesce(z["a"], F.lit(-1.0)) >= F.coalesce(z["b"], F.lit(0.0)))
    rules = [(falls, "coverage_falls"), (F.col("_a").isNotNull() & (F.col("before") != F.col("_a")), "not_where_it_ended"), (F.col("question") != F.col("_q"), "question_changes"), (F.col("_a").isNull() & F.exists("before", lambda x: x > 0), "start_not_empty")]
    why = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules)))
    return rows.select("qid", "t", F.explode(why).alias("reason"))


def costs(calls: DataFrame) -> DataFrame:
    """Per question what model calls (qid, tokens, seconds, output) cost; nulls count as nothing, blank outputs are counted."""
    blank = F.coalesce(F.trim("output"), F.lit("")) == ""
    return calls.groupBy("qid").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0)).cast("long")).alias("tokens"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 6).alias("seconds"), F.sum(blank.cast("long")).alias("empty_outputs"))


def proxy_agreement(candidates: DataFrame) -> DataFrame:
    """How often the chosen unit is the first by base score, by relevance, by coverage: rates over the states.

    ``candidates``: qid, t, unit, chosen (flag), base, relevance, coverage (scores; ties by unit).
    """
    first = lambda c: F.min(F.struct((-F.col(c)).alias("s"), "unit"))["unit"].alias(c)
    per = candidates.groupBy("qid", "t").agg(F.min(F.when(F.col("chosen"), F.col("unit"))).alias("own"), *(first(c) for c in ("base", "relevance", "coverage")))
    return per.where("own is not null").agg(F.count(F.lit(1)).alias("states"), *(F.round(F.avg((F.col(c) == F.col("own")).cast("double")), 6).alias(c) for c in ("base", "relevance", "coverage")))


def teacher_deficits(report: DataFrame, teacher: DataFrame) -> DataFrame:
    """Report steps (qid, t, ...) with the teacher's deficit at (qid, t), null where it has none."""
    return report.join(teacher.select("qid", "t", "deficit"), ["qid", "t"], "left")


def stop_prefixes(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(qid, t, terminal) of the prefixes to label.

    ``steps``: qid, t, keep (null unless a step says so). ``ends``: qid, status, terminal_step,
    last_progress. A stalled run keeps what leads to its last progress; a success adds its
    terminal prefix if no step has it.
    """
    rows = steps.join(ends, "qid")
    early = (F.col("status") != "failed_stalled") | F.col("last_progress").isNull() | (F.col("t") <= F.col("last_progress"))
    kept = rows.where(F.coalesce("keep", early)).select("qid", "t", F.lit(False).alias("terminal"))
    last = ends.where("status = 'success' and terminal_step is not null").select("qid", F.col("terminal_step").alias("t")).join(kept.select("qid", "t"), ["qid", "t"], "left_anti")
    return kept.unionByName(last.withColumn("terminal", F.lit(True)))


def runtime_profile(stages: DataFrame) -> DataFrame:
    """Per stage of (run, stage, qid, seconds): total, mean milliseconds a question and questions a second."""
    per = stages.groupBy("run", "stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.countDistinct("qid").alias("qids"))
    return per.select("run", "stage", "seconds", "qids", F.round(1000 * F.col("seconds") / F.col("qids"), 6).alias("ms_per_qid"), F.round(F.when(F.col("seconds") > 0, F.col("qids") / F.col("seconds")), 6).alias("qids_per_second"))


def protocol_differences(expected: dict[str, str], observed: DataFrame) -> DataFrame:
    """(key, expected, observed) of a run's settings (key, value) that are missing, extra or other than expected."""
    want = observed.sparkSession.createDataFrame(sorted(expected.items()), "key string, expected string")
    both = want.join(observed.select("key", F.col("value").alias("observed")), "key", "full")
    return both.where("expected is null or observed is null or expected <> observed")


def funnel(gold: DataFrame, stages: dict[str, DataFrame], k: int) -> DataFrame:
    """(stage, hits, states): how many gold units (qid, unit) each stage's ranking (qid, unit, rank) still has among its first k."""
    out = []
    for name, ranked in stages.items():
        found = gold.join(ranked.where(F.col("rank") <= k).select("qid", "unit", F.lit(1).alias("hit")), ["qid", "unit"], "left")
        out.append(found.agg(F.lit(name).alias("stage"), F.count("hit").alias("hits"), F.count(F.lit(1)).alias("states")))
    return reduce(DataFrame.unionByName, out)


def markdown(frame: DataFrame, most: int = 1000) -> str:
    """A small table as markdown; raises beyond ``most`` rows, which no report shows."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(frame.columns), line(["---"] * len(frame.columns)), *map(line, rows)])


def trajectory_marks(steps: DataFrame, width: int = 20) -> DataFrame:
    """(qid, plot): the deficits of (qid, t, deficit) as one line of bars for each step."""
    bar = F.concat(F.lpad(F.col("t").cast("string"), 3, " "), F.lit(" "), F.repeat(F.lit("#"), F.greatest(F.lit(0), F.round(F.col("deficit") * width).cast("int"))))
    return steps.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", bar.alias("b")))), lambda x: x["b"]), "\n").alias("plot"))
