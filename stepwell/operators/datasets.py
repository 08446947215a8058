"""Training rows derived from trajectories: fixed pools, rollout-aligned targets, clue states, coverage students, hard preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates
from .rewrite import first_unresolved
from .selection import hard_record

#: The order of roles in a question's gold units.
ROLE_ORDER = ("bridge", "distinguish", "support")


def state_rows(gold: DataFrame, pools: DataFrame) -> DataFrame:
    """One row for each prefix of a question's gold units: (qid, t, context, positive, candidates).

    ``gold``: qid, unit, role, pos; ordered by role, then pos. ``pools``: qid, pool (array), the
    same for all prefixes; a gold unit that it lacks comes first.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role")), F.lit(0)), F.lit(len(ROLE_ORDER) + 1))
    ordered = gold.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("r"), "pos", "unit"))), lambda g: g["unit"]).alias("gold"))
    each = ordered.join(pools, "qid").select("qid", F.posexplode("gold").alias("t", "positive"), "gold", "pool")
    return each.select("qid", "t", F.slice("gold", F.lit(1), F.col("t")).alias("context"), "positive", F.array_distinct(F.concat(F.array("positive"), "pool")).alias("candidates"))


def rollout_aligned(teacher: DataFrame, own: DataFrame, gold: DataFrame) -> DataFrame:
    """Teacher rows (qid, t, context, positive), and a policy's own states (qid, t, context) aimed at the first gold unit they lack.

    ``gold``: qid, gold (array in order). A state that has all of them is left out. ``source``
    tells the two apart.
    """
    aimed = own.join(gold, "qid").select("qid", "t", "context", first_unresolved(F.col("gold"), F.col("context")).alias("positive")).where("positive is not null")
    return teacher.select("qid", "t", "context", "positive", F.lit("teacher").alias("source")).unionByName(aimed.withColumn("source", F.lit("rollout")))


def clue_states(rows: DataFrame) -> DataFrame:
    """(qid, t, notebook) with the clue state of the evidence read so far in place of the notebook; ``rows``: qid, t, question, evidence."""
    state = gates.clue_state(gates.question_clues(F.col("question")), F.coalesce("evidence", F.lit("")))
    return rows.select("qid", "t", gates.render_clues(state).alias("notebook"))


def coverage_positive(pool: Column, targets: Column, covered: Column) -> Column:
    """The first unit of the pool (unit, parent, eligible) whose parent is a target not covered yet, else the first eligible one; where none is eligible the whole pool is. Null for an empty pool."""
    open_ = F.array_except(targets, covered)
    usable = F.filter(pool, lambda c: c["eligible"])
    some = F.when(F.size(usable) > 0, usable).otherwise(pool)
    aimed = F.filter(some, lambda c: F.coalesce(F.array_contains(open_, c["parent"]), F.lit(False)))
    return F.try_element_at(F.concat(aimed, some), F.lit(1))["unit"]


def coverage_students(states: DataFrame) -> DataFrame:
    """Every state with the positive that coverage wants in place of its own.

    ``states``: qid, t, pool (array of unit and parent, in order), history (units read so far),
    targets and covered (parents), positive. Columns: qid, t, positive, aimed (it is of a target
    not covered yet), negatives (the rest of the pool), acquired (of these the units read),
    previous (the positive of the state before), switch (from the second step on), source (the
    old positive), changed, and same_parent (null where it isn't changed).
    """
    own = F.transform("pool", lambda c: F.struct(c["unit"].alias("unit"), c["parent"].alias("parent"), (~F.array_contains("history", c["unit"])).alias("eligible")))
    chosen = states.withColumn("source", F.col("positive")).withColumn("positive", coverage_positive(own, F.col("targets"), F.col("covered")))
    parent = lambda unit: F.get(F.filter("pool", lambda c: c["unit"] == unit), F.lit(0))["parent"]
    negatives = F.transform(F.filter("pool", lambda c: c["unit"] != F.col("positive")), lambda c: c["unit"])
    before = lambda c: F.lag(c).over(Window.partitionBy("qid").orderBy("t"))  # noqa: E731  a join would work out every state twice
    out = chosen.withColumn("previous", F.when(before("t") + 1 == F.col("t"), before("positive"))).withColumn("_parent", parent(F.col("positive"))).withColumn("negatives", negatives)
    changed = F.col("positive") != F.col("source")
    aimed = F.coalesce(F.array_contains(F.array_except("targets", "covered"), F.col("_parent")), F.lit(False))
    return out.select(
        "qid", "t", "positive", aimed.alias("aimed"), "negatives", F.array_intersect("history", "negatives").alias("acquired"), "previous", (F.col("t") >= 1).alias("switch"), "source", changed.alias("changed"),
        F.when(changed, F.col("_parent").eqNullSafe(parent(F.col("source")))).alias("same_parent"),
    )


def hard_rows(errors: DataFrame, most: int) -> DataFrame:
    """(qid, t, positive, candidates, labels) of wrong choices whose gold and predicted unit are both among the candidates.

    ``errors``: qid, t, positive, predicted, rank (of the gold), ranked (array of units). The
    candidates are the first ``most``, a predicted unit beyond them comes first and a gold one
    last; one candidate alone is no preference.
    """
    some = errors.where((F.coalesce("rank", F.lit(999)) <= most) & F.array_contains("ranked", F.col("positive")) & F.array_contains("ranked", F.col("predicted")))
    top = F.array_distinct(F.slice("ranked", 1, most))
    with_gold = F.when(F.array_contains(top, F.col("positive")), top).otherwise(F.concat(top, F.array("positive")))
    whole = F.when(F.array_contains(with_gold, F.col("predicted")), with_gold).otherwise(F.concat(F.array("predicted"), with_gold))
    cut = F.slice(whole, 1, most)
    kept = F.when(F.array_contains(cut, F.col("positive")), cut).otherwise(F.concat(F.slice(cut, F.lit(1), F.size(cut) - 1), F.array("positive")))
    out = some.select("qid", "t", "positive", kept.alias("candidates")).where(F.size("candidates") >= 2)
    return out.withColumn("labels", F.transform("candidates", lambda c: (c == F.col("positive")).cast("int")))


def focus_rows(samples: DataFrame, records: DataFrame, least: int, most: int, times: int) -> DataFrame:
    """The samples (qid, t, ...) of hard records (qid, t, policy_rank, kept_rank), each so many times with ``duplicate`` from 1."""
    hard = records.where(hard_record(F.col("policy_rank"), F.col("kept_rank"), least, most)).select("qid", "t").distinct()
    return samples.join(hard, ["qid", "t"], "left_semi").withColumn("duplicate", F.explode(F.sequence(F.lit(1), F.lit(max(1, times)))))
