"""Ordered steps: windows over (qid, t), state folds, labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("bridge", "distinguish", "support")
ALPHA = 1.0
STALL_WINDOW = 2


def step_window():
    return Window.partitionBy("qid").orderBy("t")


def before_window():
    return step_window().rowsBetween(Window.unboundedPreceding, -1)


def so_far_window():
    return step_window().rowsBetween(Window.unboundedPreceding, 0)


def onwards_window():
    return step_window().rowsBetween(0, Window.unboundedFollowing)


def whole_window():
    return Window.partitionBy("qid")


def first_use(steps: DataFrame) -> DataFrame:
    """Steps with is_new: whether their unit is used for the first time in the qid."""
    w = Window.partitionBy("qid", "unit").orderBy("t")
    return steps.withColumn("is_new", (F.row_number().over(w) == 1).cast("int"))


def with_prefix(steps: DataFrame, unit: str = "unit") -> DataFrame:
    """Steps with the units of all earlier steps, in order."""
    return steps.withColumn("prefix", F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(unit).alias("u"))).over(before_window())), lambda x: x["u"]))


def neighbours(steps: DataFrame, column: str) -> DataFrame:
    """Steps with previous_ and next_ of a column."""
    return steps.withColumn(f"previous_{column}", F.lag(column).over(step_window())).withColumn(f"next_{column}", F.lead(column).over(step_window()))


def stalled(flag: str) -> Column:
    """Whether the last ``STALL_WINDOW`` progress flags are all 0."""
    w = step_window().rowsBetween(1 - STALL_WINDOW, 0)
    return (F.count(flag).over(w) == STALL_WINDOW) & (F.sum(flag).over(w) == 0)


def last_progress(flag: str) -> Column:
    return F.max(F.when(F.col(flag) == 1, F.col("t"))).over(so_far_window())


def remaining_ratio(flag: str) -> Column:
    """Marked steps from here on over all marked steps of the qid; 0 without any."""
    total = F.sum(flag).over(whole_window())
    return F.when(total > 0, F.sum(flag).over(onwards_window()) / total).otherwise(F.lit(0.0))


def contiguous(steps: DataFrame) -> DataFrame:
    """(qid, ok): whether t runs 0, 1, 2, ..."""
    return steps.withColumn("n", F.row_number().over(step_window()) - 1).groupBy("qid").agg(F.min((F.col("t") == F.col("n")).cast("int")).alias("ok"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Keys whose rows differ in their signature."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*signature)).alias("signatures")).where("signatures > 1")


def ledger(steps: DataFrame) -> DataFrame:
    """Steps (qid, t, unit, role, weight) with k_<role> before the step: the weight of distinct units used so far."""
    once = first_use(steps)
    for r in ROLES:
        gained = F.when((F.col("role") == r) & (F.col("is_new") == 1), F.col("weight")).otherwise(0.0)
        once = once.withColumn(f"k_{r}", F.coalesce(F.sum(gained).over(before_window()), F.lit(0.0)))
    return once


def deficit(k: Column, n: Column, alpha: float = ALPHA) -> Column:
    """1 - (k + alpha) / (n + 2 alpha), 0 without targets; rounded to 6."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.round(1 - (k + alpha) / (n + 2 * alpha), 6))


def deficits(steps: DataFrame, totals: DataFrame) -> DataFrame:
    """Ledger steps with d_<role>; ``totals`` has qid and n_<role>."""
    out = ledger(steps).join(totals, "qid")
    return out.select("qid", "t", "unit", "role", "is_new", *[deficit(F.col(f"k_{r}"), F.col(f"n_{r}")).alias(f"d_{r}") for r in ROLES])


def contributions(with_deficits: DataFrame, terminal: Column) -> DataFrame:
    """c_<role> = max(0, d_t - d_t+1); after the last step 0 is left where ``terminal``, else d_t."""
    out = with_deficits
    for r in ROLES:
        d, last = F.col(f"d_{r}"), F.when(terminal, F.lit(0.0))
        out = out.withColumn(f"c_{r}", F.round(F.greatest(F.lit(0.0), d - F.coalesce(F.lead(f"d_{r}").over(step_window()), last, d)), 6))
    return out


def stop_label(success: Column, terminal: Column, t: Column, false_stop: Column) -> Column:
    """terminal, false-stop, near-terminal (one or two steps before) or continue."""
    done = success & terminal.isNotNull()
    return (
        F.when(done & (t == terminal), "terminal")
        .when(F.coalesce(false_stop, F.lit(False)), "false-stop")
        .when(done & (terminal - t).isin(1, 2), "near-terminal")
        .otherwise("continue")
    )


def ranking_negatives(candidates: Column, positive: Column) -> Column:
    return F.array_except(candidates, F.array(positive))


def utility(delta: dict[str, Column], context: Column, kappa: Column) -> Column:
    """(gains by role + 1.5 x gain of context) / cost."""
    return (delta["bridge"] + delta["distinguish"] + delta["support"] + 1.5 * context) / kappa


def kappa(note_type: Column, granularity: Column) -> Column:
    """The cost of a candidate: sentence 1.00, chunk 1.10, bridge note 1.15, other notes 1.20 (fixed values)."""
    return F.when(note_type == "bridge_note", 1.15).when(note_type.isNotNull(), 1.20).when(granularity == "chunk", 1.10).otherwise(1.00)


def status(success: Column, progressed: Column) -> Column:
    return F.when(success, "success").when(progressed, "failed_but_progressive").otherwise("failed_stalled")


def as_of(left: DataFrame, bank: DataFrame, key: str = "qid", t: str = "t") -> DataFrame:
    """For each (key, t) of ``left`` the bank's last row at or before t, else its first.

    One union and one sorted window per key; no range join.
    """
    value = [c for c in bank.columns if c not in (key, t)]
    row = F.struct(t, *value)
    both = bank.select(key, t, F.lit(0).alias("_side"), row.alias("_row")).unionByName(left.select(key, t, F.lit(1).alias("_side"), F.lit(None).cast(bank.select(row.alias("r")).schema["r"].dataType).alias("_row")))
    w = Window.partitionBy(key).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(t, "_side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_r", F.coalesce(F.last("_row", True).over(w), F.first("_row", True).over(after))).where("_side = 1")
    return found.select(key, t, F.col(f"_r.{t}").alias(f"source_{t}"), *[F.col(f"_r.{c}").alias(c) for c in value])


#: Ids of one range where each is to meet the next.
RANGE_IDS = 1 << 12


def cyclic_next(rows: DataFrame, id_: str, part: str, width: int = RANGE_IDS) -> DataFrame:
    """Each whole id of a part with the next by order, the last with the first: (part, id, paired).

    A part may hold any share of the rows, so it is cut into ranges of ``width`` ids, which are
    sorted apart; the last id of a range gets the first of the next range from a table with one
    row for each range.
    """
    ranged = rows.select(part, id_, F.floor(F.col(id_) / width).alias("_range"))
    own = Window.partitionBy(part, "_range").orderBy(id_)
    firsts = ranged.groupBy(part, "_range").agg(F.min(id_).alias("_first"))
    order = Window.partitionBy(part).orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(part, "_range", F.coalesce(F.lead("_first").over(order), F.first("_first").over(whole)).alias("_after"))
    led = ranged.withColumn("_next", F.lead(id_).over(own))
    return led.join(after, [part, "_range"]).select(part, id_, F.coalesce("_next", "_after").alias("paired"))


def notebook(entries: Column, most: int = 8, chars: int = 260) -> Column:
    """Rendered state: newest first, ``[i] title: text``, those of one step and count in their order. ``entries``: array of (added_step, count, title, text)."""
    keyed = F.transform(entries, lambda e, i: F.struct(e["added_step"], e["count"], (-i).alias("i"), e["title"].alias("title"), e["text"].alias("text")))
    newest = F.slice(F.reverse(F.array_sort(keyed)), 1, most)
    cut = lambda x: F.when(F.length(x) <= chars, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(chars - 3))), F.lit("...")))
    return F.array_join(F.transform(newest, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["title"], F.lit(": "), cut(e["text"]))), "\n")


def fold_state(steps: DataFrame) -> DataFrame:
    """(qid, t, raw_refs, last_unit) after every step: each unit with its first step and how often it was chosen.

    One array fold per step over its own prefix; a qid has few steps.
    """
    so_far = F.array_sort(F.collect_list(F.struct("t", "unit")).over(so_far_window()))
    units = F.array_distinct(F.transform(F.col("_s"), lambda s: s["unit"]))
    refs = F.transform(units, lambda u: F.struct(u.alias("unit"), F.array_min(F.transform(F.filter("_s", lambda s: s["unit"] == u), lambda s: s["t"])).alias("added_step"), F.size(F.filter("_s", lambda s: s["unit"] == u)).alias("count")))
    return steps.withColumn("_s", so_far).select("qid", "t", refs.alias("raw_refs"), F.col("unit").alias("last_unit"))


def six_way(parts: list[DataFrame]) -> DataFrame:
    """Inner join of step tables on (qid, t); all share one partitioning, so each is shuffled once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["qid", "t"])
    return out


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    return x.join(y, keys, "full").where("in_a is null or in_b is null").select(*keys, F.when(F.col("in_a").isNull(), "right").otherwise("left").alias("side"))


def monotone_rate(values: DataFrame, column: str) -> DataFrame:
    """Share of adjacent pairs that don't rise by more than 1e-9."""
    pairs = values.withColumn("_p", F.lag(column).over(step_window())).where("_p is not null")
    return pairs.agg(F.round(F.avg((F.col(column) <= F.col("_p") + 1e-9).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("pairs"))


def repeat(rows: DataFrame, times: Column) -> DataFrame:
    """Every row so many times, with ``repetition`` from 0."""
    return rows.withColumn("repetition", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
