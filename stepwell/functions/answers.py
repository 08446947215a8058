"""Answer and evidence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_answer


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda x: x != "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens in common, counted with repeats."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def f1_from(same: Column, n: Column, m: Column) -> Column:
    """F1 from the tokens in common and both numbers of tokens; where one is 0, 1 if both are."""
    empty = (n == 0) | (m == 0)
    return F.when(empty, ((n == 0) & (m == 0)).cast("double")).otherwise(2.0 * same / F.greatest(n + m, F.lit(1)))


def f1(prediction: Column, gold: Column) -> Column:
    p, g = answer_tokens(prediction), answer_tokens(gold)
    return f1_from(multiset_overlap(p, g), F.size(p), F.size(g))


def official_f1(prediction: Column, gold: Column) -> Column:
    """As `f1`, but 0 where one side is yes, no or noanswer and the sides differ."""
    p, g = normalize_answer(prediction), normalize_answer(gold)
    special = ["yes", "no", "noanswer"]
    return F.when((p.isin(special) | g.isin(special)) & (p != g), F.lit(0.0)).otherwise(f1(prediction, gold))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def contains(prediction: Column, gold: Column) -> Column:
    g = normalize_answer(gold)
    return ((g != "") & F.contains(normalize_answer(prediction), g)).cast("int")


def best_over(references: Column, score) -> Column:
    """The largest score over several references."""
    return F.array_max(F.transform(references, score))


def set_metrics(predicted: Column, gold: Column) -> dict[str, Column]:
    """precision, recall, f1, em and full_coverage of two id arrays as sets."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) > 0, tp / F.size(p)).otherwise(F.lit(0.0))
    recall = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(F.lit(0.0))
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)),
        "em": ((F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)).cast("int"),
        "full_coverage": (F.size(F.array_except(g, p)) == 0).cast("int"),
    }


def joint(answer: dict[str, Column], evidence: dict[str, Column]) -> dict[str, Column]:
    """Products of precision, recall and em, and the F1 of the products."""
    p, r = answer["precision"] * evidence["precision"], answer["recall"] * evidence["recall"]
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), "em": answer["em"] * evidence["em"]}
