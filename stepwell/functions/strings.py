"""The rules of `text` and of `gates` on Python strings, for loops that go through a row's texts many times.

Each gives what the expression of the same name gives for a text that isn't null; white space and
digits are ASCII, as in Java's patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, wraps
from typing import Any

from ..operators.gates import SIGNAL_PATTERNS, SIGNAL_TERMS
from . import text as T

#: Texts whose normal form, tokens or anchors a worker remembers, and the characters to which it remembers one.
REMEMBERED, MOST_CHARS = 4096, 2000
BLANK = " \t\n\x0b\f\r"
#: White space that isn't a single blank already, which is what is squeezed.
_SPACE, _QUOTES, _WORD, _ALNUM = re.compile(r"\s{2,}|[\t\n\x0b\f\r]", re.A), re.compile(r"[\"'“”‘’`.,;:!?()\[\]{}]"), re.compile("[a-z0-9]+"), re.compile("[A-Za-z0-9]+")
_PHRASE = re.compile(r"[A-Z][A-Za-z0-9'&().-]+(?:\s+[A-Z][A-Za-z0-9'&().-]+)*", re.A)
_STOP = frozenset(T.ANCHOR_STOPWORDS)
_END, _ENDED, _PIECES = re.compile(r"(?<=[.!?])\s+", re.A), re.compile("[.!?](?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z"), re.compile("[.!?]+")
_SHOWN = re.compile(f"[^{BLANK}]")


def _pattern(p: str, flags: int = 0) -> re.Pattern:
    r"""A Java pattern: its \d and \s are ASCII, its \b isn't."""
    return re.compile(p.replace(r"\d", "[0-9]").replace(r"\s", f"[{BLANK}]"), flags)


_YES_NO, _NUMBER = re.compile(f"^({'|'.join(T.AUXILIARIES)}) "), re.compile("[0-9]|" + "|".join(T.MONTHS))
_LED = re.compile(rf"^({'|'.join(T.PRONOUNS)})\b", re.I)
_SIGNALS = {**{k: _pattern(p) for k, p in SIGNAL_PATTERNS.items()}, **{k: re.compile("|".join(t)) for k, t in SIGNAL_TERMS.items()}}
_KINDS: list[tuple[str, Callable[[str], Any]]] = [
    ("duration", _pattern(r"\bhow\s+(many\s+)?(hours?|days?|weeks?|months?|years?)\b").search),
    ("math_branch", _pattern(r"\bwhich\s+branch\s+of\s+mathematics\b").search),
    *((kind, _pattern(rf"\b(what|which)\s+{kind}\b").search) for kind in ("river", "university", "county", "city", "state")),
    ("year", lambda q: _YEAR.search(q) or q.startswith("when ") or (("originally" in q or "first" in q) and _MADE.search(q))),
    ("profession", _pattern(r"\b(what|which)\s+(profession|job|occupation)\b").search),
    ("plant", re.compile(r"\b(types|kind) of plant\b").search),
    ("person", lambda q: q.startswith("who ")),
]
_YEAR, _MADE = _pattern(r"\b(what|which)\s+year\b"), re.compile(r"\b(performed|written|built|made|released|founded)\b")
_GOALS = [(re.compile(p), name) for p, name in T.GOALS]


def remembered(f: Callable) -> Callable:
    """``f`` of a text, worked out once for one that comes again soon."""
    known = lru_cache(REMEMBERED)(f)

    @wraps(f)
    def of(x: str, *more: str) -> Any:
        return known(x, *more) if len(x) <= MOST_CHARS else f(x, *more)

    return of


def once(items: Iterable) -> list:
    return list(dict.fromkeys(items))


def rounded(x: float, n: int) -> float:
    """Half up in the decimals that are shown, as Spark rounds."""
    scaled = abs(x) * 10**n
    if abs(scaled - int(scaled) - 0.5) > 1e-3 and scaled < 1e12:
        return round(x, n)
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


@remembered
def normalize(x: str) -> str:
    bare = _SPACE.sub(" ", x.lower().strip(" "))
    return _SPACE.sub(" ", _QUOTES.sub("", bare)).strip(" ")


@remembered
def tokens(x: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(x.lower()))


def capitalized_phrases(x: str) -> list[str]:
    return once(_PHRASE.findall(x))


@remembered
def anchors(x: str) -> tuple[str, ...]:
    short = lambda words, n: [w for w in words if len(w) >= n and w not in _STOP]
    out = []
    for phrase in capitalized_phrases(x):
        out += [p for p in [normalize(phrase)] if p] + short(_WORD.findall(phrase.lower()), 3)
    return tuple(once(out + short(_WORD.findall(x.lower()), 4)))


@remembered
def anchor_set(x: str) -> frozenset[str]:
    return frozenset(anchors(x))


@remembered
def token_set(x: str) -> frozenset[str]:
    return frozenset(tokens(x))


def jaccard(a: frozenset, b: frozenset) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def token_count(x: str) -> int:
    return len(_ALNUM.findall(x))


def sentence_count(x: str) -> int:
    return max(1, sum(_SHOWN.search(p) is not None for p in _PIECES.split(x))) if _SHOWN.search(x) else 0


def sentences(x: str) -> list[str]:
    return [s for s in (p.strip(" ") for p in _END.split(x)) if s]


def is_yes_no(question: str) -> bool:
    return _YES_NO.search(question.strip(" ").lower()) is not None


@remembered
def focus_kind(question: str) -> str:
    if is_yes_no(question):
        return "yes_no"
    q = question.strip(" ").lower()
    return next((kind for kind, rule in _KINDS if rule(q)), "generic")


@remembered
def answer_signal(x: str, kind: str) -> bool:
    return kind in _SIGNALS and _SIGNALS[kind].search(x.lower()) is not None


def number_like(x: str) -> bool:
    return _NUMBER.search(x.lower()) is not None


def goal(question: str) -> str:
    q = question.strip(" ").rstrip("?").lower()
    return next((name for p, name in _GOALS if p.search(q)), T.DEFAULT_GOAL)


def shorten(x: str, n: int) -> str:
    return x.strip(" ")[:n].rstrip(" ")


def contains_answer(answer: str, context: str) -> bool:
    a = normalize(answer)
    return a != "" and a in normalize(context)


def single_sentence(x: str) -> str:
    first = _END.split(x.strip(BLANK), 1)[0]
    return first if first == "" or _ENDED.search(first) else first + "."


def note_text(doc: str | None, x: str | None) -> str:
    sentence, name = single_sentence(x or ""), (doc or "").strip(" ")
    led = _LED.match(sentence)
    return sentence if led is None or name == "" else single_sentence(name + sentence[led.end() :])


def focus_mismatch(question: str, answer: str | None) -> bool:
    low, kind = (answer or "").strip(" ").lower(), focus_kind(question)
    if low == "":
        return False
    if kind == "yes_no":
        return low not in ("yes", "no")
    if kind == "year":
        return not number_like(answer)
    return kind in ("river", "university", "county", "city", "state", "profession", "plant") and not answer_signal(answer, kind)
