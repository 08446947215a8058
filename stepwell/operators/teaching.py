"""The teacher on one question: its steps over Python lists and strings.

Every rule is the one of `notes`, `support`, `gates`, `selection`, `repair` or `teacher` of the same
name, which are expressions over arrays; a step names their values dozens of times, so that a plan
of them is far longer than what there is to do for a question's few units.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

from ..functions import strings as S
from . import gates, notes, online, repair, selection, support, teacher, trajectories
from .retrieval import FLOOR, K1, B

#: Chunks and units of a retrieval, units shown to a proposer (in a repair), targets shown beside the pool, probes that may fail.
SHORTLIST, RETRIEVED, TOP, REPAIR_TOP, SHOWN_TARGETS, FALSE_STOPS = 8, 10, 3, 5, 2, 2
#: Levels of the mean role score for notes, and the last step of an early bridge.
LATE, EARLY, EARLY_STEP, TRIGGER, SUMMARY_CHARS = 0.50, 0.40, 1, 0.45, 160
CHECK, BRIDGE = "verification_note", "bridge_note"
VERIFY, TELL_APART, JOIN, GENERIC = "answer_focus_verification", "target_type_disambiguation", "bridge_query_entity_to_answer_candidate", "generic_bridge_or_verification"


class Unit(NamedTuple):
    """A unit and what its text shows; ``words`` of the text alone, all else of its document and text."""

    unit: str
    chunk: str
    doc: str | None
    text: str | None
    words: tuple[str, ...]
    bag: frozenset
    whole: str
    place: int


class Note(NamedTuple):
    unit: str
    type: str
    text: str
    sources: list[str]
    priority: int = 1
    closure: int = 0
    answer_facing: bool = False
    mode: str = "normal"
    added_step: int = 0


class Candidate(NamedTuple):
    unit: str
    note: Note | None
    of: Unit | None


def joined(*parts: str | None) -> str:
    return " ".join(p for p in parts if p is not None)


def sentence_number(unit_id: str) -> int:
    """As `notes.sentence_number`."""
    last = unit_id.rsplit("::", 1)[-1].strip(S.BLANK)
    digits = last[1:] if last[:1] in ("-", "+") else last
    ok = digits.isascii() and digits.isdigit() and -(2**31) <= int(last) < 2**31
    return int(last) if ok else 0


def unit_of(u: dict) -> Unit:
    words, whole = S.tokens(u["text"] or ""), joined(u["doc"], u["text"])
    return Unit(u["unit"], u["chunk"], u["doc"], u["text"], words, frozenset(words), whole, sentence_number(u["unit"]))


def first_best(items: list, key: Any) -> Any:
    return max(items, key=key, default=None)  # the first among equals


def rule_note(question: str, gold: str, units: list[tuple[str, str | None, str | None]], is_repair: bool) -> tuple[str, str, list[str]] | None:
    """(type, text, sources) of `notes.rule_notes`; units are (unit, doc, text)."""
    kind, asked, q, g = S.focus_kind(question), S.anchor_set(question), S.normalize(question), S.normalize(gold)
    wholes = [joined(doc, text) for _, doc, text in units]
    places, plain = range(len(units)), [S.normalize(w) for w in wholes]
    hits = [len(S.anchor_set(w) & asked) if any(a in n for a in asked) else 0 for w, n in zip(wholes, plain)]  # an anchor of a text stands in its normal form
    signal = [S.answer_signal(w, kind) for w in wholes]

    def note(of: str, i: int, sources: list[str]) -> tuple[str, str, list[str]] | None:
        ids, text = S.once(s for s in sources if s is not None and s.strip(" ") != ""), S.note_text(units[i][1], units[i][2])
        return (of, text, ids) if S.normalize(text) != "" and 1 <= len(ids) <= teacher.MOST_SOURCES else None

    if g not in ("", "yes", "no"):
        named, bears = [S.normalize(doc or "") == g for _, doc, _ in units], [g in n for n in plain]
        b = first_best([i for i in places if named[i] or bears[i]], lambda i: (named[i], bears[i], hits[i], signal[i], -sentence_number(units[i][0])))
        if b is not None:
            speaks = lambda i: S.normalize(units[i][1] or "") in q
            c = first_best([i for i in places if units[i][0] != units[b][0]], lambda i: (speaks(i), hits[i], signal[i]))
            made = note(CHECK, b, [units[b][0]] + ([units[c][0]] if c is not None and speaks(c) else []))
            if made:
                return made
    words = S.token_set(question)
    b = first_best(list(places), lambda i: (signal[i], hits[i], len(S.token_set(wholes[i]) & words)))
    return None if b is None else note(CHECK if is_repair else BRIDGE, b, [units[b][0]])


def bm25(query: list[str], docs: list[tuple[tuple[str, ...], frozenset]]) -> list[float]:
    """Texts, as their tokens in order and as a set, among themselves for distinct query tokens: scores rounded to 6."""
    n, mean, weights = len(docs), max(sum(len(words) for words, _ in docs) / max(len(docs), 1), FLOOR), []
    for q in query:
        df = 0
        for _, bag in docs:
            if q in bag:
                df += 1
        if df:
            weights.append((q, math.log(1 + (n - df + 0.5) / (df + 0.5))))
    out = []
    for words, bag in docs:
        norm, score = K1 * (1 - B + B * len(words) / mean), 0.0
        for q, idf in weights:
            if q in bag:
                tf = words.count(q)
                score += idf * tf * (K1 + 1) / max(tf + norm, FLOOR)
        out.append(S.rounded(score, 6))
    return out


class Question:
    """A question, what can be read for it, and the state of its teacher."""

    def __init__(self, row: dict) -> None:
        self.qid, self.question, self.gold = row["qid"], row["question"] or "", row["answer"] or ""
        self.targets, self.pool = row["targets"] or [], [unit_of(u) for u in row["pool"] or []]
        self.chunks = [(c["chunk"], c["doc"], c["text"], (S.tokens(c["text"] or ""), S.token_set(c["text"] or ""))) for c in row["chunks"] or []]
        self.units: dict[str, list[Unit]] = {}
        self.of_chunk: dict[str, list[Unit]] = {}
        for u in self.pool:
            self.units.setdefault(u.unit, []).append(u)
            self.of_chunk.setdefault(u.chunk, []).append(u)
        self.texts: dict[str, list[tuple]] = {}
        for c in self.chunks:
            self.texts.setdefault(c[0], []).append(c)
        self.kind, self.asked, self.words, self.yes_no = S.focus_kind(self.question), S.anchor_set(self.question), S.token_set(self.question), S.is_yes_no(self.question)
        self.target_chunks = {t["chunk"] for t in self.targets}
        self.totals = {r: self._sum(t for t in self.targets if t["role"] == r) for r in support.ROLES}
        self.taken = S.once(s for s in row["seeds"] or [] if s in self.units)
        self.raw = [(u, i) for i, u in enumerate(self.taken)]
        self.covered = self.covering(self.taken, [])
        self.notes: list[Note] = []
        self.flags: list[int] = []
        self.probes: list[dict] = []
        self.history: list[list[str]] = []
        self.triggered: list[bool] = []
        self.false_stops = self.cooldown = self.repairs = self.next_note = self.last_delta = 0
        self.last_ratio: float | None = None
        self.notebook = self.rendered(self.raw, self.notes)

    @staticmethod
    def _sum(targets: Any) -> float:
        total = 0.0
        for t in targets:
            total += t["weight"]
        return total

    @staticmethod
    def _mean(scores: list[float]) -> float:
        total = 0.0
        for x in scores:  # sum() would make up for rounding
            total += x
        return total / len(scores) if scores else 0.0

    def read(self, raw: list[tuple[str, int]]) -> list[Unit]:
        return [x for u, _ in raw for x in self.units[u]]

    def seen(self, u: Unit) -> frozenset:
        return S.anchor_set(u.whole)

    def shows(self, u: Unit) -> bool:
        return S.answer_signal(u.whole, self.kind)

    def covering(self, units: list[str], before: list[str]) -> list[str]:
        """The target chunks covered by units beside those before, in the order they came."""
        return S.once([*before, *(c for c in (self.units[i][0].chunk for i in units if i in self.units) if c in self.target_chunks)])

    def rendered(self, raw: list[tuple[str, int]], state_notes: list[Note]) -> str:
        """As `support.rendered`."""
        back = [n for n in state_notes[-online.NOTES_BACK :] if n.type in online.NOTE_TYPES]
        key = lambda p: (p[1].answer_facing, p[1].mode == "repair_after_false_stop", p[1].type == CHECK, p[1].closure, p[1].added_step, -p[0])
        ids = [n.unit for _, n in sorted(enumerate(back), key=key, reverse=True)[: online.NOTES_SHOWN]]
        shown = [next(n for n in state_notes if n.unit == i) for i in ids]
        sources = S.once(s for n in shown for s in n.sources)
        newest = S.once(u for u, _ in sorted(raw, key=lambda r: -r[1]))
        more = [u for u in newest if u not in sources][: max(online.RAW_SHOWN - len(sources), 0)]
        texts = [x for x in (self.units[i][0].text for i in [*sources, *more][: online.RAW_SHOWN] if i in self.units) if x is not None]
        lines = ["Evidence:", *(f"[{i}] {S.shorten(x, online.RAW_CHARS)}" for i, x in enumerate(texts, 1))] if texts else []
        if shown:
            lines += ["", "Notes:", *(f"[{'bridge' if n.type == BRIDGE else 'verification'}] {S.shorten(n.text, online.NOTE_CHARS)}" for n in shown)]
        return "\n".join(lines).strip(" ")

    def sufficient(self, predicted: str | None, notebook: str, units: list[str]) -> bool:
        """Whether the notebook and the chunks of the units support an answer, as `support.probe_support`; the only answer here is the gold one."""
        if predicted is None or not self.targets or self.yes_no:
            return False
        chunks = [c for i in S.once(u.chunk for i in units for u in self.units.get(i, ())) for c in self.texts.get(i, ())]
        read = "\n".join(c[2] or "" for c in chunks)
        visible = S.contains_answer(self.gold, notebook) or S.contains_answer(self.gold, read)
        if not visible:
            return False
        docs, evidence = {(c[1] or "").strip(" ") for c in chunks} - {""}, f"{notebook}\n{read}"
        return all((t["doc"] or "").strip(" ") in docs or (t["text"] is not None and S.contains_answer(t["text"], evidence)) for t in self.targets)

    def answered(self, predicted: str | None, notebook: str, units: list[str]) -> dict:
        """As `support.answered`."""
        enough = self.sufficient(self.gold, notebook, units)
        answer = self.gold if predicted is not None or (enough and S.contains_answer(self.gold, notebook)) else None
        right = answer is not None
        return {"answer": answer, "correct": right, "sufficient": right and enough, "stop": right and enough}

    def closed(self, notebook: str, units: list[str], covered: list[str]) -> bool:
        """As `support.closed`."""
        return (len(self.targets) > 0 and self.target_chunks <= set(covered)) or self.answered(self.gold if self.yes_no else None, notebook, units)["stop"]

    def role_scores(self, covered: list[str]) -> list[float]:
        got = lambda r: self._sum(t for t in self.targets if t["role"] == r and t["chunk"] in covered)
        return [got(r) / max(self.totals[r], 1.0) for r in support.ROLES if self.totals[r] > 0]

    def context_value(self, notebook: str, covered: list[str], state_notes: list[Note]) -> float:
        has = lambda r: all(t["chunk"] in covered for t in self.targets if t["role"] == r)
        visible = S.contains_answer(self.gold, notebook)
        return (visible + (visible and has("support") and (has("bridge") or any(n.type == BRIDGE for n in state_notes))) + has("distinguish")) / 3.0

    def query(self) -> list[str]:
        """The distinct tokens of the question with the newest evidence of a covered target, the newest note, and the need."""
        read = [u.text for u in self.read(self.raw) if u.chunk in self.covered]
        parts = [f"Evidence: {S.shorten(read[-1], 80)}"] if read and read[-1] is not None else []
        parts += [f"Note: {S.shorten(self.notes[-1].text, 70)}"] if self.covered and self.notes else []
        summary = "\n".join([*parts, f"Need: {S.goal(self.question)}"])[:SUMMARY_CHARS].rstrip(" ")
        return S.once(S.tokens(f"{self.question}\n{summary}"))

    def found(self) -> list[Unit]:
        """The best open unit of each of the ``SHORTLIST`` best chunks, best first, then the best units of targets neither covered nor in reach."""
        q, taken = self.query(), set(self.taken)
        text = lambda x: (x is not None, x or "")
        short = sorted(zip(bm25(q, [c[3] for c in self.chunks]), self.chunks), key=lambda s: (-s[0], s[1][0], text(s[1][1]), text(s[1][2])))[:SHORTLIST]
        out = []
        for _, c in short:
            own = self.of_chunk.get(c[0], [])
            if all(u.unit in taken for u in own):
                continue
            scored = [(-s, u.unit, u) for s, u in zip(bm25(q, [(u.words, u.bag) for u in own]), own) if u.unit not in taken]
            out.append(min(scored, key=lambda s: (s[0], s[1], text(s[2].doc), text(s[2].text))))
        out.sort(key=lambda s: (s[0], s[1]))
        found = [u for _, _, u in out[:RETRIEVED]]
        best = []
        for t in self.targets:
            if t["chunk"] not in self.covered and t["chunk"] in self.of_chunk:
                best.append(max((self.shows(u), len(self.seen(u) & self.asked), len(S.token_set(u.whole) & self.words), -u.place, u.unit) for u in self.of_chunk[t["chunk"]])[-1])
        known = {u.unit for u in found} | taken
        return found + [u for i in [i for i in S.once(best) if i not in known][:SHOWN_TARGETS] for u in self.units[i]]

    def value(self, text: str, kind: str, goal: str, sources: int) -> int:
        """As `gates.note_value`."""
        fits = (goal in (VERIFY, TELL_APART) and kind == CHECK) or (goal == JOIN and kind == BRIDGE)
        low = text.lower()
        value = (4 if fits else 2 if kind == CHECK else 1) + 3 * S.answer_signal(text, self.kind) + min(2, len(self.asked & S.anchor_set(text)))
        return value + 3 * S.contains_answer(self.gold, text) + 2 * (goal == JOIN and sources >= 2) - 2 * ("need to" in low or "insufficient" in low)

    def faults(self, note: Note, visible: list[str]) -> list[str]:
        """As `notes.judged` of one note."""
        bare = S.normalize(note.text)
        same = lambda x: x == bare or S.jaccard(S.token_set(x), S.token_set(bare)) > teacher.DUPLICATE
        rules = {
            "duplicate_with_state": any(same(S.normalize(n.text)) for n in self.notes), "empty_text": bare == "", "invisible_source_ids": not set(note.sources) <= set(visible),
            "not_single_sentence": S.sentence_count(note.text) != 1, "too_long": S.token_count(note.text) > teacher.MOST_TOKENS,
        }
        return [k for k, v in rules.items() if v]

    def influence(self, c: Candidate, profiles: list[dict], error: str | None, goal: str) -> float:
        """The bonus of `notes.influence`."""
        text, kind = (c.note.text, c.note.type) if c.note else (c.of.whole, None)
        own, signal, sources = S.anchor_set(text), S.answer_signal(text, self.kind), set(c.note.sources) if c.note else {c.unit}
        facing, bonus = c.note is not None and c.note.answer_facing, 0.0
        for p in profiles:
            told = {
                "shares_source_with_repair_note": bool(sources & p["sources"]), "shares_bridge_anchor": bool(own & p["anchors"]), "same_doc_as_repair_source": c.of is not None and (c.of.doc or "") != "" and c.of.doc in p["docs"],
                "matches_answer_type_fix": signal and (p["focus"] or p["answer_facing"] or goal in (VERIFY, TELL_APART)), "supports_recent_false_stop_correction": error in repair.FALSE_STOP_ERRORS and (signal or kind == CHECK or facing),
                "extends_answer_facing_chain": facing or (c.note is not None and c.note.closure > 0), "bridge_to_answer_candidate": goal == JOIN and kind == BRIDGE, "supports_answer_type_fix": goal == TELL_APART and kind == CHECK,
                "answer_focus_verification": goal == VERIFY and (kind == CHECK or signal),
            }
            for k, weight in repair.INFLUENCE.items():
                bonus += weight if told[k] else 0.0
        return S.rounded(bonus, 9)

    def penalty(self, c: Candidate, recent: list[Unit], ratio: float | None) -> float:
        """As `gates.repeat_penalty`."""
        recent, alone = recent[-2:], c.of is None
        if not recent:
            return 0.0
        text = c.note.text if alone else c.of.text
        bag = None if text is None else S.token_set(text)
        same_doc = sum(not alone and r.doc is not None and r.doc == c.of.doc for r in recent)
        alike = sum(bag is not None and r.text is not None and S.jaccard(r.bag, bag) >= gates.NEAR_COPY for r in recent)
        whole = gates.REPEATS["same_doc"] * same_doc + gates.REPEATS["near_copy"] * alike
        if len(self.flags) >= gates.STALL_WINDOW and not any(self.flags[-gates.STALL_WINDOW :]):
            often, extra = ratio is not None and ratio >= gates.REPEAT_RATIO, gates.STALLED_REPEATS
            whole += (extra["same_unit"] if any(r.unit == c.unit for r in recent) else 0.0) + (extra["same_parent"] if not alone and any(r.chunk == c.of.chunk for r in recent) else 0.0) + (extra["same_doc"] if often and same_doc else 0.0)
        return S.rounded(whole * (gates.AFTER_NO_PROGRESS if self.flags and self.flags[-1] == 0 else 1.0), 9)

    def continues(self, needs_note: bool, false_stop: bool, ratio: float | None, stop_candidate: bool) -> bool:
        """As `repair.continues_repair`."""
        stuck = false_stop and self.last_delta == 0 and ratio is not None and ratio >= repair.REPEAT_RATIO
        return self.repairs < repair.MOST_REPAIRS and not needs_note and stuck and any(self.triggered[-2:]) and (stop_candidate or self.cooldown > 0)

    def taking(self, c: Candidate, raw: list, state_notes: list) -> tuple[list, list]:
        """The raw units and notes after a candidate is taken."""
        step = len(self.taken)
        if c.note is None:
            return (raw if any(u == c.unit for u, _ in raw) else [*raw, (c.unit, step)]), state_notes
        return raw, (state_notes if any(n.unit == c.unit for n in state_notes) else [*state_notes, c.note._replace(added_step=step)])

    def step(self, t: int, most_steps: int) -> dict:
        """One step: its row; the state goes on where ``status`` is null."""
        self.cooldown = max(self.cooldown - 1, 0)
        found = self.found()
        found_ids = [u.unit for u in found]
        before = [set(h) for h in self.history[-2:] if h]
        ids = set(found_ids)
        ratio = max(len(ids & h) / len(ids | h) for h in before) if before and ids else None
        effective = self.last_ratio if ratio is None else ratio
        recent_false = any(not p["stop"] for p in self.probes[-2:])
        stagnation = self.last_delta == 0 and effective is not None and effective >= repair.REPEAT_RATIO
        mismatch = bool(self.probes) and S.focus_mismatch(self.question, self.probes[-1]["answer"])
        scores = self.role_scores(self.covered)
        level = self._mean(scores)
        kinds, idle = [n.type for n in self.notes[-2:]], bool(self.flags) and self.flags[-1] == 0
        recent, state_anchors = self.read(self.raw[-2:]), frozenset().union(*(self.seen(u) for u in self.read(self.raw[-3:])))
        redundant = sum(any(S.jaccard(u.bag, r.bag) >= teacher.REDUNDANT for r in recent[-2:]) for u in found[:3]) >= 2
        no_note = CHECK in kinds or (redundant and BRIDGE in kinds)
        complete = all(s >= teacher.COMPLETE for s in scores)
        candidate = complete and (no_note or (idle and bool(scores) and all(s >= teacher.NEAR_COMPLETE for s in scores)))
        ps = [(self.seen(u), self.shows(u)) for u in found[:REPAIR_TOP]]
        touch = lambda x: bool(x[0] & self.asked)
        bridgeable = any(
            (x[0] & y[0] or (x[0] | y[0]) & state_anchors) and (touch(x) or touch(y)) and (x[1] or y[1]) for i, x in enumerate(ps[:TOP]) for y in ps[i + 1 : TOP]
        )
        ready = any(touch(x) and x[1] for x in ps)
        gap = len(ps) >= 2 and any(touch(x) and not x[1] for x in ps) and any(x[1] and not touch(x) for x in ps) and any(x[0] & state_anchors or any(x[0] & y[0] for y in ps[i + 1 :]) for i, x in enumerate(ps))
        failed_before = recent_false or stagnation or mismatch
        usable: list[Unit] = []
        for u in found[:3]:
            if all(S.jaccard(k.bag, u.bag) < selection.SIMILAR for k in usable):
                usable.append(u)
        composable = len(usable) >= 2 and len({u.chunk for u in usable if u.chunk}) >= 2
        touches, signal = any(touch(x) for x in ps[:TOP]), any(x[1] for x in ps[:TOP])
        goal = VERIFY if mismatch else JOIN if bridgeable and touches and signal else TELL_APART if self.kind not in ("generic", "yes_no") and not signal else GENERIC
        late = bridgeable and level >= LATE and failed_before and (ready or mismatch)
        early = t <= EARLY_STEP and bridgeable and level >= EARLY and not ready and gap
        wanted = level >= teacher.SEMANTIC and bridgeable and (CHECK not in kinds or failed_before) and level >= TRIGGER
        subtype = "late_verification" if (recent_false and stagnation) or late else "early_bridge" if early else "trigger_only_candidate" if wanted else None
        if subtype == "late_verification":
            goal = goal if goal in (VERIFY, TELL_APART) else VERIFY
        elif subtype == "early_bridge":
            goal = JOIN
        legacy = level >= teacher.SEMANTIC and composable and (CHECK not in kinds or idle)
        active = subtype if legacy and subtype in ("late_verification", "early_bridge") else None
        forced = self.continues(active is not None, recent_false, effective, candidate)
        can_probe = candidate and self.cooldown == 0 and self.false_stops < FALSE_STOPS
        probe = self.answered(None, self.notebook, self.taken) if can_probe else None
        stops = probe is not None and probe["stop"]
        failed = can_probe and not stops
        in_repair = (failed and self.continues(False, True, effective, candidate)) if can_probe else forced
        propose = not stops and (in_repair if can_probe else forced or (not candidate and active is not None))
        own = "late_verification" if in_repair else active
        harvest, faults, kept = 0, [], []
        if propose:
            most = REPAIR_TOP if in_repair else TOP
            tops = S.once([*(u for u, _ in self.raw[-3:] if in_repair), *found_ids[:most]])
            top = [u for i in tops for u in self.units[i]][:most]
            made = rule_note(self.question, self.gold, [(u.unit, u.doc, u.text) for u in top], in_repair)
            if made and made[1].strip(" ") != "":
                kind = {"late_verification": CHECK, "early_bridge": BRIDGE}.get(own, made[0])
                note = Note(f"{self.qid}::derived::{self.next_note}", kind, made[1].strip(" "), made[2])
                harvest, faults = 1, self.faults(note, [*found_ids, *(u for u, _ in self.raw)])
                if not faults and own is not None:
                    value = self.value(note.text, kind, goal, len(note.sources))
                    kept = [note._replace(closure=value, answer_facing=value >= 5, mode="repair_after_false_stop" if in_repair else "normal")]
        row = {"qid": self.qid, "t": t, "found": found_ids, "kept": [n.unit for n in kept], "made": harvest, "faults": faults, "stop_candidate": candidate, "proposed": propose, "subtype": own, "goal": goal, "ratio": ratio, "probe": probe}
        cands = [] if stops else [*(Candidate(u.unit, None, u) for u in found), *(Candidate(n.unit, n, None) for n in kept)]
        chosen = self.chosen(cands, kept, recent, ratio, goal, (in_repair or forced) and len(kept) > 0)
        return row | self.written(t, most_steps, chosen, stops, failed, in_repair, probe, found_ids, harvest, ratio, propose and (active is not None or in_repair or forced))

    def chosen(self, cands: list[Candidate], kept: list[Note], recent: list[Unit], ratio: float | None, goal: str, biased: bool) -> tuple[float, Candidate] | None:
        """The candidate of greatest value with it; the order among equals is the one of the states."""
        error, profiles = None, []
        if biased:
            last = self.probes[-1] if self.probes else None
            error = None if last is None else "missing_pred_answer" if last["answer"] is None else "support_insufficient" if not last["sufficient"] else "false_stop" if not last["stop"] else "unknown"
            for n in kept:
                read = [u for u in self.pool if u.unit in n.sources]
                text = joined(n.text, " ".join(u.whole for u in read))
                profiles.append({"sources": set(n.sources), "docs": {u.doc for u in read}, "anchors": S.anchor_set(text), "answer_facing": n.answer_facing, "focus": S.answer_signal(text, self.kind)})
        before, best = None, None
        for i, c in enumerate(cands):
            if before is None:
                before = self.context_value(self.notebook, self.covered, self.notes)
            new = [] if c.note else [x for x in self.targets if x["chunk"] == c.of.chunk and x["chunk"] not in self.covered][:1]
            raw, state_notes = self.taking(c, self.raw, self.notes)
            after = self.context_value(self.rendered(raw, state_notes), [*self.covered, *(x["chunk"] for x in new)], state_notes)
            gain = 0.0
            for x in new:
                total = self.totals[x["role"]] if x["role"] in self.totals else self._sum(y for y in self.targets if x["role"] is not None and y["role"] == x["role"])
                gain += x["weight"] / (total + 2 * trajectories.ALPHA) if total > 0 else 0.0
            cost = (1.15 if c.note.type == BRIDGE else 1.20) if c.note else 1.0
            score = (gain + support.CONTEXT_WEIGHT * (after - before)) / cost - support.REPEAT_WEIGHT * self.penalty(c, recent, ratio) + support.PLACE_WEIGHT * (len(cands) - i)
            score = S.rounded(score + (support.UNCOVERED_BONUS if new else 0.0) + (self.influence(c, profiles, error, goal) if biased else 0.0), 9)
            n = c.note
            key = (-score, n is not None, not (n and n.answer_facing), -n.closure if n else 0, cost, -n.priority if n else 0, c.unit)
            if best is None or key < best[0]:
                best = (key, score, c)
        return best and best[1:]

    def written(self, t: int, most_steps: int, chosen: tuple[float, Candidate] | None, stops: bool, failed: bool, in_repair: bool, probe: dict | None, found_ids: list[str], harvest: int, ratio: float | None, control: bool) -> dict:
        """The state after a step, and how the question ends with it if it does."""
        ends, before = t + 1 >= most_steps, len(self.covered)
        is_note = False
        if chosen:
            c = chosen[1]
            is_note = c.note is not None
            self.raw, self.notes = self.taking(c, self.raw, self.notes)
            self.taken = self.taken if c.unit in self.taken else [*self.taken, c.unit]
            self.covered = self.covered if is_note else self.covering([c.unit], self.covered)
        self.notebook = self.rendered(self.raw, self.notes)
        delta = len(self.covered) - before
        progress = int(delta > 0 or is_note)
        self.flags = [*self.flags, progress][-teacher.STALL_WINDOW :] if chosen else self.flags
        self.false_stops += failed
        streak = len(self.flags) == teacher.STALL_WINDOW and not any(self.flags)
        patient = in_repair and progress == 0
        tried = chosen is not None and (all(s >= teacher.COMPLETE for s in self.role_scores(self.covered)) or streak or ends)
        status, at, reason = None, None, None
        if stops:
            status, at = "terminal", t
        elif chosen is None:
            status, reason = "abort", "empty_candidate_pool"
        elif tried and self.closed(self.notebook, self.taken, self.covered):
            status, at = "terminal", t + 1
        elif not patient and streak:
            status, reason = "abort", "repeated_false_stop_no_progress" if self.false_stops >= FALSE_STOPS else "stalled"
        elif ends:
            status, reason = "abort", "max_steps"
        self.cooldown = 1 if failed else self.cooldown
        self.probes = [*self.probes, probe][-2:] if probe is not None else self.probes
        self.history, self.triggered = [*self.history, found_ids][-2:], [*self.triggered, control][-2:]
        self.repairs, self.next_note, self.last_delta, self.last_ratio = self.repairs + in_repair, self.next_note + harvest, delta, ratio
        return {
            "unit": chosen[1].unit if chosen else None, "is_note": is_note if chosen else None, "gain": chosen[0] if chosen else None, "delta": delta, "covered": len(self.covered), "progress": progress, "false_stops": self.false_stops,
            "notebook": self.notebook, "status": status, "terminal_t": at, "reason": reason,
        }


def taught(row: dict, most_steps: int) -> list[dict]:
    """A question's rows: one for every step, or one where its first state closes it."""
    q = Question(row)
    if q.closed(q.notebook, q.taken, q.covered):
        return [{"qid": q.qid, "covered": len(q.covered), "false_stops": 0, "notebook": q.notebook, "status": "terminal", "terminal_t": 0}]
    out = []
    for t in range(most_steps):
        out.append(q.step(t, most_steps))
        if out[-1]["status"] is not None:
            break
    return out
