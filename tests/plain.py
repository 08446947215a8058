"""Plain Python versions of text rules and of the teacher, for comparison on small tables."""

from __future__ import annotations

import math
import re
from collections import Counter

from stepwell.functions import text as T
from stepwell.operators import gates, repair, support, teacher

QUOTES = "[\"'“”‘’`.,;:!?()\\[\\]{}]"


def normalize(x):
    return re.sub(r"\s+", " ", re.sub(QUOTES, "", re.sub(r"\s+", " ", (x or "").lower().strip()))).strip()


def tokens(x):
    return re.findall("[a-z0-9]+", (x or "").lower())


def once(items):
    return list(dict.fromkeys(items))


def anchors(x):
    out = []
    for phrase in once(re.findall(r"[A-Z][A-Za-z0-9'&().-]+(?:\s+[A-Z][A-Za-z0-9'&().-]+)*", x)):
        out += [p for p in [normalize(phrase)] if p] + [t for t in tokens(phrase) if len(t) >= 3 and t not in T.ANCHOR_STOPWORDS]
    return once(out + [t for t in tokens(x) if len(t) >= 4 and t not in T.ANCHOR_STOPWORDS])


def yes_no(q):
    return bool(re.match(f"({'|'.join(T.AUXILIARIES)}) ", q.strip().lower()))


def kind_of(q):
    low = q.strip().lower()
    if yes_no(q):
        return "yes_no"
    for kind in ("river", "university", "county", "city", "state"):
        if re.search(rf"\b(what|which)\s+{kind}\b", low):
            return kind
    if re.search(r"\b(what|which)\s+year\b", low) or low.startswith("when "):
        return "year"
    return "person" if low.startswith("who ") else "generic"


def signal(x, kind):
    if kind in gates.SIGNAL_PATTERNS:
        return bool(re.search(gates.SIGNAL_PATTERNS[kind], x.lower()))
    return kind in gates.SIGNAL_TERMS and any(t in x.lower() for t in gates.SIGNAL_TERMS[kind])


def sentence(x):
    first = re.split(r"(?<=[.!?])\s+", (x or "").strip(), maxsplit=1)[0]
    return first if not first or first[-1] in ".!?" else first + "."


def note_text(doc, x):
    s, doc = sentence(x), (doc or "").strip()
    m = re.match(rf"({'|'.join(T.PRONOUNS)})\b", s, re.I)
    return sentence(doc + s[m.end() :]) if m and doc else s


def jaccard(a, b):
    a, b = set(tokens(a)), set(tokens(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def contains(answer, context):
    return bool(normalize(answer)) and normalize(answer) in normalize(context)


def numbers(x):
    return re.findall(r"\d+(?:[./:-]\d+)*", x)


def number_like(x):
    return bool(re.search(r"\d", x)) or any(m in x.lower() for m in T.MONTHS)


def correct(gold, probe):
    return probe is not None and (normalize(gold) == normalize(probe) or bool(numbers(gold) and numbers(gold) == numbers(probe)))


def first_best(items, key):
    best = None
    for x in items:
        if best is None or key(x) > key(best):
            best = x
    return best


def place(unit):
    last = unit.split("::")[-1]
    return int(last) if re.fullmatch(r"-?\d+", last) else 0


def whole(u):
    return f"{u['doc']} {u['text']}"


def rule_note(question, gold, units, is_repair):
    kind, asked, words = kind_of(question), set(anchors(question)), set(tokens(question))
    hits = lambda u: len(set(anchors(whole(u))) & asked)
    sig = lambda u: signal(whole(u), kind)
    g = normalize(gold)
    if g not in ("", "yes", "no"):
        named = lambda u: normalize(u["doc"]) == g
        b = first_best([u for u in units if named(u) or g in normalize(whole(u))], lambda u: (named(u), g in normalize(whole(u)), hits(u), sig(u), -place(u["unit"])))
        if b and normalize(note_text(b["doc"], b["text"])):
            speaks = lambda u: normalize(u["doc"]) in normalize(question)
            c = first_best([u for u in units if u["unit"] != b["unit"]], lambda u: (speaks(u), hits(u), sig(u)))
            return {"type": "verification_note", "text": note_text(b["doc"], b["text"]), "sources": [b["unit"]] + ([c["unit"]] if c and speaks(c) else []), "priority": 1}
    b = first_best(units, lambda u: (sig(u), hits(u), len(set(tokens(whole(u))) & words)))
    if b and normalize(note_text(b["doc"], b["text"])):
        return {"type": "verification_note" if is_repair else "bridge_note", "text": note_text(b["doc"], b["text"]), "sources": [b["unit"]], "priority": 1}
    return None


def support_of(question, gold, predicted, notebook, chunks, targets):
    """(rule, sufficient, reasons)"""
    read = "\n".join(c["text"] for c in chunks)
    docs = {c["doc"] for c in chunks if c["doc"]}
    visible = contains(gold, notebook) or contains(gold, read)
    missing = [t["chunk"].split("::")[-1] for t in targets if not ((t["doc"] and t["doc"] in docs) or contains(t["text"], f"{notebook}\n{read}"))]
    if predicted is None:
        return "insufficient", False, ["missing_pred_answer"]
    if not targets:
        return "insufficient", False, ["missing_multihop_evidence"]
    if yes_no(question):
        return ("insufficient", False, once(["yes_no_missing_one_entity_support", *missing])) if missing else ("requires_llm_judge", False, [])
    why = ["missing_multihop_evidence", *missing] if missing else []
    if not visible and (number_like(gold) or len(targets) <= 1):
        why.append("gold_answer_not_supported_by_chunks")
    if why:
        return "insufficient", False, once(why)
    if visible and len(targets) == 1:
        return "explicit_answer_in_evidence", True, []
    if visible and correct(gold, predicted):
        return "multi_hop_answer_in_evidence", True, []
    return "requires_llm_judge", False, []


def probe_of(question, gold, predicted, notebook, chunks, targets):
    answer = predicted
    if contains(gold, notebook) and predicted is None and support_of(question, gold, gold, notebook, chunks, targets)[1]:
        answer = gold
    right = correct(gold, answer)
    enough = support_of(question, gold, answer, notebook, chunks, targets)[1]
    return {"answer": answer, "correct": right, "sufficient": enough, "stop": answer is not None and right and enough}


def cut(x, n):
    return (x or "").strip()[:n].rstrip()


def active(state_notes):
    back = state_notes[-6:]
    if back:
        key = lambda p: (p[1]["force"], p[1]["answer_facing"], p[1]["mode"] == "repair_after_false_stop", p[1]["bucket"] == "final", p[1]["type"] == "verification_note", p[1]["closure"], p[1]["added_step"], -p[0])
        return [n for _, n in sorted(enumerate(back), key=key, reverse=True)[:2]]
    return []


def rendered(raw, state_notes, registry):
    shown = active(state_notes)
    ids = once(s for n in shown for s in n["sources"])
    for unit, _ in sorted(raw, key=lambda r: -r[1]):
        if len(ids) >= 4:
            break
        if unit not in ids:
            ids.append(unit)
    texts = [registry[i]["text"] for i in ids[:4] if i in registry]
    lines = (["Evidence:"] + [f"[{i}] {cut(x, 400)}" for i, x in enumerate(texts, 1)]) if texts else []
    if shown:
        lines += ["", "Notes:"] + [f"[{'bridge' if n['type'] == 'bridge_note' else 'verification'}] {cut(n['text'], 160)}" for n in shown[:2]]
    return "\n".join(lines).strip()


def bm25(query, docs):
    n, mean = len(docs), max(sum(map(len, docs)) / max(1, len(docs)), 1e-12)
    terms = {q: sum(q in d for d in docs) for q in once(query)}
    idf = {q: math.log(1 + (n - df + 0.5) / (df + 0.5)) for q, df in terms.items() if df}
    return [round(sum(w * d.count(q) * 2.5 / max(d.count(q) + 1.5 * (1 - 0.75 + 0.75 * len(d) / mean), 1e-12) for q, w in idf.items()), 6) for d in docs]


def found_for(query, pool, chunks, taken):
    q = tokens(query)
    short = sorted(zip([-s for s in bm25(q, [tokens(c["text"]) for c in chunks])], [c["chunk"] for c in chunks]))[:8]
    out = []
    for _, chunk in short:
        own = [u for u in pool if u["chunk"] == chunk]
        scored = sorted((-s, u["unit"]) for s, u in zip(bm25(q, [tokens(u["text"]) for u in own]), own) if u["unit"] not in taken)
        out += scored[:1]
    return [i for _, i in sorted(out)[:10]]


def goal_of(question):
    low = question.strip().rstrip("?").lower()
    return next((name for pattern, name in T.GOALS if re.search(pattern, low)), T.DEFAULT_GOAL)


def share_scores(targets, covered):
    out = []
    for r in support.ROLES:
        total = sum(t["weight"] for t in targets if t["role"] == r)
        if total > 0:
            out.append(sum(t["weight"] for t in targets if t["role"] == r and t["chunk"] in covered) / max(total, 1.0))
    return out


def context_value(gold, notebook, targets, covered, bridged):
    has = lambda r: all(t["chunk"] in covered for t in targets if t["role"] == r)
    visible = contains(gold, notebook)
    return (visible + (visible and has("support") and (has("bridge") or bridged)) + has("distinguish")) / 3


def covered_by(units, before, registry, targets):
    return once([*before, *(registry[u]["chunk"] for u in units if registry[u]["chunk"] in {t["chunk"] for t in targets})])


def faults_of(note, visible, existing, accepted):
    same = lambda a, b: normalize(a) == normalize(b) or jaccard(normalize(a), normalize(b)) > teacher.DUPLICATE
    n = [p for p in re.split("[.!?]+", note["text"].strip()) if p.strip()]
    rules = {
        "duplicate_with_state": any(same(x, note["text"]) for x in existing), "duplicate_in_harvest": any(same(x, note["text"]) for x in accepted), "empty_text": not normalize(note["text"]), "invisible_source_ids": not set(note["sources"]) <= set(visible),
        "not_single_sentence": (max(1, len(n)) if note["text"].strip() else 0) != 1, "too_long": len(re.findall("[A-Za-z0-9]+", note["text"])) > teacher.MOST_TOKENS,
    }
    return sorted(k for k, v in rules.items() if v)


def note_value(n, question, gold, goal):
    kind = n["type"]
    fits = (goal in ("answer_focus_verification", "target_type_disambiguation") and kind == "verification_note") or (goal == "bridge_query_entity_to_answer_candidate" and kind == "bridge_note")
    value = 4 if fits else 2 if kind == "verification_note" else 1
    value += 3 * signal(n["text"], kind_of(question)) + min(2, len(set(anchors(question)) & set(anchors(n["text"])))) + 3 * contains(gold, n["text"])
    return value + 2 * (goal == "bridge_query_entity_to_answer_candidate" and len(n["sources"]) >= 2) - 2 * bool(re.search("need to|insufficient", n["text"].lower()))


def influence_of(c, kept, registry, question, error, goal):
    bonus, kind = 0.0, kind_of(question)
    own, own_signal = set(anchors(f"{c.get('doc') or ''} {c['text']}")), signal(f"{c.get('doc') or ''} {c['text']}", kind)
    sources = set(c["sources"]) if c["is_note"] else {c["unit"]}
    for n in kept:
        read = [registry[s] for s in registry if s in n["sources"]]
        text = " ".join([n["text"], " ".join(whole(u) for u in read)])
        told = {
            "shares_source_with_repair_note": bool(sources & set(n["sources"])), "shares_bridge_anchor": bool(own & set(anchors(text))), "same_doc_as_repair_source": not c["is_note"] and bool(c["doc"]) and c["doc"] in [u["doc"] for u in read],
            "matches_answer_type_fix": own_signal and (signal(text, kind) or n["answer_facing"] or goal in ("answer_focus_verification", "target_type_disambiguation")),
            "supports_recent_false_stop_correction": error in repair.FALSE_STOP_ERRORS and (own_signal or c["type"] == "verification_note" or c["answer_facing"]), "extends_answer_facing_chain": c["answer_facing"] or (c["is_note"] and c["closure"] > 0),
            "bridge_to_answer_candidate": goal == "bridge_query_entity_to_answer_candidate" and c["type"] == "bridge_note", "supports_answer_type_fix": goal == "target_type_disambiguation" and c["type"] == "verification_note",
            "answer_focus_verification": goal == "answer_focus_verification" and (c["type"] == "verification_note" or own_signal),
        }
        bonus += sum(repair.INFLUENCE[k] for k, v in told.items() if v)
    return round(bonus, 9)


def teach(q, most_steps=8):
    """The steps of one question: tuples of (t, unit, gain, found, kept, stop_candidate, delta, progress, false_stops, status, terminal_t, reason)."""
    question, gold, pool, chunks, targets = q["question"] or "", q["answer"] or "", q["pool"] or [], q["chunks"] or [], q["targets"] or []
    registry, kind, asked = {u["unit"]: u for u in pool}, kind_of(question), set(anchors(question))
    taken = once(s for s in q["seeds"] or [] if s in registry)
    raw, state_notes = [(u, i) for i, u in enumerate(taken)], []
    covered, book = covered_by(taken, [], registry, targets), rendered([(u, i) for i, u in enumerate(taken)], [], registry)
    flags, probes, history, triggered = [], [], [], []
    false_stops = cooldown = repairs = next_note = last_delta = 0
    last_ratio = None

    def selected(units):
        ids = once(registry[u]["chunk"] for u in units if u in registry)
        return [c for i in ids for c in chunks if c["chunk"] == i]

    def closes(notebook, units, cov):
        if targets and {t["chunk"] for t in targets} <= set(cov):
            return True
        return probe_of(question, gold, gold if yes_no(question) else None, notebook, selected(units), targets)["stop"]

    out = []
    if closes(book, taken, covered):
        return [(None, None, None, None, None, None, None, None, 0, "terminal", 0, None)]
    for t in range(most_steps):
        cooldown = max(0, cooldown - 1)
        read = [registry[u]["text"] for u, _ in raw if u in registry and registry[u]["chunk"] in covered]
        parts = ([f"Evidence: {cut(read[-1], 80)}"] if read else []) + ([f"Note: {cut(state_notes[-1]['text'], 70)}"] if covered and state_notes else []) + [f"Need: {goal_of(question)}"]
        found = found_for(question + "\n" + "\n".join(parts)[:160].rstrip(), pool, chunks, taken)
        shown = []
        for x in targets:
            if x["chunk"] not in covered:
                b = max((u for u in pool if u["chunk"] == x["chunk"]), key=lambda u: (signal(whole(u), kind), len(set(anchors(whole(u))) & asked), len(set(tokens(whole(u))) & set(tokens(question))), -place(u["unit"]), u["unit"]), default=None)
                if b and b["unit"] not in (*shown, *found, *taken):
                    shown.append(b["unit"])
        found += shown[:2]
        before = [h for h in history[-2:] if h]
        ratio = max(len(set(found) & set(h)) / len(set(found) | set(h)) for h in before) if before and found else None
        effective = ratio if ratio is not None else last_ratio
        recent_false, stagnation = any(not p["stop"] for p in probes[-2:]), last_delta == 0 and effective is not None and effective >= 0.6
        mismatch = False  # an offline probe answers with the gold answer or not at all
        if probes and probes[-1]["answer"]:
            a = probes[-1]["answer"]
            mismatch = (kind == "yes_no" and a.strip().lower() not in ("yes", "no")) or (kind == "year" and not number_like(a)) or (kind in ("river", "university", "county", "city", "state", "profession", "plant") and not signal(a, kind))
        scores = share_scores(targets, covered)
        level = sum(scores) / len(scores) if scores else 0.0
        recent = [registry[u] for u, _ in raw[-2:]]
        state_anchors = {a for u, _ in raw[-3:] for a in anchors(whole(registry[u]))}
        kinds, idle = [n["type"] for n in state_notes[-2:]], bool(flags) and flags[-1] == 0
        top = [registry[i] for i in found]
        redundant = sum(any(jaccard(u["text"], r["text"]) >= 0.9 for r in recent) for u in top[:3]) >= 2
        no_note = "verification_note" in kinds or (redundant and "bridge_note" in kinds)
        candidate = all(s >= 0.7 for s in scores) and (no_note or (idle and bool(scores) and all(s >= 0.55 for s in scores)))
        profile = lambda u: (set(anchors(whole(u))), signal(whole(u), kind))
        ps = [profile(u) for u in top[:5]]
        linked = lambda x, y: bool((x[0] & y[0]) or (x[0] | y[0]) & state_anchors)
        pairs = lambda k: [(x, y) for i, x in enumerate(ps[:k]) for y in ps[:k][i + 1 :]]
        bridgeable = any(linked(x, y) and (x[0] | y[0]) & asked and (x[1] or y[1]) for x, y in pairs(3))
        ready = any(x[0] & asked and x[1] for x in ps)
        gap = len(ps) >= 2 and any(x[0] & asked and not x[1] for x in ps) and any(x[1] and not x[0] & asked for x in ps) and any(linked(x, y) for x, y in pairs(5))
        failed_before = recent_false or stagnation or mismatch
        usable = []
        for u in top[:3]:
            if all(jaccard(u["text"], v["text"]) < 0.85 for v in usable):
                usable.append(u)
        composable = len(usable) >= 2 and len({u["chunk"] for u in usable if u["chunk"]}) >= 2
        touches, has_signal = any(x[0] & asked for x in ps[:3]), any(x[1] for x in ps[:3])
        goal = "answer_focus_verification" if mismatch else "bridge_query_entity_to_answer_candidate" if bridgeable and touches and has_signal else "target_type_disambiguation" if kind not in ("generic", "yes_no") and not has_signal else "generic_bridge_or_verification"
        late = bridgeable and level >= 0.5 and failed_before and (ready or mismatch)
        early = t <= 1 and bridgeable and level >= 0.4 and not ready and gap
        trigger = level >= 0.5 and bridgeable and ("verification_note" not in kinds or failed_before)
        subtype = "late_verification" if (recent_false and stagnation) or late else "early_bridge" if early else "trigger_only_candidate" if trigger else None
        if subtype == "late_verification":
            goal = goal if goal in ("answer_focus_verification", "target_type_disambiguation") else "answer_focus_verification"
        elif subtype == "early_bridge":
            goal = "bridge_query_entity_to_answer_candidate"
        legacy = level >= 0.5 and composable and ("verification_note" not in kinds or idle)
        mine = subtype if legacy and subtype in ("late_verification", "early_bridge") else None
        goes_on = lambda need, false: repairs < 2 and not need and false and last_delta == 0 and effective is not None and effective >= 0.6 and any(triggered[-2:]) and (candidate or cooldown > 0)
        forced = goes_on(mine is not None, recent_false)
        can_probe = candidate and cooldown == 0 and false_stops < 2
        probe = probe_of(question, gold, None, book, selected(taken), targets) if can_probe else None
        if probe and probe["stop"]:
            out.append((t, None, None, found, [], candidate, 0, 0, false_stops, "terminal", t, None))
            return out
        in_repair = goes_on(False, True) if can_probe else forced
        propose = in_repair if can_probe else True if forced else (not candidate and mine is not None)
        own = "late_verification" if in_repair else mine
        error = None
        if probes:
            error = "missing_pred_answer" if probes[-1]["answer"] is None else "support_insufficient" if not probes[-1]["sufficient"] else "false_stop"
        kept = []
        if propose:
            limit = 5 if in_repair else 3
            ids = once(([u for u, _ in raw[-3:]] if in_repair else []) + found[:limit])[:limit]
            note = rule_note(question, gold, [registry[i] for i in ids], in_repair)
            if note:
                note = {**note, "unit": f"{q['qid']}::derived::{next_note}", "type": {"late_verification": "verification_note", "early_bridge": "bridge_note"}.get(own, note["type"])}
                next_note += 1
                if not faults_of(note, [*found, *(u for u, _ in raw)], [n["text"] for n in state_notes], []):
                    value = note_value(note, question, gold, goal)
                    kept = [{**note, "closure": value, "answer_facing": value >= 5}] if in_repair or own in ("late_verification", "early_bridge") else []
        mode = "repair_after_false_stop" if in_repair else "normal"
        cands = [{**registry[i], "is_note": False, "type": None, "sources": [], "priority": 0, "closure": 0, "answer_facing": False} for i in found]
        cands += [{**n, "is_note": True, "chunk": None, "doc": None} for n in kept]
        false_stops += probe is not None
        if not cands:
            out.append((t, None, None, found, [], candidate, 0, 0, false_stops, "abort", None, "empty_candidate_pool"))
            return out
        as_note = lambda c: {**c, "added_step": len(taken), "force": False, "mode": mode, "bucket": "final"}

        def score(c, i):
            raw_u = raw if c["is_note"] or c["unit"] in [u for u, _ in raw] else [*raw, (c["unit"], len(taken))]
            notes_u = [*state_notes, as_note(c)] if c["is_note"] else state_notes
            new = [x for x in targets if not c["is_note"] and x["chunk"] == c["chunk"] and x["chunk"] not in covered][:1]
            gain = sum(x["weight"] / (sum(y["weight"] for y in targets if y["role"] == x["role"]) + 2) for x in new)
            bridged = lambda ns: any(n["type"] == "bridge_note" for n in ns)
            ctx = context_value(gold, rendered(raw_u, notes_u, registry), targets, [*covered, *(x["chunk"] for x in new)], bridged(notes_u)) - context_value(gold, book, targets, covered, bridged(state_notes))
            u = (gain + 1.5 * ctx) / ({"bridge_note": 1.15, "verification_note": 1.20}[c["type"]] if c["is_note"] else 1.0)
            pen = 0.0
            if recent:
                pen = 0.05 * sum(r["doc"] == c["doc"] for r in recent) + 0.10 * sum(jaccard(r["text"], c["text"]) >= 0.9 for r in recent)
                if len(flags) >= 2 and not any(flags[-2:]):
                    pen += 0.2 * any(r["unit"] == c["unit"] for r in recent) + 0.1 * any(r["chunk"] == c["chunk"] for r in recent) + (0.1 * any(r["doc"] == c["doc"] for r in recent) if ratio is not None and ratio >= 0.75 else 0)
                pen *= 1.5 if idle else 1.0
            bonus = influence_of(c, kept, registry, question, error, goal) if (in_repair or forced) and kept else 0.0
            return round(u - 0.2 * round(pen, 9) + 1e-4 * (len(cands) - i) + (5 if new else 0) + bonus, 9)

        scored = [(score(c, i), c) for i, c in enumerate(cands)]
        cost = lambda c: {"bridge_note": 1.15, "verification_note": 1.20}[c["type"]] if c["is_note"] else 1.0
        gain, one = min(scored, key=lambda s: (-s[0], s[1]["is_note"], not s[1]["answer_facing"], -s[1]["closure"] * s[1]["is_note"], cost(s[1]), -s[1]["priority"] * s[1]["is_note"], s[1]["unit"]))
        step = len(taken)
        if one["is_note"]:
            state_notes = [*state_notes, {**as_note(one), "added_step": step}]
        elif one["unit"] not in [u for u, _ in raw]:
            raw = [*raw, (one["unit"], step)]
        if one["unit"] not in taken:
            taken = [*taken, one["unit"]]
        new_covered = covered if one["is_note"] else covered_by([one["unit"]], covered, registry, targets)
        delta, progress = len(new_covered) - len(covered), int(len(new_covered) > len(covered) or one["is_note"])
        covered, book = new_covered, rendered(raw, state_notes, registry)
        flags = [*flags, progress][-2:]
        streak = len(flags) == 2 and not any(flags)
        status, at, reason = None, None, None
        if (all(s >= 0.7 for s in share_scores(targets, covered)) or streak or t + 1 >= most_steps) and closes(book, taken, covered):
            status, at = "terminal", t + 1
        elif not (in_repair and not progress) and streak:
            status, reason = "abort", "repeated_false_stop_no_progress" if false_stops >= 2 else "stalled"
        elif t + 1 >= most_steps:
            status, reason = "abort", "max_steps"
        out.append((t, one["unit"], gain, found, [n["unit"] for n in kept], candidate, delta, progress, false_stops, status, at, reason))
        if status:
            return out
        cooldown = 1 if probe is not None else cooldown
        probes = [*probes, probe][-2:] if probe is not None else probes
        history, triggered = [*history, found][-2:], [*triggered, bool(propose and (mine or in_repair or forced))][-2:]
        repairs, last_delta, last_ratio = repairs + bool(in_repair), delta, ratio
    return out
