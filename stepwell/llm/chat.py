"""Chat formatting in budgeted windows.

Turns are written as ``<turn:role>text</turn>``. Inside texts and roles a backslash is doubled
and what would read as a control string gets one in front, so reading back is exact. A
conversation becomes windows of at most ``budget`` tokens: prefix sums of the turns' tokens
choose spans of whole turns, each window starts with the conversation's system turn and repeats
a limited history, and the loss mask covers assistant texts in the first window that holds them
only. A turn that doesn't fit beside the system turn stands alone with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .frames import map_batches

TARGET, SYSTEM = "assistant", "system"
#: Turns of a conversation that are laid out together: a longer one is cut at multiples of this turn number, so that no task holds all of it.
BLOCK_TURNS = 256
_TURN = regex.compile(r"<turn:((?:[^\\>]|\\.)*+)>((?:[^\\<]|\\.|<(?!/?turn))*+)</turn>", regex.DOTALL)
_CONTROL = regex.compile(r"<(?=/?turn)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\<", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return regex.sub(r"([\\<>])", r"\\\1", role)


def unescape(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text, flags=regex.DOTALL)


def format_turn(role: str, text: str) -> str:
    return f"<turn:{escape_role(role)}>{escape(text)}</turn>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn. Raises ValueError on anything between turns."""
    out, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError("text outside of turns")
        out.append((unescape(m[1]), unescape(m[2])))
        end = m.end()
    if end != len(formatted):
        raise ValueError("text outside of turns")
    return out


def spans(tokens: np.ndarray, system: int, budget: int, history: int, history_tokens: int, first: int = 0) -> Iterator[tuple[int, int, int]]:
    """(first history turn, first new turn, end) of the windows over turns of so many tokens.

    Turns before ``first`` serve as history only. ``system`` tokens are in every window.
    """
    prefix, start, n = np.r_[0, np.cumsum(tokens)], first, len(tokens)
    while start < n:
        back = max(0, start - history)
        while back < start and (prefix[start] - prefix[back] > history_tokens or system + prefix[start + 1] - prefix[back] > budget):
            back += 1
        end = int(np.searchsorted(prefix, prefix[back] + budget - system, "right")) - 1
        end = min(n, max(start + 1, end))
        yield back, start, end
        start = end


def windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 2, history_tokens: int = 256) -> DataFrame:
    """The windows of (conv_id, turn, role, text) rows.

    Columns: conv_id, block and number (their order), text, repeated (turns at the start that an
    earlier window has as new), tokens, and loss (array of start and end, in characters of text).
    Nulls: a role or text counts as empty, a turn comes first, a conv_id is a conversation of its
    own. Rows of one turn number are ordered by role and text, and repeated rows are turns too. A
    turn's tokens are counted apart from its neighbours', which the tokenizer may join at their
    marks. A conversation is laid out in blocks of ``BLOCK_TURNS`` turn numbers, at whose ends a
    window ends as well; rows that share a turn number are laid out by one task.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(0)).cast("long")
    system = rows.where(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("_conv")).agg(F.min(F.struct("turn", "text")).alias("s"))
    rows = rows.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", "turn", "role", "text", F.col("s.turn").alias("system_turn"), F.col("s.text").alias("system_text"))
    late = F.pmod(F.col("turn"), F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - history
    rows = rows.withColumn("_own", block)
    rows = rows.withColumn("block", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))).withColumn("old", F.col("block") > F.col("_own"))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    dealt = dealt.select("conv_id", "block", "old", "role", "text", "system_text", (F.col("turn").eqNullSafe(F.col("system_turn")) & F.col("system_text").isNotNull()).alias("may_be_system"))

    def lay_out(key: tuple, group: list[tuple], e: bpe.Encoder) -> Iterator[tuple]:
        if all(old for old, *_ in group):
            return
        formatted = [format_turn(role, text) for _, role, text, _, _ in group]
        tokens = np.array([e.count(f) for f in formatted])
        at = next((i for i, (_, role, text, sys_text, may) in enumerate(group) if may and role == SYSTEM and text == sys_text), -1)
        system = group[0][3]
        head = format_turn(SYSTEM, system) if system is not None else ""
        first = sum(old for old, *_ in group)
        for number, (back, start, end) in enumerate(spans(tokens, e.count(head) if head else 0, budget, history, history_tokens, first)):
            with_head = bool(head) and not back <= at < end and (at < back)
            parts, loss, n = ([head] if with_head else []), [], len(head) if with_head else 0
            for i in range(back, end):
                role, text = group[i][1:3]
                if i >= start and role == TARGET and text:
                    begin = n + len(f"<turn:{escape_role(role)}>")
                    loss.append({"start": begin, "end": begin + len(escape(text))})
                parts.append(formatted[i])
                n += len(formatted[i])
            yield (*key, number, "".join(parts), with_head + start - back, int(tokens[back:end].sum()) + (e.count(head) if with_head else 0), loss)

    names = ["conv_id", "block", "number", "text", "repeated", "tokens", "loss"]
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        e = bpe.encoder(path)
        key, group, id_type = None, [], None

        def batch_of(found):
            kinds = [id_type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), loss_type]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            id_type, out = batch.schema.field(0).type, []
            for conv, blk, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (conv, blk):
                    out.extend(lay_out(key, group, e))
                    group = []
                key = (conv, blk)
                group.append(tuple(row))
            if out:
                yield batch_of(out)
        if group:
            yield batch_of(list(lay_out(key, group, e)))

    return map_batches(dealt, run, f"conv_id {kind}, block long, number int, text string, repeated int, tokens long, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Hashes run over a conversation's windows in order and hold no text, however long it is. They
    are digests of an ordered whole, so one task reads all windows of a conversation. The windows
    hold no nulls but a conv_id, which is a conversation of its own; no windows give no rows.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "block", "number", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "number")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches):
        key, state, id_type = (), None, None
        done = []

        def close():
            done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flush():
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, _, _, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv,):
                    if key:
                        close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, own in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode())
                for span in loss:
                    own = unescape(text[span["start"] : span["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
                state[5] += 1
            if done:
                yield flush()
        if key:
            close()
            yield flush()

    return map_batches(ordered, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
