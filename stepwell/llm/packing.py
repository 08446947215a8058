"""Best-fit packing of token sequences.

Bulk-synchronous best-fit over run-length-coded sorted lists. Lengths are whole numbers of at
most ``capacity``, so the sorted list of documents is ``capacity`` runs (length, count) at
most, and the sorted list of gaps is runs of consecutive sequences with equal gap. A superstep
takes all documents of the next smaller length, sweeps the gaps upwards from the successor of
that length, gives the k-th place to the document of rank k (so no two claim one place),
updates the gaps and repeats. That is what best-fit decreasing does one document at a time.

Ranks are found without a global sort: every task numbers its own pieces of each length, and
the counts of (length, task), joined by a shuffle, give each task's offset. Only the runs reach the driver:
``capacity`` rows in, and out a plan whose rows are bounded by ``12 * 3 * capacity``, because
a superstep adds three runs at most and a run's gap falls by half or more whenever it is used.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .frames import map_batches, stored, text_or_empty

#: Bytes of the texts that are encoded together: the more, the less often a word is merged again.
CALL_BYTES = 8 << 20
#: Python and Arrow take these four control characters for white space; the tokenizer keeps them.
SEPARATORS = "[\x1c-\x1f]"
SPACES = regex.compile(r"\p{White_Space}+")


#: Words that Arrow's functions treat as the tokenizer does: letters whose classes, cases and forms no version of Unicode disputes.
SAFE = "[!-~\u00c0-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e\u0410-\u044f]{1,40}"
#: The token pattern within words (a fixed value of the tokenizer's format).
SAFE_TOKENS = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\pL\pN]+)"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _pieces_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and how many each has."""
    bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], np.diff(bounds).astype(np.int64)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and treats words apart.

    The distinct words of many texts are split into tokens and these merged, many at once; the
    library takes those that are long, hold a special string, or have uncommon characters.
    Nothing is kept from one call to the next.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), bpe.table(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words: one pool of ids, and where in it each word's begin and how many they are."""
        safe = pc.and_not(pc.match_substring_regex(words, f"^{SAFE}$"), pc.match_substring(words, "<|"))
        is_safe = safe.to_numpy(zero_copy_only=False).astype(bool)
        some = words.filter(safe)
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(some), SAFE_TOKENS, r"\1 ")))
        tokens = split.flatten().dictionary_encode()
        ids, counts = self.table.merge_flat(*_pieces_of(tokens.dictionary))
        at = tokens.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(counts) - counts
        pool = ids[_ragged(starts[at], counts[at])].astype("<u4")
        # a word's ids end where those of its last token do
        ends = np.r_[0, np.cumsum(counts[at])][split.offsets.to_numpy() - split.offsets[0].as_py()]
        rest = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4") for w in words.filter(pc.invert(safe)).to_pylist()]
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begins[is_safe], sizes[is_safe] = ends[:-1], np.diff(ends)
        sizes[~is_safe] = [len(x) for x in rest]
        begins[~is_safe] = len(pool) + np.cumsum(sizes[~is_safe]) - sizes[~is_safe]
        return np.concatenate([pool, *rest]) if rest else pool, begins, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last one's end)."""
        split = pc.utf8_split_whitespace(texts)
        if pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            split = pa.array(([w for w in SPACES.split(t) if w] for t in texts.to_pylist()), pa.list_(pa.string()))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        if not len(at):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        pool, begins, sizes = self._learn(coded.dictionary)
        bounds = np.r_[0, np.cumsum(sizes[at])][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pool[_ragged(begins[at], sizes[at])], bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder, of one path, for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _joined(batches):
    """Batches of at least ``CALL_BYTES``, put together of small ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CALL_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids, then ``end``, cut every ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32, task and seq (the piece's number among
    those of its length in its task), and ids (packed u32) if asked for. A null text is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e, seen = _encoder(path), defaultdict(int)
        task = TaskContext.get().partitionId()
        for batch in _joined(batches):
            ids, bounds = e(batch.column(1))
            sizes = np.diff(bounds)
            ids = np.insert(ids, bounds[1:], end)  # after each text's own
            sizes, begins = sizes + 1, bounds[:-1] + np.arange(batch.num_rows)
            number = -(-sizes // capacity)
            row = np.repeat(np.arange(batch.num_rows), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            first = begins[row] + start
            seq = np.empty(len(row), np.int64)
            for i, n in enumerate(length.tolist()):
                seq[i] = seen[n]
                seen[n] += 1
            raw = ids.tobytes()
            parts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(seq)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seq"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return map_batches(
        docs.select("doc_id", text_or_empty()),
        run,
        f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, task int, seq long" + ", ids binary" * with_ids,
    )


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """The supersteps over runs: which ranks of a length go to which sequences.

    Returns columns length, rank (first of the row), first (sequence), per (documents of the
    row in one sequence), offset (of the first of them), sorted by length and rank, and the
    number of sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, number)
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fitting = [g for g in sorted(gaps) if g >= length and gaps[g]]
        for gap in [*fitting, capacity]:
            per = gap // length
            runs = gaps.pop(gap, [])
            if gap == capacity and left:
                runs = [*runs, (sequences, -(-left // per))]
                sequences += runs[-1][1]
            while runs and left:
                first, number = runs.pop(0)
                full, over = divmod(left, per)
                use = min(number, full)
                rows.append((length, rank, first, per, capacity - gap)) if use or over else None
                if use:
                    gaps[gap - per * length].append((first, use))
                    rank, left = rank + use * per, left - use * per
                if use < number and left:  # fewer than `per` are left
                    gaps[gap - left * length].append((first + use, 1))
                    rank, left, use = rank + left, 0, use + 1
                if use < number:
                    runs.insert(0, (first + use, number - use))
            if runs:
                gaps[gap] += runs
            if not left:
                break
    names = ("length", "rank", "first", "per", "offset")
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(names)}, sequences


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """``found`` (from `pieces`, stored) with sequence_id and offset. Empty in, empty out."""
    spark = found.sparkSession
    per_task = found.groupBy("length", "task").agg((F.max("seq") + 1).alias("n"))
    per_task = stored(per_task, "packing-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    rows, _ = plan(counts, capacity)
    order = rows["length"] * (1 << 44) + rows["rank"]
    sort = np.argsort(order)
    shared = spark.sparkContext.broadcast({"order": order[sort], **{c: v[sort] for c, v in rows.items()}})
    before = per_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = found.join(before.hint("merge"), ["length", "task"])  # a row for each length of each task: it grows with the tasks, so it isn't broadcast
    names = [f.name for f in found.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def run(batches):
        p = shared.value
        for batch in batches:
            c = {n: batch.column(batch.schema.get_field_index(n)) for n in [*names, "before"]}
            length = c["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = c["seq"].to_numpy() + c["before"].to_numpy()
            at = np.searchsorted(p["order"], length * (1 << 44) + rank, "right") - 1
            k = rank - p["rank"][at]
            sequence = p["first"][at] + k // p["per"][at]
            offset = p["offset"][at] + k % p["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(c[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked, run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset; sequences hold ``capacity`` ids at most.

    Null texts are empty documents of the one id ``end``; repeated rows are packed as often as
    they occur; an empty table gives no rows.
    """
    found = stored(pieces(docs, path, capacity, end), "packing-pieces")
    return place(found, capacity).drop("task", "seq")


def sequences(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, doc_ids in their order.

    Null and empty texts are the one id ``end``; repeated rows are packed as often as they occur;
    an empty table gives no rows; columns other than doc_id and text aren't read.
    """
    found = stored(pieces(docs, path, capacity, end, with_ids=True), "packing-pieces")
    one = place(found, capacity)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def join(key, frame):
        frame = frame.sort_values("offset")
        ids = np.frombuffer(b"".join(frame["ids"]), "<u4").astype(np.int32)
        import pandas as pd

        return pd.DataFrame({"sequence_id": [key[0]], "ids": [ids], "doc_ids": [list(frame["doc_id"])]})

    return one.groupBy("sequence_id").applyInPandas(join, f"sequence_id long, ids array<int>, doc_ids array<{kind}>")
