"""Ranked lexical search over an index of postings in blocks of variable length.

Documents are dealt into shards as they lie, without a shuffle. In a shard every term has a
posting list in the order of doc_id, with each document's impact: its score but for the term's
weight. Dynamic programming cuts a list into the blocks that minimise the bound error, the sum
of (greatest impact of the block - impact), plus a fixed cost for each block.

A search reads the lists of its terms only. In a shard the ends of all blocks of a query's lists
cut the documents into intervals in which each list has one block, so the sum of the blocks'
greatest impacts bounds every score in it. Intervals are scored in the order of their bounds,
and once the best k are known to reach a threshold, all with a lower bound are skipped unread.
That loses nothing: the result is that of scoring every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, shared_dir, text_or_empty

#: A shard ends at so many bytes of text or so many documents, whose numbers then fit 16 bits.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Most postings of a block, and the cost of a block in mean impacts of its list.
MOST_BLOCK, BLOCK_COST = 64, 8
#: Lists that are cut into blocks together.
LISTS_AT_ONCE = 1 << 14
#: Rows (item, term) of queries that are searched together; they are broadcast.
BLOCK_TERMS = 200_000
#: Fixed values of the ranking: weight scale, impact scale, shares of saturation and length.
WEIGHT, IMPACT, TF, LENGTH, SHARE = 1000, 1_000_000_000, 1000, 12, 25

_BYTE = np.arange(256, dtype=np.uint8)
_IN_TERM = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
_INDEX = "shard string, term binary, df int, docs binary, impacts binary, ends binary, tops binary, keys array<long>"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of binary values that lie one after the other in ``data``; ``ends`` counts its items."""
    offsets = np.r_[0, ends].astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text number, term as bytes) of every term of the texts, in order.

    Terms are runs of ASCII letters, digits and anything beyond ASCII; A-Z are lower-cased.
    """
    spaced = pc.binary_join_element_wise(texts.cast(pa.string()), pa.scalar(""), pa.scalar(" "))  # so that no term spans two texts
    if not len(spaced):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    bounds = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = np.frombuffer(spaced.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    kept = _IN_TERM[raw]
    edges = np.diff(kept.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(bounds - bounds[0], starts, "right") - 1
    return of, _binary(_LOWER[raw[kept]], np.cumsum(ends - starts))


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def run(batches):
        n = total = 0
        for batch in batches:
            of = terms(batch.column(0))[0]
            n += len(np.unique(of))
            total += len(of)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    row = map_batches(docs.select(text_or_empty(text).alias("text")), run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def cut(impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of posting lists that lie one after the other: (number of blocks of each list, ends, greatest impacts).

    Ends count from the start of the list. A prefix's least cost is that of a shorter one and a
    block of at most ``MOST_BLOCK`` postings; all lists take the step to the next prefix together.
    """
    step = np.ones(len(impacts), np.uint8)  # length of the last block of each prefix
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    sums = np.add.reduceat(impacts, starts) if len(starts) else np.zeros(0, np.int64)
    lengths = np.arange(1, MOST_BLOCK + 1)
    for some in np.split(order, range(LISTS_AT_ONCE, len(order), LISTS_AT_ONCE)):
        if not len(some):
            continue
        first, size = starts[some], sizes[some]
        price = BLOCK_COST * sums[some] / size
        most = min(MOST_BLOCK, int(size[0]))
        cost = np.full((len(some), most), np.inf)  # of the prefixes that end 1, 2, ... before
        cost[:, 0] = 0
        top = np.zeros((len(some), most))  # of the last 1, 2, ... postings
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for j in range(int(size[0])):
            a = active[j]
            new = impacts[first[:a] + j].astype(np.float64)
            top[:a, 1:] = top[:a, :-1]
            top[:a, 0] = 0
            np.maximum(top[:a], new[:, None], out=top[:a])
            whole = top[:a] * lengths[:most]
            whole += cost[:a]
            best = np.argmin(whole, 1)
            step[first[:a] + j] = best + 1
            cost[:a, 1:] = cost[:a, :-1]
            cost[:a, 0] = whole[np.arange(a), best] + price[:a]
    place, left, found = np.arange(len(starts)), sizes.astype(np.int64), []
    while len(place):  # back from the ends
        found.append((place, left))
        left = left - step[starts[place] + left - 1]
        place, left = place[left > 0], left[left > 0]
    lists, ends = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
    sort = np.lexsort((ends, lists))
    lists, ends = lists[sort], ends[sort]
    begins = np.r_[0, ends[:-1]]
    begins[np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])] = 0
    return np.bincount(lists, minlength=len(starts)), ends, np.maximum.reduceat(impacts, starts[lists] + begins) if len(lists) else ends


def _shard(name: str, keys: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index rows of a shard: one for each term, and one without term that has the documents' keys and counts those with terms."""
    order = pc.sort_indices(keys)  # nulls come last
    of, words = terms(texts.take(order))
    coded = words.dictionary_encode()
    packed = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 16 | of
    packed.sort()
    new = np.flatnonzero(np.diff(packed, prepend=-1))
    tf, packed = np.diff(np.r_[new, len(packed)]), packed[new]
    term, doc = packed >> 16, packed & (SHARD_DOCS - 1)
    norm = 100 - SHARE + SHARE * np.bincount(of, minlength=len(keys))[doc] * n_docs // max(1, n_terms)
    impact = IMPACT * tf // (TF * tf + LENGTH * norm)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.r_[starts, len(term)])
    blocks, ends, tops = cut(impact, starts, sizes)
    at, block_ends = np.cumsum(sizes), np.cumsum(blocks)
    rows = len(starts)
    columns = [coded.dictionary, pa.array(sizes, pa.int32()), _binary(doc.astype("<u2"), at), _binary(impact.astype("<i4"), at), _binary(ends.astype("<i4"), block_ends), _binary(tops.astype("<i4"), block_ends)]
    with_keys = [pa.concat_arrays([pa.nulls(1, c.type), c]) for c in columns]
    with_keys[1] = pa.concat_arrays([pa.array([len(np.unique(of))], pa.int32()), columns[1]])
    lists = pa.ListArray.from_arrays(pa.array([0, *[len(keys)] * (rows + 1)], pa.int32()), keys.take(order))
    lists = pa.concat_arrays([lists.slice(0, 1), pa.nulls(rows, lists.type)])
    return pa.RecordBatch.from_arrays([pa.array([name] * (rows + 1)), *with_keys, lists], names=[c.split()[0] for c in _INDEX.split(", ")])


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of ``docs`` to the folder ``path`` and read it.

    Null texts have no terms. Every row is a document, repeated ones too, and so is a row without
    key; an empty table has an empty index. Columns of other names aren't read.
    """
    n_docs, n_terms = totals(docs, text)

    def run(batches):
        task, held, size, count, number = TaskContext.get().partitionId(), [], 0, 0, 0

        def whole():
            table = pa.Table.from_batches(held).combine_chunks()
            return _shard(f"{task}-{number}", table.column(0).combine_chunks(), table.column(1).combine_chunks(), n_docs, n_terms)

        for batch in batches:
            if held and (size + batch.nbytes > SHARD_BYTES or count + batch.num_rows > SHARD_DOCS):
                yield from _slices(whole())
                held, size, count, number = [], 0, 0, number + 1
            held.append(batch)
            size, count = size + batch.nbytes, count + batch.num_rows
        if count:
            yield from _slices(whole())

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    map_batches(rows, run, _INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def _slices(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Lists:
    """The posting lists of a shard that a block of queries needs."""

    def __init__(self, table: pa.Table):
        self.keys, self.lists = None, {}
        for term, docs, impacts, ends, tops, keys in zip(*(table.column(c).to_pylist() for c in ("term", "docs", "impacts", "ends", "tops", "keys"))):
            if term is None:
                self.keys = keys
            else:
                d, e = np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(ends, "<i4")
                self.lists[term] = d, np.frombuffer(impacts, "<i4").astype(np.int64), d[e - 1], np.frombuffer(tops, "<i4").astype(np.int64)
        self.scores = np.zeros(len(self.keys or ()), np.int64)

    def best(self, weighted: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for weighted terms, best first, equal scores in the documents' order."""
        lists = [(*self.lists[t], w) for t, w in weighted if w and t in self.lists]
        nothing = np.zeros(0, np.int64)
        if not lists:
            return nothing, nothing
        cuts = np.unique(np.concatenate([last for _, _, last, _, _ in lists]))  # the last document of each interval
        bound = np.zeros(len(cuts), np.int64)
        for _, _, last, tops, w in lists:
            at = np.searchsorted(last, cuts)
            inside = at < len(last)
            bound[inside] += w * tops[at[inside]]
        order = np.argsort(-bound, kind="stable")
        falling, starts = -bound[order], np.r_[0, cuts[:-1] + 1]
        docs, scores, done, step = nothing, nothing, 0, max(8, k)
        while done < len(order):
            reach = len(order) if len(docs) < k else int(np.searchsorted(falling, -scores[k - 1], "right"))
            chosen = order[done : min(reach, done + step)]
            if not len(chosen):
                break
            done, step = done + len(chosen), step * 2
            touched = []
            for d, u, _, _, w in lists:
                lo, hi = np.searchsorted(d, starts[chosen]), np.searchsorted(d, cuts[chosen], "right")
                size = hi - lo
                total = int(size.sum())
                if total:
                    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(total)
                    self.scores[d[at]] += w * u[at]
                    touched.append(d[at])
            if touched:
                new = np.unique(np.concatenate(touched))
                docs, scores = np.r_[docs, new], np.r_[scores, self.scores[new]]
                self.scores[new] = 0
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
        return docs[scores > 0], scores[scores > 0]


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, repeats) of queries."""

    def run(batches):
        for batch in batches:
            of, words = terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), words], names=["item", "term"])

    kind = queries.schema[key].dataType.simpleString()
    rows = map_batches(queries.select(F.col(key), text_or_empty(text).alias("text")), run, f"item {kind}, term binary")
    return rows.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of every query (key, text).

    Equal scores go by ascending doc_id, a document without doc_id last. A query without terms,
    or whose terms no document has, gets no rows; rows of one key are one query of all their
    terms. Queries are searched in blocks of about ``BLOCK_TERMS`` terms, whose weights are
    broadcast.
    """
    spark = index.sparkSession
    path = shared_dir(spark, "wand-terms")
    query_terms(queries, key, text).write.parquet(path)
    asked = spark.read.parquet(path)
    size = asked.count()
    shards, n_docs = index.where("term is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    blocks = max(1, math.ceil(size / BLOCK_TERMS))
    kind = asked.schema["item"].dataType.simpleString()
    parts = [_search_block(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), n_docs, k, kind) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = F.pmod(F.xxhash64("shard"), F.lit(max(1, math.isqrt(shards))))  # so that no task meets the results of all shards
    some = found.withColumn("near", near).withColumn("r", F.row_number().over(Window.partitionBy("item", "near").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc_id", "score")


def _search_block(index: DataFrame, asked: DataFrame, n_docs: int, k: int, kind: str) -> DataFrame:
    """The k best of each shard for a block of queries (item, term, repeats)."""
    spark = index.sparkSession
    needed = F.broadcast(asked.select("term").distinct())  # BLOCK_TERMS rows or so at most
    frequency = index.select("term", "df").join(needed, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    table = asked.join(F.broadcast(frequency), "term").select("item", "term", (weight * F.col("repeats")).cast("long").alias("w")).toArrow()
    by_item: dict = {}
    for item, term, w in zip(*(table.column(i).to_pylist() for i in range(3))):
        by_item.setdefault(item, []).append((term, w))
    shared = spark.sparkContext.broadcast(by_item)
    item_type = table.schema.field(0).type

    def run(shard: pa.Table) -> pa.Table:
        lists, items, docs, scores = Lists(shard), [], [], []
        for item, weighted in shared.value.items():
            d, s = lists.best(weighted, k)
            items += [item] * len(d)
            docs += [lists.keys[i] for i in d.tolist()]
            scores += s.tolist()
        name = shard.column("shard")[0].as_py()
        return pa.table({"item": pa.array(items, item_type), "shard": pa.array([name] * len(items), pa.string()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    keys = index.where("term is null")
    rows = index.where("term is not null").join(needed, "term", "left_semi").select(*keys.columns).unionByName(keys)
    return rows.groupBy("shard").applyInArrow(run, f"item {kind}, shard string, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Build an index of ``docs`` and search it for every row of ``queries``: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    index = build(docs, shared_dir(spark, "wand-index"))
    return search(index, queries, k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
