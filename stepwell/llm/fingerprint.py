"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph hashes to a wide vector of 16-bit lanes, and a document's fingerprint is the sum of
its paragraphs' vectors modulo 2**16. So the order of paragraphs doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector. ``DENSE`` lanes hold
uniform numbers and tell unequal multisets apart; ``SIGNS`` lanes hold +1 or -1, so that the
squared length of a difference estimates the number of paragraphs that two texts don't share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_or_empty

DENSE, SIGNS = 28, 64
LANES = DENSE + SIGNS
#: A longer line is cut at sentence ends, and a longer sentence every so many characters.
UNIT_CHARS = 64
#: Documents of one range of keys when each is to meet the next.
RANGE_ROWS, MOST_RANGES = 250, 1 << 16


def paragraphs(text: str) -> list[str]:
    """Lines, cut at sentence ends and then to ``UNIT_CHARS``; empty ones are left out."""
    out: list[str] = []
    for unit in text.replace(". ", ".\n").split("\n"):
        if len(unit) <= UNIT_CHARS:
            if unit:
                out.append(unit)
        else:
            out.extend(unit[i : i + UNIT_CHARS] for i in range(0, len(unit), UNIT_CHARS))
    return out


def vectors(units: Iterable[str]) -> np.ndarray:
    """A row of lanes for each paragraph."""
    blake = hashlib.blake2b
    raw = b"".join([blake(u.encode("utf-8", "surrogatepass")).digest() for u in units])
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 64)
    signs = np.unpackbits(raw[:, 2 * DENSE :], axis=1).astype(np.uint16) * 2 - 1
    return np.hstack([np.ascontiguousarray(raw[:, : 2 * DENSE]).view("<u2"), signs.astype(np.uint16)])


def fingerprints(texts: list[str]) -> np.ndarray:
    """A fingerprint for each text; that of a text without paragraphs is zero."""
    units = [paragraphs(t) for t in texts]
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    out = np.zeros((len(texts), LANES), np.uint16)
    if sizes.any():
        lanes = vectors([u for some in units for u in some])
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(lanes, starts, axis=0, dtype=np.uint16)
    return out


def insert(fingerprint: np.ndarray, units: Iterable[str]) -> np.ndarray:
    return fingerprint + vectors(units).sum(0, dtype=np.uint16)


def delete(fingerprint: np.ndarray, units: Iterable[str]) -> np.ndarray:
    return fingerprint - vectors(units).sum(0, dtype=np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common paragraphs, 0 to 1, row by row; 1 for equal fingerprints."""
    x, y = (v[:, DENSE:].astype(np.uint16).view(np.int16).astype(np.float64) for v in (a, b))
    apart = (((a[:, DENSE:] - b[:, DENSE:]).view(np.int16).astype(np.float64)) ** 2).sum(1)
    own = (x**2).sum(1) + (y**2).sum(1)
    same = (a == b).all(1)
    return np.where(same, 1.0, np.clip(1 - apart / np.maximum(own, 1), 0.0, 1.0 - 2.0**-20))


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype("<u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<u2").copy()


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (hex; all zeros for a null or empty text)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "fingerprint")

    def run(batches):
        for batch in batches:
            found = fingerprints([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(to_text, found), pa.string())], names=[*batch.schema.names, "fingerprint"])

    return map_batches(docs.drop("fingerprint"), run, f"{schema}, fingerprint string")


def _at_most(bounds: list[int], column):
    """How many of the ascending ``bounds`` are at most ``column``: a coarse search, then a fine one."""
    step = max(1, int(len(bounds) ** 0.5))
    chunks = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    coarse = F.size(F.filter(chunks, lambda c: c[0] <= column))
    fine = F.size(F.filter(F.try_element_at(chunks, coarse), lambda b: b <= column))
    return F.coalesce(F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0), F.lit(0))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (range, last, key, text), dealt and sorted so that in each range the next row follows.

    Rows descend by key (null last; equal keys by text). After the rows of a range comes, with
    ``last`` = true, a copy of the row that follows its lowest one; after the lowest range, of the
    very first row. Ranges hold about ``RANGE_ROWS`` rows, and texts are dealt once.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
        bounds = sorted(set(found or []))
    own = _at_most(bounds, F.col("key")) if bounds else F.lit(0)
    rows = rows.withColumn("range", own)
    tops = {r["range"]: r["key"] for r in rows.groupBy("range").agg(F.max("key").alias("key")).collect()}  # a row for each range
    order = sorted(tops, reverse=True)
    send = {}
    for here, lower in zip(order, [*order[1:], *order[:1]]):
        send.setdefault(tops[lower], []).append(here)
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.createDataFrame(list(send.items()), f"key {kind}, to array<int>")
    places = F.concat(F.array(F.struct("range", F.lit(False).alias("last"))), F.coalesce(F.transform("to", lambda x: F.struct(x.alias("range"), F.lit(True).alias("last"))), F.array()))
    both = rows.join(F.broadcast(sent), rows["key"].eqNullSafe(sent["key"]), "left").select(rows["key"], "text", F.explode(places).alias("p"))
    dealt = both.select("p.range", "p.last", "key", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "last", F.desc_nulls_last("key"), "text")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, and how like they are to those of its edited and the next text.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of
    the next text by descending key (all, if it has fewer; after the last text comes the first).
    A table of one row has itself as next, an empty one gives no rows. Null texts count as empty,
    keys are whole numbers, and columns of other names aren't read. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        held = None  # (range, key, text, fingerprint) that waits for its next

        def pairs():
            nonlocal held
            for batch in batches:
                ranges, lasts, keys, texts = (batch.column(i).to_pylist() for i in range(4))
                found = fingerprints(texts)
                some = []
                for r, last, k, t, f in zip(ranges, lasts, keys, texts, found):
                    if held is not None and held[0] == r:
                        some.append((held[1], held[2], held[3], t, f))
                    held = (r, k, t, f) if not last else None
                yield some

        for some in pairs():
            if not some:
                continue
            edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for _, t, _, nxt, _ in some]
            own, after = np.array([x[2] for x in some]), np.array([x[4] for x in some])
            new = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in some], batch_kind),
                    pa.array([len(x[1]) for x in some], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array(map(to_text, own), pa.string()),
                    pa.array(map(to_text, new), pa.string()),
                    pa.array(likeness(own, new)),
                    pa.array(likeness(own, after)),
                ],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(docs.schema[key].dataType)
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(docs, key, text), run, schema)
