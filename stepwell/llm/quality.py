"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_or_empty
from .langid import split_of

#: Bound of the training sample, in rows.
SAMPLE_ROWS = 12_000
#: Shape of the ensemble.
BINS, TREES, DEPTH, RATE, LEAST_ROWS, SMOOTH = 64, 80, 4, 0.15, 20, 1.0
THRESHOLD = 0.3
STATISTICS = (
    "chars words word_chars lines upper lower digit space symbol bang bar stop comma high letters distinct_words distinct_pairs distinct_lines top_word capital_words marked_words"
).split()


def _classes() -> np.ndarray:
    """The class of each byte: upper, lower, digit, space, symbol, !, |, full stop, comma, above ASCII."""
    out = np.full(256, 4)
    for k, some in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\f\v")):
        out[list(some)] = k
    out[ord("!")], out[ord("|")], out[ord(".")], out[ord(",")] = 5, 6, 7, 8
    out[128:] = 9
    return out


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The statistics named in ``STATISTICS``; all zero for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    of_class = np.bincount(CLASSES, np.bincount(raw, minlength=256), 10) / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, len(lines) / n, *of_class, of_class[0] + of_class[1] + of_class[9],
        len(counts) / n, len(set(zip(words, words[1:]))) / n, len(set(lines)) / len(lines), max(counts.values(), default=0) / n,
        sum(map(str.isupper, counts)) / max(1, len(counts)), sum(not w[-1].isalnum() for w in counts) / max(1, len(counts)),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(len(texts), len(STATISTICS))


class Trees:
    """Gradient-boosted trees for a binary label, as flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        flat = binned + np.arange(m) * BINS
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        self.feature, self.cut = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf, np.float32)
        self.leaf = np.zeros((TREES, leaves))
        rate = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                width, first = 1 << level, (1 << level) - 1
                place = (flat + ((node - first) * m * BINS)[:, None]).ravel()
                sums = [np.bincount(place, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(2) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
                best = gain.reshape(width, -1).argmax(1)
                right = np.zeros(n, bool)
                for k in range(width):
                    j, b = divmod(int(best[k]), BINS)
                    if gain[k, j, b] > 1e-6 and b < len(self.cuts[j]):
                        self.feature[t, first + k], self.cut[t, first + k] = j, self.cuts[j][b]
                        here = node == first + k
                        right[here] = binned[here, j] > b
                node = 2 * node + 1 + right
            at = node - inner
            gs, hs = (np.bincount(at, v, leaves) for v in (g, h))
            self.leaf[t] = -RATE * gs / (hs + SMOOTH)
            score += self.leaf[t][at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1: all rows go down all trees together."""
        trees, rows = np.arange(TREES), np.arange(len(x))[:, None]
        node = np.zeros((len(x), TREES), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1))))


def _measured(rows: DataFrame, schema: str, names: list[str], text_at: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = features(batch.column(text_at).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float32()))], names=[*names, "x"])

    return map_batches(rows, run, schema)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees | None:
    """Trees from at most about ``SAMPLE_ROWS`` labelled rows outside the held-out part; None without any."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).where("_key is not null and _y is not null").where(~split_of("_key", 5, 0))
    n = marked.count()
    if not n:
        return None
    share = int(min(1.0, SAMPLE_ROWS / n) * (1 << 20))
    some = marked.where(F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(1 << 20)) < share).groupBy("_key").agg(F.max("_y").cast("int").alias("_y"))
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).join(F.broadcast(some), "_key")  # of SAMPLE_ROWS small rows
    kind = docs.schema[key].dataType.simpleString()
    found = _measured(rows.select("_key", "_y", "_text"), f"k {kind}, y int, x array<float>", ["k", "y"], 2).toPandas()
    if found.empty:
        return None
    found = found.assign(t=[tuple(x) for x in found["x"]]).sort_values(["k", "t"])
    return Trees(np.array(found["x"].tolist(), np.float32), found["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``THRESHOLD`` on), from whole texts alone.

    Null texts count as empty; without a model every score is 0.5. Repeated rows are answered as
    often as they occur, an empty table gives an empty one, and other columns stay as they are.
    """
    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            s = m.predict(features(texts)) if m else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(kept, run, schema)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted, by trees learnt from ``labels``."""
    found = score(docs.select(key, text_or_empty(text).alias(text)), learn(docs, labels, key, text), text)
    return found.select(key, split_of(key, 5, 0).alias("held_out"), "score", "predicted")
