"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One logistic classifier over hashed byte n-grams
predicts each bit. Decoding takes the codeword of least loss, where a bit counts for a language
by how reliably it was predicted for that language in training; a second codeword nearly as
close flags the text as ambiguous.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_or_empty

UNKNOWN = "und"
#: Bounds of the training sample: rows in all (as many for each language, but at least so many), characters of a row's text; n-grams that count.
SAMPLE_ROWS, LEAST_ROWS, MOST_CHARS, MOST_GRAMS = 1600, 20, 20_000, 8192
#: A text is of none of the languages if so small a share of its byte pairs is known, and smaller than that of any text of the sample.
LEAST_KNOWN = 0.3
#: Hash bits of trigrams; pairs of bytes have their own places.
TRIGRAM_BITS = 14
DIMENSIONS = (1 << 16) + (1 << TRIGRAM_BITS)
SLICE_BYTES = 1 << 19
#: Least difference of the losses of the two best codewords, as a share of the best bit loss.
AMBIGUOUS = 0.05
LETTER = regex.compile(r"\p{L}")


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of up to 4 classes, else a fixed random code whose least row distance is the best of 200 draws."""
    if k <= 4:
        bits = max(1, (1 << max(0, k - 1)) - 1)
        return np.array([[1 if i == 0 or (b + 1) >> (i - 1) & 1 == 0 else -1 for b in range(bits)] for i in range(k)], np.float64)
    rng, bits = np.random.default_rng(7), 4 * (k - 1).bit_length() + 3
    draws = (np.where(rng.random((k, bits)) < 0.5, -1.0, 1.0) for _ in range(200))
    return max(draws, key=lambda m: min((m[i] != m[j]).sum() for i, j in combinations(range(k), 2)))


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs and trigrams of bytes."""
    a = raw.astype(np.uint32)
    pairs = a[:-1] << 8 | a[1:]
    triples = (pairs[:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
    return pairs, triples + np.uint32(1 << 16)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8)


class Model:
    """Codewords, classifiers and the reliability of each bit for each language."""

    def __init__(self, languages: list[str], texts: list[str], labels: np.ndarray, rounds: int = 150):
        self.languages, self.code = languages, codewords(len(languages))
        total = np.zeros(DIMENSIONS, np.int64)
        for t in texts:
            for g in _grams(_bytes(t)):
                total += np.bincount(g, minlength=DIMENSIONS)
        seen = np.sort(np.argsort(-total, kind="stable")[: min(MOST_GRAMS, int((total > 0).sum()))])
        rows = np.zeros((len(texts), len(seen)), np.float32)
        for i, t in enumerate(texts):
            for g in _grams(_bytes(t)):
                rows[i] += np.bincount(g, minlength=DIMENSIONS)[seen]
            rows[i] /= max(1.0, rows[i].sum())
        x = (np.sqrt(rows.mean(0)) + 1e-4).astype(np.float32)  # frequent n-grams are scaled down
        scaled = rows / x
        want = self.code[labels]
        share = 1.0 / np.bincount(labels, minlength=len(languages))[labels][:, None]
        w, b, step = np.zeros((len(seen), self.code.shape[1]), np.float32), np.zeros(self.code.shape[1]), 0.0
        speed = np.zeros_like(w)
        for _ in range(rounds):  # gradient descent with momentum, languages weighted equally
            slope = -want * share / len(languages) / (1 + np.exp(np.clip(want * (scaled @ w + b), -30, 30)))
            speed = 0.9 * speed - 4.0 * (scaled.T @ slope.astype(np.float32) + 1e-6 * w)
            w += speed
            step = 0.9 * step - 0.5 * slope.sum(0)
            b = b + step
        self.weights = np.zeros((DIMENSIONS, self.code.shape[1]), np.float32)
        self.weights[seen] = w / x[:, None]
        self.bias = b
        right = (np.sign(scaled @ w + b) == want).astype(np.float64)
        trust = np.array([right[labels == i].mean(0) if (labels == i).any() else np.ones(len(b)) for i in range(len(languages))])
        self.trust = (trust + 1e-9) / (trust + 1e-9).sum(1, keepdims=True)
        self.known = np.zeros(1 << 16, bool)
        self.known[seen[seen < 1 << 16]] = True
        self.least = min(LEAST_KNOWN, *(self.share(t) for t in texts))

    def share(self, text: str) -> float:
        """Of the pairs of bytes of a text, how many are among the model's n-grams."""
        raw, n = _bytes(text).astype(np.uint32), 0
        for at in range(0, len(raw) - 1, SLICE_BYTES):
            n += int(self.known[raw[at : at + SLICE_BYTES + 1][:-1] << 8 | raw[at + 1 : at + SLICE_BYTES + 1]].sum())
        return n / max(1, len(raw) - 1)

    def _losses(self, text: str) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -self.code * self.margins(text))).sum(1)

    def margins(self, text: str) -> np.ndarray:
        raw, total, n = _bytes(text), self.bias * 0, 0
        for at in range(0, max(1, len(raw) - 2), SLICE_BYTES):  # slices overlap by the two bytes a trigram looks ahead
            part = raw[at : at + SLICE_BYTES + 2]
            pairs, triples = _grams(part)
            pairs = pairs[:SLICE_BYTES]
            total = total + self.weights.take(pairs, 0).sum(0, dtype=np.float64) + self.weights.take(triples, 0).sum(0, dtype=np.float64)
            n += len(pairs) + len(triples)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float, bool, bool]:
        """Language, score from 0 to 1, whether a second language is nearly as close, and whether the text is rejected as of none."""
        if not LETTER.search(text):
            return UNKNOWN, 0.0, True, True
        loss = self._losses(text)
        unlike = self.share(text) < self.least
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.languages[0], float(np.exp(-loss[0])), False, unlike
        z = np.exp(-(loss - loss[order[0]]) * self.code.shape[1])
        return self.languages[order[0]], float(1 / z.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS), unlike


def split_of(key: str = "doc_id", parts: int = 4, held: int = 2):
    """Whether crc32 of the key as text has the held-out remainder; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == held, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """A model from a bounded sample of the labelled rows outside the held-out part; None without any."""
    rows = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~split_of(key) & (F.length(text) <= MOST_CHARS) & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    wanted = max(LEAST_ROWS, SAMPLE_ROWS / len(counts))
    shares = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, wanted / n) * (1 << 20)))))
    keep = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < shares[F.col(label)]
    sample = rows.where(keep).select(label, text, F.xxhash64(F.col(key).cast("string")).alias("h")).toPandas().sort_values(["h", text])
    if sample.empty:
        return None
    at = {name: i for i, name in enumerate(languages)}
    return Model(languages, list(sample[text]), sample[label].map(at).to_numpy())


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, ambiguous and rejected, from whole texts alone.

    A null text, one without letters, or any text without a model: ``und``, 0.0, true, true.
    Columns of these names are replaced; repeated rows are answered alike, an empty table gives
    an empty one, and a text of any length is read in slices.
    """
    names = ("lang_pred", "score", "ambiguous", "rejected")
    kept = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, ambiguous boolean, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [m.predict(t) if m and t else (UNKNOWN, 0.0, True, True) for t in texts]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return map_batches(kept, run, schema)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Per row: key, held_out, lang_pred, score, ambiguous, rejected, by a model learnt from ``docs`` themselves."""
    found = identify(docs.select(key, text_or_empty(text).alias(text)), learn(docs, key, text, label), key, text)
    return found.select(key, split_of(key).alias("held_out"), "lang_pred", "score", "ambiguous", "rejected")
