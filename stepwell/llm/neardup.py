"""Near-duplicate classes by consistent weighted sampling.

A text is a weighted set of five-word shingles: weight = sqrt(count) x idf, where the idf is
damped to ``[LEAST_IDF, 1]`` so that boilerplate draws fewer samples and yet a large family of
copies isn't pushed below the threshold by being frequent. Document frequencies come from a
counting sketch of fixed size over all documents. Improved consistent weighted sampling turns
the set into ``BANDS x ROWS`` samples; texts that agree on all samples of a band share a bucket.
Every pair in a bucket whose weighted Jaccard similarity is at least the threshold ends up in
one class, and yet a bucket's pairs are never listed:

1. Every bucket has a hub, a text that many others share buckets with, so that a whole family
   has one or a few hubs. Each member is verified against the hub by the whole sets. A hub's
   group is done with once its members are in one component.
2. The members of another group are compared with what most of them have in common, a set h
   that needs no text of its own. With L1 distances and c = (1 - threshold) / (1 + threshold),
   x and y are linked exactly where |x - y| <= c (|x| + |y|), and |x - y| = |dx| + |dy| -
   2 overlap(dx, dy) for the differences dx = x - h, dy = y - h. With p(x) = |dx| - c |x| they
   are linked exactly where overlap(dx, dy) >= (p(x) + p(y)) / 2. If that is 0 or less, both are
   linked to the member of least p as well. Otherwise, by the prefix-filter argument, x and y
   share a feature of the difference after which (in an order common to all texts: added
   shingles first, rare ones first) each has at least that much left. Members unlike h share a
   rare shingle of their own in the same way.
3. These features are new buckets, within the group only, which count where they hold members
   of two components. Edits that different copies made on their own share no feature, so little
   is left of a large family of copies; what did change alike meets again. While the new buckets
   hold more pairs than the first ones had members, and as long as that lessens them, they get
   hubs of their own as in 1. Then the pairs left are verified one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Scratch, map_batches, stored, text_or_empty

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 5
#: Counters of the document-frequency sketch, and rows of it that travel together.
SKETCH_BITS, SKETCH_BLOCK = 18, 1 << 12
LEAST_IDF = 0.5
#: Draws (r, ln c, beta) of one hash function; a shingle picks one by its hash.
DRAWS_BITS = 13
#: Texts of one call of the shingler; their number fits the upper bits of a sort key.
CALL_TEXTS, CALL_BITS = 512, 9
MULTIPLIER = 0x9E3779B97F4A7C15
#: Marks a shingle that a text lacks and its hub has.
LACKS = np.uint64(0xA5A5_5A5A_C3C3_3C3C)
#: About so many members show what a group has in common.
SHOWN = 64
#: Bounds are widened by this share, which is more than rounding makes of them.
ROUNDING = 1e-6


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of at most ``CALL_TEXTS`` texts, sorted by text and hash.

    A text of fewer than five words is one shingle; one without words has none. Words compare in
    lower case. The lowest ``CALL_BITS`` bits of a hash are zero.
    """
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    known = coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(texts)), sizes)
    if "" in known:  # white space at an end of a text
        real = at != known.index("")
        at, of = at[real], of[real]
        sizes = np.bincount(of, minlength=len(texts))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[at] if known else np.zeros(0, np.uint64)
    h = np.zeros(len(w), np.uint64)
    mixed = w ^ w >> np.uint64(29)
    for k in range(WORDS):
        h *= np.uint64(MULTIPLIER)
        h[: len(w) - k] += mixed[k:]
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(w)) - start[of]
    for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)):  # its neighbours' words have no part in it
        h[start[i]] = xxhash.xxh3_64_intdigest(" ".join(known[j] for j in at[start[i] : start[i] + sizes[i]]), seed=1)
    keep = place < np.maximum(1, sizes - WORDS + 1)[of]
    of, h = of[keep], h[keep]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    both = np.sort(of.astype(np.uint64) << np.uint64(64 - CALL_BITS) | h >> np.uint64(CALL_BITS))
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(both)])
    both = both[first]
    return (both >> np.uint64(64 - CALL_BITS)).astype(np.int64), both << np.uint64(CALL_BITS), count


def _calls(texts: pa.Array):
    """Slices of at most ``CALL_TEXTS`` texts, with the number of the first."""
    for at in range(0, len(texts), CALL_TEXTS):
        yield at, texts.slice(at, CALL_TEXTS)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch's counters over all rows of ``text``, and the number of rows. Fixed size on the driver."""

    def run(batches):
        total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            for _, some in _calls(batch.column(0)):
                total += np.bincount(_counter(shingles(some)[1]), minlength=1 << SKETCH_BITS)
            n += batch.num_rows
        if n:
            blocks = total.reshape(-1, SKETCH_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blocks)), pa.int32()), pa.array([np.array([n]).tobytes(), *(b.tobytes() for b in blocks)], pa.binary())], names=["block", "counts"])

    def add(batches):  # a task may see many parts of a block
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[b] = sums[b] + np.frombuffer(c, np.int64) if b in sums else np.frombuffer(c, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = map_batches(texts, run, schema)
    summed = map_batches(parts.repartition("block"), add, schema)
    total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for row in summed.toLocalIterator():
        found = np.frombuffer(bytes(row["counts"]), np.int64)
        if row["block"] < 0:
            n += int(found[0])
        else:
            total[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] += found
    return total, n


def idf_table(counters: np.ndarray, n: int) -> np.ndarray:
    """The damped idf of each counter. What rare shingles heap up in a counter by chance is taken off first."""
    floor = np.median(counters)
    df = np.maximum(0.0, counters - floor - 6 * np.sqrt(floor) - 1)
    idf = np.log1p(n / (1 + df)) / np.log1p(max(1, n))
    return (LEAST_IDF + (1 - LEAST_IDF) * np.minimum(1.0, idf)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling (r, c ~ Gamma(2, 1), beta ~ U(0, 1))."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        rng, size = np.random.default_rng(20), (BANDS * ROWS, 1 << DRAWS_BITS)
        self.r, self.ln_c = rng.gamma(2, 1, size).astype(np.float32), np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.odd = rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.unit = self._order(self.ln_c + self.r * self.beta - self.r)  # for weight 1: t = 0

    @staticmethod
    def _order(value: np.ndarray) -> np.ndarray:
        """Floats as numbers of the same order in the upper half of 64 bits."""
        bits = value.astype(np.float32).view(np.int32)
        return np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64) << np.uint64(32)

    def weights(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.sqrt(count.astype(np.float32)) * self.idf[_counter(h)]

    def samples(self, of: np.ndarray, h: np.ndarray, count: np.ndarray):
        """For each sample, its value in every text that has shingles (a 32-bit name of shingle and level)."""
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ln_w = np.log(self.weights(h, count))
        other = np.flatnonzero(np.abs(ln_w) > 1e-6)
        h_other, w_other = h[other], ln_w[other]
        mark = h >> np.uint64(CALL_BITS) & np.uint64(0xFFFFFFFF)
        shift = np.uint64(64 - DRAWS_BITS)
        for i in range(BANDS * ROWS):
            value = self.unit[i][(h * self.odd[i] >> shift).view(np.int64)] | mark
            if len(other):
                at = (h_other * self.odd[i] >> shift).view(np.int64)
                r, beta = self.r[i][at], self.beta[i][at]
                t = np.floor(w_other / r + beta)
                own = mark[other] ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF))
                value[other] = self._order(self.ln_c[i][at] - r * (t - beta) - r) | own
            yield np.minimum.reduceat(value, starts) & np.uint64(0xFFFFFFFF)

    def bands(self, of: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text numbers that have shingles, a row of bucket keys for each)."""
        if not len(h):
            return of, np.zeros((0, BANDS), np.int64)
        own = of[np.flatnonzero(np.r_[True, of[1:] != of[:-1]])]
        keys = np.zeros((len(own), BANDS), np.uint64)
        for i, least in enumerate(self.samples(of, h, count)):
            b = i // ROWS
            keys[:, b] = (keys[:, b] ^ least) * np.uint64(MULTIPLIER) + np.uint64(b + 1)
            keys[:, b] ^= keys[:, b] >> np.uint64(31)
        return own, keys.view(np.int64)

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard of two (hashes ascending, weights)."""
        return Difference(a, b).similarity


_NO_NAMES = np.zeros(0, np.int64)


class Difference:
    """A weighted set x (hashes ascending, weights) seen from another one, its hub h."""

    def __init__(self, x: tuple[np.ndarray, np.ndarray], h: tuple[np.ndarray, np.ndarray]):
        self.x, self.h = x, h
        at = np.searchsorted(h[0], x[0])
        at[at == len(h[0])] = 0
        hit = h[0][at] == x[0] if len(h[0]) else np.zeros(len(x[0]), bool)
        self.in_hub = np.where(hit, h[1][at], 0.0) if len(h[0]) else np.zeros(len(x[0]))
        self.at, self.hit = at, hit
        self.size, self.hub_size = float(x[1].sum(dtype=np.float64)), float(h[1].sum(dtype=np.float64))
        least = float(np.minimum(x[1], self.in_hub).sum(dtype=np.float64))
        self.added, self.lacking = self.size - least, self.hub_size - least
        self.similarity = least / max(1e-12, self.size + self.hub_size - least)

    def features(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names of the difference's features in their order, and the weight of each and all after it."""
        own = self.x[1] - self.in_hub
        more, less = own > 0, own < 0
        gone = np.ones(len(self.h[0]), bool)
        gone[self.at[self.hit]] = False
        h = np.concatenate([self.x[0][more], self.x[0][less], self.h[0][gone]])
        w = np.concatenate([own[more], -own[less], self.h[1][gone]]).astype(np.float64)
        lacks = np.arange(len(h)) >= more.sum()
        order = np.lexsort((h, -idf[_counter(h)], lacks))
        return np.where(lacks, h ^ LACKS, h)[order].view(np.int64), np.cumsum(w[order][::-1])[::-1]

    def rare(self, idf: np.ndarray, threshold: float) -> np.ndarray:
        """The rarest shingles of x itself, one of which any text linked to x has as well."""
        h, w = self.x
        order = np.lexsort((h, -idf[_counter(h)]))
        left = np.cumsum(w[order].astype(np.float64)[::-1])[::-1]
        return h[order[left >= threshold * self.size * (1 - ROUNDING)]].view(np.int64)


_SAMPLERS: dict[int, Sampler] = {}


def _sampler(shared) -> Sampler:
    """One sampler for each broadcast table and worker process."""
    key = shared.id if hasattr(shared, "id") else id(shared.value)
    if key not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[key] = Sampler(shared.value)
    return _SAMPLERS[key]


def _signatures(rows: DataFrame, shared) -> DataFrame:
    """(_key, t, keys) for every row (_key, t, text): the bucket keys of all bands, none for a text without words."""

    def run(batches):
        sampler = _sampler(shared)
        for batch in batches:
            for at, some in _calls(batch.column(2)):
                of, keys = sampler.bands(*shingles(some))
                sizes = np.zeros(len(some), np.int32)
                sizes[of] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), lists], names=["_key", "t", "keys"])

    kind = rows.schema["_key"].dataType.simpleString()
    return map_batches(rows, run, f"_key {kind}, t binary, keys array<long>")


def _buckets(signatures: DataFrame) -> DataFrame:
    """(key, t) of the buckets with two members or more; each text once."""
    rows = signatures.select(F.explode("keys").alias("key"), "t")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, "key")


def _pairs(members: DataFrame) -> DataFrame:
    """The hub of each bucket of (key, t, score) is the member of greatest score: (hub, t, on).

    ``on`` is false where a bucket has one member beside the hub, so that no pair is left.
    """
    best = members.groupBy("key").agg(F.max(F.struct("score", "t")).alias("best"), F.count(F.lit(1)).alias("n"))
    return _against(members, best)


def _against(members: DataFrame, best: DataFrame) -> DataFrame:
    met = members.join(best, "key").select(F.col("best.t").alias("hub"), "t", (F.col("n") > 2).alias("on"))
    return met.where("hub <> t").groupBy("hub", "t").agg(F.bool_or("on").alias("on"))


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """`_pairs` of the bands' buckets (key, t, n), where a whole family of texts has the same hub.

    A text's score is the number of members it meets. A bucket's hub is the first text, by score,
    of the buckets that its members are in, so it need not be a member.
    """
    score = buckets.groupBy("t").agg(F.sum("n").alias("score"))
    members = buckets.join(score, "t").select("key", "t", "score")
    own = members.groupBy("key").agg(F.max(F.struct("score", "t")).alias("best"))
    reach = members.join(own, "key").groupBy("t").agg(F.max("best").alias("best"))
    best = members.select("key", "t").join(reach, "t").groupBy("key").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    inside = members.join(best, "key").where(F.col("best.t") == F.col("t")).select("key", F.lit(1).alias("inside"))
    return _against(members, best.join(inside, "key", "left").select("key", "best", (F.col("n") + 1 - F.coalesce("inside", F.lit(0))).alias("n")))


def _sets(texts: pa.Array, sampler: Sampler) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted sets of at most ``CALL_TEXTS`` texts."""
    of, h, count = shingles(texts)
    w, cuts = sampler.weights(h, count), np.searchsorted(of, np.arange(len(texts) + 1))
    return [(h[a:b], w[a:b]) for a, b in zip(cuts, cuts[1:])]


def _verified(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """(hub, t, s) of pairs (hub, t), by whole texts. A hub's text moves once for each task that has members of it."""

    def run(batches):
        sampler = _sampler(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, CALL_TEXTS // 2):
                batch = whole.slice(at, CALL_TEXTS // 2)
                of_hub = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                one = np.unique(of_hub, return_index=True)[1]
                sets = _sets(pa.concat_arrays([batch.column(2), batch.column(3).take(pa.array(one))]), sampler)
                s = [Difference(sets[i], sets[batch.num_rows + j]).similarity for i, j in enumerate(of_hub)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["hub", "t", "s"])

    with_text = pairs.select("hub", "t").join(texts, "t")
    of_hubs = texts.join(pairs.select(F.col("hub").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("hub"), F.col("text").alias("hub_text"))
    full = with_text.join(of_hubs, "hub").select("hub", "t", "text", "hub_text")
    return map_batches(full, run, "hub binary, t binary, s double")


def _in_common(groups: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """(hub, names, weights) of groups (hub, t): the shingles of most of about ``SHOWN`` members. Any set would do for right results."""

    def common(table: pa.Table) -> pa.Table:
        sampler, sets = _sampler(shared), []
        for _, some in _calls(table.column(1).combine_chunks()):
            sets += _sets(some, sampler)
        h, w = (np.concatenate(x) for x in zip(*sets))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        most = count * 2 > len(sets)
        middle = (first + count // 2)[most]
        return pa.table({"hub": table.column(0).slice(0, 1), "names": pa.array([h[first[most]].tobytes()], pa.binary()), "weights": pa.array([w[middle].tobytes()], pa.binary())})

    sizes = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    some = groups.join(sizes, "hub").where(F.pmod(F.xxhash64("t"), F.col("n")) < SHOWN).select("hub", "t").join(texts, "t")
    return some.select("hub", "text").groupBy("hub").applyInArrow(common, "hub binary, names binary, weights binary")


def _differences(groups: DataFrame, common: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """(hub, t, comp, p, near, far) of groups (hub, t, comp): features of the difference (f, left), and rare shingles.

    Two linked texts differ by 1 - threshold at most in their similarity to a set, so both are at
    least ``low`` (``near``) or both below ``high`` (``far``).
    """
    low, high, c = threshold / 2, threshold / 2 + (1 - threshold), (1 - threshold) / (1 + threshold)

    def run(batches):
        sampler = _sampler(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, CALL_TEXTS):
                batch = whole.slice(at, CALL_TEXTS)
                sets, p, near, far, hubs = _sets(batch.column(3), sampler), [], [], [], {}
                for x, hub, names, weights in zip(sets, *(batch.column(i).to_pylist() for i in (0, 4, 5))):
                    if hub not in hubs:
                        hubs[hub] = np.frombuffer(names or b"", np.uint64), np.frombuffer(weights or b"", np.float32)
                    d = Difference(x, hubs[hub])
                    p.append(d.added + d.lacking - c * d.size)
                    near.append(d.features(sampler.idf) if d.similarity >= low else (_NO_NAMES, np.zeros(0)))
                    far.append(d.rare(sampler.idf, threshold) if d.similarity < high else _NO_NAMES)
                ends = pa.array(np.cumsum([0, *(len(f) for f, _ in near)]), pa.int32())
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([_NO_NAMES, *(f for f, _ in near)])), pa.array(np.concatenate([np.zeros(0), *(x for _, x in near)]))], names=["f", "left"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array(p, pa.float64()), pa.ListArray.from_arrays(ends, pairs), _lists(far)], names=["hub", "t", "comp", "p", "near", "far"]
                )

    full = groups.join(texts, "t").join(common, "hub", "left").select("hub", "t", "comp", "text", "names", "weights")
    return map_batches(full, run, "hub binary, t binary, comp binary, p double, near array<struct<f:long,left:double>>, far array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, _NO_NAMES])))


def _next(groups: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of groups as by `_differences`: the members sure to be linked to the one of least p, and the next buckets.

    The first are pairs (hub, t, on), the second (key, side, t, comp, p, left, score), as far as
    they hold pairs of two components. A pair counts in a bucket where its sides are 0, or 1 (in
    the component of the one of least p) and 2 (not in it).
    """
    least = groups.groupBy("hub").agg(F.min(F.struct("p", "t", "comp")).alias("m"))
    # written out, so that adaptive execution may split a large group's rows in each join on the hub
    placed = scratch.keep(groups.join(least, "hub"), "neardup-placed").withColumn("sure", F.col("p") + F.col("m.p") <= 1e-9)
    sure = placed.where("sure and t <> m.t and comp <> m.comp").select(F.col("m.t").alias("hub"), "t").distinct().withColumn("on", F.lit(False))
    # those sure to be linked count as of the same component from here on
    placed = placed.withColumn("comp", F.when(F.col("sure"), F.col("m.comp")).otherwise(F.col("comp")))
    others = placed.where("comp <> m.comp").groupBy("hub").agg(F.min("p").alias("q"))
    placed = placed.join(others, "hub")
    inside, wide = F.col("comp") == F.col("m.comp"), 1 - ROUNDING

    def buckets(kind: int, side: int, other):
        """Features of which a pair with a member whose p is at least ``other`` may share the first."""
        some = F.filter("near", lambda x: x["left"] >= (F.col("p") + other) / 2 * wide - ROUNDING)
        return F.transform(some, lambda x: F.struct(F.xxhash64("hub", F.lit(kind), x["f"]).alias("key"), F.lit(side).alias("side"), x["left"].alias("left")))

    rare = F.transform("far", lambda f: F.struct(F.xxhash64("hub", F.lit(3), f).alias("key"), F.lit(0).alias("side"), F.lit(float("inf")).alias("left")))
    near = F.when(inside, buckets(2, 1, F.col("q"))).otherwise(F.concat(buckets(1, 0, F.col("q")), buckets(2, 2, F.col("m.p"))))
    rows = placed.select(F.explode(F.concat(near, rare)).alias("b"), "t", "comp", "p").select("b.*", "t", "comp", "p", (-F.col("p")).alias("score"))
    two = (F.min("comp") != F.max("comp")).alias("two")
    live = rows.groupBy("key").agg(two, F.min("side").alias("lo"), F.max("side").alias("hi")).where("two and (hi = 0 or lo < hi)")
    return sure, rows.join(live.select("key"), "key", "left_semi")


def _one_by_one(members: DataFrame) -> DataFrame:
    """The pairs (hub, t, on) that count in buckets as by `_next` and have enough left to be linked."""
    other = members.select("key", *(F.col(c).alias(f"{c}_") for c in ("side", "t", "comp", "p", "left")))
    met = members.join(other, "key").where("comp <> comp_ and ((side = 0 and t < t_) or side < side_)")
    enough = F.least("left", "left_") >= (F.col("p") + F.col("p_")) / 2 * (1 - ROUNDING) - ROUNDING
    return met.where(enough).select(F.greatest("t", "t_").alias("hub"), F.least("t", "t_").alias("t")).distinct().withColumn("on", F.lit(False))


def links(buckets: DataFrame, texts: DataFrame, shared, threshold: float = THRESHOLD) -> DataFrame:
    """(t, root) for every linked text of the buckets (key, t, n); ``texts`` has each of their texts once.

    The classes are the components of all pairs that share a bucket and reach the threshold.
    """
    scratch = Scratch(texts.sparkSession)
    met, known, last, most = scratch.keep(_first_pairs(buckets), "neardup-pairs"), None, None, None
    while True:
        new = met.select("hub", "t") if known is None else met.select("hub", "t").distinct().join(known, ["hub", "t"], "left_anti")
        found = scratch.keep(_verified(new, texts, shared), "neardup-verified")
        known = found if known is None else known.unionByName(found)
        roots = scratch.keep(components(known.where(F.col("s") >= threshold - ROUNDING).select(F.col("hub").alias("a"), F.col("t").alias("b"))), "neardup-roots")
        if last == "one by one":
            break
        placed = met.where("on").join(roots, "t", "left").select("hub", "t", F.coalesce("root", "t").alias("comp"))
        open_ = placed.groupBy("hub").agg((F.min("comp") != F.max("comp")).alias("two")).where("two").select("hub")
        groups = scratch.keep(placed.join(open_, "hub", "left_semi"), "neardup-groups")
        if groups.isEmpty():
            break
        common = scratch.keep(_in_common(groups, texts, shared), "neardup-common")
        sure, members = _next(scratch.keep(_differences(groups, common, texts, shared, threshold), "neardup-differences"), scratch)
        members = scratch.keep(members, "neardup-members")
        sizes = members.groupBy("key").agg(*(F.sum((F.col("side") == k).cast("long")).alias(f"n{k}") for k in range(3)))
        pairs = sizes.agg(F.sum(F.expr("n0 * (n0 - 1) div 2 + n1 * n2"))).first()[0] or 0
        most = most or met.count()
        direct = pairs <= most or (last is not None and pairs >= last)  # few, or hubs don't lessen them
        last = "one by one" if direct else pairs
        met = scratch.keep((_one_by_one(members) if direct else _pairs(members)).unionByName(sure), "neardup-pairs")
    out = stored(roots, "neardup-roots")
    scratch.drop_all_but()
    return out


def components(edges: DataFrame) -> DataFrame:
    """(t, root): for every node of the edges (a, b), the least node of its component.

    Alternating large-star and small-star steps on stored tables; a hot node's rows are joined,
    never gathered.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")

    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        if large:
            new = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return new.where("a <> b").select(a, b).distinct()

    def digest(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = scratch.keep(edges.select(a, b).where("a <> b").distinct(), "components")
    before = digest(now)
    while before[0]:
        half = scratch.keep(star(now, True), "components")
        new = scratch.keep(star(half, False), "components")
        after = digest(new)
        scratch.drop(half, now)
        now = new
        if after == before:
            break
        before = after
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "t")


def _digest(text: str):
    """A text's identity: 128 bits."""
    return F.unhex(F.md5(text_or_empty(text)))


def _classed(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(_key, t, root) of every row, stored."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), _digest(text).alias("t"), text_or_empty(text).alias("text"))
    counters, n = frequencies(rows.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(idf_table(counters, n))
    signed = scratch.keep(_signatures(rows, shared), "neardup-signatures")
    # one row of each text: copies meet in the map-side part of the aggregation
    distinct = scratch.keep(signed.groupBy("t").agg(F.first("keys").alias("keys"), F.min("_key").alias("_key")), "neardup-distinct")
    buckets = scratch.keep(_buckets(distinct), "neardup-buckets")
    need = distinct.join(buckets.select("t").distinct(), "t", "left_semi").select("t", F.col("_key").alias("k"))
    some = rows.join(need, (rows["t"] == need["t"]) & rows["_key"].eqNullSafe(need["k"]), "left_semi").select("t", "text")
    texts = scratch.keep(some.groupBy("t").agg(F.first("text").alias("text")), "neardup-texts")
    roots = links(buckets, texts, shared, threshold)
    of = signed.select("_key", "t").join(roots, "t", "left")
    out = stored(of.select("_key", "t", F.coalesce("root", "t").alias("root")), "neardup-classes")
    scratch.drop_all_but()
    shared.unpersist()
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's key with class_id, the least key of its class of near-duplicates.

    Classes are the connected components of the verified links; copies of a text are in one
    class. Null and empty texts are copies of the empty text. A row without key is in a class
    but names none (a class of such rows alone has a null id). Words compare in lower case.
    Repeated rows are answered as often as they occur; an empty table gives an empty one; other
    columns aren't read.
    """
    of = _classed(docs, key, text, threshold)
    least = of.groupBy("root").agg(F.min("_key").alias("class_id"))
    return of.join(least, "root").select(F.col("_key").alias(key), "class_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one row of each class: the one of least key (any one of rows that repeat key and text).

    A row without key stays only where its class has no other; then one of them does. Rows of one
    key with texts of different classes are different rows.
    """
    scratch = Scratch(docs.sparkSession)
    of = _classed(docs, key, text, threshold)
    best = of.groupBy("root").agg(F.min(F.struct(F.isnull("_key").alias("none"), "_key", "t")).alias("b")).select(F.col("b._key").alias("_nd_k"), F.col("b.t").alias("_nd_t"))
    counts = of.groupBy("_key", "t").agg(F.count(F.lit(1)).alias("_nd_n"))
    same = counts["_key"].eqNullSafe(best["_nd_k"]) & (counts["t"] == best["_nd_t"])
    kept = scratch.keep(counts.join(best, same).select("_nd_k", "_nd_t", "_nd_n"), "neardup-kept")

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[key].eqNullSafe(some["_nd_k"]) & (_digest(text) == some["_nd_t"]), "left_semi")

    out, many = rows_of(kept.where("_nd_n = 1")), kept.where("_nd_n > 1")
    return out if many.isEmpty() else out.unionByName(rows_of(many).dropDuplicates([key, text]))
