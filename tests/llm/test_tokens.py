"""BPE, token counts and packing against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stepwell.llm import bpe, codec, packing, token_counts

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTE)
PARTS = ["a", "th", " ", "  ", "\n", "\t", "'", "'s", "'re", "<|endoftext|>", "<|endo", "é", "ß", "日本", " ", " ", "\x1c", "1", "²", "!!", "́", "😀", "ing", "\r\n", "Ⅷ", "Σ"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.sampled_from([1, 7, 1 << 16]))
def test_stream_equals_library(text, block):
    e = bpe.encoder(BYTE)
    ids = [int(i) for b in e.stream(text, block) for i in b]
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(bpe.table(BYTE))
    assert "".join(d.feed([i]) for i in ids) + d.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_windows_of_a_long_pretoken():
    table = bpe.MergeTable(BYTE)
    table.window = table.lookahead + 200
    rng = random.Random(4)
    for text in ["ab" * 900, "=" * 2000, "".join(rng.choice("theinrsao") for _ in range(1800))]:
        assert list(table.pretoken(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_merge_many_equals_merge():
    table, rng = bpe.table(BYTE), random.Random(5)
    words = ["".join(rng.choice("theinrsao") for _ in range(rng.randint(1, 14))).encode() for _ in range(300)]
    for w, ids in zip(words, table.merge_many(words)):
        assert list(ids) == table.merge([table.base[b] for b in w])


def test_broken_bytes_decode_like_the_library():
    ids = [LIBRARY.token_to_id("Ã"), 50256, LIBRARY.token_to_id("â")]
    d = bpe.Decoder(bpe.table(BYTE))
    assert d.feed(ids) + d.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (4, "Hello world", None), (4, "Hello world", None), (None, "a\x1cb Σ <|endoftext|>", "y"), (6, "tion er " * 4000, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_codec_rows_nulls_repeats_and_clashing_columns(spark, docs):
    got = codec.codec_digests(docs, BYTE).collect()
    assert len(got) == 7
    for r in got:
        text = {1: "Hello world", 2: "", 3: "", 4: "Hello world", 6: "tion er " * 4000}.get(r.doc_id, "a\x1cb Σ <|endoftext|>")
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = codec.decode(codec.encode(docs, BYTE), BYTE).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert codec.codec_digests(docs.limit(0), BYTE).count() == 0


def test_counts_use_and_grow_the_cache(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    first = token_counts.token_counts(docs, BYTE, path, limit=5)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in first.collect())[1:3] == [(1, 11, 2, False), (2, 0, 0, False)]
    assert first.count() == 7
    known = spark.read.parquet(path).count()
    assert known == 4
    more = docs.union(spark.createDataFrame([(9, "new text", None)], docs.schema))
    assert token_counts.token_counts(more, BYTE, path).count() == 8
    assert spark.read.parquet(path).count() == known + 1
    assert token_counts.token_counts(docs.limit(0), BYTE, str(tmp_path / "none")).count() == 0


def test_word_encoder_equals_library():
    library, e = Tokenizer.from_file(WORD), packing.WordEncoder(WORD)
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["x" * 500]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, sequences = packing.plan(counts, 64)
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(64 - n)
    assert sequences == len(gaps)
    held: dict[int, list] = {}
    for n, c in counts.items():
        own = [i for i in range(len(rows["length"])) if rows["length"][i] == n]
        for rank in range(c):
            i = max(i for i in own if rows["rank"][i] <= rank)
            k = rank - rows["rank"][i]
            held.setdefault(int(rows["first"][i] + k // rows["per"][i]), []).append((int(rows["offset"][i] + k % rows["per"][i] * n), n))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 64


def test_packed_rows(spark, docs):
    packed = packing.pack(docs, WORD, 64).toPandas()
    library = Tokenizer.from_file(WORD)
    ids = np.array(library.encode("tion er " * 4000, add_special_tokens=False).ids + [0], "<u4")
    own = packed[packed.doc_id == 6].sort_values("piece")
    assert list(own.ids_crc32) == [zlib.crc32(ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
    assert list(packed[packed.doc_id == 2].length) == [1]
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(np.cumsum(s.length) - s.length) and s.length.sum() <= 64
    assert packing.pack(docs.limit(0), WORD, 64).count() == 0
    whole = packing.sequences(docs.where(F.col("doc_id") == 1), WORD, 64).first()
    assert list(whole.ids) == library.encode("Hello world", add_special_tokens=False).ids + [0] and list(whole.doc_ids) == [1]


def test_every_safe_character_in_words_equals_library():
    import regex

    library, e = Tokenizer.from_file(WORD), packing.WordEncoder(WORD)
    safe = [c for c in map(chr, range(33, 0x500)) if regex.fullmatch(packing.SAFE, c)]
    assert len(safe) > 300
    texts = [f"{c} a{c}b {c}{c}1 x'{c} {c}'s{c.upper()}" for c in safe] + ["".join(random.Random(k).choices(safe, k=35)) for k in range(300)]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
