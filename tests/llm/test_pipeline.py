import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stepwell.llm import langid, neardup, pii, quality, queries

SF = "/root/testdata/sf0.001"


def stages_of(spark, docs, sf, at):
    """(name, docs before, docs after) of every stage, each written and read again."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        yield name, now, after
        now = after


def test_stages_against_plain_versions(spark, tmp_path):
    """Nulls, repeated rows, extra columns with the operators' own names and a very long text among the documents of a small table."""
    rng, base = random.Random(30), spark.read.parquet(f"{SF}/documents.parquet")
    kept = [c for c in base.columns]
    rows = [tuple(r) + ("x", 1) for r in base.collect()]
    at = {c: i for i, c in enumerate(kept)}

    def row(**more):
        new = list(rng.choice(rows))
        for c, v in more.items():
            new[at[c]] = v
        return tuple(new)

    long = " ".join(rng.choice(rows)[at["text"]] or "" for _ in range(300))
    rows += [row(doc_id=900_001, text=None), row(doc_id=900_002, text=""), row(doc_id=900_003, text="123 456"), row(doc_id=900_004, text=long), rows[5], rows[5], row(doc_id=None)]
    docs = spark.createDataFrame(rows, base.schema.add("score", "string").add("root", "long"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "neardup", "pii", "packing"]
    for name, before, after in stages_of(spark, docs, SF, tmp_path):
        old, new = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        ids = sorted((r["doc_id"] for r in new), key=str)
        if name != "packing":
            assert after.columns == docs.columns
        if name == "language":
            model = langid.learn(before)
            assert ids == sorted((r["doc_id"] for r in old if r["text"] and not model.predict(r["text"])[3]), key=str)
            assert len(old) - 3 >= len(new) > len(old) - 12
        elif name == "quality":
            model = quality.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == sorted((r["doc_id"] for r, s in zip(old, model.predict(quality.features([r["text"] or "" for r in old]))) if s >= quality.THRESHOLD), key=str)
        elif name == "neardup":
            found = {}
            for r in neardup.classes(before).collect():
                found.setdefault(r.class_id, []).append(r.doc_id)
            assert ids == sorted((min((i for i in some if i is not None), default=None) for some in found.values()), key=str)
            text = {r["doc_id"]: r["text"] for r in old}
            assert len({r["text"] for r in new}) == len(new) and all(r["text"] == text[r["doc_id"]] for r in new)
        elif name == "pii":
            text = {r["doc_id"]: r["text"] for r in old}
            assert ids == sorted(text, key=str) and all(r["n_chars"] == len(r["text"]) for r in new)
            mentions = [r.found for r in before.select(pii.found(F.col("text")).alias("found")).collect()]
            names = [m for some in mentions for m in some if len(m) > 6]
            assert len(names) > 10 and not any(m in r["text"] for r in new for m in names)
            untouched = {r["doc_id"] for r, some in zip(before.collect(), mentions) if not some}
            assert all(r["text"] == text[r["doc_id"]] for r in new if r["doc_id"] in untouched)
        else:
            library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            sizes = {}
            for r in new:
                sizes.setdefault(r["doc_id"], []).append(r["length"])
            assert {i: sum(n) for i, n in sizes.items()} == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in old}
            lengths = sorted((n for some in sizes.values() for n in some), reverse=True)
            gaps = []
            for n in lengths:
                fit = min(((g, i) for i, g in enumerate(gaps) if g >= n), default=None)
                if fit is None:
                    gaps.append(2048 - n)
                else:
                    gaps[fit[1]] -= n
            assert len({r["sequence_id"] for r in new}) == len(gaps)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    sf = tmp_path / "sf"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(sf / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(sf)).count() == 0


COLUMNS = {
    "op1_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op7_mpegts": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_language_id": "doc_id held_out lang_pred score", "op10_quality": "doc_id held_out score predicted", "op3_neardup": "doc_id class_id", "op9_pii": "doc_id text",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_their_columns_for_every_row(spark, name):
    found = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    got, docs = found.collect(), spark.read.parquet(f"{SF}/documents.parquet")
    if name == "op1_chat":
        import hashlib

        says = "\\### Assistant: </turn> ok"
        own = [r for r in got if r.conv_id == -7][0]
        assert own.turns_sha256 == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest() and own.loss_sha256 == hashlib.sha256(says.encode()).hexdigest()
        assert {r.conv_id for r in got} == {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()} | {-7}
    else:
        assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(got) == docs.count() or name == "op4_packing"
    if name == "op5_token_counts":
        library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        for r, d in zip(sorted(got, key=lambda r: r.doc_id), docs.orderBy("doc_id").collect()):
            n = len(library.encode(d.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((d.text or "").encode()), n > 1024)
