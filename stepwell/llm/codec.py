"""BPE encoding and decoding of a text column (see `bpe` for the transducer)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .frames import map_batches, text_or_empty


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the ids of each whole text.

    A null text counts as empty and gives an empty array; repeated rows stay repeated.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "ids")
    kept = docs.drop("ids")

    def run(batches):
        e = bpe.encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            e.prime(texts)
            ids = pa.array(([int(i) for block in e.stream(t) for i in block] for t in texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return map_batches(kept, run, f"{schema}, ids array<int>")


def decode(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``frame`` with a column ``decoded``: the text of each id array (null: empty)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "decoded")
    kept = frame.drop("decoded")

    def run(batches):
        table = bpe.table(path)
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index(ids)).to_pylist():
                d = bpe.Decoder(table)
                out.append(d.feed(x or ()) + d.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_batches(kept, run, f"{schema}, decoded string")


def codec_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, sha256 of the ids in decimal joined by commas, sha256 of the decoded text.

    Both digests are taken block by block as the transducer emits ids, so a long text needs
    no list of all its ids.
    """

    def run(batches):
        e, table = bpe.encoder(path), bpe.table(path)
        decimal = [str(i) for i in table.ids]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            e.prime(texts)
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                n, of_ids, of_text, d = 0, hashlib.sha256(), hashlib.sha256(), bpe.Decoder(table)
                for block in e.stream(t):
                    if len(block):
                        ids = block.tolist()
                        of_ids.update(("," * (n > 0) + ",".join(map(decimal.__getitem__, ids))).encode())
                        of_text.update(d.feed(ids).encode())
                        n += len(ids)
                of_text.update(d.finish().encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text_or_empty(text)), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
