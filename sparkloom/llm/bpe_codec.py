"""BPE encoding and decoding of text columns (see bpe for the method).

``encode_column`` gives the ids and ``decode_column`` texts from ids; ``round_trip`` makes digests of both in one pass. It
keeps neither unless the ids are wanted, so that a long text costs a block of memory at a time.

Nulls: a null text encodes as an empty one, to no ids; null ids decode to an empty text. Rows are independent: repeated rows
and equal ids give equal results, in any order. An empty table gives an empty result. Columns but those of the id and the
text are not read, whatever their names. A text of any length is encoded in pieces (see bpe).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TextDecoder, WordTokenizer, load
from .common import small_batches, table


def encode_column(text: Column, tokenizer: str) -> Column:
    """Ids as array<int>. tokenizer: a path that every executor can read."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = load(tokenizer).encode
        return pa.array([[i for part in encoder(t.as_py() or "") for i in part] for t in texts], pa.list_(pa.int32()))

    return encode(text)


def decode_column(ids: Column, tokenizer: str) -> Column:
    """The text that an array of ids stands for; bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            decoder = TextDecoder(load(tokenizer).text_of)
            out.append(decoder.push(row.as_py() or []) + decoder.finish())
        return pa.array(out, pa.string())

    return decode(ids)


def digests(tokenizer: WordTokenizer, text: str, keep: list[int] | None = None) -> tuple[int, str, str]:
    """How many ids a text has, and SHA-256 of the ids in decimal with commas between and of the text decoded from them.

    keep: a list that gets the ids, if they are wanted.
    """
    n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(tokenizer.text_of)
    decimal = tokenizer.decimal.__getitem__
    for ids in tokenizer.encode(text):
        if ids:
            of_ids.update(("," * (n > 0) + ",".join(map(decimal, ids))).encode())
            n += len(ids)
            of_text.update(decoder.push(ids).encode())
            if keep is not None:
                keep += ids
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, and its ids if they are wanted."""
    small_batches(docs.sparkSession)
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids + ">")
    def both(texts: pa.Array) -> pa.Array:
        tok, rows = load(tokenizer), []
        for t in texts:
            kept: list[int] | None = [] if with_ids else None
            rows.append((*digests(tok, t.as_py() or "", kept), kept))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), both(F.col(f"`{text}`")).alias("_both")).select("doc_id", "_both.*")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
