"""Vector points from chunked documents: ids, neighbours, payload, vector. There is no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.identity import chunk_ids, text_hash
from ..functions.text import file_uri, payload_extension
from ..schema import PAYLOAD
from .embedding import Provider, retried

TENANT = "default"
_VECTORS = pa.list_(pa.list_(pa.float32()))


def point_rows(chunked: DataFrame, hash_name: str = "blake3") -> DataFrame:
    """One row a chunk: id, the columns of schema.PAYLOAD, and chunk_text_sha2_256.

    chunked: canonical_path, size_bytes, mtime_unix_secs, strategy_fingerprint and chunks. The payload's chunk_text_sha256
    holds the hash that hash_name names, as other tools expect it there; the honest SHA-256 is the last column. If chunked has
    vectors beside its chunks, the columns vector and source_path follow.
    """
    path, none = F.col("canonical_path"), F.lit(None).cast("string")
    # no filter on chunks here: pushed below, it would have every text chunked once more
    docs = chunked.withColumn("_ids", chunk_ids(path, F.size("chunks"), F.col("strategy_fingerprint"), hash_name))
    # neighbours stand beside each chunk before chunks become rows, so that no row carries the arrays of its document
    ids = F.col("_ids")
    vectors = [F.col("vectors").alias("vector")] if "vectors" in chunked.columns else []
    zipped = F.arrays_zip(
        *vectors,
        F.col("chunks").alias("chunk"),
        ids.alias("id"),
        F.concat(F.array(none), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))).alias("previous"),
        F.concat(F.slice(ids, 2, F.size(ids)), F.array(none)).alias("next"),
    )
    docs = docs.select(path.alias("_path"), "size_bytes", "mtime_unix_secs", "strategy_fingerprint", F.size("chunks").alias("total_chunks"), text_hash(file_uri(path), hash_name).alias("doc_id"), zipped.alias("_zipped"))
    rows = docs.select("_path", "size_bytes", "mtime_unix_secs", "strategy_fingerprint", "total_chunks", "doc_id", F.posexplode_outer("_zipped").alias("chunk_index", "_at")).where(F.col("_at").isNotNull())
    chunk = F.col("_at.chunk")
    return rows.select(
        F.col("_at.id").alias("id"),
        file_uri(F.col("_path")).alias("canonical_path"),
        "doc_id",
        F.lit(TENANT).alias("tenant_id"),
        payload_extension(F.col("_path")).alias("file_extension"),
        "size_bytes",
        "mtime_unix_secs",
        "chunk_index",
        "total_chunks",
        F.col("_at.previous").alias("previous_chunk_id"),
        F.col("_at.next").alias("next_chunk_id"),
        chunk["start_byte"].alias("chunk_start_byte"),
        chunk["end_byte"].alias("chunk_end_byte"),
        chunk["char_len"].alias("chunk_char_len"),
        text_hash(chunk["text"], hash_name).alias("chunk_text_sha256"),
        "strategy_fingerprint",
        chunk["text"].alias("chunk_text"),
        F.sha2(chunk["text"], 256).alias("chunk_text_sha2_256"),
        *([F.col("_at.vector").alias("vector"), F.col("_path").alias("source_path")] if vectors else []),
    )


def embedded(texts: Column, provider: Provider) -> Column:
    """The vectors of a text column. The texts of an Arrow batch go to the provider in requests of provider.batch texts."""

    @F.arrow_udf("array<float>")
    def vectors(batch: pa.Array) -> pa.Array:
        return pa.array(provider.embed_all([t.as_py() or "" for t in batch]), pa.list_(pa.float32()))

    return vectors(texts)


def embed_documents(chunked: DataFrame, provider: Provider, retries: int = 0) -> DataFrame:
    """chunked with a column vectors, one for each chunk; no request has chunks of two documents.

    A document whose request fails, after so many retries, gets no vectors but error_kind and error_message.
    """

    @F.arrow_udf("struct<vectors:array<array<float>>,kind:string,message:string>")
    def vectors(documents: pa.Array) -> pa.Array:
        out = []
        for texts in documents:
            try:
                out.append((retried(lambda t=texts: provider.embed_all(t.as_py()), retries) if texts.is_valid else None, None, None))
            except Exception as e:  # noqa: BLE001  a document's error is a value of its row
                out.append((None, e.kind if isinstance(e, LoomError) else "embed", str(e)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((_VECTORS, pa.string(), pa.string()))], names=["vectors", "kind", "message"])

    made = chunked.withColumn("_embedded", vectors(F.transform("chunks", lambda c: c["text"])))
    kind, message = F.coalesce("error_kind", "_embedded.kind"), F.coalesce("error_message", "_embedded.message")
    return made.withColumns({"vectors": F.col("_embedded.vectors"), "error_kind": kind, "error_message": message}).drop("_embedded")


def with_vectors(points: DataFrame, provider: Provider) -> DataFrame:
    """(id, vector, payload): payload is a struct of the fixed keys; a sink makes JSON of it."""
    return payload_rows(points.withColumn("vector", embedded(F.col("chunk_text"), provider)))


def payload_rows(points: DataFrame) -> DataFrame:
    """(id, vector, payload) of points that have vectors, and their source_path if they have one."""
    return points.select("id", "vector", F.struct(*PAYLOAD).alias("payload"), *(c for c in ("source_path",) if c in points.columns))


def join_vectors(points: DataFrame, vectors: DataFrame, on: str) -> DataFrame:
    """Points with the vectors of a table, by a shared column; points without one are left out."""
    return points.join(vectors, on)
