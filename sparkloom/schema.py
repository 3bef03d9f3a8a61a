"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

FINGERPRINT = T.StructType([T.StructField("canonical_path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("mtime_unix_secs", T.LongType())])

FILES = T.StructType([*FINGERPRINT.fields, T.StructField("content", T.BinaryType()), T.StructField("error_kind", T.StringType()), T.StructField("error_message", T.StringType())])

CHUNK = "struct<index:int,text:string,boundary:string,start_byte:bigint,end_byte:bigint,char_len:bigint>"

WAL_RECORD = T.StructType([T.StructField("kind", T.StringType()), T.StructField("chunk_id", T.BinaryType()), T.StructField("fingerprint", FINGERPRINT)])

#: The keys of a point's payload, in order.
PAYLOAD = (
    "canonical_path", "doc_id", "tenant_id", "file_extension", "size_bytes", "mtime_unix_secs", "chunk_index", "total_chunks",
    "previous_chunk_id", "next_chunk_id", "chunk_start_byte", "chunk_end_byte", "chunk_char_len", "chunk_text_sha256", "strategy_fingerprint", "chunk_text",
)
