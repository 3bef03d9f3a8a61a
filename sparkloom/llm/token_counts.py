"""Token counts of texts, by a compiled transducer (see transducer).

Nulls: a null text has 0 bytes and 0 tokens, as an empty one. Each row is counted for itself: repeated rows get equal
counts, whatever their ids, and null ids stay. An empty table gives an empty result; other columns are not read, whatever
their names. A text of any length is counted in chunks, whose maps are composed. Special strings inside a text count as one token each, as the library has it by default.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .transducer import counter


def token_count(text: Column | str, tokenizer: str) -> Column:
    """The number of tokens of a text column as a long. tokenizer: a path that every executor can read."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        tokens = counter(tokenizer).count
        return pa.array([tokens(t.as_py()) for t in texts], pa.int64())

    return count(text)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(F.col("text"), str(public_tokenizers.path("word_bpe_49k.json"))).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
