"""Documents in, training sequences out. Each stage works on all rows that the one before it kept.

1. quality_rules: weak supervision takes out documents of poor quality.
2. line_dedup: passages that repeat across documents stay at their first occurrence only.
3. simhash_near_dedup: of documents whose fingerprints link and whose five-word shingles have a similarity of 0.8 or more, the
   one with the smallest id stays.
4. source_mixing: documents are repeated or left out, and one of a source is cut, to meet the sources' weights in words.
5. bpe_encoding: the rows as ids, with digests of the ids and of the text that they decode to.

All stages but the last return the columns of documents. Nulls, empty texts, ties, repeated rows, empty tables and other
columns are handled as the operators' modules say; columns beside those of documents pass through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe_codec, line_dedup, mixing, neardup, quality_rules
from sparkloom.llm.common import WRITTEN, drop, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def remove_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_representatives(docs, similarity=0.8, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(docs, str(public_tokenizers.path("byte_bpe_50k.json")), with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", remove_repeated),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: SQL can express neither fingerprints and their components nor tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's helper tables and its input go once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = len(WRITTEN)
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *helpers, result = WRITTEN[before:]
        drop(spark, [*helpers, *last])
        last = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
