"""Document quality by a generalised additive model with pairwise interactions (see gam) over counts of whole texts.

Features are computed beside the scan and written as a thin table. The model is fitted on the driver from at most
SAMPLE_ROWS labelled rows, the first in the order of a hash of their id; the scores of all rows are then table lookups.

Nulls: a null text counts as empty; empty texts get a score like any other. Labels that are null are not learnt from, nor
those of null ids, and a null id is not held out. A repeated row of labels or documents is learnt from once. An empty table gives an empty result, and
without labels to learn from every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam
from .common import small_batches, table, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "words", "word_length", "long_words", "distinct_words", "commonest_word", "repeated_neighbours", "repeated_windows", "lines", "line_words", "repeated_lines",
    "letters", "upper", "digits", "marks", "shouts", "symbols", "words_ending_in_marks", "other_bytes", "sentence_ends", "compressed",
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_MARKS = b".,;:?\"'()-"
_SYMBOLS = b"#*$%&|<>@^~_=+/\\[]{}`"
_DIGITS = b"0123456789"
_ASCII = bytes(range(128))
#: Upper-case letters of the Latin-1 supplement in UTF-8.
_UPPER_LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
#: Bytes that are compressed at a time.
PIECE = 1 << 16


def features(text: str | None) -> list[float]:
    """FEATURES of a text; shares of nothing are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    some, chars = max(n, 1), max(sum(map(len, words)), 1)
    of = lambda which: size - len(raw.translate(None, which))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    upper, lower = of(_UPPER) + len(_UPPER_LATIN.findall(raw)), of(_LOWER)
    other = size - of(_ASCII)
    packed = sum(len(zlib.compress(raw[at : at + PIECE], 1)) for at in range(0, size, PIECE))
    return [
        float(n),
        chars / some,
        sum(1 for w in words if len(w) > 18) / some,
        len(counts) / some**0.8,
        counts.most_common(1)[0][1] / some if n else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / some,
        1 - len(set(windows)) / max(len(windows), 1),
        float(len(lines)),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        (upper + lower + other / 2) / chars,
        upper / max(upper + lower, 1),
        of(_DIGITS) / chars,
        of(_MARKS) / some,
        of(b"!") / some,
        of(_SYMBOLS) / some,
        sum(1 for w in words if not w[-1:].isalnum() and w[-1:] < b"\x80") / some,
        other / chars,
        (raw.count(b". ") + raw.count(b".\n") + raw.count(b"? ") + raw.endswith(b".")) / some,
        packed / max(size, 1),
    ]


def features_udf():  # noqa: ANN201
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        values = np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))

    return of


def score_column(column: Column, model: gam.Gam) -> Column:
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.scores(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(FEATURES))))

    return score(column)


def fold(doc_id: Column) -> Column:
    """CRC-32 of an id in decimal, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(counted: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gam.Gam:
    """The model of a written table (doc_id, features) and labels (doc_id, label) outside the held-out fold."""
    usable = labels.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("label").cast("int").alias("label"))
    drawn = usable.select("doc_id", "label", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id", "label").limit(sample_rows)
    met = counted.join(F.broadcast(drawn), "doc_id").groupBy("draw", "doc_id", "label").agg(F.min("features").alias("features"))
    rows = sorted(met.collect(), key=lambda r: (r.draw, r.doc_id, r.label))  # at most sample_rows
    x = np.array([r.features for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return gam.fit(x, np.array([r.label for r in rows], np.float64))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    counted = written(docs.select("doc_id", features_udf()(F.col("text")).alias("features")), "text-features")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(counted, labels)
    scored = counted.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score_column(F.col("features"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
