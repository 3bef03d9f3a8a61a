"""Mixes sources to target weights, exactly and alike in every run.

Each source has a budget of words. Its documents are ordered by a random key, the hash of id and text, and taken whole for
every epoch that the budget holds; the last epoch stops where a running sum of words in key order reaches the rest, so
one document of a source may be cut.

The running sums are distributed: keys are uniform, so equal slices of the key range hold equal shares of every source,
however large. A table of words by (source, slice) gives each slice its start; within a slice sums run beside each other.
Sums and budgets are whole numbers. One row a source reaches the driver, where weights are shared out.

Nulls: a null text has no words, null and "" are different sources, a null source is the last. Documents without words
take nothing. Rows that share a doc_id (or have none) are told apart by a hash of their text, which the key covers, too; equal
ones are alike, so that ties change no sum. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused_name, word_count, written

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = Fraction(3, 2), 2
#: Documents of a slice of the key range, about; slices are a power of two.
SLICE_ROWS = 2048


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = MOST_EPOCHS) -> dict[str | None, Fraction]:
    """Words to take from each source.

    Sources in order of code points, null last, weigh as weights repeat, and share out share times all words; none gets
    more than epochs times its own, and what is over is shared out among the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, Fraction] = {}
    rest, open_ = share * sum(sizes.values()), list(names)
    while open_:
        each = Fraction(rest) / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > epochs * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(epochs * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = MOST_EPOCHS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, text_hash) for each document; taken counts repeats."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    rows = written(rows.withColumn("key", F.xxhash64("doc_id", "text_hash", F.lit("mixing"))), "document-sizes")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    goal = targets({s: n for s, (n, _) in sizes.items()}, weights, share, epochs)
    plan = []
    for s, (n, _) in sizes.items():
        whole, rest = divmod(int(goal[s]), n) if n else (0, 0)
        plan.append((s, n, float(goal[s]), whole, rest))
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole long, rest long")

    bits = max(8, (sum(c for _, c in sizes.values()) // SLICE_ROWS).bit_length())
    part = F.shiftright(F.col("key"), 64 - bits)  # a signed number, ascending with the key
    sliced = rows.withColumn("part", part)
    starts = sliced.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = written(starts, "slice-starts", thin=True)
    within = Window.partitionBy("part", "source").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = sliced.repartition(F.col("part")).withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = summed.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("ahead", F.col("ahead") + F.col("start")).drop("s", "p", "start", "part", "key").withColumnRenamed("source", "of")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return placed.join(plan, F.col("of").eqNullSafe(F.col("source"))).select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + last).cast("long").alias("taken"), "text_hash")


def mix(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mixed documents: each row of docs as often as it is taken whole, and once more, cut after a word, for the rest.

    All columns are kept and n_chars, if there is one, is that of the cut text. Rows without words are taken by no source.
    Rows of one id, source and text are alike: each is taken as the mixture has that of them that it takes most of.
    """
    took, size, cut, of_id, of_source, of_text = (unused_name(docs, f"mixing_{c}") for c in ("taken", "size", "cut", "id", "source", "text"))
    hashed = unused_name(docs, "mixing_hash")  # a column of its own: a join key that is an expression is worked out again and again
    decided = mixture(docs, **options).where("taken > 0").select(F.col("doc_id").alias(of_id), F.col("size").alias(size), F.col("source").alias(of_source), F.col("text_hash").alias(of_text), F.col("taken").alias(took))
    decided = written(decided.groupBy(of_id, of_source, of_text, size).agg(F.max(took).alias(took)), "mixture", thin=True)
    # a merge join at every size: texts are shuffled alike, and hot keys are split
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(hashed) == F.col(of_text))
    met = docs.withColumn(hashed, F.xxhash64(F.col("text"))).join(decided.hint("merge"), same)
    whole, rest = F.floor(F.col(took) / F.col(size)).cast("int"), F.col(took) % F.col(size)
    cuts = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    copies = met.withColumn(cut, F.explode(cuts))
    spaces = F.lit(" \t\n\x0b\x0c\r")
    words = F.split(F.ltrim(F.col("text"), spaces), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each with the space after it
    text = F.when(F.col(cut) == 0, F.col("text")).otherwise(F.rtrim(F.array_join(F.slice(words, 1, F.col(cut).cast("int")), ""), spaces))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(cut) == 0, F.col(c)).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return copies.select(*out)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, words, target (to three places) and words taken."""
    rows = mixture(table(spark, sf_dir, "documents"))
    of_source = [F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.round(F.first("target"), 3).alias("target"), F.sum("taken").alias("taken")]
    return rows.groupBy("source").agg(*of_source)


#: The level at which weights fill up sources that hold so much each is the highest of those that any number of the smallest
#: sources by weight, taken as full, would give.
MIXING_TOTALS_SQL = """
WITH sized AS (
  SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM documents
), s AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), r AS (
  SELECT *, sum(2 * source_size) OVER o AS full_words, sum(weight) OVER () - sum(weight) OVER o AS open_weight, 1.5 * sum(source_size) OVER () AS words FROM w
  WINDOW o AS (ORDER BY 2 * source_size / weight, source ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max(level) AS level FROM (SELECT (words - full_words) / open_weight AS level FROM r WHERE open_weight > 0 UNION ALL SELECT any_value(words) / sum(weight) FROM r)
)
SELECT source, n_docs, source_size, round(least(2.0 * source_size, level * weight), 3)::DOUBLE AS target, floor(least(2.0 * source_size, level * weight) + 1e-6)::BIGINT AS taken FROM r, l
"""
