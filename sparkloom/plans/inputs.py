"""The driver's tables as inputs of ingestion: documents as files, events as observations of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes on disk of a table that is dealt to all cores, at least.
SPREAD_FROM = 4 << 20


def _row_groups(spark: SparkSession, files: list[str]) -> int:
    """Row groups of some Parquet files, from their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for file in files:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf))
        try:
            total += reader.getRowGroups().size()
        finally:
            reader.close()
    return total


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. A row group is read by one task, and chunking costs far more than dealing rows out: a table that has
    fewer row groups than there are cores is dealt to all of them. Any other is not shuffled; footers are read only of a table
    with fewer files than cores."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPREAD_FROM:
        return docs
    files = docs.inputFiles()
    return docs.repartition(2 * cores) if len(files) < cores and _row_groups(spark, files) < cores else docs


def path_column() -> Column:
    """A path for a document, of one of eight shapes by its id."""
    d, s = F.col("doc_id").cast("string"), F.col("source")
    shapes = [
        F.concat(F.lit("/"), s, F.lit("/"), d, F.lit(".md")),
        F.concat(F.lit("/"), s, F.lit("/"), d, F.lit(".RS")),
        F.concat(F.lit("D:\\"), s, F.lit("\\"), d, F.lit(".txt")),
        F.concat(F.lit("/"), s, F.lit("/"), d),
        F.concat(F.lit("/"), s, F.lit("/"), d, F.lit("/.gitignore")),
        F.concat(F.lit("/"), s, F.lit("/"), d, F.lit(".tar.gz")),
        F.concat(s, F.lit("/"), d, F.lit(".Py")),
        F.concat(F.lit("/"), s, F.lit("/"), d, F.lit(".")),
    ]
    out = shapes[-1]
    for i, shape in reversed(list(enumerate(shapes[:-1]))):
        out = F.when(F.col("doc_id") % 8 == i, shape).otherwise(out)
    return out


PATH_SQL = r"""CASE doc_id % 8
 WHEN 0 THEN '/' || source || '/' || doc_id || '.md' WHEN 1 THEN '/' || source || '/' || doc_id || '.RS'
 WHEN 2 THEN 'D:\' || source || '\' || doc_id || '.txt' WHEN 3 THEN '/' || source || '/' || doc_id
 WHEN 4 THEN '/' || source || '/' || doc_id || '/.gitignore' WHEN 5 THEN '/' || source || '/' || doc_id || '.tar.gz'
 WHEN 6 THEN source || '/' || doc_id || '.Py' ELSE '/' || source || '/' || doc_id || '.' END"""


def document_files(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """documents as files: canonical_path, size_bytes, mtime_unix_secs, text, doc_id. plain: all are text files."""
    docs = documents(spark, sf_dir)
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")) if plain else path_column()
    return docs.select("doc_id", path.alias("canonical_path"), F.octet_length("text").cast("long").alias("size_bytes"), (1_700_000_000 + F.col("doc_id")).alias("mtime_unix_secs"), "text")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of files, in the order of seq: few versions of each path, so that they come back."""
    events = table(spark, sf_dir, "events")
    size = F.coalesce(F.floor(F.abs("value")), F.lit(0)).cast("long") % 3
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400) * 86400
    return events.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("canonical_path"), size.alias("size_bytes"), day.cast("long").alias("mtime_unix_secs"), F.col("event_id").alias("seq"))


OBSERVATIONS_SQL = """SELECT '/u/' || user_id AS canonical_path, coalesce(floor(abs(value)), 0)::BIGINT % 3 AS size_bytes,
 (floor(epoch(ts) / 86400) * 86400)::BIGINT AS mtime_unix_secs, event_id AS seq FROM events"""
