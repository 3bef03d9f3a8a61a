"""What the operators share: tables, words, folders for written tables, and dealing rows in key order.

Written tables go to the folder that ``spark.checkpoint.dir`` names, which a cluster shares between the driver and
all executors; a table read again from there needs no lineage, so a lost executor costs one task and no recomputation.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: U+0020 and U+0009 to U+000D. bytes.split() without arguments splits at these six.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; only where that is unset and Spark runs on this machine alone, below its
    temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Files of a thin table: so many at least, or some for each core, or one for so many bytes of the tables that it comes from.
LEAST_FILES, FILE_BYTES = 24, 32 << 20
#: Folders of tables that this process has written, in order; drop() takes them out.
WRITTEN: list[str] = []


def written(df: DataFrame, label: str, thin: bool = False) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there. The table stays until drop().

    It gets a file a task. thin: a table of few bytes a row, which gets fewer; their number grows with the tables below.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    WRITTEN.append(path)
    if thin:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        below = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        files = max(LEAST_FILES, 4 * spark.sparkContext.defaultParallelism, below // FILE_BYTES)
        df = df.coalesce(int(min(files, (1 << 31) - 1)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing will read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


#: Most rows, and about the most bytes, of texts that go to a Python worker in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that long texts can't fill a worker. It only lowers its settings."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def unused_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def word_count(text: Column | str) -> Column:
    """Words of a text as a long; 0 for null. Splitting leaves at most an empty piece at either end."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.coalesce(text, F.lit("")), SPACES)
    ends = (F.element_at(pieces, 1) == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - ends).cast("long")


#: Slices of a key at most, as their bounds go to the driver and into a closure; beyond that slices get more rows.
MOST_SLICES = 20_000


class Slices:
    """Slices of rows in the order of an integer key, null first, and a hash of the row, each of about rows_per_slice rows.

    The bounds come from one aggregate over the key column alone. A key that would be the bound of several slices, as null or
    an id that very many rows share, gets slices of its own, among which its rows are dealt by the hash. Rows with equal key
    and hash always share a slice.
    """

    def __init__(self, df: DataFrame, key: str, rows_per_slice: int) -> None:
        n = df.count()
        slices = int(min(MOST_SLICES, max(1, -(-n // rows_per_slice))))
        found: list[int] = []
        if slices > 1:
            at = [i / slices for i in range(1, slices)]
            known = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST).cast("long"))
            found = [int(x) for x in df.select(F.percentile_approx(known, at, max(10_000, 20 * slices))).first()[0]]
        bounds, times = np.unique(np.array(found, np.int64), return_counts=True)
        self.bounds, self.own = bounds, np.where(times > 1, times, 0)  # own: slices of a bound's rows alone
        self.base = np.concatenate([[0], np.cumsum(1 + self.own)])
        self.count = int(self.base[-1]) + 1

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slices of rows: ascending with (key, hash)."""
        i = np.searchsorted(self.bounds, keys, side="left")
        out = self.base[i]
        if len(self.bounds):
            at = np.minimum(i, len(self.bounds) - 1)
            alone = (i < len(self.bounds)) & (self.bounds[at] == keys) & (self.own[at] > 0)
            share = (hashes.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1)
            out = out + np.where(alone, 1 + np.minimum((share * self.own[at]).astype(np.int64), self.own[at] - 1), 0)
        return out

    def column(self, key: Column, hashed: Column) -> Column:
        """The slice of each row; the closure holds the bounds only."""
        of = self.of

        @F.arrow_udf("int")
        def place(keys: pa.Array, hashes: pa.Array) -> pa.Array:
            return pa.array(of(longs(keys), longs(hashes)).astype(np.int32))

        return place(key, hashed)


_LEAST = -(1 << 63)


def longs(values: pa.Array) -> np.ndarray:
    """Whole numbers as longs; null is the least of them."""
    return values.cast(pa.int64()).fill_null(_LEAST).to_numpy(zero_copy_only=False)
