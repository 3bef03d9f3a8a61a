"""Token files: flat unsigned integers with 64-bit document offsets, read through memory maps.

Shard k holds the documents of one range of ids in ascending order, in two files:

* ``<k>.bin``: the ids of all its documents, one after the other, little-endian, of 16 or 32 bits as the vocabulary asks;
* ``<k>.idx``: the number of documents, their ids, which of those are not null (a byte each), and n + 1 offsets into the
  .bin file, in tokens; all but the bytes are 64-bit integers.

A table of shards goes with them; the place of a shard's first token among all tokens is the prefix sum over shards.

Rows with a null doc_id come first; rows that share one (or have none) are ordered by a hash of their text, then by it, so
that an id that very many rows share takes several shards. A null text is empty. An empty table gives no shards. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LongWord, Memo, WordTokenizer, byte_symbols
from .common import Slices, shared_folder, small_batches, table, written
from .files import open_map, whole_file

#: Bytes of what words gave that a worker keeps (see Memo).
REMEMBERED = 40 << 20
#: Documents of a shard, about.
SHARD_ROWS = 8192
SHARDS = "shard int, path string, dtype string, n_docs long, n_tokens long"


class LibraryEncoder:
    """Ids by the tokenizers library, as bytes of a dtype. Words of Latin-1 texts are encoded once while they recur.

    Normalised, such texts are their lower case, and their words are cut as the library cuts them; its model then gives a
    word the same ids by itself as within a text. Other texts go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.cut = WordTokenizer(path)
        self.dtype = "<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4"
        self._symbols = byte_symbols()
        self._memo = Memo(self._word, REMEMBERED)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self._symbols.__getitem__, word.encode()))
        return np.array([t.id for t in self.library.model.tokenize(symbols)], self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(text)
        word = self._memo.__getitem__
        return b"".join(
            np.array([special], self.dtype).tobytes()
            if special is not None
            else b"".join([self._word(words.whole().decode()) if isinstance(words, LongWord) else b"".join(map(word, words)) for words in self.cut.words(piece)])
            for piece, special in self.cut.pieces(text)
        )


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the token files of docs to folder and returns the table of shards, written too, with base_token added.

    end_id is appended to every document. There is one shuffle of the texts, by slices of the doc_id column.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slices = Slices(rows, "doc_id", shard_rows)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.withColumn("shard", slices.column(F.col("doc_id"), F.col("hash"))).repartitionById(slices.count, F.col("shard")).sortWithinPartitions("doc_id", "hash", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, ends, total, encoder = array("q"), bytearray(), array("Q", [0]), 0, library_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = len(end)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = first.column("shard")[0].as_py()
        path = f"{folder}/{shard:07d}"
        with whole_file(f"{path}.bin") as out:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    raw = encoder.encode(t.as_py()) + end
                    out.write(raw)
                    total += len(raw) // width
                    ids.append(i or 0)
                    known.append(i is not None)
                    ends.append(total)
                batch = next(batches, None)
        with whole_file(f"{path}.idx") as out:
            for values, kind in ((array("q", [len(ids)]), "<i8"), (ids, "<i8"), (ends, "<u8"), (known, "u1")):
                out.write(np.asarray(values).astype(kind, copy=False).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "dtype": [encoder.dtype], "n_docs": [len(ids)], "n_tokens": [total]})

    shards = written(dealt.select("shard", "doc_id", "text").mapInArrow(write, SHARDS), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return written(shards.withColumn("base_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))), "token-bases")


class TokenShard:
    """The documents of a shard through memory maps: len() of them, and (doc_id, start, ids) at a place."""

    def __init__(self, path: str, dtype: str) -> None:
        index = open_map(f"{path}.idx")
        n = int(np.frombuffer(index.read_at(8, 0), "<i8")[0])
        self.doc_ids = np.frombuffer(index.read_at(8 * n, 8), "<i8")
        self.ends = np.frombuffer(index.read_at(8 * (n + 1), 8 + 8 * n), "<u8").astype(np.int64)
        self.known = np.frombuffer(index.read_at(n, 16 + 16 * n), "u1")
        self.dtype = np.dtype(dtype)
        self._tokens = open_map(f"{path}.bin")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> tuple[int | None, int, np.ndarray]:
        a, b = int(self.ends[i]), int(self.ends[i + 1])
        ids = np.frombuffer(self._tokens.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)
        return (int(self.doc_ids[i]) if self.known[i] else None), a, ids


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that a table of shards names."""
    n = max(1, shards.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["path"], row["dtype"])
                if len(shard) != row["n_docs"] or int(shard.ends[-1]) != row["n_tokens"]:
                    raise ValueError(f"{row['path']} does not hold what its table says")
                crc = np.fromiter((zlib.crc32(shard[i][2].astype("<u4")) for i in range(len(shard))), np.int64, len(shard))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.known == 0), pa.array(shard.ends[:-1] + row["base_token"]), pa.array(np.diff(shard.ends)), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), 2, shared_folder(spark, "token-files"))
    return read_tokens(shards)
