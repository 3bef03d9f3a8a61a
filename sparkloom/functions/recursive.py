"""The recursive chunker for sizes in characters, without overlap, as native expressions.

A chunk ends at the last boundary of the strongest kind in its window of max_size characters: before an empty line, after
a line, after a sentence, after white space; else at the window's end. White space after a chunk is skipped. One regular
expression says this: its alternatives are the kinds, from strong to weak, each greedy, so the first that matches is the
strongest and its match the longest. Java's expressions count code points.

The kind of a chunk follows from its own end: whatever kind it was chosen as, it is the first whose condition holds there,
or a stronger kind would have been chosen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError
from .text import WHITE, normalize_newlines


@dataclass(frozen=True)
class RecursiveConfig:
    """metric: chars or tokens. A max_size of 0 gives no chunks. ranks: a file of cl100k_base's merge ranks, which is not part of
    this package; without it tokens are those of byte_bpe_50k."""

    max_size: int = 512
    min_size: int = 0
    overlap: int = 0
    metric: str = "chars"
    ranks: str | None = None

    def __post_init__(self) -> None:
        if self.metric not in ("chars", "tokens"):
            raise LoomError("config", f"unknown size metric: {self.metric}")
        if min(self.max_size, self.min_size, self.overlap) < 0:
            raise LoomError("invalid input", "sizes must not be negative")
        if self.min_size > self.max_size:
            raise LoomError("invalid input", f"min_size {self.min_size} is above max_size {self.max_size}")
        if self.max_size > 0 and self.overlap >= self.max_size:
            raise LoomError("invalid input", f"overlap {self.overlap} must be below max_size {self.max_size}")

    @property
    def tokenizer(self) -> str:
        return "chars" if self.metric == "chars" else "tiktoken:cl100k_base" if self.ranks else "bpe:byte_bpe_50k"

    @property
    def sizes(self) -> str:
        return f"max={self.max_size}|min={self.min_size}|overlap={self.overlap}"

    @property
    def fingerprint(self) -> str:
        return f"recursive:v1|metric={self.metric}|tokenizer={self.tokenizer}|{self.sizes}"


def _alternative(low: int, high: int, body: str) -> str:
    return body.replace("#", f"{{{low},{high}}}") if low <= high else "(?!)"


def pattern(config: RecursiveConfig) -> str:
    """One chunk in group 1, and with the white space after it the whole match."""
    n, least = config.max_size, config.min_size
    kinds = (
        _alternative(max(1, least), n - 2, r".#(?=\n\n)"),
        _alternative(max(0, least - 1), n - 1, r".#\n"),
        _alternative(max(0, least - 1), n - 2, r".#[.?!](?=[ \n])"),
        _alternative(max(0, least - 1), n - 1, r".#[ \t]"),
        _alternative(1, n, r".#"),
    )
    return f"(?s)({'|'.join(kinds)})[{WHITE}]*"


def boundary_kind(chunk: Column, after: Column, config: RecursiveConfig) -> Column:
    """The public kind of a chunk; after: the white space that was skipped behind it, at least its first two characters."""
    size, end, n = F.char_length(chunk), F.right(chunk, F.lit(1)), config.max_size
    kind = (
        F.when((size <= n - 2) & after.startswith("\n\n"), "Paragraph")
        .when(end == "\n", "Line")
        .when((size <= n - 1) & end.isin(".", "?", "!") & (after.startswith(" ") | after.startswith("\n")), "Line")
        .when(end.isin(" ", "\t"), "Whitespace")
        .otherwise("Forced")
    )
    return F.when(size < max(1, config.min_size), "Forced").otherwise(kind)


#: Numbers are summed in runs of 2 ** _RUN.
_RUN = 6


def running_starts(sizes: Column) -> Column:
    """For each of an array of whole numbers the sum of those before it.

    An accumulator that holds an array is copied at each step, so none is used: a sum is that of the runs before, and of the
    numbers before in its run; sums of runs come likewise from runs of runs. For n numbers that takes about 32 * n steps, and
    n * n / 2 ** 25 for the runs of runs.
    """
    size = 1 << _RUN

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))  # a name for a value that is worked out once

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + y)

    def runs(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.shiftright(F.size(x) - 1, _RUN))
        return F.transform(F.sequence(F.lit(0), last), lambda k: total(F.slice(x, F.shiftleft(k, _RUN) + 1, F.lit(size))))

    def starts(x: Column, of_runs: Column) -> Column:
        return F.transform(x, lambda _, i: F.get(of_runs, F.shiftright(i, _RUN)) + total(F.slice(x, i - i.bitwiseAND(F.lit(size - 1)) + 1, i.bitwiseAND(F.lit(size - 1)))))

    def from_runs(x: Column, r: Column) -> Column:
        rough = lambda rr: F.transform(rr, lambda _, i: total(F.slice(rr, F.lit(1), i)))
        return let(runs(r), lambda rr: let(rough(rr), lambda top: let(starts(r, top), lambda at: starts(x, at))))

    return let(sizes, lambda x: let(runs(x), lambda r: from_runs(x, r)))


def with_pieces(df: DataFrame, text: Column, config: RecursiveConfig, out: str) -> DataFrame:
    """df with an array column of (text, piece, start) structs: each chunk, the same with the white space after it, and its
    byte offset in the normalised text."""
    if config.metric != "chars" or config.overlap:
        raise LoomError("invalid input", "the native chunker counts characters, without overlap")
    if config.max_size == 0:
        return df.withColumn(out, F.array().cast("array<struct<text:string,piece:string,start:bigint>>"))
    p = F.lit(pattern(config))
    df = df.withColumn(f"{out}_t", normalize_newlines(text))
    df = df.withColumns({f"{out}_p": F.regexp_extract_all(f"{out}_t", p, F.lit(0)), f"{out}_c": F.regexp_extract_all(f"{out}_t", p, F.lit(1))})
    df = df.withColumn(f"{out}_s", running_starts(F.transform(f"{out}_p", F.octet_length)))
    zipped = F.arrays_zip(F.col(f"{out}_c").alias("text"), F.col(f"{out}_p").alias("piece"), F.col(f"{out}_s").alias("start"))
    return df.withColumn(out, zipped).drop(*(f"{out}_{x}" for x in "tpcs"))


def chunk_fields(piece: Column, config: RecursiveConfig) -> dict[str, Column]:
    """The columns of a chunk from one struct of with_pieces."""
    chunk = piece["text"]
    after = F.substr(piece["piece"], F.char_length(chunk) + 1, F.lit(2))
    return {
        "boundary": boundary_kind(chunk, after, config),
        "start_byte": piece["start"],
        "end_byte": piece["start"] + F.octet_length(chunk),
        "char_len": F.char_length(chunk).cast("bigint"),
        "chunk_text": chunk,
    }


def chunk_rows(df: DataFrame, text: Column, config: RecursiveConfig, keep: list[str]) -> DataFrame:
    """One row a chunk: the kept columns, chunk_index, boundary, start_byte, end_byte, char_len and chunk_text."""
    made = with_pieces(df.select(*(f"`{c}`" for c in keep), text.alias("_text")), F.col("_text"), config, "_pieces")
    # the outer form, as Spark infers a filter for the other one that would chunk each text once more
    rows = made.select(*(f"`{c}`" for c in keep), F.posexplode_outer("_pieces").alias("chunk_index", "_piece")).where(F.col("_piece").isNotNull())
    return rows.select(*(f"`{c}`" for c in keep), "chunk_index", *(v.alias(k) for k, v in chunk_fields(F.col("_piece"), config).items()))


def chunk_array(df: DataFrame, text: Column, config: RecursiveConfig, out: str) -> DataFrame:
    """df with an array column of chunks as schema.CHUNK has them."""
    made = with_pieces(df, text, config, f"{out}_pieces")

    def struct(piece: Column, i: Column) -> Column:
        c = chunk_fields(piece, config)
        return F.struct(i.alias("index"), c["chunk_text"].alias("text"), *(c[k].alias(k) for k in ("boundary", "start_byte", "end_byte", "char_len")))

    return made.withColumn(out, F.transform(f"{out}_pieces", struct)).drop(f"{out}_pieces")
