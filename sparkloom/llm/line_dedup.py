"""Removes passages that repeat across documents, as content-defined chunks of lines.

A line here ends at a newline, or at a sentence end with a space after it, so that a passage inside a long line has lines
of its own. Each line has a hash, and a chunk the rolling hash of its lines' hashes. Each line starts a chunk, the fewest
lines from it on that have LEAST_WORDS words, and each line ends one, the fewest lines up to it that have as many. A chunk
depends on its own lines only, so a passage is cut alike wherever it stands, and the chunks inside it cover it from its
first line to its last: a passage of LEAST_WORDS words in whole lines leaves no line. (Boundaries that a rolling hash
chooses leave the lines before the first and after the last of them; see the README for figures.) A text of fewer words is
one chunk, so the chunks tile any text with words, and an exact copy leaves nothing.
A chunk that occurs again anywhere is removed everywhere but at its first occurrence, by (doc_id, position). Every removed
line stays in some document: the one with the first occurrence of its chunk, or one before that.

1. Beside the scan, each document gives the different hashes of its chunks; this thin table is written.
2. Hashes that occur in two rows get their first doc_id by a partial aggregate, and meet their rows in a join of two written
   tables, in which hot hashes are split.
3. Each document meets the hashes that it shares in the one shuffle of the texts; the result is written.
4. Byte comparison: the bytes of all shared chunks are grouped by (hash, bytes), with a partial aggregate. Where a hash has
   two different byte strings, its occurrences are decided by these groups instead.
5. Repeats within a text are found in the text itself, by their bytes.

Nulls: a null text stays null. A row with a null doc_id takes part; null comes before all ids, and counts as the least long.
Rows with one doc_id (or none) count as one document: none loses a passage to another, whatever their texts. Their hashes
are kept apart by a hash of the text, so that an id or null that many rows share is spread over tasks.
All columns pass through; an empty table gives an empty one. A line of any length costs a hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, drop, small_batches, table, unused_name, written

#: A chunk has the fewest lines with so many words.
LEAST_WORDS = 10

_hash = xxhash.xxh64_intdigest
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
#: The base of the rolling hash, an odd number, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 16:  # those of longer texts aren't kept
            _powers[base] = have
    return have[:n]


class Texts:
    """The lines and chunks of a batch of texts, which lie one after the other in data; null texts are empty.

    bounds: where texts begin, and the end of the last. starts, ends: of all lines; lines_of: the first line of each text,
    and the number of all. first, stop: lines of each chunk, in order; chunks_of: the first chunk of each text, and the
    number of all. hashes: signed and even, the last bit is free.
    """

    def __init__(self, texts: pa.Array, bits: int = 63) -> None:
        texts = texts.cast(pa.large_string())  # offsets of a text are longs, whatever came
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        self.data = memoryview(data)[int(bounds[0]) : int(bounds[-1])] if data is not None else memoryview(b"")
        self.bounds = bounds = bounds - bounds[0]
        self.n, self.known = len(texts), texts.is_valid().to_numpy(zero_copy_only=False)
        b = np.frombuffer(self.data, np.uint8)
        at_end = b == 10
        at_end[1:] |= (b[1:] == 32) & _STOP[b[:-1]]
        filled = bounds[1:] > bounds[:-1]
        at_end[bounds[1:][filled] - 1] = True
        self.ends = np.flatnonzero(at_end) + 1
        self.starts = np.concatenate([[0], self.ends])[:-1]
        self.lines_of = np.searchsorted(self.ends, bounds, "right")
        self._cut(b, bits)

    def _cut(self, b: np.ndarray, bits: int) -> None:
        n, bounds, lines_of = len(self.ends), self.bounds, self.lines_of
        if n:
            space = _SPACE[b]
            begins = ~space
            begins[1:] &= space[:-1]
            begins[bounds[:-1][bounds[:-1] < bounds[1:]]] |= ~space[bounds[:-1][bounds[:-1] < bounds[1:]]]
            counts = np.add.reduceat(begins, self.starts, dtype=np.int64)
        else:
            counts = np.zeros(0, np.int64)
        words = np.concatenate([[0], np.cumsum(counts)])
        of_text = np.diff(words[lines_of])
        line = np.arange(n)
        text = np.repeat(np.arange(self.n), np.diff(lines_of))
        stop = np.searchsorted(words, words[:-1] + LEAST_WORDS)
        start = np.searchsorted(words, words[1:] - LEAST_WORDS, "right") - 1
        from_each, to_each = stop <= lines_of[1:][text], start >= lines_of[:-1][text]
        short = np.flatnonzero((of_text > 0) & (of_text < LEAST_WORDS))  # a copy of a short text goes too; one without words stays
        pairs = [(line * (n + 1) + stop)[from_each], (start * (n + 1) + line + 1)[to_each], lines_of[short] * (n + 1) + lines_of[short + 1]]
        self.first, self.stop = np.divmod(np.unique(np.concatenate(pairs)), n + 1)
        self.chunks_of = np.searchsorted(self.first, lines_of)
        lines = np.array([_hash(self.data[a:e]) for a, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines * _powers_of(_BASE, n), dtype=np.uint64)])
        rolled = (sums[self.stop] - sums[self.first]) * _powers_of(_INVERSE, n)[self.first]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(_BASE)
        self.hashes = (rolled >> np.uint64(64 - bits) << np.uint64(1)).view(np.int64)

    def raw(self, t: int) -> bytes:
        return self.data[self.bounds[t] : self.bounds[t + 1]].tobytes()

    def own(self, t: int) -> slice:
        """The chunks of a text."""
        return slice(self.chunks_of[t], self.chunks_of[t + 1])

    def bytes(self, i: int) -> bytes:
        return self.data[self.starts[self.first[i]] : self.ends[self.stop[i] - 1]].tobytes()

    def repeated(self) -> np.ndarray:
        """Which chunks have bytes that occur before in their text."""
        text = np.repeat(np.arange(self.n), np.diff(self.chunks_of))
        order = np.lexsort((np.arange(len(text)), self.hashes, text))
        h, t = self.hashes[order], text[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        out = np.zeros(len(order), bool)
        seen: set[bytes] = set()
        for k in np.flatnonzero(same[:-1] | same[1:]).tolist():
            if not same[k]:
                seen = set()
            own = self.bytes(int(order[k]))
            out[order[k]] = own in seen
            seen.add(own)
        return out

    def spans(self, marks: pa.Array, again: pa.Array) -> list[list[tuple[int, int]]]:
        """By text the spans of bytes to remove, from its start on, joined where they touch: chunks whose hash is marked (its
        last bit set), whose bytes are among those of again, or whose bytes occur before in the text."""
        gone = self.repeated()
        for t in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
            m = marks[t].values.to_numpy()
            gone[self.own(t)] |= np.isin(self.hashes[self.own(t)], m[m & 1 == 1] & ~1)
        for t in np.flatnonzero(again.is_valid().to_numpy(zero_copy_only=False)).tolist():
            wanted = set(again[t].as_py())
            for i in range(*self.own(t).indices(len(gone))):
                gone[i] |= self.bytes(i) in wanted
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        at = np.flatnonzero(gone)
        if not len(at):
            return out
        a, b, t = self.first[at], np.maximum.accumulate(self.stop[at]), np.searchsorted(self.chunks_of, at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (a[1:] > b[:-1]) | (t[1:] != t[:-1])]))
        last = np.concatenate([new[1:], [len(at)]]) - 1
        base = self.bounds[t[new]]
        for k, x, y in zip(t[new].tolist(), (self.starts[a[new]] - base).tolist(), (self.ends[b[last] - 1] - base).tolist(), strict=True):
            out[k].append((x, y))
        return out


def hashes_udf(bits: int = 63):  # noqa: ANN201
    """The different hashes of a text's chunks."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        found = Texts(texts, bits)
        text = np.repeat(np.arange(found.n), np.diff(found.chunks_of))
        order = np.lexsort((found.hashes, text))
        h, t = found.hashes[order], text[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(t[keep], minlength=found.n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keep]))

    return of


def _bytes_udf(bits: int, each: bool = False):  # noqa: ANN202
    """The chunks of a text that have one of some hashes, as (hash, bytes); each once in a batch of texts, or in a text."""

    @F.arrow_udf("array<struct<h:bigint,bytes:binary>>")
    def of(texts: pa.Array, shared: pa.Array) -> pa.Array:
        found, seen, out = Texts(texts, bits), set(), []
        for t in range(found.n):
            row, own = [], found.own(t)
            if each:
                seen = set()
            for i in (own.start + np.flatnonzero(np.isin(found.hashes[own], shared[t].values.to_numpy() & ~1))).tolist():
                key = int(found.hashes[i]), found.bytes(i)
                if key not in seen:
                    seen.add(key)
                    row.append({"h": key[0], "bytes": key[1]})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("bytes", pa.binary())])))

    return of


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without some spans, which are ascending and apart."""
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _in_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not spans or raw.isascii():
        return spans
    places = [0, *(x for s in spans for x in s)]
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    at = np.cumsum([int(np.count_nonzero(begins[a:b])) for a, b in zip(places, places[1:], strict=False)])
    return [tuple(x) for x in at.reshape(-1, 2).tolist()]


def _kept_udf(bits: int):  # noqa: ANN202
    """What is left of each text, and whether anything is gone. Called non-deterministic, so that filters on the result don't
    have it computed once more below them."""

    @F.arrow_udf("struct<text:string,changed:boolean>")
    def of(texts: pa.Array, marks: pa.Array, again: pa.Array) -> pa.Array:
        found = Texts(texts, bits)
        spans = found.spans(marks, again)
        kept = [without(found.raw(t), spans[t]) if known else None for t, known in enumerate(found.known.tolist())]
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())], names=["text", "changed"])

    return of.asNondeterministic()


def _digest_udf(bits: int):  # noqa: ANN202
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [("n_lines", pa.int32()), ("n_removed_lines", pa.int32()), ("n_removed_chars", pa.int32()), ("kept_sha256", pa.string()), ("removed", kind)]

    @F.arrow_udf("struct<n_lines:int,n_removed_lines:int,n_removed_chars:int,kept_sha256:string,removed:array<struct<start:int,end:int>>>")
    def of(texts: pa.Array, marks: pa.Array, again: pa.Array) -> pa.Array:
        found, rows = Texts(texts, bits), []
        for t, gone in enumerate(found.spans(marks, again)):
            raw = found.raw(t)
            edges = np.searchsorted(found.ends, np.array(gone, np.int64).ravel() + found.bounds[t], "right").reshape(-1, 2)
            spans = _in_characters(raw, gone)
            rows.append((int(found.lines_of[t + 1] - found.lines_of[t]), int((edges[:, 1] - edges[:, 0]).sum()), sum(b - a for a, b in spans), hashlib.sha256(without(raw, gone)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return of


def _met(docs: DataFrame, doc_id: str, text: str, bits: int) -> tuple[DataFrame, Column, Column]:
    """A written table of docs, and two columns beside it: hashes of shared chunks, those to remove with their last bit set,
    and the bytes of chunks to remove of which the hashes do not decide. Helper tables go as soon as their readers are written."""
    spark, before = docs.sparkSession, len(WRITTEN)
    small_batches(spark)
    names = {c: unused_name(docs, f"dedup_{c}") for c in ("id", "salt", "marks", "again")}
    least = F.lit(-(1 << 63)).cast("long")
    keyed = docs.withColumns({names["id"]: F.coalesce(F.col(f"`{doc_id}`").cast("long"), least), names["salt"]: F.hash(F.col(f"`{text}`"))})
    key = [F.col(names["id"]).alias("id"), F.col(names["salt"]).alias("salt")]
    thin = written(keyed.select(*key, hashes_udf(bits)(F.col(f"`{text}`")).alias("hashes")), "chunk-hashes")
    one = thin.select("id", "salt", F.explode("hashes").alias("h"))
    firsts = one.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "least")
    firsts = written(firsts, "repeated-chunks", thin=True)
    marked = one.join(firsts, "h").select("id", "salt", F.when(F.col("id") == F.col("least"), F.col("h")).otherwise(F.col("h").bitwiseOR(F.lit(1).cast("long"))).alias("m"))
    marks = marked.groupBy("id", "salt").agg(F.collect_set("m").alias("marks"))
    marks = written(marks, "shared-chunks", thin=True).withColumnsRenamed({k: names[k] for k in ("id", "salt", "marks")})
    drop(spark, WRITTEN[before:-1])
    met = written(keyed.join(marks, [names["id"], names["salt"]], "left"), "documents-met")
    drop(spark, WRITTEN[before:-1])

    found, t = F.col(names["marks"]), F.col(f"`{text}`")
    shared = met.where(F.size(found) > 0)
    seen = shared.select(F.explode(_bytes_udf(bits)(t, found)).alias("c")).select("c.*")
    different = seen.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("times")).groupBy("h").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1").select("h")
    different = written(different, "different-bytes", thin=True)
    if different.isEmpty():
        drop(spark, WRITTEN[before + 1 :])
        return met, found, F.lit(None).cast("array<binary>")
    # hashes that different bytes share: first occurrences by their bytes
    exact = shared.select(*key, F.explode(_bytes_udf(bits, each=True)(t, found)).alias("c")).select("id", "salt", "c.*").join(different, "h", "left_semi")
    exact = written(exact, "exact-chunks")
    by_bytes = written(exact.groupBy("h", "bytes").agg(F.min("id").alias("least")), "firsts-by-bytes", thin=True)
    told = exact.join(by_bytes, ["h", "bytes"]).groupBy("id", "salt").agg(F.collect_set("h").alias("undecided"), F.collect_set(F.when(F.col("id") != F.col("least"), F.col("bytes"))).alias("again"))
    told = written(told, "decided-by-bytes", thin=True).withColumnsRenamed({"id": names["id"], "salt": names["salt"], "again": names["again"]})
    undecided = unused_name(met, "undecided")
    met = met.join(told.withColumnRenamed("undecided", undecided), [names["id"], names["salt"]], "left")
    sure = F.when(F.col(undecided).isNull(), found).otherwise(F.filter(found, lambda m: ~F.array_contains(F.col(undecided), m.bitwiseAND(F.lit(-2).cast("long")))))
    met = written(met.withColumn(names["marks"], sure).drop(undecided), "documents-decided")
    drop(spark, WRITTEN[before:-1])
    return met, F.col(names["marks"]), F.col(names["again"])


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 63) -> tuple[DataFrame, str]:
    """docs with a struct column, and its name: lines, lines and characters removed, SHA-256 of what is kept, and the removed
    spans in characters, apart and in order.

    bits: of the hashes, fewer only to test how equal hashes of different chunks are told apart.
    """
    name = unused_name(docs, "removal")
    met, marks, again = _met(docs, doc_id, text, bits)
    return met.select(*(f"`{c}`" for c in docs.columns), _digest_udf(bits)(F.col(f"`{text}`"), marks, again).alias(name)), name


def remove_repeated(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs without the repeated passages, its n_chars column, if any, set anew where a text changes; rows that lose all
    their words are left out, since others hold them."""
    met, marks, again = _met(docs, "doc_id", text, 63)
    new = unused_name(met, "kept")
    cut = met.withColumn(new, _kept_udf(63)(F.col(f"`{text}`"), marks, again))
    changed, kept = F.col(f"{new}.changed"), F.col(f"{new}.text")
    cut = cut.where(~changed | kept.rlike(r"[^\x20\x09-\x0D]"))
    out: list[Column] = []
    for c in docs.columns:
        if c == text:
            out.append(kept.alias(c))
        elif c == n_chars:
            out.append(F.when(changed, F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return cut.select(*out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines and characters removed, SHA-256 of what is kept, and the removed spans in characters."""
    marked, name = removed_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", f"{name}.*")
