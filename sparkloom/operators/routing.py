"""Which chunker a file gets, by its extension or for all files, and the chunks of a table of documents.

Documents that go to the native chunker are chunked by expressions; all others pass through one Arrow UDF. Both see each
text once, in one scan: either gets a null for the documents of the other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.recursive import RecursiveConfig, chunk_array
from ..functions.text import ascii_lower, routing_extension
from ..schema import CHUNK
from .code import LANGUAGES, code_fingerprint, split_code
from .markdown import markdown_fingerprint, split_markdown
from .semantic import Embedder, SemanticConfig, hashed_words, split_semantic
from .splitting import Chunk, split

# Extensions of each kind of file.
MARKDOWN = ("md", "markdown", "mdx")
CODE = {
    "rust": ("rs",),
    "python": ("py", "pyi"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts",),
    "tsx": ("tsx",),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "ruby": ("rb",),
    "bash": ("sh", "bash"),
}


def routes(semantic: bool = False) -> dict[str, str]:
    """Strategy by extension; semantic: Markdown files go to the semantic chunker."""
    prose = dict.fromkeys(MARKDOWN, "semantic" if semantic else "markdown")
    return prose | {e: f"code:{lang}" for lang, ends in CODE.items() for e in ends}


def router_fingerprint(table: dict[str, str]) -> str:
    """For diagnosis; documents carry the fingerprint of the chunker that they go to."""
    return "|".join(["router:v1", *(f"{e}=on" for e in sorted(table))])


@dataclass(frozen=True)
class ChunkerConfig:
    """single: one strategy for all files (recursive, markdown, semantic, code:LANGUAGE); without it files are routed.

    semantic: if given while routing, Markdown and files of no known kind are chunked by it.
    """

    sizes: RecursiveConfig = field(default_factory=RecursiveConfig)
    single: str | None = None
    semantic: SemanticConfig | None = None

    def __post_init__(self) -> None:
        known = ("recursive", "markdown", "semantic", *(f"code:{x}" for x in LANGUAGES))
        if self.single is not None and self.single not in known:
            raise LoomError("invalid input", f"unknown chunker: {self.single}")

    @property
    def semantic_config(self) -> SemanticConfig:
        return self.semantic or SemanticConfig(self.sizes)

    @property
    def strategies(self) -> list[str]:
        if self.single:
            return [self.single]
        table = routes(self.semantic is not None)
        return sorted({*table.values(), "semantic" if self.semantic else "recursive"})

    def fingerprint(self, strategy: str) -> str:
        if strategy == "recursive":
            return self.sizes.fingerprint
        if strategy == "markdown":
            return markdown_fingerprint(self.sizes)
        if strategy == "semantic":
            return self.semantic_config.fingerprint
        return code_fingerprint(strategy.removeprefix("code:"), self.sizes)

    @property
    def is_native(self) -> bool:
        """Whether the recursive strategy is said by expressions."""
        return self.sizes.metric == "chars" and not self.sizes.overlap


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def strategy_of(path: Column, config: ChunkerConfig) -> Column:
    if config.single:
        return F.lit(config.single)
    rest = "semantic" if config.semantic else "recursive"
    return F.coalesce(_lookup(routes(config.semantic is not None), ascii_lower(F.coalesce(routing_extension(path), F.lit("")))), F.lit(rest))


def chunk_text(text: str, strategy: str, config: ChunkerConfig, embed: Embedder = hashed_words) -> list[Chunk]:
    """The chunks of one text, in Python."""
    if strategy == "recursive":
        return split(text, config.sizes)
    if strategy == "markdown":
        return split_markdown(text, config.sizes)
    if strategy == "semantic":
        return split_semantic(text, config.semantic_config, embed)
    return split_code(text, strategy.removeprefix("code:"), config.sizes)


_MADE = f"struct<chunks:array<{CHUNK}>,kind:string,message:string>"
_CHUNK = pa.struct([("index", pa.int32()), ("text", pa.string()), ("boundary", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("char_len", pa.int64())])


def _chunk_udf(config: ChunkerConfig, embed: Embedder):  # noqa: ANN202
    @F.arrow_udf(_MADE)
    def chunks(texts: pa.Array, strategies: pa.Array) -> pa.Array:
        out = []
        for text, strategy in zip(texts, strategies, strict=True):
            try:
                out.append((chunk_text(text.as_py(), strategy.as_py(), config, embed) if text.is_valid else None, None, None))
            except Exception as e:  # noqa: BLE001  a document's error is a value of its row
                out.append((None, e.kind if isinstance(e, LoomError) else "internal", f"chunker failed: {e}"))
        kinds = [pa.list_(_CHUNK), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["chunks", "kind", "message"])

    return chunks


def with_chunks(docs: DataFrame, config: ChunkerConfig, text: str = "text", path: str = "canonical_path", embed: Embedder = hashed_words) -> DataFrame:
    """docs with strategy, strategy_fingerprint, chunks, error_kind and error_message.

    An empty text gives one empty Forced chunk, as does any other that a chunker finds nothing in; a null text gives none.
    An error of a chunker is told in the row, whose chunks are then null.
    """
    spark = docs.sparkSession
    if "strategy" not in docs.columns:
        docs = docs.withColumn("strategy", strategy_of(F.col(path), config))
    docs = docs.withColumn("strategy_fingerprint", _lookup({s: config.fingerprint(s) for s in config.strategies}, F.col("strategy")))
    t = F.col(text)
    native = config.is_native and "recursive" in config.strategies
    python = not native or len(config.strategies) > 1
    if native:
        docs = chunk_array(docs, F.when(F.col("strategy") == "recursive", t), config.sizes, "_native")
    if python:
        bound_batches(spark)
        mine = F.when(F.col("strategy") != "recursive", t) if native else t
        docs = docs.withColumn("_made", _chunk_udf(config, embed)(mine, F.col("strategy")))
    else:
        docs = docs.withColumn("_made", F.lit(None).cast(_MADE))
    made = F.coalesce(F.col("_native"), F.col("_made.chunks")) if native else F.col("_made.chunks")
    alone = F.array(F.struct(F.lit(0).alias("index"), t.alias("text"), F.lit("Forced").alias("boundary"), F.lit(0).cast("bigint").alias("start_byte"), F.octet_length(t).cast("bigint").alias("end_byte"), F.char_length(t).cast("bigint").alias("char_len")))
    chunks = F.when(t.isNotNull() & F.col("_made.kind").isNull() & (F.coalesce(F.size(made), F.lit(0)) < 1), alone).otherwise(made)
    return docs.withColumns({"chunks": chunks, "error_kind": F.col("_made.kind"), "error_message": F.col("_made.message")}).drop("_native", "_made")


def bound_batches(spark) -> None:  # noqa: ANN001
    """At most 256 texts in an Arrow batch; the session's setting is only lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 256:
        spark.conf.set(key, "256")
