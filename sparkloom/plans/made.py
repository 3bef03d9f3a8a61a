"""Queries over texts that are made from whole documents so that SQL knows where their blocks, declarations and sentences end.

What a parser has to find in such a text, SQL knows from how it was made: it has the slabs as a list, and cuts each as the
recursive chunker does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recursive import RecursiveConfig
from ..functions.text import WHITE_CHARS
from ..operators.code import LANGUAGES
from ..operators.routing import ChunkerConfig, bound_batches
from ..operators.semantic import SemanticConfig
from ..operators.sentences import sentences
from .inputs import documents
from .queries import chunks_cte, templated
from .registry import query

#: Stands in a template where a slab ends; it is no part of the text.
CUT = "\x1e"
#: For each language: how a comment begins; what stands before the comments, before the literals, between them, after them.
CODE = {
    "rust": ("//", f"use std::fmt;{CUT}\n", f"\n{CUT}fn a() {{ let c = '{{'; }}{CUT}\n{CUT}const B: &[&str] = &[\n  ", ",\n  ", f"\n];{CUT}\n{CUT}struct S {{ x: u8 }}{CUT}\n"),
    "python": ("#", "import os\n", f"\n{CUT}def f(x):\n    return [\n        ", ",\n        ", f"\n    ]{CUT}\n\n{CUT}class A:\n    pass{CUT}\n"),
    "javascript": ("//", "import a from 'a';\n", f"\n{CUT}function f(x) {{\n  return [\n    ", ",\n    ", f"\n  ];\n}}{CUT}\n\n{CUT}class A {{\n  g() {{ return '{{'; }}\n}}{CUT}\n"),
    "typescript": ("//", "import a from 'a';\n", f"\n{CUT}function f(x: number): string[] {{\n  return [\n    ", ",\n    ", f"\n  ];\n}}{CUT}\n\n{CUT}interface A {{ x: string }}{CUT}\n"),
    "tsx": ("//", "import a from 'a';\n", f"\n{CUT}function f(x: number): string[] {{\n  return [\n    ", ",\n    ", f"\n  ];\n}}{CUT}\n\n{CUT}function B() {{ return <p>it's</p>; }}{CUT}\n"),
    "go": ("//", 'package a\n\nimport "fmt"\n', f"\n{CUT}func f() []string {{\n\treturn []string{{\n\t\t", ",\n\t\t", f",\n\t}}\n}}{CUT}\n\n{CUT}type S struct {{ x int }}{CUT}\n"),
    "java": ("//", "import java.util.List;\n", f"\n{CUT}class A {{\n  String[] b = {{\n    ", ",\n    ", f"\n  }};\n  char c = '{{';\n}}{CUT}\n\n{CUT}interface B {{ void g(); }}{CUT}\n"),
    "c": ("//", "#include <stdio.h>\n", "\nconst char *a[] = {\n  ", ",\n  ", f"\n}};\n\n{CUT}int f(int x) {{ return '{{' + x; }}{CUT}\n"),
    "cpp": ("//", "#include <vector>\n", f"\n{CUT}namespace a {{\nconst char *b[] = {{\n  ", ",\n  ", f"\n}};\n}}{CUT}\n\n{CUT}class S {{ int x; }}{CUT};\n"),
    "ruby": ("#", "require 'set'\n", f"\n{CUT}def f\n  [\n    ", ",\n    ", f"\n  ]\nend{CUT}\n\n{CUT}class A\nend{CUT}\n"),
    "bash": ("#", "set -e\n", f"\n{CUT}f() {{\n  echo ", "\n  echo ", f'\n}}{CUT}\n\n{CUT}g() {{ echo "}}"; }}{CUT}\n'),
}
_NEWLINE = r"\r\n?|\n"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def slab_chunks(slabs: str, n: int, least: int = 0, whole: str = "") -> str:
    """SQL for the chunks of texts; slabs: a query of (doc_id, slab, slab_text), slabs of a text in order. whole: a condition for
    slabs of at most n characters that are one chunk, and its kind as a column."""
    key = "doc_id * 1000000 + slab AS doc_id"
    one = f"UNION ALL SELECT {key}, 0, whole, 0::BIGINT, strlen(slab_text), length(slab_text), slab_text FROM pieces WHERE {whole}" if whole else ""
    return f"""WITH RECURSIVE slabs AS ({slabs}),
pieces AS (SELECT *, coalesce(sum(strlen(slab_text)) OVER (PARTITION BY doc_id ORDER BY slab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM slabs),
{chunks_cte(n, least, f"SELECT {key}, slab_text AS text FROM pieces WHERE trim(slab_text, '{WHITE_CHARS}') <> ''{f' AND NOT ({whole})' if whole else ''}")},
found AS (SELECT doc_id, chunk_index, boundary, start_byte, end_byte, char_len, chunk_text FROM chunks {one})
SELECT p.doc_id, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.slab, f.chunk_index) - 1)::INT AS chunk_index, f.boundary, f.start_byte + p.base AS start_byte, f.end_byte + p.base AS end_byte, f.char_len, f.chunk_text
FROM found f JOIN pieces p ON f.doc_id = p.doc_id * 1000000 + p.slab"""


# code


def _code(language: str) -> Column:
    """Code that holds a document's whole text twice: each line as a comment, and each as a string literal."""
    mark, *rest = CODE[language]
    head, before, between, after = (x.replace(CUT, "") for x in rest)
    comments = F.regexp_replace("text", _NEWLINE, f"\n{mark} ")
    literals = F.regexp_replace(F.regexp_replace("text", r'([\\"])', r"\\$1"), _NEWLINE, f'"{between}"')
    return F.concat(F.lit(f"{head}{mark} "), F.col("doc_id").cast("string"), F.lit(f"\n{mark} "), comments, F.lit(f'{before}"'), literals, F.lit(f'"{after}'))


def _code_sql(language: str) -> str:
    """The slabs of such a text."""
    mark, head, before, between, after = CODE[language]
    comments = f"regexp_replace(text, '{_NEWLINE}', {_quoted(chr(10) + mark + ' ')}, 'g')"
    literals = f"""regexp_replace(regexp_replace(text, '([\\\\"])', '\\\\\\1', 'g'), '{_NEWLINE}', {_quoted('"' + between + '"')}, 'g')"""
    slabs: list[list[str]] = [[]]
    for kind, part in (("", f"{head}{mark} "), ("sql", "doc_id"), ("", f"\n{mark} "), ("sql", comments), ("", f'{before}"'), ("sql", literals), ("", f'"{after}')):
        first, *others = [part] if kind else part.split(CUT)
        slabs[-1].append(first if kind else _quoted(first))
        slabs += [[_quoted(x)] for x in others]
    return f"SELECT doc_id, unnest(range(1, {len(slabs) + 1})) AS slab, unnest([{', '.join(' || '.join(x) for x in slabs)}]) AS slab_text FROM documents WHERE text IS NOT NULL"


for _language in LANGUAGES:
    templated(f"code_chunks_{_language}", f"code:{_language}", partial(_code, _language), RecursiveConfig(512), slab_chunks(_code_sql(_language), 512))


# Markdown and sentences: a text's lines, of which letters, numbers and spaces are kept, and one before another kept line that
# has no letter is left out


def _lines() -> Column:
    bare = F.transform(F.split("text", _NEWLINE), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N} ]", "")))
    return F.filter(bare, lambda x: x.rlike(r"\p{L}"))


_LINES = f"""lines AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{_NEWLINE}'), lambda x: trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}} ]', '', 'g'))), lambda x: regexp_matches(x, '\\p{{L}}')) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM lines)"""


def _markdown() -> Column:
    """Headings of both kinds, paragraphs and code blocks in turns."""

    def block(line: Column, i: Column) -> Column:
        return F.when(i % 4 == 0, F.concat(F.lit("# "), line, F.lit("\n"))).when(i % 4 == 1, F.concat(line, F.lit("\n"))).when(i % 4 == 2, F.concat(F.lit("```\n"), line, F.lit("\n```\n"))).otherwise(F.concat(line, F.lit("\n---\n")))

    return F.array_join(F.transform(_lines(), block), "\n")


#: A slab ends with each block, and one begins with a heading.
_MARKDOWN_SQL = f"""WITH {_LINES},
blocks AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN '# ' || line || chr(10) WHEN 1 THEN line || chr(10) WHEN 2 THEN '```' || chr(10) || line || chr(10) || '```' || chr(10) ELSE line || chr(10) || '---' || chr(10) END AS block FROM numbered)
SELECT doc_id, 2 * i AS slab, CASE WHEN i > 0 AND i % 4 IN (0, 3) THEN chr(10) ELSE '' END AS slab_text FROM blocks
UNION ALL SELECT doc_id, 2 * i + 1, CASE WHEN i > 0 AND i % 4 IN (1, 2) THEN chr(10) ELSE '' END || block FROM blocks
UNION ALL SELECT doc_id, 0, '' FROM lines WHERE len(lines) = 0"""
#: A text without chunks has an empty one.
_EMPTY = "UNION ALL SELECT doc_id, 0, 'Forced', 0, 0, 0, '' FROM slabs GROUP BY doc_id HAVING max(slab_text) = ''"

templated("markdown_blocks", "markdown", _markdown, RecursiveConfig(512), f"{slab_chunks(_MARKDOWN_SQL, 512)} {_EMPTY}")


def _prose() -> Column:
    """A sentence of each line; each fifth ends a line."""

    def sentence(line: Column, i: Column) -> Column:
        stop = F.when(i % 3 == 0, ". ").when(i % 3 == 1, "! ").otherwise("? ")
        return F.concat(F.lit("S"), line, F.when(i % 5 == 4, ".\n").otherwise(stop))

    return F.array_join(F.transform(_lines(), sentence), "")


_PROSE = f"{_LINES}, said AS (SELECT doc_id, i, 'S' || line || CASE WHEN i % 5 = 4 THEN '.' || chr(10) ELSE CASE i % 3 WHEN 0 THEN '. ' WHEN 1 THEN '! ' ELSE '? ' END END AS s FROM numbered)"


@query("sentence_spans", f"WITH {_PROSE} SELECT doc_id, i::INT AS sentence, (sum(length(s)) OVER w - length(s))::INT AS start_char, (sum(length(s)) OVER w)::INT AS end_char FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY i)")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in sentences(t.as_py())] for t in texts], kind)

    made = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", _prose().alias("made"))
    rows = made.select("doc_id", F.posexplode_outer(spans("made")).alias("sentence", "s")).where("s IS NOT NULL")
    return rows.select("doc_id", "sentence", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


def by_parity(texts: list[str]) -> Sequence[Sequence[float]]:
    """Vectors by whether a text has an even number of characters: neighbours are equal, or at right angles."""
    return [[1.0, 0.0] if len(t) % 2 else [0.0, 1.0] for t in texts]


#: Sentences whose distance to the one before is above the percentile begin a group; small groups join the one before.
_GROUPS_SQL = f"""WITH {_PROSE},
apart AS (SELECT *, CASE WHEN i > 0 THEN (length(s) % 2 <> lag(length(s) % 2) OVER (PARTITION BY doc_id ORDER BY i))::INT::DOUBLE END AS distance FROM said),
told AS (SELECT *, coalesce(distance > quantile_cont(distance, 0.6) OVER (PARTITION BY doc_id), false) AS split FROM apart),
grouped AS (SELECT *, sum(split::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM told),
sized AS (SELECT doc_id, g, sum(length(s)) AS size FROM grouped GROUP BY ALL),
joined AS (SELECT doc_id, g, sum(CASE WHEN g = 0 OR size >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g)::BIGINT AS slab FROM sized)
SELECT doc_id, slab, string_agg(s, '' ORDER BY i) AS slab_text, CASE WHEN max(max(i)) OVER (PARTITION BY doc_id) = 0 THEN 'Forced' ELSE 'Paragraph' END AS whole FROM grouped JOIN joined USING (doc_id, g) GROUP BY doc_id, slab
UNION ALL SELECT doc_id, 0, '', 'Forced' FROM lines WHERE len(lines) = 0"""

templated(
    "semantic_blocks",
    "semantic",
    _prose,
    RecursiveConfig(512, 100),
    slab_chunks(_GROUPS_SQL, 512, 100, "length(slab_text) <= 512"),
    ChunkerConfig(RecursiveConfig(512, 100), "semantic", SemanticConfig(RecursiveConfig(512, 100), 60, "parity")),
    by_parity,
)
