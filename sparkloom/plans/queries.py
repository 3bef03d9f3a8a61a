"""Queries over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import file_version_id
from ..functions.recursive import RecursiveConfig, chunk_rows
from ..functions.text import WHITE_CHARS, file_uri, normalize_newlines, payload_extension, point_id_errors, utf8_text
from ..functions.vectors import merge_small_groups, neighbour_distances, semantic_groups
from ..operators import planning, summary
from ..operators.code import declarations, tiles
from ..operators.embedding import LocalProvider
from ..operators.points import join_vectors, point_rows, with_vectors
from ..operators.routing import ChunkerConfig, bound_batches, router_fingerprint, routes, strategy_of, with_chunks
from ..operators.semantic import Embedder, SemanticConfig, hashed_words
from ..operators.sentences import sentences
from ..operators.splitting import normalized
from .inputs import OBSERVATIONS_SQL, PATH_SQL, document_files, documents, observations, table
from .registry import ORACLES, QUERIES, query

# chunks


#: The columns of the only chunk of a text without chunks.
_ALONE = "0, 'Forced', 0::BIGINT, 0::BIGINT, 0::BIGINT, ''"


def chunks_cte(n: int, least: int = 0, texts: str = "SELECT doc_id, text FROM documents", alone: bool = False) -> str:
    """A recursive table chunks (doc_id, chunk_index, boundary, start_byte, end_byte, char_len, chunk_text). alone: an empty text
    has one empty chunk."""
    enough = lambda x: f"length({x}) >= {max(1, least)}"
    return f"""texts AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM ({texts}) WHERE text <> ''),
steps AS (
  SELECT doc_id, -1 AS chunk_index, '' AS boundary, 0::BIGINT AS start_byte, '' AS chunk_text, t AS rest, 0::BIGINT AS next_byte FROM texts
  UNION ALL
  SELECT doc_id, chunk_index + 1, kind, next_byte, ch, after, next_byte + strlen(rest) - strlen(after)
  FROM (
    SELECT *, CASE kind WHEN 'Paragraph' THEN p WHEN 'Line1' THEN l WHEN 'Line' THEN s WHEN 'Whitespace' THEN b ELSE w END AS ch,
      ltrim(substr(rest, length(ch) + 1), '{WHITE_CHARS}') AS after
    FROM (
      SELECT *, substr(rest, 1, {n}) AS w,
        regexp_extract(w, '(?s)^(.+)\\n\\n', 1) AS p, regexp_extract(w, '(?s)^(.*\\n)', 1) AS l,
        regexp_extract(w, '(?s)^(.*[.?!])[ \\n]', 1) AS s, regexp_extract(w, '(?s)^(.*[ \\t])', 1) AS b,
        CASE WHEN {enough('p')} THEN 'Paragraph' WHEN {enough('l')} THEN 'Line1' WHEN {enough('s')} THEN 'Line' WHEN {enough('b')} THEN 'Whitespace' ELSE 'Forced' END AS kind
      FROM steps WHERE rest <> ''
    )
  )
),
chunks AS (
  SELECT doc_id, chunk_index, CASE boundary WHEN 'Line1' THEN 'Line' ELSE boundary END AS boundary, start_byte,
    start_byte + strlen(chunk_text) AS end_byte, length(chunk_text) AS char_len, chunk_text
  FROM steps WHERE chunk_index >= 0{f" UNION ALL SELECT doc_id, {_ALONE} FROM ({texts}) WHERE text = ''" if alone else ""}
)"""


_CHUNKS = "SELECT doc_id, chunk_index, boundary, start_byte, end_byte, char_len, chunk_text FROM chunks"


def _recursive(name: str, config: RecursiveConfig) -> None:
    @query(name, f"WITH RECURSIVE {chunks_cte(config.max_size, config.min_size)} {_CHUNKS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_rows(documents(spark, sf_dir), F.col("text"), config, ["doc_id"])


_recursive("chunk_recursive_512", RecursiveConfig())
_recursive("chunk_recursive_min", RecursiveConfig(512, 200))
_recursive("chunk_recursive_small", RecursiveConfig(64, 20))
_recursive("chunk_recursive_2000", RecursiveConfig(2000))

_OVERLAP = f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t, length(t) AS n FROM documents WHERE text <> ''),
steps AS (
  SELECT doc_id, t, n, -1 AS chunk_index, '' AS boundary, 0 AS cur, '' AS ch, 0 AS nxt FROM texts
  UNION ALL
  SELECT doc_id, t, n, chunk_index + 1, kind, pos, c, CASE WHEN pos + length(c) >= n THEN n ELSE greatest(1, pos + length(c) - 32, pos + 1) END
  FROM (
    SELECT *, nxt AS pos, substr(t, nxt + 1, 256) AS w, regexp_extract(w, '(?s)^(.+)\\n\\n', 1) AS p, regexp_extract(w, '(?s)^(.*\\n)', 1) AS l,
      regexp_extract(w, '(?s)^(.*[.?!])[ \\n]', 1) AS s, regexp_extract(w, '(?s)^(.*[ \\t])', 1) AS b,
      CASE WHEN p <> '' THEN 'Paragraph' WHEN l <> '' OR s <> '' THEN 'Line' WHEN b <> '' THEN 'Whitespace' ELSE 'Forced' END AS kind,
      CASE WHEN p <> '' THEN p WHEN l <> '' THEN l WHEN s <> '' THEN s WHEN b <> '' THEN b ELSE w END AS c
    FROM steps WHERE nxt < n
  )
)
SELECT doc_id, chunk_index, boundary, strlen(substr(t, 1, cur)) AS start_byte, strlen(substr(t, 1, cur)) + strlen(ch) AS end_byte, length(ch) AS char_len, ch AS chunk_text
FROM steps WHERE chunk_index >= 0
UNION ALL SELECT doc_id, {_ALONE} FROM documents WHERE text = ''"""


def exploded(chunked: DataFrame, keep: list[str]) -> DataFrame:
    rows = chunked.select(*keep, F.explode_outer("chunks").alias("_c")).where(F.col("_c").isNotNull())
    return rows.select(*keep, F.col("_c.index").alias("chunk_index"), "_c.boundary", "_c.start_byte", "_c.end_byte", "_c.char_len", F.col("_c.text").alias("chunk_text"))


def _single(spark: SparkSession, sf_dir: str, config: ChunkerConfig) -> DataFrame:
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", F.lit("").alias("canonical_path"))
    return exploded(with_chunks(docs, config), ["doc_id"])


@query("chunk_recursive_overlap", _OVERLAP)
def chunk_recursive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, ChunkerConfig(RecursiveConfig(256, 0, 32), "recursive"))


@query("chunk_tokens_512")
def chunk_tokens_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, ChunkerConfig(RecursiveConfig(512, metric="tokens"), "recursive"))


@query("chunk_texts", f"WITH RECURSIVE {chunks_cte(512, alone=True)} SELECT doc_id, string_agg(chunk_text, '|' ORDER BY chunk_index) AS chunk_texts FROM chunks GROUP BY doc_id")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the texts of a document's chunks, as the simplest call gives them, joined."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", F.lit("").alias("canonical_path"))
    chunked = with_chunks(docs, ChunkerConfig(single="recursive"))
    return chunked.select("doc_id", F.array_join(F.transform("chunks", lambda c: c["text"]), "|").alias("chunk_texts"))


def _markdown() -> Column:
    """Markdown that holds a document's first line and its text."""
    line = F.regexp_replace(F.substring_index("text", "\n", 1), r"[^\p{L} ]", "")
    return F.concat(F.lit("# Part "), F.col("doc_id").cast("string"), F.lit("\n\n"), line, F.lit("\n\n- one\n- two\n\n```\ncode\n```\n\nSetext\n---\n\n"), F.col("text"), F.lit("\n"))


def templated(name: str, strategy: str, text: Callable[[], Column], sizes: RecursiveConfig, sql: str | None = None, config: ChunkerConfig | None = None, embed: Embedder = hashed_words) -> None:
    """Registers the chunks of texts that are made from documents."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", text().alias("text"), F.lit("").alias("canonical_path"))
        return exploded(with_chunks(docs, config or ChunkerConfig(sizes, strategy), embed=embed), ["doc_id"])


templated("markdown_chunks", "markdown", _markdown, RecursiveConfig(512))


@query(
    "code_tiles",
    """WITH d AS (SELECT doc_id, 'use a;' || chr(10) || '// ' || doc_id || chr(10) AS head, 'fn f' || doc_id || '() { g(); }' AS decl, chr(10) || 'x' AS tail FROM documents)
SELECT doc_id, unnest([0, 1, 2, 3]) AS slab, unnest([0, 6, length(head), length(head) + length(decl)])::INT AS slab_start,
  unnest([6, length(head), length(head) + length(decl), length(head) + length(decl) + 2])::INT AS slab_end FROM d""",
)
def code_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and the gaps around them cover a source text without holes."""
    bound_batches(spark)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def slabs(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in tiles(declarations(t.as_py(), "rust"), len(t.as_py()))] for t in texts])

    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("use a;\n// "), i, F.lit("\nfn f"), i, F.lit("() { g(); }\nx"))
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(slabs(text)).alias("slab", "s"))
    return rows.select("doc_id", "slab", F.col("s.start").alias("slab_start"), F.col("s.end").alias("slab_end"))


@query("sentences_uax29")
def sentences_uax29(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in sentences(normalized(t.as_py() or ""))] for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    rows = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(spans("text")).alias("sentence", "s")).where("s IS NOT NULL")
    return rows.select("doc_id", "sentence", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir, ChunkerConfig(RecursiveConfig(512), "semantic", SemanticConfig(RecursiveConfig(512))))


# texts and paths


@query("normalize_newlines", "SELECT doc_id, regexp_replace('a' || chr(13) || chr(10) || text || chr(13) || 'b', '\\r\\n?', chr(10), 'g') AS normalized FROM documents")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", normalize_newlines(F.concat(F.lit("a\r\n"), "text", F.lit("\rb"))).alias("normalized"))


@query("path_to_uri", f"SELECT doc_id, replace({PATH_SQL}, '\\', '/') AS p, CASE WHEN contains(p, ':/') THEN 'file:///' || p WHEN starts_with(p, '/') THEN 'file://' || p ELSE 'file:///' || p END AS uri FROM documents")
def path_to_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select("doc_id", F.replace(F.col("canonical_path"), F.lit("\\"), F.lit("/")).alias("p"), file_uri(F.col("canonical_path")).alias("uri"))


@query("file_extension_payload", f"SELECT doc_id, regexp_extract(regexp_extract({PATH_SQL}, '([^/\\\\]*)$', 1), '\\.([^.]*)$', 1) AS file_extension FROM documents")
def file_extension_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", payload_extension(F.col("canonical_path")).alias("file_extension"))


_ROUTES = " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in sorted(routes().items()))


@query(
    "route_by_extension",
    f"""SELECT doc_id, CASE lower(CASE WHEN regexp_matches(f, '^.+\\.[^.]*$') THEN regexp_extract(f, '\\.([^.]*)$', 1) ELSE '' END) {_ROUTES} ELSE 'recursive' END AS strategy,
  '{router_fingerprint(routes())}' AS router FROM (SELECT doc_id, regexp_extract({PATH_SQL}, '([^/\\\\]*)$', 1) AS f FROM documents)""",
)
def route_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", strategy_of(F.col("canonical_path"), ChunkerConfig()).alias("strategy"), F.lit(router_fingerprint(routes())).alias("router"))


_ROUTES_SEMANTIC = " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in sorted(routes(True).items()))


@query(
    "route_semantic",
    f"""SELECT doc_id, CASE lower(CASE WHEN regexp_matches(f, '^.+\\.[^.]*$') THEN regexp_extract(f, '\\.([^.]*)$', 1) ELSE '' END) {_ROUTES_SEMANTIC} ELSE 'semantic' END AS strategy
  FROM (SELECT doc_id, regexp_extract({PATH_SQL}, '([^/\\\\]*)$', 1) AS f FROM documents)""",
)
def route_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", strategy_of(F.col("canonical_path"), ChunkerConfig(semantic=SemanticConfig())).alias("strategy"))


@query(
    "invalid_utf8_rows",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 'invalid input' END AS error_kind,
  CASE WHEN doc_id % 5 = 0 THEN 'failed to read utf-8 file' END AS error_message FROM documents""",
)
def invalid_utf8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("C328")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    text, kind, message = utf8_text(F.col("content"))
    return docs.select("doc_id", content.alias("content")).select("doc_id", text.alias("text"), kind.alias("error_kind"), message.alias("error_message"))


@query("point_id_check", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'point id is empty' END AS error_message FROM documents")
def point_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    identifier = F.when(F.col("doc_id") % 4 == 0, " 　\t").otherwise(F.concat(F.lit(" p"), F.col("doc_id").cast("string")))
    return documents(spark, sf_dir).select("doc_id", point_id_errors(identifier).alias("error_message"))


@query(
    "empty_fallback",
    """SELECT doc_id, len(kinds)::INT AS n_chunks, kinds[1] AS boundary FROM (
  SELECT doc_id, ['Forced'] AS kinds FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, ['Whitespace', 'Forced'] FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, ['Whitespace'] FROM documents WHERE doc_id % 3 = 2)""",
)
def empty_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without chunks still gives one."""
    text = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "two words").otherwise("  ")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"), F.lit("a.txt").alias("canonical_path"))
    return with_chunks(docs, ChunkerConfig()).select("doc_id", F.size("chunks").alias("n_chunks"), F.get("chunks", F.lit(0))["boundary"].alias("boundary"))


# points

_LE = "".join(f"substr(h, {i}, 2){' || ' if i > 1 else ''}" for i in range(15, 0, -2))
_FP = RecursiveConfig().fingerprint
_UUID = "substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-4' || substr(g, 14, 3) || '-' || translate(substr(g, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(g, 18, 3) || '-' || substr(g, 21, 12)"
_TEXT_PATH = "'/' || source || '/' || doc_id || '.txt'"


@query(
    "chunk_payload",
    f"""WITH RECURSIVE {chunks_cte(512, alone=True)},
ids AS (
  SELECT *, {_UUID} AS id FROM (
    SELECT c.*, p.path, p.size_bytes, lpad(printf('%x', c.chunk_index), 16, '0') AS h,
      sha256(unhex(hex(encode(p.path)) || '1F' || {_LE} || '1F' || hex(encode('{_FP}')))) AS g
    FROM chunks c JOIN (SELECT doc_id, {_TEXT_PATH} AS path, strlen(text) AS size_bytes FROM documents) p USING (doc_id))
)
SELECT id, 'file://' || path AS canonical_path, sha256('file://' || path) AS doc_id, 'default' AS tenant_id, 'txt' AS file_extension, size_bytes, 1700000000 + doc_id AS mtime_unix_secs,
  chunk_index, (count(*) OVER (PARTITION BY path))::INT AS total_chunks, lag(id) OVER w AS previous_chunk_id, lead(id) OVER w AS next_chunk_id,
  start_byte AS chunk_start_byte, end_byte AS chunk_end_byte, char_len AS chunk_char_len, sha256(chunk_text) AS chunk_text_sha256, '{_FP}' AS strategy_fingerprint, chunk_text,
  sha256(chunk_text) AS chunk_text_sha2_256
FROM ids WINDOW w AS (PARTITION BY path ORDER BY chunk_index)""",
)
def chunk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all documents, ids by SHA-256."""
    files = document_files(spark, sf_dir, plain=True).where("text IS NOT NULL")
    return point_rows(with_chunks(files, ChunkerConfig(single="recursive")), "sha256")


@query("point_ids_blake3")
def point_ids_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of files of all kinds, each by the chunker of its extension, ids by BLAKE3."""
    files = document_files(spark, sf_dir)
    return point_rows(with_chunks(files, ChunkerConfig()), "blake3").drop("chunk_text")


@query("vector_points")
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from files to (id, vector, payload)."""
    files = document_files(spark, sf_dir)
    return with_vectors(point_rows(with_chunks(files, ChunkerConfig())), LocalProvider())


@query("file_version_ids")
def file_version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select("doc_id", file_version_id(*map(F.col, planning.VERSION)).alias("file_version_id"))


_LE_OF = lambda x: " || ".join(f"substr(lpad(printf('%x', {x}), 16, '0'), {i}, 2)" for i in range(15, 0, -2))


@query("file_version_ids_sha256", f"SELECT doc_id, sha256(unhex(hex(encode({PATH_SQL})) || {_LE_OF('strlen(text)')} || {_LE_OF('1700000000 + doc_id')})) AS file_version_id FROM documents")
def file_version_ids_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select("doc_id", file_version_id(*map(F.col, planning.VERSION), "sha256").alias("file_version_id"))


@query(
    "embed_lookup_points",
    f"WITH RECURSIVE {chunks_cte(512)} SELECT c.doc_id, c.chunk_index, c.chunk_text, e.label, len(e.embedding)::INT AS dimension FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id",
)
def embed_lookup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors from a table instead of a service."""
    chunks = chunk_rows(documents(spark, sf_dir), F.col("text"), RecursiveConfig(), ["doc_id"])
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("dimension"))
    return join_vectors(chunks, vectors, "doc_id").select("doc_id", "chunk_index", "chunk_text", "label", "dimension")


# planning and state

_CHANGES = f"""obs AS ({OBSERVATIONS_SQL}),
changes AS (
  SELECT canonical_path, size_bytes, mtime_unix_secs, seq FROM (
    SELECT *, lag(size_bytes) OVER w AS s, lag(mtime_unix_secs) OVER w AS m, lag(seq) OVER w AS b FROM obs WINDOW w AS (PARTITION BY canonical_path ORDER BY seq)
  ) WHERE b IS NULL OR s <> size_bytes OR m <> mtime_unix_secs
)"""
_PLANNED = f"{_CHANGES}, planned AS (SELECT canonical_path, size_bytes, mtime_unix_secs, min(seq) AS seq FROM changes GROUP BY ALL)"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_versions(planning.tailer_changes(observations(spark, sf_dir)))


@query("tailer_changes", f"WITH {_CHANGES} SELECT * FROM changes")
def tailer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.tailer_changes(observations(spark, sf_dir))


@query("planner_dedupe", f"WITH {_PLANNED} SELECT * FROM planned")
def planner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned versions with what became of them."""
    status = F.when(F.col("seq") % 5 == 0, "failed").when(F.col("seq") % 5 != 1, "ok")
    return _planned(spark, sf_dir).withColumns({"status": status, "n_points": F.col("size_bytes") + 1})


_RESULTS = f"{_PLANNED}, results AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'failed' WHEN seq % 5 <> 1 THEN 'ok' END AS status, size_bytes + 1 AS n_points FROM planned)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.log_records(_results(spark, sf_dir))


def _versions(log: DataFrame) -> DataFrame:
    return log.select("kind", "fingerprint.*", "seq")


@query("wal_tail", f"WITH {_RESULTS} SELECT 'work_item_v2' AS kind, canonical_path, size_bytes, mtime_unix_secs, seq FROM planned WHERE seq > 100 UNION ALL SELECT 'sink_ack_v2', canonical_path, size_bytes, mtime_unix_secs, seq FROM results WHERE status = 'ok' AND seq > 100")
def wal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(planning.new_since(_log(spark, sf_dir), 100))


@query("wal_discovered", f"WITH {_PLANNED} SELECT canonical_path, count(*) AS n_items FROM planned GROUP BY 1")
def wal_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.discovered(_log(spark, sf_dir)).groupBy(F.col("fingerprint.canonical_path").alias("canonical_path")).agg(F.count(F.lit(1)).alias("n_items"))


@query("wal_pending", f"WITH {_RESULTS} SELECT 'work_item_v2' AS kind, canonical_path, size_bytes, mtime_unix_secs, seq FROM results WHERE status IS DISTINCT FROM 'ok'")
def wal_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(planning.pending_work(_log(spark, sf_dir)))


@query("upsert_latest", "SELECT id, batch, event_type, value FROM (SELECT user_id || '-' || (event_id % 7) AS id, event_id AS batch, event_type, value, row_number() OVER (PARTITION BY user_id || '-' || (event_id % 7) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    identifier = F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string"))
    return planning.upsert_latest(table(spark, sf_dir, "events").select(identifier.alias("id"), F.col("event_id").alias("batch"), "event_type", "value"))


@query("stale_tail", f"WITH RECURSIVE {chunks_cte(512)}, sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) SELECT doc_id, chunk_index, chunk_text FROM sized WHERE chunk_index >= (n + 1) // 2")
def stale_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beyond the end of documents that now have half as many chunks, rounded up."""
    chunks = chunk_rows(documents(spark, sf_dir), F.col("text"), RecursiveConfig(), ["doc_id"]).select("doc_id", "chunk_index", "chunk_text")
    now = chunks.groupBy("doc_id").agg(F.floor((F.count(F.lit(1)) + 1) / 2).alias("total_chunks"))
    return planning.stale_tail(chunks, now)


@query("ingest_summary", f"WITH {_RESULTS} SELECT count(*) AS discovered, count(*) FILTER (status = 'ok') AS indexed, count(*) FILTER (status = 'failed') AS failed, coalesce(sum(n_points) FILTER (status = 'ok'), 0)::BIGINT AS emitted_points, count(*) FILTER (status IS NULL) AS pending FROM results")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ingest_summary(_results(spark, sf_dir))


@query(
    "ingest_idle_windows",
    """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n_events FROM r GROUP BY user_id, run""",
)
def ingest_idle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.activity_windows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 3600)


# semantic arithmetic over a table of vectors

#: Vectors stand for the sentences of documents, so many in each.
_SENTENCES = 50
_DISTANCES = f"""u AS (SELECT vec_id // {_SENTENCES} AS doc_no, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT doc_no, vec_id, v, lag(v) OVER (PARTITION BY doc_no ORDER BY vec_id) AS b FROM u),
d AS (SELECT doc_no, vec_id, CASE WHEN b IS NOT NULL THEN 1 - list_cosine_similarity(b, v) END AS distance FROM p)"""
_GROUPS = f"""{_DISTANCES}, t AS (SELECT doc_no, quantile_cont(distance, 0.95) AS threshold FROM d GROUP BY doc_no),
g AS (SELECT doc_no, vec_id, coalesce(distance > threshold, false) AS split FROM d JOIN t USING (doc_no)),
n AS (SELECT *, sum(split::INT) OVER (PARTITION BY doc_no ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::INT AS group_no FROM g)"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("doc_no", F.floor(F.col("vec_id") / _SENTENCES))
    return neighbour_distances(rows, "doc_no", "vec_id", "embedding")


@query("semantic_distances", f"WITH {_DISTANCES} SELECT doc_no, vec_id, round(distance, 6) AS distance FROM d")
def semantic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query("semantic_groups", f"WITH {_GROUPS} SELECT doc_no, vec_id, split, group_no FROM n")
def semantic_group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_groups(_distances(spark, sf_dir), "doc_no", "vec_id", 95).select("doc_no", "vec_id", "split", "group_no")


@query(
    "semantic_merge_min",
    f"""WITH {_GROUPS}, s AS (SELECT doc_no, group_no, count(*) AS size FROM n GROUP BY ALL),
m AS (SELECT *, CASE WHEN size >= 5 OR row_number() OVER (PARTITION BY doc_no ORDER BY group_no) = 1 THEN 1 ELSE 0 END AS starts FROM s)
SELECT doc_no, group_no, size, (sum(starts) OVER (PARTITION BY doc_no ORDER BY group_no ROWS UNBOUNDED PRECEDING) - 1)::INT AS merged_no FROM m""",
)
def semantic_merge_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = semantic_groups(_distances(spark, sf_dir), "doc_no", "vec_id", 95)
    sizes = grouped.groupBy("doc_no", "group_no").agg(F.count(F.lit(1)).alias("size"))
    return merge_small_groups(sizes, "doc_no", "group_no", "size", 5)


from . import made  # noqa: E402, F401  it registers its queries, and needs the functions above
