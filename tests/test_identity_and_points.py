import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.errors import LoomError
from sparkloom.functions.blake3 import blake3_hex, digests
from sparkloom.functions.identity import chunk_ids, file_version_id
from sparkloom.functions.text import file_uri, payload_extension, point_id_errors, routing_extension, utf8_text
from sparkloom.operators.embedding import LocalProvider
from sparkloom.operators.points import point_rows, with_vectors
from sparkloom.operators.routing import ChunkerConfig, with_chunks
from sparkloom.schema import PAYLOAD

# The first bytes of BLAKE3's official vectors: inputs are 0, 1, ..., 250, 0, 1, ...
VECTORS = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2048: "e776b6028c7cd22a4d0ba182a8bf6220"}


def test_blake3_vectors_and_the_jvm(spark):
    inputs = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert [d.hex()[:32] for d in digests(inputs)] == list(VECTORS.values())
    rng = random.Random(1)
    many = [rng.randbytes(rng.choice([0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 9000, rng.randint(0, 30000)])) for _ in range(50)]
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    assert [bytes(jvm.hash(bytearray(m))) for m in many] == digests(many)
    assert digests([]) == []
    df = spark.createDataFrame([(bytearray(b""),), (None,)], "b binary")
    assert [r[0] and r[0][:32] for r in df.select(blake3_hex(F.col("b"))).collect()] == [VECTORS[0], None]


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column).first()[0]


@pytest.mark.parametrize(
    "path,routing,payload,uri",
    [
        ("/a/b/c.md", "md", "md", "file:///a/b/c.md"),
        ("d:\\code\\main.RS", "RS", "RS", "file:///d:/code/main.RS"),
        ("D:/code\\repo\\a.txt", "txt", "txt", "file:///D:/code/repo/a.txt"),
        ("/repo/.gitignore", None, "gitignore", "file:///repo/.gitignore"),
        ("/repo/Makefile", None, "", "file:///repo/Makefile"),
        ("archive.tar.gz", "gz", "gz", "file:///archive.tar.gz"),
        ("foo.", "", "", "file:///foo."),
        ("a.b/c", None, "", "file:///a.b/c"),
        ("/x/a:/b", None, "", "file:////x/a:/b"),
    ],
)
def test_paths(spark, path, routing, payload, uri):
    p = F.col("p")
    assert [one(spark, c, p=path) for c in (routing_extension(p), payload_extension(p), file_uri(p))] == [routing, payload, uri]


def test_version_ids(spark):
    schema = "p string, s long, m long"
    base = ("/x/a.txt", 10, 100)
    rows = [base, ("/x/b.txt", 10, 100), ("/x/a.txt", 11, 100), ("/x/a.txt", 10, 101), ("/x/a.txt", 10, -1)]
    found = [r[0] for r in spark.createDataFrame(rows, schema).select(file_version_id(F.col("p"), F.col("s"), F.col("m"))).collect()]
    raw = [p.encode() + s.to_bytes(8, "little") + m.to_bytes(8, "little", signed=True) for p, s, m in rows]
    assert found == [d.hex() for d in digests(raw)] and len(set(found)) == 5
    sha = [r[0] for r in spark.createDataFrame(rows, schema).select(file_version_id(F.col("p"), F.col("s"), F.col("m"), "sha256")).collect()]
    assert sha == [hashlib.sha256(x).hexdigest() for x in raw]
    with pytest.raises(LoomError):
        file_version_id(F.col("p"), F.col("s"), F.col("m"), "md5")


@pytest.mark.parametrize("name", ["blake3", "sha256"])
def test_chunk_ids(spark, name):
    df = spark.createDataFrame([("/x/ä.txt", 3, "s:v1"), ("/y", 0, "s"), (None, 2, "s")], "p string, n int, s string")
    got = [r[0] for r in df.select(chunk_ids(F.col("p"), F.col("n"), F.col("s"), name)).collect()]
    for i, uid in enumerate(got[0]):
        raw = "/x/ä.txt".encode() + b"\x1f" + i.to_bytes(8, "little") + b"\x1f" + b"s:v1"
        h = bytearray((digests([raw])[0] if name == "blake3" else hashlib.sha256(raw).digest())[:16])
        h[6], h[8] = h[6] & 0x0F | 0x40, h[8] & 0x3F | 0x80
        assert uid.replace("-", "") == bytes(h).hex() and [len(x) for x in uid.split("-")] == [8, 4, 4, 4, 12]
    assert len(set(got[0])) == 3 and got[1] == []


def chunked(spark, config, rows=(("/docs/a.txt", 12, 100, "para1\n\npara2"), ("/docs/e.md", 0, 5, ""))):
    return with_chunks(spark.createDataFrame(rows, "canonical_path string, size_bytes long, mtime_unix_secs long, text string"), config)


def test_payload(spark):
    points = with_vectors(point_rows(chunked(spark, ChunkerConfig())), LocalProvider(8))
    assert points.select("payload.*").columns == list(PAYLOAD)
    rows = {(r.payload.canonical_path, r.payload.chunk_index): r for r in points.collect()}
    a, b = rows["file:///docs/a.txt", 0], rows["file:///docs/a.txt", 1]
    assert (a.payload.chunk_text, b.payload.chunk_text) == ("para1", "para2")
    assert a.payload.strategy_fingerprint == "recursive:v1|metric=chars|tokenizer=chars|max=512|min=0|overlap=0"
    assert (a.payload.previous_chunk_id, a.payload.next_chunk_id, b.payload.previous_chunk_id, b.payload.next_chunk_id) == (None, b.id, a.id, None)
    assert a.payload.total_chunks == 2 and a.payload.tenant_id == "default" and a.payload.file_extension == "txt"
    assert (b.payload.chunk_start_byte, b.payload.chunk_end_byte, b.payload.chunk_char_len) == (7, 12, 5)
    assert a.payload.chunk_text_sha256 == digests([b"para1"])[0].hex()
    assert a.payload.doc_id == digests([b"file:///docs/a.txt"])[0].hex()
    assert len(a.vector) == 8 and len(rows) == 3


def test_ids_differ_by_strategy(spark):
    sets = [{r.id for r in point_rows(chunked(spark, c)).collect()} for c in (ChunkerConfig(single="recursive"), ChunkerConfig(single="markdown"), ChunkerConfig(single="semantic"))]
    assert not (sets[0] & sets[1] or sets[0] & sets[2] or sets[1] & sets[2])


def test_invalid_utf8_and_blank_ids_are_values(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xc3\xa4"),), (bytearray(b"\xc3("),), (None,)], "content binary")
    assert [tuple(r) for r in df.select(*utf8_text(F.col("content"))).collect()] == [("ok ä", None, None), (None, "invalid input", "failed to read utf-8 file"), (None, None, None)]
    ids = spark.createDataFrame([("x",), (" 　",), ("",), (None,)], "id string")
    assert [r[0] for r in ids.select(point_id_errors(F.col("id"))).collect()] == [None] + ["point id is empty"] * 3
