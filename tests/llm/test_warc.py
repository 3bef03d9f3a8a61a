import hashlib
import io
import random
import struct

import pyarrow as pa
import pytest
import zstandard

from sparkloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def want(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(raw) >= 100 and ids and i != min(ids)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    bodies = ["é" * 50, "x" * 99, "x" * 100, "a\r\n\r\nb" * 40, "<p>" + "y" * 700_000, "😀 </html>\0" * 20]
    rows = [(i * 3 % 200 + 1000, f"http://h/{i}", rng.choice(bodies)) for i in range(70)]
    return rows + [(1, None, None), (2, "http://x/\r\nWARC-Type: evil", ""), (3, "http://ü", "short"), (4, "", "short")]


@pytest.mark.parametrize("extra", [[], [(None, "u", "x" * 100), (None, None, "n" * 200), (None, "v", "n" * 200), (1000, "again", "é" * 50), (1000, "again", "é" * 50)]])
def test_query_equals_brute_force(spark, folder, extra):
    rows = corpus() + extra
    found = warc.op3_warc_archives(spark, folder(pages=pages(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=str) == want(rows)


def test_no_shared_payload_and_empty_table(spark, folder, tmp_path):
    rows = [(i, "u", f"{i}" * 200) for i in range(20)]
    assert sorted(map(tuple, warc.op3_warc_archives(spark, folder(pages=pages(spark, rows))).collect()), key=str) == want(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert warc.op3_warc_archives(spark, f"{tmp_path}/e").collect() == []


def test_archive_is_a_seekable_bundle(tmp_path):
    records = [warc.Record(i, "response", n := 100 * i, hashlib.sha256(b"z" * n).hexdigest(), None, f"http://u/{i}", b"z" * n) for i in range(50)]
    path = f"{tmp_path}/a.warc.zst"
    with pa.OSFile(path, "wb") as out:
        writer = warc.ArchiveWriter(out, "a", 20_000)
        for r in records:
            writer.add(r, False)
        writer.close()
    raw = open(path, "rb").read()
    n, _, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and n == len(writer.frames) > 5
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(r.bytes() for r in records)  # skippable frames are skipped by any reader
    archive = warc.Archive(path)
    assert list(archive) == records
    assert archive.find(7) == records[7] and archive.find(99) is None


def test_record_ids_are_unique_and_lead_to_their_records(spark, tmp_path):
    rows = [(7, f"http://h/{i}", f"{i % 3}" * 150) for i in range(30)] + [(None, "u", "n" * 200)] * 5 + [(i, f"http://o/{i}", "short" if i % 2 else "x" * 300) for i in range(100, 130)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS again", "3 AS PATH").repartition(6)
    archives = warc.write_archives(table, str(tmp_path), 500)
    assert archives.count() > 3
    found = warc.record_locations(archives).collect()
    assert len({r.record_id for r in found}) == len(found) == len(rows)
    got = []
    for r in found:
        record = warc.fetch(r.path, r.frame, r.offset)
        assert record.page_id == r.page_id
        raw = warc.Archive(r.path).read_frame(r.frame)[r.offset :]
        assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in raw[:400]
        got.append((record.page_id, record.url, record.length))
    assert sorted(got, key=str) == sorted(((i, u, len(h)) for i, u, h in rows), key=str)
    assert {r.record_id for r in found if r.page_id and r.page_id >= 100} == {f"<urn:page:{i}>" for i in range(100, 130)}


def test_damage_is_found():
    record = warc.Record(1, "response", 5, hashlib.sha256(b"right").hexdigest(), None, None, b"wrong")
    with pytest.raises(ValueError, match="does not hold the payload"):
        warc.parse(record.bytes())
