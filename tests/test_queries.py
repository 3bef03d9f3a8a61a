"""Each registered query runs on the smallest tables, and equals its SQL in DuckDB where it has any."""

from pathlib import Path

import duckdb
import pytest

from sparkloom.operators.code import LANGUAGES
from sparkloom.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert rows
    if name in ORACLES:
        found = db.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        assert sorted(map(repr, found.select(*columns).fetchall())) == rows


@pytest.mark.parametrize("language", LANGUAGES)
def test_code_chunks_hold_whole_texts(spark, tmp_path, language):
    bare = lambda s: "".join(s.split())
    texts = {1: "one", 2: 'a "b" \\ c\r\n\r\n{ it\'s 4\n' + "word, 5 (six). " * 90 + "\nthe `last` line", 3: "\n".join(f"line {i} }} end" for i in range(400))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in QUERIES[f"code_chunks_{language}"](spark, str(tmp_path)).orderBy("doc_id", "chunk_index").collect():
        found[r.doc_id] = found.get(r.doc_id, "") + bare(r.chunk_text)
    mark = "#" if language in ("python", "ruby", "bash") else "//"
    for i, t in texts.items():
        lines = t.replace("\r\n", "\n").split("\n")
        assert bare("".join(mark + x for x in lines)) in found[i]
        assert all(bare('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"') in found[i] for x in lines)


def test_chunking_is_native_and_shuffle_free(spark):
    for name in ("chunk_recursive_512", "chunk_payload"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "id"
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
