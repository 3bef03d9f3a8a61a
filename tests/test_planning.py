from datetime import datetime, timedelta

from sparkloom.operators import planning, summary

OBS = "canonical_path string, size_bytes long, mtime_unix_secs long, seq long"


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_changes_and_plans(spark):
    rows = [("/a", 1, 100, 1), ("/a", 1, 100, 2), ("/a", 1, 101, 3), ("/a", 1, 100, 4), ("/b", 1, 100, 5), ("/b", 2, 100, 6), ("/a", 1, 100, 7)]
    changes = planning.tailer_changes(spark.createDataFrame(rows, OBS))
    assert seqs(changes) == [1, 3, 4, 5, 6]  # a version that comes back has changed again
    planned = planning.plan_versions(changes)
    assert seqs(planned) == [1, 3, 5, 6] and planned.columns == ["canonical_path", "size_bytes", "mtime_unix_secs", "seq"]


def test_log(spark):
    planned = spark.createDataFrame([("/a", 1, 1, 1), ("/b", 1, 1, 2), ("/c", 1, 1, 3)], OBS)
    results = spark.createDataFrame([("/a", 1, 1, 4, "ok"), ("/b", 1, 1, 5, "failed")], OBS + ", status string")
    log = planning.work_items(planned).unionByName(planning.acknowledgements(results))
    assert seqs(planning.pending_work(log)) == [2, 3]
    both = planning.work_items(planned).unionByName(planning.acknowledgements(results, only_ok=False))
    assert seqs(planning.pending_work(both)) == [3]
    assert seqs(planning.new_since(log, 2)) == [3, 4] and seqs(planning.executable(log)) == seqs(planning.discovered(log)) == [1, 2, 3]


def test_upserts_and_stale_tails(spark):
    points = spark.createDataFrame([("p", 1, "old"), ("p", 2, "new"), ("q", 1, None)], "id string, batch long, text string")
    assert sorted((r.id, r.batch, r.text) for r in planning.upsert_latest(points).collect()) == [("p", 2, "new"), ("q", 1, None)]
    store = spark.createDataFrame([("d", i) for i in range(4)] + [("e", 0)], "doc_id string, chunk_index int")
    now = spark.createDataFrame([("d", 2), ("e", 1)], "doc_id string, total_chunks int")
    assert sorted(r.chunk_index for r in planning.stale_tail(store, now).collect()) == [2, 3]


def test_summary(spark):
    rows = [("ok", 3), ("ok", 2), ("failed", 0), (None, None)]
    found = summary.ingest_summary(spark.createDataFrame(rows, "status string, n_points long")).collect()
    assert [tuple(r) for r in found] == [(4, 2, 1, 5, 1)]
    assert [tuple(r) for r in summary.ingest_summary(spark.createDataFrame([], "status string, n_points long")).collect()] == [(0, 0, 0, 0, 0)]


def test_windows_of_activity(spark):
    t = datetime(2024, 1, 1)
    rows = [("u", t + timedelta(seconds=s), i) for i, s in enumerate([0, 5, 10, 100, 101])] + [("v", t, 9)]
    found = summary.activity_windows(spark.createDataFrame(rows, "u string, ts timestamp, i int"), "u", "ts", 10)
    assert sorted((r.u, r.n_events) for r in found.collect()) == [("u", 2), ("u", 3), ("v", 1)]
