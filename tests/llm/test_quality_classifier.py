import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import gam
from sparkloom.llm import quality_classifier as qc


def brute_gain(g, h, i, j):
    def part(rows, cols):
        a, b = g[rows, cols].sum(), h[rows, cols].sum()
        return a * a / (b + gam.RIDGE)

    cut = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    return sum(part(*c) for c in cut) - part(slice(None), slice(None))


def test_pair_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
        best = max((brute_gain(g, h, i, j), i, j) for i in range(4) for j in range(3))
        gain, steps = gam.pair_tree(g, h)
        assert gain == pytest.approx(best[0])
        i, j = best[1:]
        assert steps[0, 0] == pytest.approx(-g[: i + 1, : j + 1].sum() / (h[: i + 1, : j + 1].sum() + gam.RIDGE))


def test_learns_shapes_and_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 4))
    truth = np.abs(x[:, 0]) * 2 - 2 + 3 * np.sign(x[:, 1] * x[:, 2])
    y = (rng.random(6000) < gam.sigmoid(truth)).astype(float)
    model = gam.fit(x[:4500], y[:4500])
    assert (1, 2) in model.pairs
    right = ((model.scores(x[4500:]) > 0.5) == y[4500:]).mean()
    best = ((truth[4500:] > 0) == y[4500:]).mean()
    assert right > best - 0.03
    # a score is a sum of table entries
    row = x[4500]
    total = model.intercept + sum(t[np.searchsorted(c, v)] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
    total += sum(t[np.searchsorted(model.coarse[i], row[i]), np.searchsorted(model.coarse[j], row[j])] for (i, j), t in model.pairs.items())
    assert model.scores(x[4500:4501])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_degenerate_fits():
    assert gam.fit(np.empty((0, 3)), np.empty(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gam.fit(np.ones((9, 3)), np.ones(9)).scores(np.zeros((2, 3))) > 0.9).all()
    constant = gam.fit(np.ones((9, 2)), np.array([0, 1, 1] * 3, float))
    assert 0.5 < constant.scores(np.zeros((1, 2)))[0] < 0.8


def corpus():
    rng = random.Random(5)
    words = ["river", "the", "of", "stone", "walked", "green", "a", "letters", "spoke", "winter"]
    rows, labels = [], []
    for i in range(600):
        n = rng.randint(20, 80)
        good = rng.random() < 0.7
        if good:
            text = ". ".join(" ".join(rng.choices(words, k=7)) for _ in range(n // 7)) + "."
        else:
            text = rng.choice([lambda: " ".join([rng.choice(words)] * n), lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=n)), lambda: " ".join(w + "***" for w in rng.choices(words, k=n))])()
        rows.append((i, text))
        if rng.random() < 0.8:
            labels.append((i, int(good), 0))
    return rows, labels


def test_query_scores_held_out_rows_well(docs, folder, spark):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (None, "no id here"), (5, "a repeated id"), (1002, "w " * 20_000)]
    # labels of the held-out fold are wrong on purpose: they must not be learnt
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    shown = [(i, 1 - q if held(i) else q, t) for i, q, t in labels] + [(None, 1, 0), (1001, None, 0), (7, 1, None)]
    d = folder(documents=docs(rows + odd), labels=spark.createDataFrame(shown, "doc_id long, quality int, toxic int"))
    found = qc.op6_quality_classifier(spark, d).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in rows + odd), key=str)
    truth = dict((i, q) for i, q, _ in labels)
    for r in found:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.97
    again = {r.doc_id: r.score for r in qc.op6_quality_classifier(spark, d).collect() if r.doc_id != 5}
    assert all(again[r.doc_id] == r.score for r in found if r.doc_id != 5)


def test_no_labels_and_empty_table(docs, folder, spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = folder(documents=docs([(1, "a b c")]), labels=none)
    assert [r.score for r in qc.op6_quality_classifier(spark, d).collect()] == [0.5]
    docs([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    none.write.parquet(f"{tmp_path}/e/labels.parquet")
    assert qc.op6_quality_classifier(spark, f"{tmp_path}/e").collect() == []
