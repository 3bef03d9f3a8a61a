import hashlib
import random
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm import fingerprints as fpr
from sparkloom.llm.simhash import fingerprint


def plain(text, width=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\n", " ").split(" ") if w]
    terms = Counter([" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else []))
    total = sum(terms.values())
    return sum(1 << b for b in range(64) if 2 * sum(n for t, n in terms.items() if xxhash.xxh64_intdigest(t, 42) >> b & 1) > total)


def corpus(n):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)] + ["É", "😀", "The"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split(" ")
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 200))))
    return texts


def hash_of(text):
    """As a signed long; rows that share an id are ordered by it."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), 42)))[0]


def check(found, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hash_of(r[1] or "")))
    want = []
    fps = [plain(t or "") for _, t in order]
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + follow[:third]
        f, e = fps[k], plain(new)
        within = sum((f ^ g).bit_count() <= 3 for g in fps) - 1 if i is not None and i % 50 == 0 else None
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", 1 - (f ^ e).bit_count() / 64, 1 - (f ^ fps[(k + 1) % len(order)]).bit_count() / 64, within))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(docs, folder, spark, monkeypatch):
    monkeypatch.setattr(fpr.neighbour_fingerprints, "__defaults__", ("doc_id", "text", 15))
    rows = [(i * 5, t) for i, t in enumerate(corpus(120))] + [(1001, None), (1002, ""), (1003, " \n"), (50, "a repeated id"), (None, "no id"), (None, None)]
    check(fpr.op1_document_fingerprints(spark, folder(documents=docs(rows))), rows)


def test_an_id_that_many_rows_share_takes_several_slices(docs, folder, spark, monkeypatch):
    monkeypatch.setattr(fpr.neighbour_fingerprints, "__defaults__", ("doc_id", "text", 10))
    rows = [(None if i % 3 else 7 if i % 2 else i, t) for i, t in enumerate(corpus(150))]
    check(fpr.op1_document_fingerprints(spark, folder(documents=docs(rows))), rows)
    ids = spark.range(100_000).selectExpr("IF(id % 3 = 0, id, NULL) AS k", "xxhash64(id) AS h")
    slices = common.Slices(ids, "k", 1000)
    sizes = [r["count"] for r in ids.groupBy(slices.column(F.col("k"), F.col("h"))).count().collect()]
    assert max(sizes) < 3000 and sum(sizes) == 100_000 and len(sizes) <= slices.count


def test_one_document_and_null_ids(docs, folder, spark):
    check(fpr.op1_document_fingerprints(spark, folder(documents=docs([(100, "one two three four five six seven")]))), [(100, "one two three four five six seven")])


def test_only_null_ids(docs, folder, spark):
    check(fpr.op1_document_fingerprints(spark, folder(documents=docs([(None, "b c d"), (None, "a b")]))), [(None, "b c d"), (None, "a b")])


def test_empty_table(docs, folder, spark):
    assert fpr.op1_document_fingerprints(spark, folder(documents=docs([]))).collect() == []


def test_weights_equal_repeats():
    text = "a b c d e f a b c d e f a b c d e"
    words = text.split()
    assert fpr.weighted_fingerprint(Counter(" ".join(words[i : i + 5]) for i in range(len(words) - 4))) == fingerprint(text, 5)
    assert fpr.weighted_fingerprint({}) == 0


def test_search_with_hot_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    fps = np.uint64(0x0123_4567_89AB_CDEF) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.r_[fps.view(np.int64), rng.integers(-(2**63), 2**63 - 1, 100)])
    data = spark.createDataFrame([(int(x), int(x) % 3 + 1) for x in fps], "fp long, n long")
    queries = data.where("n = 2").select("fp")
    for radius, blocks, tile in ((3, 4, 32), (3, 6, 16), (1, 2, 50), (0, 1, 16)):
        got = {r.fp: r.n for r in fpr.find_within(queries, data, radius, blocks, tile).collect()}
        assert got == {int(q): sum(int(x) % 3 + 1 for x in fps if int(np.uint64(q.view(np.uint64)) ^ x.view(np.uint64)).bit_count() <= radius) for q in fps if int(q) % 3 == 1}


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    a, b = (" ".join(rng.choices(words, k=400)) for _ in range(2))
    f = fingerprint(a, 5)
    assert fpr.likeness(f, fingerprint(fpr.edited(a, b), 5)) > fpr.likeness(f, fingerprint(b, 5)) + 0.05
