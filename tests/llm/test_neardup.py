import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from sparkloom.llm import neardup, setjoin
from sparkloom.llm.bitslice import links
from sparkloom.llm.simhash import block_masks


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 7), st.integers(1, 40), st.integers(0, 2**32), st.integers(1, 250))
def test_bit_sliced_links_equal_brute_force(radius, n_groups, seed, n):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, size=12, dtype=np.uint64)[rng.integers(0, 12, n)]
    for _ in range(rng.integers(0, 5)):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    groups = np.sort(rng.integers(0, n_groups, n))
    brute = [(i, j) for i in range(n) for j in range(i) if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]
    assert roots(n, links(fps, groups, radius)) == roots(n, brute)


def test_block_masks_lose_no_pair_within_the_radius():
    rng = random.Random(3)
    for blocks in (4, 5, 6):
        masks = block_masks(3, blocks)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            flips = flips - (1 << 64) if flips >> 63 else flips
            assert any(flips & m == 0 for m in masks)


def check(found, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    top = roots(len(rows), near)
    least = {}
    for (i, _), r in zip(rows, top, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, top, strict=True)), key=str)
    assert sorted([tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()], key=str) == want


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            old = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                old[rng.randrange(len(old))] = rng.choice(words)
            text = " ".join(old)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 120)))
        rows.append((i * 3 + 1, text))
    return rows


def test_query_equals_brute_force(docs, folder, spark):
    rows = corpus(150, 1) + [(1000, None), (1001, ""), (1002, " \n\t"), (None, "lone words of a row without an id"), (7, "repeated id"), (7, "repeated id"), (1003, "A B C"), (1004, "a b c")]
    check(neardup.op8_simhash_neardup(spark, folder(documents=docs(rows))), rows)


def test_hot_keys_are_tiled_without_loss(spark):
    rng = np.random.default_rng(5)
    fps = (np.uint64(0xF0F0_1234_5678_9ABC) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))).view(np.int64)
    fps = np.unique(np.r_[fps, rng.integers(-(2**63), 2**63 - 1, 100)])
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = neardup.fingerprint_links(df, 3, tile=16).collect()
    at = {int(x): i for i, x in enumerate(fps)}
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps.view(np.uint64)[i] ^ fps.view(np.uint64)[j]).bit_count() <= 3]
    assert roots(len(fps), [(at[a], at[b]) for a, b in found]) == roots(len(fps), brute)


def test_a_block_of_very_many_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**32, 50_000))  # all agree in half their bits
    df = spark.createDataFrame([(x,) for x in fps.tolist()], "fp long").repartition(4)
    grouped = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, f=DataFrame.mapInArrow: grouped.append(self) or f(self, *a))
    found = neardup.fingerprint_links(df, 3).collect()
    assert grouped[0].groupBy("g").count().agg({"count": "max"}).first()[0] <= neardup.TILE
    at = {x: i for i, x in enumerate(fps.tolist())}
    small, brute = fps.astype(np.uint32), []
    for i in range(0, len(small), 500):
        a, b = np.nonzero(np.bitwise_count(small[i : i + 500, None] ^ small[None, i:]) <= 3)
        brute += [(i + x, i + y) for x, y in zip(a.tolist(), b.tolist()) if x < y]
    assert brute and roots(len(fps), [(at[a], at[b]) for a, b in found]) == roots(len(fps), brute)


def test_near_copies_go_and_others_stay(docs):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, copies = [], set()
    for i in range(60):
        text = rng.choices(words, k=rng.randint(150, 400))
        rows.append((i, " ".join(text)))
        if i % 3 == 0:  # a word in a hundred differs: five-word sets share nine parts of ten
            for j in range(3):
                near = list(text)
                for _ in range(len(near) // 100):
                    near[rng.randrange(len(near))] = rng.choice(words)
                rows.append((100 + 10 * i + j, " ".join(near)))
                copies.add(100 + 10 * i + j)
        elif i % 3 == 1:  # half of it is another's: no near copy
            rows.append((1000 + i, " ".join(text[: len(text) // 2] + rng.choices(words, k=len(text) // 2))))
    kept = {r.doc_id for r in neardup.keep_representatives(docs(rows)).collect()}
    assert kept >= {i for i, _ in rows} - copies
    assert len(kept & copies) <= 0.1 * len(copies)
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    assert all(any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i) for i in copies - kept)


def edited(text, n, rng, words):
    text = list(text)
    for i in rng.sample(range(len(text)), n):
        text[i] = rng.choice(words)
    return text


def groups_of(rows):
    """The kept ids and the similar pairs, by brute force over five-word shingles."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [set(zip(*(w[k:] for k in range(5)))) or {tuple(w)} for w in words]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    top = roots(len(rows), pairs)
    return {min(i for (i, _), r in zip(rows, top, strict=True) if r == x) for x in top}, pairs


def test_no_similar_pair_is_lost_to_far_fingerprints_or_to_the_forest(docs):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        text = rng.choices(words, k=rng.randint(60, 300))
        rows += [(10 * i + j, " ".join(x)) for j, x in enumerate([text, *(edited(text, max(1, len(text) // 48), rng, words) for _ in range(2))])]
    want, pairs = groups_of(rows)
    fps = [plain_fingerprint(t, 2) for _, t in rows]
    assert sum((fps[i] ^ fps[j]).bit_count() > 6 for i, j in pairs) > 50  # which the fingerprints alone can't find
    assert 150 <= len(want) < 450
    assert {r.doc_id for r in neardup.keep_representatives(docs(rows)).collect()} == want


def test_parities_never_differ_in_more_than_the_members_that_only_one_set_has():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 63, 64, 65, 300, 1025):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for keep, more in ((1, 0), (0.9, 0.1), (0.8, 0), (1, 0.25), (0.1, 0.9)):
            y = np.unique(np.r_[x[: int(n * keep)], rng.integers(-(2**63), 2**63 - 1, int(n * more))])
            found = setjoin.parities_differ(setjoin.parities(x), setjoin.parities(y))
            assert found == setjoin.parities_differ(setjoin.parities(y), setjoin.parities(x)) <= len(np.setxor1d(x, y))
            assert keep == 1 or keep > 0.1 or n < 300 or found > (len(x) + len(y)) / 9  # unlike sets are refuted


def test_equal_fingerprints_of_unlike_texts_are_no_near_copies(docs):
    rows = [(i, "a " * 100 + " ".join(f"{x}{k}" for k in range(20))) for i, x in enumerate("xyz")] + [(9, "a " * 99 + "a")]
    assert len({plain_fingerprint(t, 2) for _, t in rows}) == 1
    assert {r.doc_id for r in neardup.keep_representatives(docs(rows)).collect()} == groups_of(rows)[0] == {0, 1, 2, 9}


@pytest.mark.parametrize(("tile", "rounds", "one_in"), [(256, 3, 1), (8, 3, 16), (8, 1, 1), (3, 0, 16)])
def test_groups_of_any_size_lose_no_pair(docs, monkeypatch, tile, rounds, one_in):
    rng = random.Random(22)
    words, lines = [f"w{i}" for i in range(2000)], [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(8)]
    rows = [(i, " ".join(rng.sample(lines, 4) + rng.choices(words, k=rng.randint(0, 8)))) for i in range(60)]  # members that many share
    text = rng.choices(words, k=90)
    rows += [(100 + i, " ".join(edited(text, 1, rng, words))) for i in range(40)]  # a large group of near copies
    rows += [(200 + i, rows[i][1]) for i in range(0, 100, 4)] + [(300, "few words"), (301, ""), (302, "few words")]
    found = []
    monkeypatch.setattr(setjoin, "ONE_IN", one_in)
    monkeypatch.setattr(neardup, "similar_sets", lambda *a: setjoin.similar_sets(*a, tile=tile, rounds=rounds))
    tiled = setjoin._tiled
    monkeypatch.setattr(setjoin, "_tiled", lambda *a: found.append(1) or tiled(*a))
    monkeypatch.setattr(neardup, "fingerprint_candidates", lambda nodes, radius: nodes.selectExpr("node AS a", "node AS b").limit(0))
    assert {r.doc_id for r in neardup.keep_representatives(docs(rows)).collect()} == groups_of(rows)[0]
    assert bool(found) == (tile < 256)


def test_one_document_of_each_group_stays(docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w q"), (4, None), (5, "")]
    kept = neardup.keep_representatives(docs(rows).selectExpr("*", "doc_id AS FP"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert kept.columns[-1] == "FP"


def test_empty_table(docs, folder, spark):
    assert neardup.op8_simhash_neardup(spark, folder(documents=docs([]))).collect() == []
