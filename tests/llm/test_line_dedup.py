import itertools
import random
import re
import struct

import pyarrow as pa
import pytest

from sparkloom.llm import line_dedup as ld


def plain_lines(text):
    return re.findall(r"[\s\S]*?(?:\n|[.!?] )|[\s\S]+", text or "")


def plain_chunks(text):
    """(start, end) in characters of each chunk, from the rule alone."""
    lines = plain_lines(text)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    at = [0, *itertools.accumulate(map(len, lines))]
    if sum(words) < 10:
        return [(0, at[-1])] if sum(words) else []
    found = set()
    for i in range(len(lines)):
        if sum(words[i:]) >= 10:
            found.add((at[i], at[next(j for j in range(i + 1, len(lines) + 1) if sum(words[i:j]) >= 10)]))
        if sum(words[: i + 1]) >= 10:
            found.add((at[next(j for j in range(i, -1, -1) if sum(words[j : i + 1]) >= 10)], at[i + 1]))
    return sorted(found)


def brute(rows):
    """Removed spans by row, from the bytes of chunks that plain_chunks cuts."""
    first = {}
    key = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for a, b in plain_chunks(t):
            first[t[a:b]] = min(first.get(t[a:b], key(i)), key(i))
    out = []
    for i, t in rows:
        here, joined = set(), []
        for a, b in plain_chunks(t):
            gone = first[t[a:b]] != key(i) or t[a:b] in here
            here.add(t[a:b])
            if gone and joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            elif gone:
                joined.append([a, b])
        out.append((i, t, [tuple(x) for x in joined]))
    return sorted(out, key=str)


def sentence(rng):
    return " ".join(rng.choices(["river", "stone", "é", "walked", "under", "green", "letters", "spoke", "winter", "table", "morning"], k=rng.randint(4, 9))) + rng.choice([". ", "!\n", "?\n", "\n", ". "])


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passages = ["".join(sentence(rng) for _ in range(rng.randint(8, 14))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [sentence(rng) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i * 2 + 10, "".join(parts)))
    return rows + rows[5:8] + [(500, rows[3][1]), (501, None), (502, ""), (503, " \n \n \n \n"), (None, rows[0][1]), (None, passages[0])], passages


@pytest.mark.parametrize("bits", [63, 4])
def test_spans_equal_brute_force(docs, bits):
    rows, _ = corpus()
    marked, name = ld.removed_spans(docs(rows), bits=bits)
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r[name].removed]) for r in marked.collect()), key=str)
    assert got == brute(rows)


def test_chunks_of_a_batch_equal_the_rule():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é ", " ", ". ", ".\n", "\n", "日本 x ", "\t\x0b", "word word "]) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(200)] + [None, "", " ", "\n", "x" * 50_000]
    for part in (texts, texts[::-1], texts[7:8]):
        found = ld.Texts(pa.chunked_array([part[:3], part], pa.string()).combine_chunks()[3 if len(part) > 3 else len(part) :])
        assert found.n == len(part)
        for t, text in enumerate(part):
            raw = (text or "").encode()
            own = range(*found.own(t).indices(len(found.hashes)))
            at = [(int(found.starts[found.first[i]] - found.bounds[t]), int(found.ends[found.stop[i] - 1] - found.bounds[t])) for i in own]
            assert [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in at] == plain_chunks(text)
            alone = ld.Texts(pa.array([text], pa.string()))
            assert struct.pack(f"{len(own)}q", *found.hashes[own.start : own.stop]) == alone.hashes.tobytes() and all(h % 2 == 0 for h in alone.hashes.tolist())


def test_rows_with_one_id_or_none_lose_nothing_to_each_other(docs):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=8)) + ".\n"
    passage = "".join(line() for _ in range(30))
    rows = [(5, line() * 1 + passage), (5, "".join(line() for _ in range(4)) + passage), (6, passage + line()), (None, line() + passage), (None, passage)]
    for part, lost in ((rows[:3], {6}), (rows, {5, 6})):
        kept = ld.removed_spans(docs(part))[0].collect()
        assert {r.doc_id for r in kept if r.removal.removed} == lost


def test_many_rows_without_an_id(docs, spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choices([f"w{i}" for i in range(3000)], k=9)) + ".\n"
    shared = line() + line()
    rows = spark.range(100_000).selectExpr("IF(id < 3, id, NULL) AS doc_id", f"concat('Document number ', id, ' has just one line of its own here and now.\\n', '{shared.strip()}') AS text")
    got = {(r.none, r.n): r["count"] for r in ld.removed_spans(rows)[0].selectExpr("doc_id IS NULL AS none", "removal.n_removed_lines AS n").groupBy("none", "n").count().collect()}
    assert got == {(True, 0): 99_997, (False, 2): 3}


def test_query_and_empty_table(docs, folder, spark, tmp_path):
    rows, _ = corpus(2)
    found = ld.op5_line_dedup(spark, folder(documents=docs(rows))).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, [tuple(s) for s in r.removed]) for r in found), key=str) == sorted(((i, s) for i, _, s in want), key=str)
    by_id = {r.doc_id: r for r in found}
    for i, t, s in want:
        if i is not None and i != 500:
            assert by_id[i].n_removed_chars == sum(b - a for a, b in s) and by_id[i].n_lines == len(plain_lines(t))
    docs([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert ld.op5_line_dedup(spark, f"{tmp_path}/e").collect() == []


def test_every_removed_line_stays_somewhere_and_clean_text_is_left_alone(docs):
    rows, passages = corpus(3)
    rows = [r for r in rows if r[0] is not None]
    kept = {r.doc_id: r for r in ld.remove_repeated(docs(rows).selectExpr("*", "1 AS SPANS", "2 AS kept_text")).collect()}
    whole = " ".join(r.text or "" for r in kept.values())
    for _, t in rows:
        for x in plain_lines(t):
            assert x.strip() in whole
    shared = "".join(passages)
    for i, t in rows:
        if t and all(s not in shared for s in re.split(r"(?<=[.!?\n])", t) if len(s.split()) > 3) and sum(x[1] == t for x in rows) == 1:
            assert kept[i].text == t
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)
    assert 501 in kept and kept[501].text is None


@pytest.mark.parametrize("lines", [4, 8, 14, 40])
def test_a_shared_passage_goes_wherever_it_stands(docs, lines):
    rng = random.Random(lines)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rng.choices(words, k=8)) + ". "
    passage = "".join(line() for _ in range(lines))
    rows = [(i, "".join(line() for _ in range(rng.randint(1, 9))) + "a start of a line " + passage + "".join(line() for _ in range(rng.randint(1, 9)))) for i in range(30)]
    kept = {r.doc_id: r.text for r in ld.remove_repeated(docs(rows)).collect()}
    assert kept[0] == rows[0][1]
    left = [sum(x in kept[i] for x in plain_lines(passage)) for i in range(1, 30)]
    assert sum(left) / len(left) <= 0.1 * lines  # the line that the passage begins inside has another start


@pytest.mark.parametrize("lines", [1, 2, 3, 4, 5])
def test_short_passages_go_whole_wherever_they_stand(docs, lines):
    rng = random.Random(lines)
    words = [f"w{i}" for i in range(4000)]
    line = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice([". ", ".\n"])
    rows, passages = [], []
    for i in range(60):
        n = rng.randint(51, 80)
        cuts = [0, *sorted(rng.sample(range(1, n), lines - 1)), n]
        passages.append("".join(line(b - a) for a, b in zip(cuts, cuts[1:])))
        for j in (2 * i, 2 * i + 1):
            rows.append((j, "".join(line(8) for _ in range(rng.randint(1, 9))) + passages[-1] + "".join(line(8) for _ in range(rng.randint(1, 9)))))
    kept = {r.doc_id: r.text for r in ld.remove_repeated(docs(rows)).collect()}
    for i, p in enumerate(passages):
        assert kept[2 * i] == rows[2 * i][1]
        assert kept[2 * i + 1] == rows[2 * i + 1][1].replace(p, "")
