import hashlib
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import line_dedup, mixing
from sparkloom.llm.common import WRITTEN
from sparkloom.llm.simhash import fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ri", "sto", "wa", "gre", "le", "spo", "win", "ta", "mor", "hou") for b in ("ver", "ne", "lked", "en", "tters", "ke", "ter", "ble", "ning", "se")]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(7, 11))) + ". "
    passage = "".join(line() for _ in range(10))
    rows = []
    for i in range(80):
        parts = [line() for _ in range(rng.randint(6, 20))]
        if i % 9 == 0:
            parts.insert(3, passage)
        rows.append((i, "".join(parts), rng.choice(["a", "b", "c", None])))
    rows += [(100 + i, rows[i][1], "a") for i in range(5)]  # exact copies
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in rng.choices(words, k=90)), "b") for i in range(6)]  # junk
    rows += [(300, None, "a"), (301, "", "c"), (None, "".join(line() for _ in range(8)), "a"), (302, "word " * 3000, "b")]
    return rows


def plain_components(rows):
    fps = [fingerprint(t, 2) for _, t in rows]
    words = [(t or "").lower().split() for _, t in rows]
    sets = [set(zip(*(w[k:] for k in range(5)))) or {tuple(w)} for w in words]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fps[i] == fps[j] or (fps[i] ^ fps[j]).bit_count() <= 6 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_stages_take_effect_and_equal_brute_force(docs, folder, spark, tmp_path):
    rows = corpus()
    d = folder(documents=docs(rows))
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, d)
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"] and now.dtypes == docs([]).dtypes
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now.collect())

    good = {r.doc_id: r.text for r in kept[0]}
    assert set(range(80)) | {100, 101, 102, 103, 104, None} == set(good)

    for r in kept[1]:
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in kept[1]} >= {i for i in range(80) if i % 9}
    assert sum(len(r.text) for r in kept[1]) < sum(map(len, good.values()))

    texts = [(r.doc_id, r.text) for r in kept[1]]
    roots = plain_components(texts)
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert sorted((i for (i, _), r in zip(texts, roots, strict=True) if i == least.get(r) or (i is None and r not in least)), key=str) == sorted((r.doc_id for r in kept[2]), key=str)

    sizes = {}
    for r in kept[2]:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    goal = mixing.targets(sizes)
    for s in sizes:
        assert sum(len(WORD.findall(r.text)) for r in kept[3] if r.source == s) == int(goal[s])

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted((str(r.doc_id), library.encode(r.text, add_special_tokens=False).ids, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept[3])
    assert sorted((str(r.doc_id), r.ids, r.decoded_sha256) for r in kept[4]) == want
    before = list(WRITTEN)
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, kept[4]))
    assert len(WRITTEN) == len(before) + 1 and WRITTEN[: len(before)] == before  # only what the last stage reads stays


def test_exact_copies_leave_nothing(docs, folder, spark):
    rows = corpus()
    short = [(400, "Three words only", "a"), (401, "Two. Lines.\n", "b")]
    rows += short + [(i + 100, *r) for i, *r in short] + [(150 + i, rows[i][1], "c") for i in range(5, 45)]
    copies = {*range(100, 105), *range(155, 195), 500, 501}
    assert copies < {r[0] for r in rows}
    left = {r.doc_id for r in line_dedup.remove_repeated(docs(rows)).collect()}
    assert not left & copies and left >= {*range(45), 400, 401}
    assert not {r.doc_id for r in corpus_pipeline.run(spark, folder(documents=docs(rows))).collect()} & copies


def test_columns_of_any_name_pass_through(docs, spark, tmp_path):
    names = ["gone", "_gone", "_id", "_source", "spans", "kept", "occurrences", "key", "taken", "size", "cut", "mixing_cut", "n_words", "tmp_w", "h", "id", "fp", "component_id", "found", "target", "ids"]
    rows = [r for r in corpus() if r[0] is None or r[0] < 110]
    now = docs(rows).selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, "")
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns[5:] == names and not now.where(" or ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count()
    assert now.count()


def test_empty_table(docs, folder, spark):
    assert corpus_pipeline.run(spark, folder(documents=docs([]))).collect() == []
