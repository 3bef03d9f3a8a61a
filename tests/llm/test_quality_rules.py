import random
import re

import numpy as np
import pytest
import regex

from sparkloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def texts():
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)] + ["é ß", "***", "A|B", "x\u0085y", "😀"]
    out = [None, "", " \t\n", "one two", "\x1cone\x1f", "a b c d e f g h i j", "a b c d e a b c d e a b c d e", "x x x x x x", "l\nl\nl\n \n \nm", "a\r\nb\r\na\r\n"]
    for _ in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        out.append("\n".join(rng.choices(lines, k=rng.randint(1, 12))) + rng.choice(["", "\n", " ", "\x0b"]))
    return out


def test_counts_equal_brute_force(docs, folder, spark):
    rows = list(enumerate(texts())) + [(3, "repeated id"), (None, "a text without an id")]
    found = q.op4_quality_rules(spark, folder(documents=docs(rows)))
    got = sorted((tuple(r)[:7] for r in found.collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert not found.where("base_failed and kept").count()


def plain_votes(text):
    """The rules' votes, from the text alone."""
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    letters = regex.findall(r"\p{L}", text or "")
    shares = [
        (sum(map(len, words)) / n, lambda x: 3 <= x <= 10, lambda x: x < 2 or x > 14),
        (sum(c in "#*$%&|<>" for c in text or "") / n, lambda x: x < 0.02, lambda x: x > 0.1),
        (plain(text)[4] / n, lambda x: x < 0.05, lambda x: x > 0.15),
        ((len(lines) - len(set(lines))) / max(1, len(lines)), lambda x: x < 0.1, lambda x: x > 0.3),
        (len(letters) / chars, lambda x: x > 0.85, lambda x: x < 0.7),
        (len(regex.findall(r"\p{Lu}", text or "")) / max(1, len(letters)), lambda x: x < 0.2, lambda x: x > 0.4),
        ((text or "").count("!") / n, lambda x: x < 0.02, lambda x: x > 0.2),
        (len(set(words)) / n**0.5, lambda x: x > 4, lambda x: x < 1),
        (sum(bool(regex.search(r"\p{L}", w)) for w in words) / n, lambda x: x > 0.95, lambda x: x < 0.8),
    ]
    return tuple(-1 if bad(x) else 1 if good(x) else 0 for x, good, bad in shares)


def plain_quality(table, rounds=200):
    """Posteriors of vote rows by expectation-maximisation over rows, one after the other, with arrays."""
    votes = np.array(table)
    good = np.where((votes == -1).any(1), 0.1, np.where((votes == 1).any(1), 0.9, 0.5))
    last = None
    for _ in range(rounds):
        prior = (1 + good.sum()) / (2 + len(good))
        on_good = np.clip((18 + ((votes == 1) * good[:, None]).sum(0)) / (20 + ((votes != 0) * good[:, None]).sum(0)), 1e-6, 1 - 1e-6)
        on_bad = np.clip((3 + ((votes == -1) * (1 - good)[:, None]).sum(0)) / (5 + ((votes != 0) * (1 - good)[:, None]).sum(0)), 1e-6, 1 - 1e-6)
        p = np.log(prior) + np.where(votes == 1, np.log(on_good), np.where(votes == -1, np.log(1 - on_good), 0)).sum(1)
        r = np.log(1 - prior) + np.where(votes == 1, np.log(1 - on_bad), np.where(votes == -1, np.log(on_bad), 0)).sum(1)
        good = 1 / (1 + np.exp(r - p))
        likely = np.logaddexp(p, r).sum()
        if last is not None and abs(likely - last) <= 1e-9 * max(1, abs(last)):
            break
        last = likely
    return 1 / (1 + np.exp(r - p))


def junk_and_prose(n=150):
    rng = random.Random(8)
    sounds = ["ri", "sto", "wa", "gre", "le", "spo", "win", "ta", "mor", "hou", "ne", "ver"]
    word = lambda: "".join(rng.choices(sounds, k=rng.randint(1, 4)))
    prose = [" ".join([word() for _ in range(rng.randint(30, 300))]).capitalize() + "." for _ in range(n)]
    piped = [" | ".join(word() for _ in range(rng.randint(15, 150))) for _ in range(n // 10)]
    marked = [" ".join(word() + rng.choice(["###", "&&&", "%%%"]) for _ in range(rng.randint(30, 300))) for _ in range(n // 10)]
    shouted = [" ".join(word().upper() + "!!" for _ in range(rng.randint(30, 300))) for _ in range(n // 10)]
    return prose, piped + marked + shouted


def test_kept_equals_plain_expectation_maximisation(docs, folder, spark):
    prose, junk = junk_and_prose()
    rows = list(enumerate(prose + junk + texts()))
    found = {r.doc_id: r for r in q.op4_quality_rules(spark, folder(documents=docs(rows))).collect()}
    judged = [(i, t) for i, t in rows if not plain(t)[5]]
    want = plain_quality([plain_votes(t) for _, t in judged])
    for (i, _), p in zip(judged, want):
        assert found[i].quality == pytest.approx(p, abs=1e-6) and found[i].kept == (p >= 0.5)
    assert not any(r.kept for i, r in found.items() if plain(dict(rows)[i])[5])
    assert all(found[i].kept for i in range(len(prose)))
    assert sum(found[i].kept for i in range(len(prose), len(prose) + len(junk))) <= 0.1 * len(junk)


def test_a_very_long_text(docs, folder, spark):
    long = "\n".join(f"line {i} of a text that goes on and on, word{i % 977}" for i in range(60_000))
    r = q.op4_quality_rules(spark, folder(documents=docs([(1, long), (2, None)]))).where("doc_id = 1").first()
    words = long.split()
    assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), 0) and len(long) > 2_500_000


def test_plan_has_no_python(docs, folder, spark, tmp_path):
    counted, name = q.annotate(docs([(1, "a b")]))
    for df in (counted, q.op4_quality_rules(spark, folder(documents=docs([(1, "a b")]))), q.keep_good(docs([(1, "a b")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("RoundRobinPartitioning", "").split("Scan")[0].split("AdaptiveSparkPlan")[0]


def test_em_recovers_planted_accuracies():
    rng = random.Random(7)
    truth = {"a": (0.98, 0.7), "b": (0.95, 0.6), "c": (0.97, 0.8), "d": (0.99, 0.5)}
    seen = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(0 if rng.random() < 0.1 else (1 if good else -1) * (1 if rng.random() < truth[r][0 if good else 1] else -1) for r in truth)
        seen[votes] = seen.get(votes, 0) + 1
    model = q.expectation_maximisation(sorted(seen.items()), list(truth))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    for r, (g, b) in truth.items():
        assert model.right[r][0] == pytest.approx(g, abs=0.03)
        assert model.right[r][1] == pytest.approx(b, abs=0.12)


def test_clean_documents_stay_and_junk_goes(docs):
    rng = random.Random(4)
    words = ["the", "of", "river", "morning", "house", "walked", "under", "green", "letters", "table", "spoke", "winter"]
    clean = [" ".join(rng.choices(words, k=120)) + "." for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=120)) for _ in range(6)] + [" ".join(w + "***" for w in rng.choices(words, k=120)) for _ in range(6)]
    rows = list(enumerate(clean + junk))
    kept = q.keep_good(docs(rows).selectExpr("*", "1 AS N_WORDS", "2 AS tmp_h"))
    assert kept.columns[-2:] == ["N_WORDS", "tmp_h"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_empty_table(docs, folder, spark):
    assert q.op4_quality_rules(spark, folder(documents=docs([]))).collect() == []
    assert q.expectation_maximisation([], ["a"]).prior == 0.5
