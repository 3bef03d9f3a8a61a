import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.errors import LoomError
from sparkloom.functions.recursive import RecursiveConfig, chunk_rows, running_starts
from sparkloom.functions.text import WHITE_CHARS
from sparkloom.operators import legacy, splitting
from sparkloom.operators.routing import ChunkerConfig, chunk_text, with_chunks
from sparkloom.operators.semantic import SemanticConfig
from sparkloom.operators.splitting import normalized, split, token_counter, default_token_ranks

ODD = ["a", "bc", " ", "\t", "\n", "\r", "\r\n", "\n\n", ".", "? ", "! ", ".\n", "é", "你", "🙂", "\xa0", "　", "\x85", "\x1c", "word", "the end. "]
texts = st.lists(st.sampled_from(ODD), max_size=60).map("".join)


def words(text, **sizes):
    return [c["text"] for c in split(text, RecursiveConfig(**sizes))]


def test_golden_vectors():
    assert words("", max_size=10) == [] and words("hello", max_size=0) == []
    assert words("abcdefghij", max_size=4) == ["abcd", "efgh", "ij"]
    assert words("abcdefghij", max_size=5, overlap=2) == ["abcde", "defgh", "ghij"]
    first = split("aaaa\n\nbbbb cccc\ndddd", RecursiveConfig(8))[0]
    assert (first["text"], first["boundary"]) == ("aaaa", "Paragraph")
    assert words("hello world", max_size=512) == ["hello ", "world"]
    assert words("para1\n\npara2", max_size=512) == ["para1", "para2"]
    assert normalized("a\r\nb\rc\nd") == "a\nb\nc\nd"


@pytest.mark.parametrize("sizes", [{"max_size": 10, "min_size": 11}, {"max_size": 10, "overlap": 10}, {"max_size": -1}, {"metric": "bytes"}])
def test_bad_sizes_are_rejected(sizes):
    with pytest.raises(LoomError):
        RecursiveConfig(**sizes)


def oracle(text, n, least):
    """The rules once more, by candidates at every place."""
    text, at, out = normalized(text), 0, []
    while at < len(text):
        w = text[at : at + n]
        kinds = [
            [i for i in range(1, len(w) - 1) if w[i : i + 2] == "\n\n"],
            [i for i in range(1, len(w) + 1) if w[i - 1] == "\n"],
            [i for i in range(1, len(w)) if w[i - 1] in ".?!" and w[i] in " \n"],
            [i for i in range(1, len(w) + 1) if w[i - 1] in " \t"],
        ]
        end, kind = next(((max(k for k in c if k >= least), name) for c, name in zip(kinds, ("Paragraph", "Line", "Line", "Whitespace")) if any(k >= least for k in c)), (len(w), "Forced"))
        out.append((w[:end], kind, len(text[:at].encode()), end))
        at += end
        while at < len(text) and text[at] in WHITE_CHARS:
            at += 1
    return out


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 40), st.integers(0, 40))
def test_python_splitter_follows_the_rules(text, n, least):
    if least > n:
        return
    got = [(c["text"], c["boundary"], c["start_byte"], c["char_len"]) for c in split(text, RecursiveConfig(n, least))]
    assert got == oracle(text, n, least)


@pytest.mark.parametrize("n,least", [(1, 0), (2, 0), (3, 2), (8, 0), (8, 5), (20, 20), (64, 20), (512, 0)])
def test_native_splitter_equals_python(spark, n, least):
    rng = random.Random(n * 100 + least)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randint(0, 80)))) for i in range(250)] + [(-1, None)]
    config = RecursiveConfig(n, least)
    got = chunk_rows(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), config, ["doc_id"]).collect()
    want = [(i, c["index"], c["boundary"], c["start_byte"], c["end_byte"], c["char_len"], c["text"]) for i, t in rows for c in split(t or "", config)]
    assert sorted(map(tuple, got)) == sorted(want)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(2, 30), st.integers(1, 29))
def test_overlap_repeats_the_end_of_a_chunk(text, n, overlap):
    if overlap >= n:
        return
    chunks = split(text, RecursiveConfig(n, 0, overlap))
    plain = normalized(text)
    assert all(plain.encode()[c["start_byte"] : c["end_byte"]].decode() == c["text"] and c["char_len"] <= n for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        end = len(plain.encode()[: a["end_byte"]].decode())
        start = len(plain.encode()[: a["start_byte"]].decode())
        assert len(plain.encode()[: b["start_byte"]].decode()) == max(start + 1, max(1, end - overlap))
    assert not plain or chunks[-1]["end_byte"] == len(plain.encode())


def test_token_sizes_hold():
    count = token_counter(default_token_ranks())
    rng = random.Random(4)
    text = "".join(rng.choices([*ODD, "several words of prose ", "naïve "], k=600))
    for overlap in (0, 8):
        chunks = split(text, RecursiveConfig(32, 0, overlap, "tokens"))
        assert all(count(c["text"]) <= 32 for c in chunks)
        assert chunks[-1]["end_byte"] == len(normalized(text).encode())


@settings(max_examples=80, deadline=None)
@given(texts, st.sampled_from(["recursive", "markdown", "semantic", "code:rust", "code:python", "code:tsx", "code:bash", "code:ruby", "code:cpp"]), st.integers(16, 64))
def test_properties_of_every_chunker(text, strategy, n):
    config = ChunkerConfig(RecursiveConfig(n), strategy)
    chunks = chunk_text(text, strategy, config)
    raw = normalized(text).encode()
    assert [c["index"] for c in chunks] == list(range(len(chunks)))
    for c in chunks:
        assert c["char_len"] == len(c["text"]) <= n and raw[c["start_byte"] : c["end_byte"]].decode() == c["text"]
    assert all(a["end_byte"] <= b["start_byte"] for a, b in zip(chunks, chunks[1:]))
    kept = "".join(c["text"] for c in chunks)
    assert "".join(kept.split()) == "".join(normalized(text).split()) or strategy == "semantic"


def test_table_of_all_kinds_of_files(spark):
    rows = [("/a/x.md", "# T\n\nbody text"), ("/a/x.rs", "fn a() {}\nfn b() {}"), ("/a/x.txt", "two words"), ("/a/e.txt", ""), ("/a/e.md", "  \n"), ("/a/n.py", None), ("/a/X.PY", "def f(): pass\n")]
    df = with_chunks(spark.createDataFrame(rows, "canonical_path string, text string"), ChunkerConfig())
    got = {r.canonical_path: r for r in df.collect()}
    assert [c.text for c in got["/a/x.md"].chunks] == ["# T\n", "body ", "text"] or len(got["/a/x.md"].chunks) >= 2
    assert got["/a/x.rs"].strategy_fingerprint == "code:v1|lang=rust|grammar=scan-rust@1|metric=chars|max=512|min=0|overlap=0"
    assert got["/a/x.txt"].strategy_fingerprint == "recursive:v1|metric=chars|tokenizer=chars|max=512|min=0|overlap=0"
    assert [(c.text, c.boundary, c.end_byte) for c in got["/a/e.txt"].chunks] == [("", "Forced", 0)]
    assert [(c.text, c.boundary) for c in got["/a/e.md"].chunks] == [("  \n", "Forced")]
    assert got["/a/n.py"].chunks is None and got["/a/X.PY"].strategy == "code:python"
    assert all(r.error_kind is None for r in got.values())


def test_a_chunker_error_is_a_value(spark):
    def broken(sentences):
        return []

    df = spark.createDataFrame([("a.txt", "One sentence. Two sentences."), ("b.txt", "Alone")], "canonical_path string, text string")
    got = {r.canonical_path: r for r in with_chunks(df, ChunkerConfig(single="semantic"), embed=broken).collect()}
    assert got["a.txt"].error_kind == "internal" and "count mismatch: expected 2, got 0" in got["a.txt"].error_message and got["a.txt"].chunks is None
    assert got["b.txt"].error_kind is None and len(got["b.txt"].chunks) == 1


def test_fingerprints():
    c = ChunkerConfig(RecursiveConfig(100, 10, 5, "tokens"), semantic=SemanticConfig(RecursiveConfig(100, 10, 5), 60, "keyword:test"))
    assert c.fingerprint("recursive") == "recursive:v1|metric=tokens|tokenizer=bpe:byte_bpe_50k|max=100|min=10|overlap=5"
    assert c.fingerprint("markdown") == "markdown:v1|metric=tokens|max=100|min=10|overlap=5"
    assert c.fingerprint("semantic") == "semantic:v1|signal=keyword:test|metric=chars|max=100|min=10|percentile=60"


def test_oldest_calls():
    assert legacy.chunk_text("para1\n\npara2") == ["para1", "para2"]
    assert legacy.chunk_document("abc", 10, 0, 10) == ([], "legacy:v0|broken")
    assert legacy.chunk_document("abc")[1] == "recursive:v1|metric=chars|tokenizer=chars|max=512|min=0|overlap=0"


@settings(max_examples=300, deadline=None)
@given(st.one_of(texts, st.text(max_size=40), st.lists(st.sampled_from([*ODD, "  ", "'re", "'", "l", "12", "_", "՘"]), max_size=40).map("".join)))
def test_token_counts_equal_the_tokenizer(text):
    count = token_counter(default_token_ranks())
    plain = lambda t: len(count._encoding.encode_ordinary(t))
    assert count(text) == plain(text)
    prefix = count.prefixes(text)
    assert [prefix(k) for k in range(len(text) + 1)] == [plain(text[:k]) for k in range(len(text) + 1)]


def test_sizes_by_a_file_of_ranks():
    import base64

    import public_tokenizers
    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("x", pat_str=splitting.CL100K_WORDS, mergeable_ranks=ranks, special_tokens=splitting.CL100K_SPECIAL)
    config = RecursiveConfig(20, metric="tokens", ranks=path)
    count = splitting.counter(config)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["word ", "It'S", "12345", "  ", "\n", "\r\n", "...", "é", "<|endoftext|>", "՘", "Other", ". "], k=rng.randint(0, 30)))
        assert count(text) == len(library.encode(text, allowed_special="all"))
        prefix = count.prefixes(text)
        assert all(prefix(k) == len(library.encode(text[:k], allowed_special="all")) for k in range(len(text) + 1))
    assert config.fingerprint == "recursive:v1|metric=tokens|tokenizer=tiktoken:cl100k_base|max=20|min=0|overlap=0"
    assert all(count(c["text"]) <= 20 for c in splitting.split("Some words of a text. " * 60, config))


def test_offsets_take_linear_time(spark):
    took = {}
    for n in (0, 1, 63, 64, 65, 200, 10_000, 80_000):
        df = spark.range(1).select(F.expr("transform(sequence(1, 80000), x -> CAST(x % 7 AS INT))").alias("s")).select(running_starts(F.slice("s", 1, n)).alias("at"))
        began = time.perf_counter()
        got = df.first()["at"]
        took[n] = time.perf_counter() - began
        assert got == [0, *itertools.accumulate(i % 7 for i in range(1, n + 1))][:n]
    assert took[80_000] < 5 + 20 * took[10_000]
