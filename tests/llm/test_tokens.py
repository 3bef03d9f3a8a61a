import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, bpe_codec, token_counts, token_files, transducer

BYTE, WORD = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ODD = ["a", "b", "e", " ", "  ", "\n", "\r\n", "'s", "'", "'re", "1", "²", "é", "É", "ß", "é", "J̌", "İ", "<|endoftext|>", "<|startoftext|>", "!", "\x85", "\x1c", "\xa0", "œ", "Σ", "你好", "😀", "՘", "\U0001f9f0", "ſ", "the", "ing", "_", "\x00", "�"]


def ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.lists(st.sampled_from(ODD), max_size=25).map("".join), st.text(max_size=40)))
def test_encoding_and_decoding_equal_the_library(path, text):
    tok = bpe.load(path)
    got = [i for part in tok.encode(text) for i in part]
    assert got == ids(path, text)
    if path == BYTE:
        decoder = bpe.TextDecoder(tok.text_of)
        assert "".join(decoder.push([i]) for i in got) + decoder.finish() == LIBRARY[path].decode(got, skip_special_tokens=False)


def cut_anywhere(tok, text, size):
    """The symbols of a text in chunks of size bytes."""
    out, words, head, head_ends, tail, room = [], [], b"", False, b"", size

    def close():
        nonlocal words, head, head_ends, tail, room
        out.append(transducer.Chunk(words, head, head_ends, tail))
        words, head, head_ends, tail, room = [], b"", False, b"", size

    for piece, special in tok.pieces(text):
        if special is not None:
            out += [transducer.Chunk(words, head, head_ends, tail), transducer.Chunk([], special=1)]
            words, head, head_ends, room = [], b"", False, size
            continue
        for word in (w for part in tok.words(piece) for w in part):
            raw = word.encode("utf-8", "surrogateescape")
            first = True
            while len(raw) > room:
                if first:
                    tail = raw[:room]
                else:
                    head = raw[:room]
                raw, first = raw[room:], first and not room
                close()
            if first:
                words.append(raw.decode("utf-8", "surrogateescape"))
            else:
                head, head_ends = raw, True
            room -= len(raw)
    close()
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.lists(st.sampled_from(ODD), max_size=25).map("".join), st.text(st.characters(max_codepoint=255), max_size=40)), size=st.integers(1, 12))
def test_counts_equal_the_library_however_texts_are_cut(path, text, size):
    counter = transducer.counter(path)
    chunks = cut_anywhere(counter.tokenizer, text, size)
    maps = counter.maps(chunks, transducer.START)
    scanned = transducer.scan(maps)
    one_by_one = maps[0]
    for k, m in enumerate(maps[1:], 1):
        assert scanned[k - 1][transducer.START] == one_by_one[transducer.START]
        one_by_one = transducer.compose(one_by_one, m)
    assert scanned[-1][transducer.START] == (transducer.START, len(ids(path, text))) == one_by_one[transducer.START]
    if len(maps) > 2:
        a, b, c = maps[:3]
        assert transducer.compose(transducer.compose(a, b), c) == transducer.compose(a, transducer.compose(b, c))
    assert counter.count(text) == len(ids(path, text))


def test_maps_hold_no_text():
    counter = transducer.counter(BYTE)
    chunks = [transducer.Chunk([], tail=b"ab" * 4000), *(transducer.Chunk([], head=b"ab" * 4000) for _ in range(5)), transducer.Chunk(["word"], head=b"ab" * 4000, head_ends=True)]
    maps = counter.maps(chunks, transducer.START)
    longest = counter.tokenizer.table.longest
    assert all(len(s[0]) < longest and len(e[0]) < longest for m in maps for s, (e, _) in m.items())
    assert transducer.scan(maps)[-1][transducer.START][1] == len(ids(BYTE, "ab" * 28000)) + len(ids(BYTE, "word"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_all_words_come_from_the_stream(path):
    rng = random.Random(2)
    text = "".join(rng.choices([*ODD, "word ", "and "], k=2000)) + "x" * 9000 + " end"
    for remember in (False, True):
        tok = bpe.WordTokenizer(path, remember)
        got = [i for part in tok.encode(text) for i in part]
        assert got == ids(path, text)
        special = sum(i in tok.special.values() for i in got)
        assert tok.stream.emitted + special == len(got) if not remember else 0 < tok.stream.emitted < len(got)


@pytest.mark.parametrize("unit", ["abcdefghij", "the cat sat. ", "՘՘ ՘ word word "])
def test_memory_of_encoding_does_not_grow_with_the_text(unit):
    tok, peaks = bpe.WordTokenizer(BYTE), []
    for n in (1 << 14, 1 << 16, 1 << 18):
        text = unit * (n // len(unit))
        tracemalloc.start()
        count = sum(len(part) for part in tok.encode(text))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count
    assert peaks[2] < 2 * peaks[1] + (1 << 20), peaks


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("letters", ["a", "ab", "aeinrst", "=", "abcdefghijklmnopqrstuvwxyz", " ", "0123456789"])
def test_long_words_stream_with_a_bounded_window(path, letters):
    text = "".join(random.Random(3).choices(letters, k=20_000))
    tok = bpe.load(path)
    assert [i for part in tok.encode(text) for i in part] == ids(path, text)
    stream = bpe.StreamEncoder(tok.table)
    for at in range(0, 20_000, 777):
        list(stream.push(text[at : at + 777].encode()))
        assert len(stream.held) <= stream.window
    assert transducer.counter(path).count(text) == len(ids(path, text))


def test_lookahead_decides(monkeypatch):
    table = bpe.load(BYTE).table
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choices("aeinrst", k=table.lookahead + 60)).encode()
        more = text + "".join(rng.choices("aeinrst", k=50)).encode()
        ends = []
        for t in (text, more):
            at, found = 0, []
            for token in table.merge([table.base[b] for b in t]):
                at += len(table.bytes[token])
                if at <= len(text) - table.lookahead:
                    found.append(at)
            ends.append(found)
        assert ends[0] == ends[1]


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices([x for x in ODD if x.isascii()] + ["word ", "other  "], k=4000))
    want = {p: ids(p, text) for p in (BYTE, WORD)}
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "LONG", 7)
    for p in (BYTE, WORD):
        assert [i for part in bpe.load(p).encode(text) for i in part] == want[p]


def texts():
    rng = random.Random(9)
    return [None, "", " ", "<|endoftext|>", "long " * 3000, "x" * 9000] + ["".join(rng.choices([*ODD, "word ", "and "], k=rng.randint(1, 60))) for _ in range(80)]


def test_op10_equals_the_library(docs, folder, spark):
    rows = list(enumerate(texts())) + [(3, "a repeated id"), (None, "no id")]
    want = []
    for i, t in rows:
        got = ids(BYTE, t or "")
        text = LIBRARY[BYTE].decode(got, skip_special_tokens=False)
        want.append((i, len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = bpe_codec.op10_bpe_codec(spark, folder(documents=docs(rows)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_columns_of_ids_and_back(docs):
    from pyspark.sql import functions as F

    df = docs([(1, "Hello wörld <|endoftext|>"), (2, None)]).withColumn("ids", bpe_codec.encode_column(F.col("text"), BYTE))
    rows = {r.doc_id: r for r in df.withColumn("back", bpe_codec.decode_column(F.col("ids"), BYTE)).collect()}
    assert rows[1].ids == ids(BYTE, rows[1].text) and rows[1].back == rows[1].text
    assert rows[2].ids == [] and rows[2].back == ""


def test_op9_equals_the_library(docs, folder, spark):
    rows = list(enumerate(texts())) + [(3, "a repeated id"), (None, "no id")]
    want = [(i, len((t or "").encode()), n := len(ids(WORD, t or "")), n > 2048) for i, t in rows]
    found = token_counts.op9_token_counts(spark, folder(documents=docs(rows)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_op2_reads_back_what_the_library_gives(docs, folder, spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_ROWS", 20)
    monkeypatch.setattr(token_files.write_tokens, "__defaults__", ("doc_id", "text", 20))
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts())] + [(1, "a repeated id"), (1, "a repeated id"), (None, "no id"), (None, "another")]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, struct.pack(">Q", xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ 1 << 63))):
        got = [*ids(WORD, t or ""), 2]
        want.append((i, start, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        start += len(got)
    found = token_files.op2_token_files(spark, folder(documents=docs(rows)))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want


def test_empty_tables(docs, folder, spark):
    d = folder(documents=docs([]))
    for query in (token_files.op2_token_files, token_counts.op9_token_counts, bpe_codec.op10_bpe_codec):
        assert query(spark, d).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.lists(st.sampled_from(ODD), max_size=25).map("".join), st.text(st.characters(max_codepoint=255), max_size=40), st.text(max_size=20)))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_words_equal_the_library(path, text):
    encoder = token_files.library_encoder(path)
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == ids(path, text)


def test_what_is_remembered_is_bounded():
    memo = bpe.Memo(lambda w: (1, 2, 3), most=100_000)
    for i in range(50_000):
        assert memo[f"w{i}"] == (1, 2, 3)
    assert len(memo) + len(memo.old) < 1200
