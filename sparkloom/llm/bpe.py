"""Byte-pair encoding by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

A merge list decides a stretch of text from a bounded number of bytes to its right, its sufficient lookahead, which
``lookahead`` computes from the list. The encoder holds a window of that size and a fixed part besides; a token that ends
before the lookahead region can't change any more and is emitted, so memory doesn't depend on the length of the input.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sized
from functools import lru_cache
from itertools import chain

import regex

_SHIFT = 21  # symbol ids are below 2 ** 21


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A tokenizer file's vocabulary and merges over byte symbols, the last symbol of a word marked by a suffix if any."""

    def __init__(self, model: dict) -> None:
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model.get("ignore_merges") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain byte-level merge lists are supported")
        symbols = byte_symbols()
        self.base = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        value = {s: b for b, s in enumerate(symbols)}
        self.size = max(vocab.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token.removesuffix(self.suffix)) if self.suffix and token.endswith(self.suffix) else bytes(value[c] for c in token)
        ids = list(range(self.size))  # one object for each id: memo entries share them
        self.pairs: dict[int, int] = {}  # the rank of the merge of two symbols
        self.left, self.right, self.made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(left << _SHIFT | right, rank)
            self.left.append(ids[left])
            self.right.append(ids[right])
            self.made.append(ids[new])
        self.base, self.final = [ids[i] for i in self.base], [ids[i] for i in self.final]
        self.none = len(self.made)
        self.longest = max(map(len, self.bytes))

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of a word, whole or the part of it that a window holds: merges apply in order of rank, from the left.

        It may change the list that it is given.
        """
        return self._merge_one_by_one(symbols) if len(symbols) <= 64 else self._merge_by_rank(symbols)

    def _merge_one_by_one(self, symbols: list[int]) -> list[int]:
        get, none, shift = self.pairs.get, self.none, _SHIFT
        ranks = [get(a << shift | b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] = new = self.made[best]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << shift | new, none)
            if i < len(ranks):
                ranks[i] = get(new << shift | symbols[i + 1], none)
        return symbols

    def _merge_by_rank(self, symbols: list[int]) -> list[int]:
        get, none, shift = self.pairs.get, self.none, _SHIFT
        while len(symbols) > 1:
            rank = min(get(a << shift | b, none) for a, b in zip(symbols, symbols[1:], strict=False))
            if rank == none:
                break
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            out, i, last = [], 0, len(symbols) - 1
            while i <= last:
                s = symbols[i]
                if s == left and i < last and symbols[i + 1] == right:
                    out.append(new)
                    i += 2
                else:
                    out.append(s)
                    i += 1
            symbols = out
        return symbols

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a token that can decide about it, at most.

        Compare the merges of a text and of a text that goes on after it. Both agree up to a common boundary, at first the
        text's end. The boundary moves left only when a merge (a, b) joins the token a before it to what follows in one of
        the two, and then by the length of a. The next move, by a merge (c, t) of higher rank, needs a token t that grew
        from a or a longer token starting like it: a is on the left spine of t's derivation. The longest such chain, as
        the sum of the lengths of its left parts, bounds how far the boundary can get.
        """
        if not hasattr(self, "_lookahead"):
            parts = {new: (a, b) for new, a, b in zip(reversed(self.made), reversed(self.left), reversed(self.right), strict=True)}
            reach: dict[int, int] = {}  # by token: the longest chain so far that ends with a merge whose left part it is
            for a, t in zip(self.left, self.right, strict=True):
                before, spine = 0, t
                while spine is not None:
                    before = max(before, reach.get(spine, 0))
                    spine = parts[spine][0] if spine in parts else None
                reach[a] = max(reach.get(a, 0), before + len(self.bytes[a]))
            self._lookahead = max(reach.values(), default=0)
        return self._lookahead


class StreamEncoder:
    """Encodes words that come in pieces; push() and finish() give tokens as they become stable.

    It holds window bytes at most. A token that ends lookahead bytes before the end of what is held can't change any more;
    the end of a word makes all its tokens stable.
    """

    def __init__(self, table: MergeTable) -> None:
        self.table, self.held = table, b""
        self.window = 2 * table.lookahead + table.longest + 256
        self.emitted = 0

    def push(self, piece: bytes) -> Iterator[list[int]]:
        """Takes the next bytes of a word."""
        if len(self.held) + len(piece) <= self.window:
            self.held += piece
            return
        table, size = self.table, table_bytes(self.table)
        for at in range(0, len(piece), self.window):
            self.held += piece[at : at + self.window]
            if len(self.held) <= self.window:
                continue
            stable, done, out = len(self.held) - 1 - table.lookahead, 0, []  # the last byte may turn out to be a word's final symbol
            for token in table.merge([table.base[b] for b in self.held[:-1]]):
                end = done + size(token)
                if end > stable:
                    break
                out.append(token)
                done = end
            self.held = self.held[done:]
            self.emitted += len(out)
            yield out

    def finish(self) -> list[int]:
        """The end of a word; the encoder is ready for the next."""
        held, self.held = self.held, b""
        if not held:
            return []
        base = self.table.base
        out = self.table.merge([*[base[b] for b in held[:-1]], self.table.final[held[-1]]])
        self.emitted += len(out)
        return out


def table_bytes(table: MergeTable) -> Callable[[int], int]:
    """How many bytes a token stands for."""
    return lambda token: len(table.bytes[token])


#: Unicode White_Space, as pattern text.
_SPACE = r"\t-\r \x85\xa0  -     　"
_LATIN_LETTER, _LATIN_NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose classes, composition and lower case are the same in all versions of Unicode that matter here.
_SAFE = regex.compile("[\0-՗ -⁤₠-₸ぁ-ゖ゙-ヿ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]*+")
_LATIN = re.compile("[\\0-\xff]*+")
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"


def _patterns(keeps_space: bool) -> tuple[re.Pattern, regex.Pattern]:
    """The pre-tokenizer for Latin-1 texts and for others."""
    out = []
    for module, letter, number in ((re, _LATIN_LETTER, _LATIN_NUMBER), (regex, r"\p{L}", r"\p{N}")):
        space = r"\t-\r \x85\xa0" if module is re else _SPACE
        if keeps_space:
            p = rf"{_CONTRACTION}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        else:
            p = rf"{_CONTRACTION}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
        out.append(module.compile(p))
    return tuple(out)


#: Characters of a text whose words are listed at a time; words of more than LONG characters are read in pieces.
BLOCK, LONG = 1 << 16, 1 << 12


class LongWord:
    """A word of more than LONG characters: a place in a text, of which pieces() are read one after the other."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end

    def pieces(self) -> Iterator[bytes]:
        for at in range(self.start, self.end, LONG):
            yield self.text[at : min(self.end, at + LONG)].encode("utf-8", "surrogateescape")

    def whole(self) -> bytes:
        return b"".join(self.pieces())


def _with_long_words(words: list[str], size: int) -> Iterator[list[str] | LongWord]:
    """The words, the long ones apart; size: of all."""
    if size <= LONG or max(map(len, words), default=0) <= LONG:
        yield words
        return
    at = 0
    for i, word in enumerate(words):
        if len(word) > LONG:
            yield words[at:i]
            yield LongWord(word, 0, len(word))
            at = i + 1
    yield words[at:]


class Memo(dict):
    """What make gives for a word, for the words of late: two generations, each of at most most bytes, about."""

    def __init__(self, make: Callable[[str], Sized], most: int = 24 << 20, longest: int = 48) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.old, self.bytes = make, most, longest, {}, 0

    def __missing__(self, word: str):  # noqa: ANN204
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > self.longest:
                return found
        if self.bytes >= self.most:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[word] = found
        self.bytes += 170 + len(word) + (8 * len(found) if hasattr(found, "__len__") else 0)
        return found


class WordTokenizer:
    """A tokenizer file as its library applies it: special strings, normalisation, words; words go through a StreamEncoder.

    remember: what it gave for short words of late is kept and not worked out again.
    """

    def __init__(self, path: str, remember: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.table = MergeTable(spec["model"])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lowers = spec["normalizer"] is not None
        pre = spec["pre_tokenizer"]
        kinds = [x["type"] for x in pre.get("pretokenizers", [pre])]
        norms = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if (kinds, norms) not in ((["ByteLevel"], []), (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"])):
            raise ValueError("this pre-tokenizer or normalizer is not supported")
        self.keeps_space = kinds == ["ByteLevel"]
        self._latin, self._other = _patterns(self.keeps_space)
        self.stream = StreamEncoder(self.table)
        self._memo: Memo | None = Memo(self._encode_word) if remember else None
        self._library = None
        self.text_of = list(self.table.bytes)
        for content, i in self.special.items():
            self.text_of += [b""] * (i + 1 - len(self.text_of))
            self.text_of[i] = content.encode()
        self.decimal = [str(i) for i in range(len(self.text_of))]

    # words

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The stretches between special strings, and those strings with their ids."""
        if self._cut is None or not any(s in text for s in self.special):
            yield text, None
            return
        for piece in self._cut.split(text):
            if piece:
                yield piece, self.special.get(piece)

    def words(self, text: str) -> Iterator[list[str] | LongWord]:
        """The words of a stretch without special strings, normalised, in lists of about BLOCK characters, long ones apart."""
        if text.isascii() or _LATIN.fullmatch(text):
            pattern, text = self._latin, text.lower() if self.lowers else text
        elif _SAFE.fullmatch(text):
            pattern = self._other
            if self.lowers:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:
            yield from self._library_words(text)
            return
        if len(text) <= BLOCK:
            yield from _with_long_words(pattern.findall(text), len(text))
            return
        words, size = [], 0
        for m in pattern.finditer(text):
            start, end = m.span()
            if end - start > LONG:
                yield words
                yield LongWord(text, start, end)
                words, size = [], 0
                continue
            words.append(m.group())
            size += end - start
            if size >= BLOCK:
                yield words
                words, size = [], 0
        yield words

    def _library_words(self, text: str) -> Iterator[list[str] | LongWord]:
        """For characters that versions of Unicode may see differently: as the library itself cuts them, a BLOCK at a time.

        A block ends before a space between two ASCII letters, where any pre-tokenizer here begins a word.
        """
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._value = {s: b for b, s in enumerate(byte_symbols())}
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK)
            end = cut.start() + 1 if cut else len(text)
            part, at = text[at:end], end
            if self._library.normalizer is not None:
                part = self._library.normalizer.normalize_str(part)
            words = [bytes(self._value[c] for c in word).decode("utf-8", "surrogateescape") for word, _ in self._library.pre_tokenizer.pre_tokenize_str(part)]
            yield from _with_long_words(words, len(part))

    # encoding

    def _encode_word(self, word: str) -> tuple[int, ...]:
        """A word of bounded length through the streaming encoder."""
        early = [i for part in self.stream.push(word.encode("utf-8", "surrogateescape")) for i in part]
        return (*early, *self.stream.finish())

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in lists of bounded length, emitted as they become stable."""
        word_ids = self._encode_word if self._memo is None else self._memo.__getitem__
        for piece, special in self.pieces(text):
            if special is not None:
                yield [special]
                continue
            for words in self.words(piece):
                if isinstance(words, LongWord):
                    for part in words.pieces():
                        yield from self.stream.push(part)
                    yield self.stream.finish()
                else:
                    yield list(chain.from_iterable(map(word_ids, words)))


class TextDecoder:
    """Ids to text, bit by bit: the state is the start of a character of which bytes are still to come, three at most."""

    def __init__(self, text_of: list[bytes]) -> None:
        self._bytes = text_of.__getitem__
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self._state.decode(b"".join(map(self._bytes, ids)))

    def finish(self) -> str:
        return self._state.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, once a Python worker."""
    return WordTokenizer(path)
