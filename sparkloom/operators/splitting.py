"""Size-bounded splitting in Python, for what native expressions can't say: overlap, and sizes in tokens.

Chunks are dicts as schema.CHUNK has them. Offsets are bytes of the normalised text. For sizes in characters without
overlap this gives what functions.recursive gives; tests hold the two against each other.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import regex

from ..functions.recursive import RecursiveConfig
from ..functions.text import WHITE, WHITE_CHARS

Chunk = dict[str, object]
_WHITE_RUN = re.compile(f"[{WHITE}]*")
#: Ends of each kind in a window, from the strongest; only sentences look at what follows.
_ENDS = (("Paragraph", re.compile(r"(?=\n\n)")), ("Line", re.compile(r"(?<=\n)")), ("Line", re.compile(r"(?<=[.?!])(?=[ \n])")), ("Whitespace", re.compile(r"(?<=[ \t])")))


# The words and the special strings of cl100k_base.
CL100K_WORDS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
CL100K_SPECIAL = {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276}


def default_token_ranks() -> str:
    """The merge ranks that sizes in tokens are counted with."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class TokenCounter:
    """The number of tokens of texts, by merge ranks that are loaded once a process.

    Tokens never cross the words that the pattern finds, so the counts of words add up; a worker remembers those of recent
    words. Characters that versions of Unicode may see differently are left to the tokenizer's own pattern, and so are texts with
    special strings, each of which is a token. cl100k: the file has the ranks of cl100k_base.
    """

    #: Words that are remembered.
    MOST = 100_000
    _SAFE = regex.compile("[\0-\x1b\x20-\u0557\u2000-\u2064\u3041-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*+")

    def __init__(self, ranks_path: str, cl100k: bool = False) -> None:
        import tiktoken

        if cl100k:
            pattern, special = CL100K_WORDS, CL100K_SPECIAL
        else:
            import public_tokenizers

            pattern, special = public_tokenizers.PATTERN, {}

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._words, self._special = regex.compile(pattern), tuple(special)
        self._memo: dict[str, int] = {}

    def _word(self, word: str) -> int:
        n = self._memo.get(word)
        if n is None:
            n = len(self._encoding.encode_ordinary(word))
            if len(self._memo) >= self.MOST:
                self._memo.clear()
            if len(word) <= 64:
                self._memo[word] = n
        return n

    def _by_words(self, text: str) -> bool:
        return bool(self._SAFE.fullmatch(text)) and not any(s in text for s in self._special)

    def __call__(self, text: str) -> int:
        if self._by_words(text):
            return sum(map(self._word, self._words.findall(text)))
        return len(self._encoding.encode(text, allowed_special="all", disallowed_special=()))

    def prefixes(self, text: str) -> Callable[[int], int]:
        """A function from a place to the number of tokens of the text up to it.

        What a word is depends on one character behind it, or on a word behind it if it is white space; so all words but
        the last two before a place are those of the whole text, and only what follows them is counted anew.
        """
        if not self._by_words(text):
            return lambda at: self(text[:at])
        words = self._words.findall(text)
        ends = [0, *accumulate(map(len, words))]
        sums = [0, *accumulate(map(self._word, words))]

        def count(at: int) -> int:
            k = max(0, bisect_right(ends, at) - 3)
            return sums[k] + self(text[ends[k] : at])

        return count


@lru_cache(maxsize=2)
def token_counter(ranks_path: str, cl100k: bool = False) -> TokenCounter:
    return TokenCounter(ranks_path, cl100k)


def counter(config: RecursiveConfig) -> Callable[[str], int]:
    return len if config.metric == "chars" else token_counter(config.ranks, True) if config.ranks else token_counter(default_token_ranks())


def normalized(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def is_blank(text: str) -> bool:
    return not text.strip(WHITE_CHARS)


class _Text:
    """A text with its characters' byte offsets, between which sizes are looked for by halving byte ranges."""

    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.text, self.count = text, count
        self.at = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]

    def _char(self, byte: int) -> int:
        """The last character that begins at or before a byte."""
        return bisect_right(self.at, byte) - 1

    def _halve(self, low: int, high: int, keeps_low: Callable[[int], bool]) -> tuple[int, int]:
        """Narrows a range of characters, in the middle by bytes, until it has one character; keeps_low tells the side."""
        while self.at[low] + 1 < self.at[high]:
            middle = self._char((self.at[low] + self.at[high]) // 2)
            if middle == low:
                middle += 1
                if middle >= high:
                    break
            if keeps_low(middle):
                low = middle
            else:
                high = middle
        return low, high

    def window(self, start: int, most: int) -> int:
        """Where a window of at most so many units ends, by the search that sizes without order ask for: a longer prefix can
        have fewer tokens, so the places that are tried are part of the result. No window is longer than 4 bytes a unit."""
        high = self._char(min(self.at[start] + 4 * most, self.at[-1]))
        if self.count is len:
            return min(start + most, high)
        size = self.count.prefixes(self.text[start:high]) if isinstance(self.count, TokenCounter) else lambda k: self.count(self.text[start : start + k])
        if size(high - start) <= most:
            return high
        return self._halve(start, high, lambda m: size(m - start) <= most)[0]

    def back(self, end: int, overlap: int) -> int:
        """Where the next chunk begins so that at most overlap units are repeated; never at the text's start."""
        if self.count is len:
            return max(min(1, end), end - overlap)
        return self._halve(0, end, lambda m: self.count(self.text[m:end]) > overlap)[1]


def _last(window: str, *ends: str) -> int:
    return max(window.rfind(e) for e in ends)


def _chosen(text: str, start: int, end: int, least: int, count: Callable[[str], int]) -> tuple[int, str] | None:
    window = text[start:end]
    if count is not len and least:  # a shorter text can have more tokens, so each place is tried
        for kind, pattern in _ENDS:
            for k in sorted((m.start() for m in pattern.finditer(window)), reverse=True):
                if k > 0 and count(window[:k]) >= least:
                    return start + k, kind
        return None
    least = max(least, 1)
    if (k := window.rfind("\n\n")) >= least:
        return start + k, "Paragraph"
    if (k := window.rfind("\n") + 1) >= least:
        return start + k, "Line"
    if (k := _last(window, ". ", ".\n", "? ", "?\n", "! ", "!\n") + 1) >= least:
        return start + k, "Line"
    if (k := _last(window, " ", "\t") + 1) >= least:
        return start + k, "Whitespace"
    return None


def split(text: str, config: RecursiveConfig) -> list[Chunk]:
    """The chunks of a text."""
    if config.max_size == 0 or not text:
        return []
    count = counter(config)
    t = _Text(normalized(text), count)
    text, n, start, out = t.text, len(t.text), 0, []
    while start < n:
        window = t.window(start, config.max_size)
        end, kind = _chosen(text, start, window, config.min_size, count) or (max(window, start + 1), "Forced")
        out.append({"index": len(out), "text": text[start:end], "boundary": kind, "start_byte": t.at[start], "end_byte": t.at[end], "char_len": end - start})
        if end >= n:
            break
        after = t.back(end, config.overlap) if config.overlap else _WHITE_RUN.match(text, end).end()
        start = max(after, start + 1)
    return out


def split_slabs(text: str, slabs: list[tuple[int, int]], config: RecursiveConfig) -> list[Chunk]:
    """The chunks of slabs of a normalised text, spans of characters, that aren't blank; offsets are within the text."""
    at = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    out: list[Chunk] = []
    for a, b in slabs:
        if not is_blank(text[a:b]):
            out += [{**c, "start_byte": c["start_byte"] + at[a], "end_byte": c["end_byte"] + at[a]} for c in split(text[a:b], config)]
    return [{**c, "index": i} for i, c in enumerate(out)]


def whole(text: str, kind: str, start_byte: int = 0) -> Chunk:
    """One chunk of all of a text."""
    return {"index": 0, "text": text, "boundary": kind, "start_byte": start_byte, "end_byte": start_byte + len(text.encode("utf-8", "surrogatepass")), "char_len": len(text)}


