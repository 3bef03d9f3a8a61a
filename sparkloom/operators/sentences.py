"""Sentences by the default rules of Unicode Standard Annex 29, over the property classes of the regex library."""

from __future__ import annotations

from functools import lru_cache

import regex

from .splitting import is_blank

# Short names of the Sentence_Break classes.
_CLASSES = ("CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close")
_CLASS = regex.compile("|".join(rf"(?P<{c}>\p{{Sentence_Break={c}}})" for c in _CLASSES), regex.DOTALL)
_PARA = ("CR", "LF", "Sep")
_QUICK = regex.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}\p{Sentence_Break=CR}\p{Sentence_Break=LF}\p{Sentence_Break=Sep}]")


@lru_cache(maxsize=1 << 14)
def _class(c: str) -> str:
    m = _CLASS.match(c)
    return m.lastgroup if m else "Other"


def breaks(text: str) -> list[int]:
    """Where sentences end, in characters; the last is the text's end."""
    out, n, at = [], len(text), 0
    while at < n:
        m = _QUICK.search(text, at)
        if m is None:
            break
        at = end = m.end()
        kind = _class(m.group())
        if kind in _PARA:  # SB3, SB4
            if kind == "CR" and text[at : at + 1] == "\n":
                at += 1
            out.append(at)
            continue
        skip = lambda i, kinds: next((k for k in range(i, n) if _class(text[k]) not in kinds), n)
        ignored = ("Extend", "Format")
        end = skip(at, ignored)
        after = _class(text[end]) if end < n else ""
        if kind == "ATerm":
            if after == "Numeric":  # SB6
                continue
            if after == "Upper":  # SB7: a letter before the stop
                k = m.start() - 1
                while k >= 0 and _class(text[k]) in ignored:
                    k -= 1
                if k >= 0 and _class(text[k]) in ("Upper", "Lower"):
                    continue
        end = skip(end, ("Close", *ignored))
        end = skip(end, ("Sp", *ignored))
        after = _class(text[end]) if end < n else ""
        if kind == "ATerm":  # SB8
            k = skip(end, ("Other", "Extend", "Format", "Sp", "Numeric", "SContinue", "Close"))
            if k < n and _class(text[k]) == "Lower":
                at = end
                continue
        if after in ("SContinue", "ATerm", "STerm"):  # SB8a
            at = end
            continue
        if after in _PARA:  # SB9 to SB11 take one separator in
            end += 2 if text[end : end + 2] == "\r\n" else 1
        out.append(end)
        at = end
    if n and (not out or out[-1] < n):
        out.append(n)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, in characters, that aren't blank; the space after a sentence belongs to it."""
    ends = breaks(text)
    return [(a, b) for a, b in zip([0, *ends], ends, strict=False) if not is_blank(text[a:b])]
