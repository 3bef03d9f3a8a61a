"""Markdown blocks: where headings begin and end, and where paragraphs and code blocks end.

The block structure is CommonMark's, without extensions: ATX and setext headings, fenced and indented code, HTML blocks,
thematic breaks, block quotes and lists, nested, with lazy continuation lines. Lines of a container are taken together and
read again without its markers. Paragraphs in items of a tight list give no boundary, as they have no blocks of their own.
A block's range includes its last line's end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..functions.recursive import RecursiveConfig
from .splitting import Chunk, normalized, split_slabs


@dataclass(frozen=True)
class Line:
    """A line without its containers' markers; start and end are its place in the text, the newline included."""

    text: str
    start: int
    end: int
    lazy: bool = False  # continues a paragraph without its container's marker

    @property
    def blank(self) -> bool:
        return not self.text.strip(" \t")

    @property
    def indent(self) -> int:
        return _width(self.text[: len(self.text) - len(self.text.lstrip(" \t"))])

    def dedented(self, columns: int) -> Line:
        """Without so many columns of white space before it; a tab that is cut leaves spaces."""
        at = width = 0
        while at < len(self.text) and width < columns and self.text[at] in " \t":
            width += 4 - width % 4 if self.text[at] == "\t" else 1
            at += 1
        return replace(self, text=" " * (width - columns) + self.text[at:], start=self.start + at)


def _width(space: str) -> int:
    n = 0
    for c in space:
        n += 4 - n % 4 if c == "\t" else 1
    return n


_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_REFERENCE = re.compile(r" {0,3}\[(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|\S+)(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
# Names of elements that begin an HTML block.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary "
    "table tbody td tfoot th thead title tr track ul"
).split()
_HTML = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS)})(?:[ \t]|/?>|$)", re.I), None),
)
_ATTRIBUTE = r"""[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^ \t"'=<>`]+|'[^']*'|"[^"]*"))?"""
_TAG_ALONE = re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*[ \t]*/?>|</[A-Za-z][A-Za-z0-9-]*[ \t]*>)[ \t]*$")


def _html_end(line: str) -> tuple[bool, re.Pattern | None]:
    """Whether an HTML block that may interrupt a paragraph begins, and what ends it; None: an empty line."""
    return next(((True, end) for start, end in _HTML if start.match(line)), (False, None))


def _interrupts(line: Line) -> bool:
    """Whether a line ends a paragraph before it (setext underlines aside)."""
    t = line.text
    item = _ITEM.match(t)
    begins = item and t[item.end() :].strip(" \t") and (item[2] in "-+*" or item[2][:-1] == "1")
    return bool(line.blank or _ATX.match(t) or _RULE.match(t) or _FENCE.match(t) or _QUOTE.match(t) or begins or _html_end(t)[0])


def _paragraph_is_open(lines: list[Line]) -> bool:
    """Whether the last of some lines is within a paragraph, however deep, that a lazy line may continue."""
    last = None
    i = 0
    while i < len(lines):
        i, last = _block(lines, i, [], [], False)
    return last == "paragraph" and not lines[-1].blank


def _block(lines: list[Line], i: int, starts: list[int], ends: list[int], tight: bool) -> tuple[int, str]:
    """Reads the block that begins at a line; the next line, and the kind of the innermost block that the last one is in."""
    line = lines[i]
    t = line.text
    if line.blank:
        return i + 1, "blank"
    if line.indent >= 4:
        last = i
        while i < len(lines) and (lines[i].blank or lines[i].indent >= 4) and not lines[i].lazy:
            last = i if not lines[i].blank else last
            i += 1
        ends.append(lines[last].end)
        return last + 1, "code"
    if (fence := _FENCE.match(t)) is not None:
        closing = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
        i += 1
        while i < len(lines) and not closing.match(lines[i].text):
            i += 1
        ends.append(lines[min(i, len(lines) - 1)].end)
        return min(i + 1, len(lines)), "code"
    if _ATX.match(t):
        starts.append(line.start)
        ends.append(line.end)
        return i + 1, "heading"
    if _RULE.match(t):
        return i + 1, "rule"
    if _QUOTE.match(t):
        return _quote(lines, i, starts, ends)
    if _ITEM.match(t):
        return _list(lines, i, starts, ends)
    html, end = _html_end(t)
    if html or _TAG_ALONE.match(t):
        while i < len(lines):
            if (end.search(lines[i].text) if end else lines[i].blank):
                return i + 1, "html"
            i += 1
        return i, "html"
    return _paragraph(lines, i, starts, ends, tight)


def _paragraph(lines: list[Line], i: int, starts: list[int], ends: list[int], tight: bool) -> tuple[int, str]:
    first = i
    i += 1
    while i < len(lines):
        if not lines[i].lazy and _SETEXT.match(lines[i].text) and not lines[i].blank and not _only_references(lines[first:i]):
            starts.append(lines[first].start)
            ends.append(lines[i].end)
            return i + 1, "heading"
        if _interrupts(lines[i]):
            break
        i += 1
    if not tight and not _only_references(lines[first:i]):
        ends.append(lines[i - 1].end)
    return i, "paragraph"


def _only_references(lines: list[Line]) -> bool:
    rest = "\n".join(x.text.strip(" \t") for x in lines)
    while rest and (m := _REFERENCE.match(rest)):
        rest = rest[m.end() :]
    return not rest


def _quote(lines: list[Line], i: int, starts: list[int], ends: list[int]) -> tuple[int, str]:
    inner: list[Line] = []
    while i < len(lines):
        m = _QUOTE.match(lines[i].text)
        if m is not None:
            inner.append(replace(lines[i], text=lines[i].text[m.end() :], start=lines[i].start + m.end()))
        elif not lines[i].blank and not _interrupts(lines[i]) and _paragraph_is_open(inner):
            inner.append(replace(lines[i], lazy=True))
        else:
            break
        i += 1
    return i, _blocks(inner, starts, ends)


def _list(lines: list[Line], i: int, starts: list[int], ends: list[int]) -> tuple[int, str]:
    mark = _ITEM.match(lines[i].text)[2][-1]
    items: list[list[Line]] = []
    loose = False
    while i < len(lines):
        m = _ITEM.match(lines[i].text)
        if m is None or m[2][-1] != mark or _RULE.match(lines[i].text):
            break
        after = lines[i].text[m.end() :]
        gap = _width(after[: len(after) - len(after.lstrip(" \t"))])
        content = m.end() + (gap if 1 <= gap <= 4 and after.strip(" \t") else 1)
        first = replace(lines[i], text=lines[i].text[m.end() :], start=lines[i].start + m.end()).dedented(content - m.end())
        item, k = [first], i + 1
        while k < len(lines):
            if lines[k].blank:
                if len(item) == 1 and first.blank:  # an item may begin with one empty line, not two
                    break
                item.append(lines[k])
            elif lines[k].indent >= content and not lines[k].lazy:
                item.append(lines[k].dedented(content))
            elif not item[-1].blank and not _interrupts(lines[k]) and not _ITEM.match(lines[k].text) and _paragraph_is_open(item):
                item.append(replace(lines[k], lazy=True))
            else:
                break
            k += 1
        trailing = 0
        while len(item) > 1 and item[-1].blank:
            item.pop()
            trailing += 1
        following = _ITEM.match(lines[k].text) if k < len(lines) else None
        if trailing and following and following[2][-1] == mark and not _RULE.match(lines[k].text):
            loose = True
        loose = loose or _blank_between_blocks(item)
        items.append(item)
        i = k
    kind = "blank"
    for item in items:
        kind = _blocks(item, starts, ends, tight=not loose)
    return i, kind


def _blank_between_blocks(lines: list[Line]) -> bool:
    i, seen, blank = 0, False, False
    while i < len(lines):
        at = i
        i, kind = _block(lines, i, [], [], False)
        if kind == "blank" and lines[at].blank:
            blank = seen
        else:
            if blank:
                return True
            seen = True
            blank = lines[i - 1].blank
    return False


def _blocks(lines: list[Line], starts: list[int], ends: list[int], tight: bool = False) -> str:
    i, kind = 0, "blank"
    while i < len(lines):
        i, kind = _block(lines, i, starts, ends, tight)
    return kind


def boundaries(text: str) -> list[int]:
    """Ascending places, in characters, at which a normalised text is cut into slabs; the first is 0, the last its end."""
    lines, at = [], 0
    for raw in text.split("\n"):
        if at < len(text) or raw:
            lines.append(Line(raw, at, min(at + len(raw) + 1, len(text))))
        at += len(raw) + 1
    starts: list[int] = []
    ends: list[int] = []
    _blocks(lines, starts, ends)
    return sorted({0, len(text), *starts, *ends})


def markdown_fingerprint(config: RecursiveConfig) -> str:
    return f"markdown:v1|metric={config.metric}|{config.sizes}"


def split_markdown(text: str, config: RecursiveConfig) -> list[Chunk]:
    """The chunks of a Markdown text: its slabs, each split by size. The text is normalised before it is cut."""
    text = normalized(text)
    places = boundaries(text)
    return split_slabs(text, list(zip(places, places[1:], strict=False)), config)
