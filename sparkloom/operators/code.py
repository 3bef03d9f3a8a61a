"""Top-level declarations of source files, by a scanner for each of eleven languages.

Comments, strings and the like are first covered with filler of the same length, so that brackets and keywords that are
left are code. Statements at the top level are then read one after the other; those of a kind that the language's table
lists are declarations. Text between declarations (imports, comments, attributes) stays as slabs of its own, so slabs tile
the text, whatever it is: a scanner never fails, it only finds fewer declarations in broken files.
"""

from __future__ import annotations

import ast
import warnings
from dataclasses import dataclass

import regex

from ..errors import LoomError
from ..functions.recursive import RecursiveConfig
from .splitting import Chunk, normalized, split, split_slabs

LANGUAGES = ("rust", "python", "javascript", "typescript", "tsx", "go", "java", "c", "cpp", "ruby", "bash")

_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_TEMPLATE = r"(?P<tpl>`(?:\\.|[^`\\$]|\$(?!\{)|\$(?P<braces>\{(?:[^{}`\"']|(?&tpl)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?&braces))*\}))*`?)"
_JS_REGEX = r"(?<=(?:^|[(,=:\[!&|?{};\n]|\breturn)[ \t]*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_HEREDOC = r"<<[-~]?(?P<q>[\"'`]?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n(?:.*?\n)??[ \t]*(?P=tag)(?=\n|\Z)"


def _cover(*parts: str) -> regex.Pattern:
    return regex.compile("|".join(parts), regex.DOTALL | regex.MULTILINE)


# an apostrophe after a letter is one of JSX text
_JS = _cover(_LINE_COMMENT, _BLOCK_COMMENT, _TEMPLATE, _DOUBLE, r"(?<!\w)" + _SINGLE, _JS_REGEX)
_C_LIKE = (_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE, r"'(?:\\.[^'\n]*|[^'\\\n])'")
_COVERS = {
    "rust": _cover(_LINE_COMMENT, r"(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*(?:\*/|\Z))", r'\bb?r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)', r'"(?:\\.|[^"\\])*"?', r"'(?:\\[^'\n]+|[^'\\\n])'"),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": _cover(_LINE_COMMENT, _BLOCK_COMMENT, r"`[^`]*`?", _DOUBLE, r"'(?:\\.[^'\n]*|[^'\\\n])'"),
    "java": _cover(r'"""(?:\\.|.)*?(?:"""|\Z)', *_C_LIKE),
    "c": _cover(*_C_LIKE, r"^[ \t]*#(?:\\\n|[^\n])*"),
    "cpp": _cover(r'R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z)', *_C_LIKE, r"^[ \t]*#(?:\\\n|[^\n])*"),
    "ruby": _cover(r"^=begin\b.*?(?:^=end[^\n]*|\Z)", _HEREDOC, r"#[^\n]*", r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?", r"(?<=(?:^|[(,=~!&|]|\b(?:if|unless|when))[ \t]*)/(?:\\.|[^/\\\n])+/[a-z]*"),
    "bash": _cover(_HEREDOC, r"(?<=^|[\s;&|(){}])#[^\n]*", r'"(?:\\.|[^"\\])*"?', r"'[^']*'?", r"\\."),
}


def covered(text: str, language: str) -> str:
    """The text with comments as white space and strings as quotes; newlines within them become spaces."""

    def fill(m: regex.Match) -> str:
        found = m.group()
        if found[:2] in ("//", "/*") or found.lstrip(" \t")[:1] == "#" or found[:6] == "=begin":
            return " " * len(found)
        return '"' * len(found)

    return _COVERS[language].sub(fill, text)


@dataclass(frozen=True)
class Rule:
    """A statement whose beginning matches. ends: how it ends, see _end. declares: whether it is a declaration."""

    starts: regex.Pattern
    ends: str
    declares: bool = True


def _rules(*rows: tuple[str, str, bool]) -> tuple[Rule, ...]:
    return tuple(Rule(regex.compile(a), b, c) for a, b, c in rows)


_VIS = r"(?:pub\b(?:\s*\([^)]*\))?\s*)?"
_JS_RULES = [(r"(?:async\s+)?function\b|(?:abstract\s+)?class\b", "block", True), (r"export\s+(?:default\s+)?(?:async\s+)?(?:function|(?:abstract\s+)?class|interface|(?:const\s+)?enum|namespace|module)\b", "block", True), (r"export\b", "soft", True), (r"(?:const|let)\b(?!\s+enum\b)", "soft", True)]
_TS_RULES = [(r"interface\b(?=\s+[\w$])", "block", True), (r"(?:const\s+)?enum\b(?=\s+[\w$])", "block", True), (r"(?:declare|namespace|module)\b(?=\s+[\w$\"])", "soft_block", False)]
_ALIAS, _VAR = (r"type\b(?=\s+[\w$]+\s*(?:<[^=]*>)?\s*=)", "soft", True), (r"var\b", "soft", True)
_MODS = r"(?:(?:@(?!interface\b)[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?|public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*"
_SPEC = r"\b[^;{}()=]*\{"
_TABLE: dict[str, tuple[Rule, ...]] = {
    "rust": _rules(
        (r"#!?\s*\[", "bracket", False),
        (_VIS + r"(?:default\s+)?(?:(?:const|async|unsafe|safe)\s+|extern\s*(?:\"+\s*)?)*fn\b", "block", True),
        (_VIS + r"(?:default\s+)?(?:unsafe\s+)?(?:impl|(?:auto\s+)?trait|mod)\b", "block", True),
        (_VIS + r"(?:struct|enum|union)\b(?=\s+\w)", "block", True),
        (_VIS + r"(?:extern\s+crate|use|type|const|static)\b", "semi", True),
        (r"macro_rules\s*!", "block_semi", True),
        (r"(?:unsafe\s+)?extern\b", "block", True),
    ),
    "javascript": _rules(*_JS_RULES, _VAR),
    "typescript": _rules(*_TS_RULES, *_JS_RULES, _ALIAS),
    "tsx": _rules(*((a, b, False) for a, b, _ in _TS_RULES), *_JS_RULES, _VAR, (*_ALIAS[:2], False)),
    "go": _rules((r"(?:func|type|var|const)\b", "line", True)),
    "java": _rules((_MODS + r"(?:class|interface|enum)\b", "block", True), (_MODS + r"(?:record|@interface)\b", "block", False), (_MODS + r"(?:<[^{;]*>\s*)?[\w.<>\[\], ?]+\s+\w+\s*\([^{};]*\)[^{};=]*\{", "block", True)),
    "c": _rules((r"typedef\b", "semi", True), (r"(?:struct|union|enum)" + _SPEC, "specifier", True), (r"[^;{}=]*\([^;{}]*\)[^;{}=]*\{", "block", True)),
    "cpp": _rules(
        (r"template\s*<", "block_semi", True),
        (r"typedef\b", "semi", True),
        (r"(?:inline\s+)?namespace\b[^;={}]*\{", "block", True),
        (r"(?:class|struct|union|enum)" + _SPEC, "specifier", True),
        (r"extern\s*\"+\s*\{", "block", False),
        (r"[^;{}=]*(?:\([^;{}]*\)|operator[^;{}]*)[^;{}]*\{", "body", True),
    ),
}
_DEFAULT = {"rust": "stop", "java": "stop", "c": "semi", "cpp": "semi", "go": "line", "javascript": "soft_block", "typescript": "soft_block", "tsx": "soft_block"}
_MORE_BODY = regex.compile(r"\s*[,{]")
_STRUCTURE = regex.compile(r"[(){}\[\];\n]")
#: Where a line without a semicolon goes on: an operator or an opening bracket around the line's end.
_GOES_ON_BEFORE, _GOES_ON_AFTER = regex.compile(r"(?:[-+*/%=&|^?:,.<>!~(\[{]|=>|\b(?:extends|implements|as|typeof|new|return|in|of|instanceof|from|default))\s*\Z"), regex.compile(r"\s*(?:[-+*/%=&|^?:,.<>)\]}(\[`{]|instanceof\b|in\b|as\b|from\b|extends\b)")


def _end(code: str, at: int, ends: str) -> int:
    """Where a statement that begins at a place ends.

    block: after the first braces at its own level, or a semicolon before them; block_semi: and a semicolon after those;
    specifier: as block; body: as block, but braces before a comma or other braces initialise members; semi: after a semicolon; stop: after either, whichever comes first; soft: at a semicolon or at the
    end of a line that doesn't go on; soft_block: or after braces; line: at the end of a line outside brackets; bracket:
    after the first brackets of any kind.
    """
    depth = 0
    for m in _STRUCTURE.finditer(code, at):
        c, k = m.group(), m.start()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return k + 1 if ends != "soft" else k
            if depth:
                continue
            if ends == "bracket" or (c == "}" and ends in ("block", "specifier", "stop")):
                return k + 1
            if c == "}" and ends == "body" and not _MORE_BODY.match(code, k + 1):
                return k + 1
            if c == "}" and ends == "soft_block" and not _GOES_ON_AFTER.match(code, k + 1):
                return k + 1
            if c == "}" and ends == "block_semi":
                after = regex.compile(r"\s*;").match(code, k + 1)
                return after.end() if after else k + 1
        elif depth:
            continue
        elif c == ";":
            return k + 1
        elif c == "\n" and (ends == "line" or (ends in ("soft", "soft_block") and not _GOES_ON_BEFORE.search(code, at, k) and not _GOES_ON_AFTER.match(code, k))):
            return k
    return len(code.rstrip())


def _declarations(text: str, language: str) -> list[tuple[int, int]]:
    code, rules, out, at = covered(text, language), _TABLE[language], [], 0
    blank = regex.compile(r"[\s;]*")
    while (at := blank.match(code, at).end()) < len(code):
        rule = next((r for r in rules if r.starts.match(code, at)), None)
        end = max(_end(code, at, rule.ends if rule else _DEFAULT[language]), at + 1)
        if rule and rule.declares:
            out.append((at, end))
        at = end
    return out


def _python(text: str) -> list[tuple[int, int]]:
    lines = text.split("\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
        if len(text.splitlines()) > len(lines):  # characters that Python takes as line ends, newlines apart
            raise ValueError
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indentation(lines, begins)
    out = []
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            last = lines[node.end_lineno - 1].encode("utf-8", "surrogatepass")[: node.end_col_offset].decode("utf-8", "surrogatepass")
            out.append((begins[first], begins[node.end_lineno - 1] + len(last)))
    return out


def _python_by_indentation(lines: list[str], begins: list[int]) -> list[tuple[int, int]]:
    out, i = [], 0
    head = regex.compile(r"(?:async[ \t]+def|def|class)\b")
    while i < len(lines):
        first = i
        while i < len(lines) and lines[i].startswith("@"):
            i += 1
        if i < len(lines) and head.match(lines[i]):
            last, i = i, i + 1
            while i < len(lines) and (not lines[i].strip() or lines[i][0] in " \t)"):
                last = i if lines[i].strip() else last
                i += 1
            out.append((begins[first], begins[last] + len(lines[last])))
        else:
            i = max(i, first + 1)
    return out


_RUBY_WORD = regex.compile(r"(?<![\w.:@$])(?:(?P<open>def|class|module|begin|case|do|if|unless|while|until|for)|(?P<end>end))(?![\w?!:])")


def _ruby(text: str) -> list[tuple[int, int]]:
    code, out, depth, start, loop = covered(text, "ruby"), [], 0, None, -1
    for m in _RUBY_WORD.finditer(code):
        word, line = m.group(), code.rfind("\n", 0, m.start()) + 1
        before = code[line : m.start()].strip()
        if m["end"]:
            depth -= 1
            if depth <= 0:
                if start is not None:
                    out.append((start, m.end()))
                depth, start = 0, None
            continue
        modifier = word in ("if", "unless", "while", "until") and before and not regex.search(r"(?:[=(,|&;]|\b(?:then|else|do|return|and|or|not))\s*\Z", before)
        if modifier:
            continue
        if word in ("while", "until", "for"):
            loop = code.find("\n", m.end())
        elif word == "do" and m.start() < loop:  # belongs to the loop's line
            continue
        if word == "def" and regex.compile(r"[ \t]+[\w.?!]+[ \t]*(?:\([^)\n]*\))?[ \t]*=[^=~>]").match(code, m.end()):
            if depth == 0:
                stop = code.find("\n", m.end())
                out.append((m.start(), len(code.rstrip()) if stop < 0 else stop))
            continue
        if depth == 0 and word in ("def", "class", "module") and not before:
            start = m.start()
        depth += 1
    return out


_BASH_HEAD = regex.compile(r"^[ \t]*(?P<head>(?:function[ \t]+[^\s(){};]+[ \t]*(?:\([ \t]*\))?|[^\s(){};=&|<>\"$]+[ \t]*\([ \t]*\))\s*)(?=[{(])", regex.MULTILINE)


def _bash(text: str) -> list[tuple[int, int]]:
    code, out, at = covered(text, "bash"), [], 0
    for m in _BASH_HEAD.finditer(code):
        if m.start("head") < at:
            continue
        body = m.end()
        closing = regex.compile(r"(?<=[\s;&])\}(?=$|[\s;&|)<>])", regex.MULTILINE) if code[body] == "{" else None
        if closing is None:
            end = _end(code, body, "bracket")
        else:
            depth, end = 0, len(code.rstrip())
            for b in regex.finditer(r"(?<=^|[\s;&|(])\{(?=\s)|(?<=[\s;&])\}(?=$|[\s;&|)<>])", code, regex.MULTILINE, pos=body):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    end = b.end()
                    break
        out.append((m.start("head"), end))
        at = end
    return out


def declarations(text: str, language: str) -> list[tuple[int, int]]:
    """Spans of the top-level declarations of a text, in characters, ascending and apart."""
    if language not in LANGUAGES:
        raise LoomError("invalid input", f"unsupported language: {language}")
    special = {"python": _python, "ruby": _ruby, "bash": _bash}.get(language)
    return special(text) if special else _declarations(text, language)


def tiles(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The spans and the gaps around them, which cover everything up to size."""
    out, at = [], 0
    for a, b in spans:
        out += [(at, a)] * (a > at) + [(a, b)]
        at = b
    return out + [(at, size)] * (size > at)


def code_fingerprint(language: str, config: RecursiveConfig) -> str:
    return f"code:v1|lang={language}|grammar=scan-{language}@1|metric={config.metric}|{config.sizes}"


def split_code(text: str, language: str, config: RecursiveConfig) -> list[Chunk]:
    """The chunks of a source file: declarations and what lies between, each split by size; without any, the whole."""
    text = normalized(text)
    spans = declarations(text, language)
    return split_slabs(text, tiles(spans, len(text)), config) if spans else split(text, config)
