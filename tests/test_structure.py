"""Markdown blocks, code declarations, sentences, semantic groups."""

import random

import pytest

from sparkloom.errors import LoomError
from sparkloom.functions.recursive import RecursiveConfig
from sparkloom.operators import code, markdown, semantic
from sparkloom.operators.sentences import sentences


def slabs(text):
    p = markdown.boundaries(text)
    return [text[a:b] for a, b in zip(p, p[1:])]


@pytest.mark.parametrize(
    "text,want",
    [
        ("# T\nbody\n", ["# T\n", "body\n"]),
        ("a\nb\n\nc", ["a\nb\n", "\nc"]),
        ("T\n===\nx", ["T\n===\n", "x"]),
        ("```\na\n\n# b\n```\nc", ["```\na\n\n# b\n```\n", "c"]),
        ("~~~\nopen", ["~~~\nopen"]),
        ("    code\n\n    more\n\nx", ["    code\n\n    more\n", "\nx"]),
        ("- a\n- b\n\nx", ["- a\n- b\n\nx"]),
        ("- a\n\n- b\n", ["- a\n", "\n- b\n"]),
        ("> q\nlazy\n\nx", ["> q\nlazy\n", "\nx"]),
        ("> # h\n> p\n", ["> ", "# h\n", "> p\n"]),
        ("<div>\n# no\n</div>\n\nx", ["<div>\n# no\n</div>\n\nx"]),
        ("[a]: /u 'x'\n\np", ["[a]: /u 'x'\n\np"]),
        ("#hashtag", ["#hashtag"]),
        ("a\n***\nb", ["a\n", "***\nb"]),
        ("1. a\n\n   b\n2. c", ["1. a\n", "\n   b\n", "2. c"]),
        ("- ```\n  x\n  ```\n- y", ["- ```\n  x\n  ```\n", "- y"]),
        ("p\n2. not a list", ["p\n2. not a list"]),
    ],
)
def test_markdown_blocks(text, want):
    assert slabs(text) == want


def test_markdown_never_fails_and_tiles():
    rng = random.Random(3)
    parts = ["# ", "- ", "1. ", "> ", "```", "~~~", "    ", "\t", "\n", "\n\n", "a", "===", "---", "***", "<div>", "<!--", "-->", "[a]: b", "é", "+ ", "* "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert "".join(slabs(text)) == text


CODE = {
    "rust": ("use a::{b, c};\n#[x]\npub fn f<'a>() { let c = '}'; }\n", ["use a::{b, c};", "pub fn f<'a>() { let c = '}'; }"]),
    "python": ("import os\n@d\ndef f():\n    return 1\nx = 1\nclass A: pass\n", ["@d\ndef f():\n    return 1", "class A: pass"]),
    "javascript": ("import a from 'b'\nconst x = {\n  y: `}${'}'}`\n}\nfunction f() {}\nexport default x\n", ["const x = {\n  y: `}${'}'}`\n}", "function f() {}", "export default x"]),
    "typescript": ("interface I { a: 1 }\ntype T = { b: 2 } | 3;\nenum E { A }\nvar v = 1\n", ["interface I { a: 1 }", "type T = { b: 2 } | 3;", "enum E { A }"]),
    "tsx": ("const A = () => <b>it's</b>;\ninterface P {}\nexport function B() { return <i/>; }", ["const A = () => <b>it's</b>;", "export function B() { return <i/>; }"]),
    "go": ("package m\ntype T struct { a int }\nfunc (t T) f() { x := `}` }\n", ["type T struct { a int }", "func (t T) f() { x := `}` }"]),
    "java": ("package a;\n@X(1)\npublic class A { void f() {} }\ninterface I {}\n", ["@X(1)\npublic class A { void f() {} }", "interface I {}"]),
    "c": ("#include <a>\ntypedef struct { int a; } T;\nstruct S { int b; };\nint f(int x) { return '}'; }\nint g(void);", ["typedef struct { int a; } T;", "struct S { int b; }", "int f(int x) { return '}'; }"]),
    "cpp": ("namespace n { int a; }\ntemplate <class T> struct V {};\nC::C() : a{1} { }\nusing X = int;", ["namespace n { int a; }", "template <class T> struct V {};", "C::C() : a{1} { }"]),
    "ruby": ("require 'x'\nclass A\n  def f\n    1 if x\n  end\nend\ndef self.g; end\n", ["class A\n  def f\n    1 if x\n  end\nend", "def self.g; end"]),
    "bash": ("set -e\nf() {\n  echo '}'\n}\nfunction g { x; }\nf\n", ["f() {\n  echo '}'\n}", "function g { x; }"]),
}


@pytest.mark.parametrize("language", code.LANGUAGES)
def test_declarations(language):
    text, want = CODE[language]
    assert [text[a:b] for a, b in code.declarations(text, language)] == want
    chunks = code.split_code(text, language, RecursiveConfig(1000))
    assert len(chunks) >= 2 and f"lang={language}" in code.code_fingerprint(language, RecursiveConfig())


def test_broken_python_falls_back_to_indentation():
    text = "def f(:\n    x\n\n@d\nclass A\n    y\nz = (\n"
    assert [text[a:b] for a, b in code.declarations(text, "python")] == ["def f(:\n    x", "@d\nclass A\n    y"]


@pytest.mark.parametrize("language", code.LANGUAGES)
def test_scanners_tile_any_text(language):
    rng = random.Random(7)
    parts = ["{", "}", "(", ")", '"', "'", "`", "/", "*", "\n", " ", "def ", "fn f", "class ", "end", "$", "#", "<<E\n", "\\", "a", "=", ";", 'r#"', "if ", "=>", "é"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        spans = code.declarations(text, language)
        assert "".join(text[a:b] for a, b in code.tiles(spans, len(text))) == text
        assert all(a < b for a, b in spans)


def test_unknown_language():
    with pytest.raises(LoomError, match="unsupported language: cobol"):
        code.declarations("", "cobol")


def split_sentences(text):
    return [text[a:b] for a, b in sentences(text)]


def test_sentences():
    assert split_sentences("One sentence. Two sentences! Three?") == ["One sentence. ", "Two sentences! ", "Three?"]
    assert len(split_sentences("你好。今天天气不错。我们走吧!")) == 3
    assert split_sentences(" \n ") == [] and split_sentences("") == []
    assert split_sentences("It is 3.4 m. tall") == ["It is 3.4 m. tall"]
    assert split_sentences("U.S. law. Next") == ["U.S. law. ", "Next"]
    assert split_sentences('He said "Go." Then left.') == ['He said "Go." ', "Then left."]
    assert split_sentences("a\nb\r\nc") == ["a\n", "b\r\n", "c"]
    assert split_sentences("Wait... what? Yes.") == ["Wait... what? ", "Yes."]


def vectors(*rows):
    return lambda texts: list(rows)[: len(texts)]


def test_semantic_groups():
    assert semantic.percentile([0, 0.25, 0.5, 0.75, 1], 50) == 0.5
    assert semantic.percentile([0, 0.25, 0.5, 0.75, 1], 25) == 0.25
    assert semantic.percentile([0, 0.25, 0.5, 0.75, 1], 95) == pytest.approx(0.95)
    x, y = [1.0, 0.0], [0.0, 1.0]
    text = "A b. C d. E f. G h."
    config = semantic.SemanticConfig(RecursiveConfig(200), 50)
    assert [c["text"] for c in semantic.split_semantic(text, config, vectors(x, x, y, y))] == ["A b. C d. ", "E f. G h."]
    assert len(semantic.split_semantic(text, config, vectors(x, x, x, x))) == 1
    assert semantic.distances([[0.0, 0.0], x, [2.0, 0.0, 5.0]]) == [1.0, pytest.approx(1 - 2 / 29**0.5, abs=1e-6)]
    assert semantic.merged([(0, 0), (1, 1), (2, 5)], lambda g: g[1] - g[0] + 1, 2) == [(0, 1), (2, 5)]
    with pytest.raises(LoomError, match="count mismatch"):
        semantic.split_semantic(text, config, vectors(x))
    for p in (0, 100):
        with pytest.raises(LoomError):
            semantic.SemanticConfig(percentile=p)


def test_semantic_offsets_and_small_inputs():
    config = semantic.SemanticConfig(RecursiveConfig(12), 50)
    assert [(c["text"], c["boundary"]) for c in semantic.split_semantic("tiny", config, vectors())] == [("tiny", "Forced")]
    text = "Ünder. Näxt longer sentence here. Ünd."
    raw = text.encode()
    for c in semantic.split_semantic(text, config, semantic.hashed_words):
        assert raw[c["start_byte"] : c["end_byte"]].decode() == c["text"] and c["char_len"] <= 12
