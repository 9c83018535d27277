"""Symbol rules on single sources."""

import pytest

from codelake.operators.js_symbols import parse_javascript
from codelake.operators.python_symbols import parse_python, symbols_in_source


def python(source):
    return [(name, kind, start, end, sig) for name, kind, start, end, sig in symbols_in_source(source)]


@pytest.fixture
def js(files_of):
    def run(source, path="a.js"):
        rows = parse_javascript(files_of({path: source})).collect()
        return [(r.name, r.kind, r.start_line, r.signature) for r in rows]

    return run


def test_python_functions_and_defaults():
    assert python("def weigh(parcel, scale=None):\n    return 1\n") == [
        ("weigh", "function", 1, 2, "def weigh(parcel, scale=...)")
    ]
    assert python("async def f(x, *args, key=None, other, **kw): pass\n")[0][4] == (
        "async def f(x, *args, key=..., other, **kw)"
    )


def test_python_positional_only_default_marks_all_others():
    assert python("def f(a=1, b=2, /, c=3): pass\n")[0][4] == "def f(c=...)"


def test_python_decorated_definition_starts_at_def():
    assert [s[2] for s in python("@deco\ndef f(): pass\n\n@deco\nclass A: pass\n")] == [2, 5]


def test_python_classes_and_methods():
    found = python("class Tram(Vehicle, city.Line, Generic[T]):\n    def stop(self): pass\n")
    assert found[0][4] == "class Tram(Vehicle, city.Line, )"
    assert found[1][:2] == ("Tram.stop", "method")


def test_python_nested_definitions():
    source = "class A:\n    class B:\n        def m(self):\n            def hidden(): pass\n    def n(self): pass\n"
    assert [s[0] for s in python(source)] == ["A", "B", "B.m", "A.n"]


def test_python_definitions_below_statements_are_found():
    source = "if x:\n    def f(): pass\ntry:\n    import a\nexcept E:\n    import b\nwith c:\n    class D: pass\n"
    assert [s[0] for s in python(source)] == ["f", "a", "b", "D"]


def test_python_imports():
    source = "import os, a.b as c\nfrom m import x, y as z\nfrom . import r\nfrom .p import *\nfrom . import *\n"
    assert [s[0] for s in python(source)] == ["os", "a.b", "m.x", "m.y", "r", "p.*", "*"]
    assert all(s[1] == "import" and s[4] is None for s in python(source))


def test_python_broken_and_empty():
    assert python("def broken(\n") == []
    assert python("") == []


def test_python_parser_failure_is_reported_and_others_go_on(files_of):
    texts = {"deep.py": "x = " + "-" * 200_000 + "1\n", "ok.py": "def f(): pass\n", "bad.py": "def (\n"}
    rows = {r.path: r for r in parse_python(files_of(texts)).collect()}
    assert set(rows) == {"deep.py", "ok.py"}
    assert rows["deep.py"].error and rows["deep.py"].name is None
    assert rows["ok.py"].name == "f"


def test_js_functions(js):
    source = "function a(x, y) {}\nexport async function b() {}\nfunction* gen() {}\nexport default function c() {}\n"
    assert js(source) == [
        ("a", "function", 1, "function a(x, y)"),
        ("b", "function", 2, "async function b()"),
    ]


def test_js_name_with_async_counts_as_async(js):
    assert js("function asyncJob() {}\n")[0][3] == "async function asyncJob()"


def test_js_arrows(js):
    source = "const f = (a) => a;\nexport const g = async () => {};\nlet h = x => x;\n"
    assert js(source) == [
        ("f", "function", 1, "const f = (a) =>"),
        ("g", "function", 2, "async g = () =>"),
    ]


def test_js_blank_lines_before_a_declaration_belong_to_it(js):
    source = "function first() {\n}\n\n\n  function second() {}\n"
    assert [s[2] for s in js(source)] == [1, 3]


def test_js_methods_and_reserved_words(js):
    source = (
        "class A extends B {\n  constructor(x) {\n    if (x) {\n    }\n    for (;;) {\n    }\n  }\n"
        "  async go(n: number): Promise<void> {\n  }\n}\n"
    )
    assert js(source, "a.ts") == [
        ("A", "class", 1, "class A extends B"),
        ("A.go", "method", 8, "async go(n: number)"),
    ]


def test_js_class_window_reaches_later_classes(js):
    source = "class A {\n  a() {\n  }\n}\nclass B {\n  b() {\n  }\n}\n"
    assert [s[0] for s in js(source)] == ["A", "A.a", "A.b", "B", "B.b"]


def test_js_class_window_ends_after_5000_characters(js):
    source = "class A {\n" + " " * 5000 + "\n  late() {\n  }\n}\n"
    assert [s[0] for s in js(source)] == ["A"]


def test_js_imports(js):
    source = (
        "import { a, b as c, } from 'm';\nimport D from \"d\";\nimport * as N from 'n';\nimport 'side';\n"
        "import R, { x } from 'r';\nconst fs = require('fs');\nvar { p, q } = require('pq');\n"
    )
    assert [(s[0], s[2]) for s in js(source)] == [
        ("m.a", 1), ("m.b as c", 1), ("d", 2), ("n.*", 3), ("fs", 6), ("pq.p", 7), ("pq.q", 7),
    ]


def test_js_no_symbols_and_many_matches(js):
    assert js("let x = 1;\n") == []
    many = js("".join(f"function f{i}() {{}}\n" for i in range(300)))
    assert [(s[0], s[2]) for s in many] == [(f"f{i}", i + 1) for i in range(300)]


def test_js_agrees_with_python_regular_expressions(js):
    """The offset recipe against re.finditer on text with other alphabets and odd blanks."""
    import re

    source = "\u00e9 = 1\n\x1c\n function \u00fcber(a) {}\nfunction b\u00b2(\u00e9) {}\n\u2028function c() {}\r\n"
    pattern = re.compile(r"^\s*function\s+(\w+)\s*\((.*?)\)", re.M)
    expected = [(m[1], source[: m.start()].count("\n") + 1) for m in pattern.finditer(source)]
    assert [(s[0], s[2]) for s in js(source)] == expected


def test_python_files_are_parsed_in_slices(monkeypatch):
    """A batch of many files gives several short frames with the same rows, and a file that breaks the parser is told of."""
    import pandas as pd

    from codelake.operators import python_symbols as P

    texts = [f"def f_{i}(): pass\nclass C_{i}: pass\n" for i in range(10)] + ["x = \0"]
    batch = pd.DataFrame([("r", f"{i}.py", "python", t) for i, t in enumerate(texts)], columns=["repo", "path", "language", "content"])
    whole = list(P._extract(iter([batch])))
    monkeypatch.setattr(P, "FILES_AT_ONCE", 3)
    parts = list(P._extract(iter([batch])))
    assert len(whole) == 1 and max(map(len, parts)) <= 6
    assert pd.concat(parts).to_csv(index=False) == pd.concat(whole).to_csv(index=False)
