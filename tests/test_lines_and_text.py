"""Line, chunk, path and text functions against Python's own."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelake.functions import lines as L
from codelake.functions import paths as P
from codelake.functions import text as X
from codelake.operators.chunks import chunk_files, file_text
from codelake.operators.percentiles import percentiles

ODD = ["", "\n", "\n\n", "a", "a\n", "a\nb", "a\r\nb\r", "a\x0bb\x0c\x1cc\x1d\x1ed\x85e\u2028f\u2029", "\r\n\n\r", "x\n\u2028\n"]


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in frame.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_line_splitting(spark):
    assert column(spark, ODD, L.wide_lines) == [v.splitlines() for v in ODD]
    narrow = [[line.rstrip("\n") for line in v.split("\n")] for v in ODD]
    narrow = [n[:-1] if n[-1] == "" else n for n in narrow]
    assert column(spark, ODD, L.lf_lines) == narrow


@pytest.mark.parametrize("size", [1, 3, 300])
def test_chunks(spark, files_of, size):
    texts = {f"{i}.md": v for i, v in enumerate([*ODD, "".join(f"l{i}\n" for i in range(10))])}
    found = {}
    for r in chunk_files(files_of(texts), size).orderBy("path", "chunk_id").collect():
        found.setdefault(r.path, []).append((r.content, r.start_line, r.end_line))
    for path, text in texts.items():
        lines = text.splitlines(keepends=True)
        expected = [
            ("".join(lines[i : i + size]), i + 1, min(i + size, len(lines))) for i in range(0, len(lines), size)
        ]
        assert found[path] == (expected or [("", 1, 1)]), path


def test_chunk_spans(files_of):
    rows = chunk_files(files_of({"a.md": "".join(f"{i}\n" for i in range(10))}), 3).collect()
    assert sorted((r.start_line, r.end_line) for r in rows) == [(1, 3), (4, 6), (7, 9), (10, 10)]


def test_text_is_put_together_again(files_of):
    texts = {f"{i}.md": v for i, v in enumerate(ODD)}
    rows = file_text(chunk_files(files_of(texts), 2)).collect()
    assert {r.path: r.content for r in rows} == texts


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x1c\x85\u2028\u00a0", max_size=30), min_size=1, max_size=20))
def test_line_splitting_on_random_text(spark, values):
    assert column(spark, values, L.wide_lines) == [v.splitlines() for v in values]
    assert column(spark, values, X.normalize_whitespace) == [" ".join(v.split()) for v in values]
    assert column(spark, values, X.strip_end) == [v.rstrip() for v in values]


def test_snippets(spark):
    text = "".join(f"l{i}\n" for i in range(1, 8))
    around = column(spark, [text], lambda c: L.snippet_around(c, F.lit(2), 2))[0]
    assert (around.snippet, around.start_line, around.end_line) == ("l1\nl2\nl3\nl4", 1, 4)
    past = column(spark, [text], lambda c: L.snippet_around(c, F.lit(20), 2))[0]
    assert past.snippet == ""
    shown = column(spark, ["a\nb"], lambda c: L.format_snippet(c, F.lit(9), F.lit(10)))[0]
    assert shown == "     9 | a\n>   10 | b"
    assert column(spark, [text], lambda c: L.line_at(c, F.lit(3))) == ["l3"]
    assert column(spark, [text], lambda c: L.line_at(c, F.lit(0))) == [""]
    assert column(spark, [text], lambda c: L.line_at(c, F.lit(8))) == [""]
    assert column(spark, [text], L.head_snippet) == ["l1\nl2\nl3\nl4"]
    assert column(spark, ["a \nb\t\nc"], lambda c: L.context_window(c, F.lit(2), F.lit(1))) == [
        ["   1 | a", "   2 | b", "   3 | c"]
    ]


PATHS = ["a.py", ".bashrc", "Makefile", "x/y.TAR.GZ", "x.d/file", "a.", "..py", "dir/.x.JSX", "a.b.ts", "__init__.py"]


def test_suffix_and_language(spark):
    from pathlib import PurePosixPath

    assert column(spark, PATHS, P.suffix) == [
        "" if p == "a." else PurePosixPath(p).suffix for p in PATHS
    ]
    found = dict(zip(PATHS, column(spark, PATHS, P.detect_language)))
    assert found["a.py"] == found["..py"] == "python" and found["dir/.x.JSX"] == "javascript"
    assert found[".bashrc"] is None and found["x/y.TAR.GZ"] is None


def test_truncate_and_highlight(spark):
    assert column(spark, ["abcdef", "abc"], lambda c: X.truncate_text(c, 5)) == ["ab...", "abc"]
    assert column(spark, ["The the"], lambda c: X.highlight_match(c, F.lit("THE"))) == ["**The** **the**"]
    assert column(spark, ["a$1 A$1"], lambda c: X.highlight_match(c, F.lit("a$1"), "<$", "\\>")) == [
        "<$a$1\\> <$A$1\\>"
    ]
    assert column(spark, [r"x\Ey"], lambda c: X.highlight_match(c, F.lit(r"\E"), "[", "]")) == [r"x[\E]y"]


def test_like_rules(spark):
    names = ["calculate_total", "calculateXtotal", "CALCULATE_TOTAL", "\u00c4b", "a\\b", "100%"]

    def hits(pattern):
        return [n for n, ok in zip(names, column(spark, names, lambda c: X.like_substring(c, F.lit(pattern)))) if ok]

    assert hits("calculate_total") == names[:3]
    assert hits("\u00e4b") == []  # only ASCII letters are folded
    assert hits("a\\b") == ["a\\b"]
    assert hits("0%") == ["100%"]
    assert hits("\\") == ["a\\b"]


def test_decode(spark):
    raw = [b"a\xff\xfeb", b"x\r\ny\rz", "\u00e9\ufffd".encode(), b"\xe2\x82", b"", b"\xc3("]
    frame = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(raw)], "i int, v binary")
    found = [r.o for r in frame.select("i", X.decode_text(F.col("v")).alias("o")).orderBy("i").collect()]
    expected = [v.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for v in raw]
    assert found == expected


@pytest.mark.parametrize("values", [list(range(1, 11)), [5.0] * 1000 + [1e12, -3.5], [0.1 * i for i in range(777)]])
def test_percentiles(spark, values):
    frame = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    row = percentiles(frame, "g", "v", points).first()
    ordered = sorted(map(float, values))
    assert [row[p] for p in points] == [ordered[int(len(ordered) * q)] for q in points.values()]
    assert row.n == len(values)


def test_percentiles_of_outliers(spark):
    """What is in question shrinks whatever the values are; no group above the limit is sorted."""
    values = [float(i % 5000) for i in range(20_000)] + [1e15, -1e15, float("inf"), float("-inf"), float("nan")]
    frame = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0), ("e", None)], "g string, v double")
    points = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "top": 0.99999}
    found = {r.g: r for r in percentiles(frame, "g", "v", points, left=50, cuts=8).collect()}
    ordered = sorted(values, key=lambda v: (v != v, v))
    for name, q in points.items():
        expected, got = ordered[int(len(ordered) * q)], found["g"][name]
        assert got == expected or (got != got and expected != expected)
    assert found["h"].p50 == 1.0 and (found["e"].n, found["e"].p50) == (0, 0.0)


def test_shortcuts_for_plain_text_change_nothing(spark):
    """ASCII texts take a shorter way through tokens, line ends and case; the ways must agree on every text."""
    from codelake.functions.lines import _RARE, _has_rare_ends, lf_lines
    from codelake.functions.text import ascii_lower, decode_text
    from codelake.functions.tokens import fold, tokens

    texts = [chr(c) for c in range(0x250)] + [
        None, "", "A_b-C9\n", "a\r\nb\rc", "\r", "\n", "\n\n", "x\n\r", "Ünï Côde\n", "Kelvin K", "İI", "日本 x1", "z",
        "é", "a b", "\x1cQ\x1d", "\U0001f600 OK\n", "x = " + "-" * 500 + "1\n",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.col("t")
    pairs = {
        "tokens": (tokens(t), F.regexp_extract_all(fold(t), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))),
        "rare": (_has_rare_ends(t), t.rlike(f"[{_RARE}]")),
        "lines": (lf_lines(t), F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))),
        "lower": (ascii_lower(t), F.translate(t, upper, upper.lower())),
        "decoded": (decode_text(t.cast("binary")), F.regexp_replace(t, r"\r\n?", "\n")),
    }
    found = rows.select(t, *[c.alias(f"{k}_{i}") for k, both in pairs.items() for i, c in enumerate(both)]).collect()
    for k in pairs:
        assert [r[f"{k}_0"] for r in found] == [r[f"{k}_1"] for r in found], k


def test_grams_fold_a_name_once(spark):
    from codelake.operators.symbol_search import name_grams

    names = ["J_1.Run", "ab", "", None, "ÀBcd", "aaaa"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", name_grams(F.col("name")).alias("grams"))
    assert [r.grams for r in rows.collect()] == [
        ["", "j_1", "_1.", "1.r", ".ru", "run"], [""], [""], [""], ["", "Àbc", "bcd"], ["", "aaa"],
    ]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "substring(lambda" in plan and "substring(translate" not in plan and "substring(CASE" not in plan


def test_grams_of_plain_names_by_one_expression(spark):
    from codelake.operators.symbol_search import name_grams

    names = ["", "ab", "abc", "Abcabc", "a\nb\rc", "x.y_1", "\U0001d54fabc", "\u00c4bCd", "a\U0001f600b"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", name_grams(F.col("name")).alias("grams"))
    for r in rows.collect():
        folded = "".join(c.lower() if c.isascii() else c for c in r.name)
        assert r.grams == list(dict.fromkeys(["", *(folded[i : i + 3] for i in range(len(folded) - 2))]))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
