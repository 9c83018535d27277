"""Symbol extraction, symbol filters and symbol scores."""

from pyspark.sql import functions as F

from codelake.functions.scoring import match_type, symbol_score, symbol_snippet
from codelake.operators.js_symbols import parse_javascript
from codelake.operators.python_symbols import parse_python
from codelake.operators.queries import parse_queries
from codelake.operators.symbol_search import match_names, name_patterns, top_symbols
from codelake.operators.symbols import extract_symbols
from codelake.plans import corpora as C
from codelake.plans.registered.registry import SYMBOLS, query

COLUMNS = ["path", "name", "kind", "start_line", "end_line", "signature"]
SELECT = f"WITH {SYMBOLS} SELECT path, name, kind, start_line, end_line, signature FROM syms WHERE "


def _extraction(name: str, where: str, condition: str, parse) -> None:
    @query(name, SELECT + where)
    def run(spark, sf):
        return parse(C.generated_files(spark, sf)).filter(condition).select(*COLUMNS)


def _python(files):
    return parse_python(files)


_extraction("sym_p0_python", "language = 'python'", "true", _python)
_extraction("sym_p1_classes", "language = 'python' AND kind = 'class'", "kind = 'class'", _python)
_extraction("sym_p2_functions", "language = 'python' AND kind = 'function'", "kind = 'function'", _python)
_extraction("sym_p3_methods", "language = 'python' AND kind = 'method'", "kind = 'method'", _python)
_extraction(
    "sym_p4_imports", "kind = 'import' AND name LIKE 'mod%'", "kind = 'import' AND name LIKE 'mod%'", _python
)
_extraction(
    "sym_p5_from_imports", "kind = 'import' AND name LIKE 'pkg%'", "kind = 'import' AND name LIKE 'pkg%'", _python
)
_extraction(
    "sym_j1_functions",
    "language = 'javascript' AND signature LIKE 'function %'",
    "signature LIKE 'function %'",
    parse_javascript,
)
_extraction(
    "sym_j2_arrows",
    "language = 'javascript' AND signature LIKE '%=>'",
    "signature LIKE '%=>'",
    parse_javascript,
)
_extraction("sym_j3_classes", "language = 'javascript' AND kind = 'class'", "kind = 'class'", parse_javascript)
_extraction("sym_j4_methods", "language = 'javascript' AND kind = 'method'", "kind = 'method'", parse_javascript)
_extraction(
    "sym_j5_named_imports",
    "language = 'javascript' AND kind = 'import' AND name LIKE 'lib%'",
    "kind = 'import' AND name LIKE 'lib%'",
    parse_javascript,
)
_extraction(
    "sym_j8_requires",
    "language = 'javascript' AND kind = 'import' AND name LIKE 'fs%'",
    "kind = 'import' AND name LIKE 'fs%'",
    parse_javascript,
)

# Files with the rarer forms; the expected symbols again follow from the key.
RARE_PYTHON = (
    "from . import s_%1$d\nfrom .rel_%1$d import *\nimport a_%1$d.b as c, d_%1$d\ntry:\n"
    "    from . import *\nexcept ImportError:\n    pass\n"
    "class O_%1$d(gen.Base, Generic[T]):\n    class I_%1$d(Generic[T]):\n        @deco\n"
    "        def im_%1$d(self, /, p, z=1):\n            import hidden\n            def hidden(): pass\n"
)
RARE_JS = (
    "import X from 'x_%1$d';\nimport * as N from \"n_%1$d\";\n"
    "const { p_%1$d , q_%1$d,} = require('r_%1$d');\nexport async function af_%1$d(a, b = 1) {}\n"
    "import 'side_%1$d';\nexport default class Z {}\n\n\nexport class E_%1$d {\n"
    "  constructor(x) {\n    if (x) {\n    }\n  }\n  async go_%1$d(a: number): Promise<void> {\n  }\n}\n"
)


def rare_files(spark, sf):
    k = F.col("p_partkey")
    kinds = F.array(
        F.struct(
            F.format_string("rare/%d.py", k).alias("path"),
            F.lit("python").alias("language"),
            F.format_string(RARE_PYTHON, k).alias("content"),
        ),
        F.struct(
            F.format_string("rare/%d.ts", k).alias("path"),
            F.lit("typescript").alias("language"),
            F.format_string(RARE_JS, k).alias("content"),
        ),
    )
    return C.table(spark, sf, "part").select(F.lit("rare").alias("repo"), F.inline(kinds))


RARE = """WITH k AS (SELECT p_partkey::VARCHAR AS k FROM part), rare AS (
  SELECT u.* FROM k, LATERAL (SELECT unnest([
    {'path': 'rare/' || k || '.py', 'name': 's_' || k, 'kind': 'import', 'start_line': 1, 'end_line': 1, 'signature': NULL, 'form': 'relative'},
    {'path': 'rare/' || k || '.py', 'name': 'rel_' || k || '.*', 'kind': 'import', 'start_line': 2, 'end_line': 2, 'signature': NULL, 'form': 'star'},
    {'path': 'rare/' || k || '.py', 'name': 'a_' || k || '.b', 'kind': 'import', 'start_line': 3, 'end_line': 3, 'signature': NULL, 'form': 'plain'},
    {'path': 'rare/' || k || '.py', 'name': 'd_' || k, 'kind': 'import', 'start_line': 3, 'end_line': 3, 'signature': NULL, 'form': 'plain'},
    {'path': 'rare/' || k || '.py', 'name': '*', 'kind': 'import', 'start_line': 5, 'end_line': 5, 'signature': NULL, 'form': 'star'},
    {'path': 'rare/' || k || '.py', 'name': 'O_' || k, 'kind': 'class', 'start_line': 8, 'end_line': 13, 'signature': 'class O_' || k || '(gen.Base, )', 'form': 'class'},
    {'path': 'rare/' || k || '.py', 'name': 'I_' || k, 'kind': 'class', 'start_line': 9, 'end_line': 13, 'signature': 'class I_' || k || '()', 'form': 'class'},
    {'path': 'rare/' || k || '.py', 'name': 'I_' || k || '.im_' || k, 'kind': 'method', 'start_line': 11, 'end_line': 13, 'signature': 'def im_' || k || '(p, z=...)', 'form': 'signature'},
    {'path': 'rare/' || k || '.ts', 'name': 'af_' || k, 'kind': 'function', 'start_line': 4, 'end_line': 4, 'signature': 'async function af_' || k || '(a, b = 1)', 'form': 'function'},
    {'path': 'rare/' || k || '.ts', 'name': 'E_' || k, 'kind': 'class', 'start_line': 7, 'end_line': 7, 'signature': 'class E_' || k, 'form': 'class'},
    {'path': 'rare/' || k || '.ts', 'name': 'E_' || k || '.go_' || k, 'kind': 'method', 'start_line': 14, 'end_line': 14, 'signature': 'async go_' || k || '(a: number)', 'form': 'method'},
    {'path': 'rare/' || k || '.ts', 'name': 'x_' || k, 'kind': 'import', 'start_line': 1, 'end_line': 1, 'signature': NULL, 'form': 'default'},
    {'path': 'rare/' || k || '.ts', 'name': 'n_' || k || '.*', 'kind': 'import', 'start_line': 2, 'end_line': 2, 'signature': NULL, 'form': 'namespace'},
    {'path': 'rare/' || k || '.ts', 'name': 'r_' || k || '.p_' || k, 'kind': 'import', 'start_line': 3, 'end_line': 3, 'signature': NULL, 'form': 'destructured'},
    {'path': 'rare/' || k || '.ts', 'name': 'r_' || k || '.q_' || k, 'kind': 'import', 'start_line': 3, 'end_line': 3, 'signature': NULL, 'form': 'destructured'}
  ]) AS u))
SELECT path, name, kind, start_line, end_line, signature FROM rare WHERE """


def _rare(name: str, where: str, condition: str) -> None:
    @query(name, RARE + where)
    def run(spark, sf):
        return extract_symbols(rare_files(spark, sf)).filter(condition).select(*COLUMNS)


_rare("sym_p6_star_imports", "form = 'star'", "language = 'python' AND name LIKE '%*'")
_rare("sym_p7_signatures", "form = 'signature'", "language = 'python' AND kind = 'method'")
_rare("sym_j6_default_imports", "form = 'default'", "kind = 'import' AND name LIKE 'x%'")
_rare("sym_j7_namespace_imports", "form = 'namespace'", "kind = 'import' AND name LIKE 'n%'")
_rare("sym_j9_destructured_requires", "form = 'destructured'", "kind = 'import' AND name LIKE 'r\\\\_%'")
_rare("sym_rare_forms", "true", "true")


def gen_symbols(spark, sf):
    return extract_symbols(C.generated_files(spark, sf))


@query(
    "prj_08_match_type",
    f"WITH {SYMBOLS} SELECT path, name, 'symbol:' || kind AS match_type FROM syms",
)
def match_types(spark, sf):
    return gen_symbols(spark, sf).select("path", "name", match_type(F.col("kind")).alias("match_type"))


@query(
    "prj_09_symbol_snippet",
    f"WITH {SYMBOLS} SELECT path, name, coalesce(signature, kind || ': ' || name) AS snippet FROM syms",
)
def snippets(spark, sf):
    shown = symbol_snippet(F.col("name"), F.col("kind"), F.col("signature"))
    return gen_symbols(spark, sf).select("path", "name", shown.alias("snippet"))


# One filter each; the request table is small, the symbols searched grow with the data.
def _filter(name: str, text: str, where: str) -> None:
    @query(name, f"WITH {SYMBOLS} SELECT path, name, kind FROM syms WHERE {where}")
    def run(spark, sf):
        asked = parse_queries(C.requests(spark, (text,)))
        return match_names(gen_symbols(spark, sf), name_patterns(asked)).select("path", "name", "kind")


_filter("flt_01_language", "symbol:_1 lang:python", "name ILIKE '%_1%' AND language = 'python'")
_filter("flt_02_path", "symbol:_1 path:J_1", "name ILIKE '%_1%' AND path ILIKE '%J_1%'")
_filter("flt_03_name", "symbol:RUN", "name ILIKE '%RUN%'")
_filter("flt_04_kind", "class:_", "name ILIKE '%_%' AND kind = 'class'")
_filter("flt_05_definitions", "def:_2", "name ILIKE '%_2%' AND kind IN ('function', 'method')")
_filter("flt_06_classes", "class:c%9", "name ILIKE '%c%9%' AND kind = 'class'")
_filter("flt_07_imports", "import:lib_3.a", "name ILIKE '%lib_3.a%' AND kind = 'import'")
_filter("flt_08_any_kind", "symbol:m_1", "name ILIKE '%m_1%'")


@query(
    "scr_01_symbol_score",
    f"""WITH {SYMBOLS}, pats AS (SELECT unnest(['C_1', 'mod_', 'g_1', 'J_1.run_1', 'zz']) AS pattern)
    SELECT path, name, pattern, 9.0
      + CASE WHEN lower(name) = lower(pattern) THEN 10.0 WHEN contains(lower(name), lower(pattern)) THEN 5.0 ELSE 0.0 END
      + CASE WHEN signature IS NOT NULL THEN 2.0 ELSE 0.0 END
      + CASE kind WHEN 'class' THEN 2.0 WHEN 'import' THEN 1.0 ELSE 1.5 END AS score
    FROM syms JOIN pats ON name ILIKE '%' || pattern || '%'""",
)
def scores(spark, sf):
    texts = ("C_1", "mod_", "g_1", "J_1.run_1", "zz")
    asked = C.requests(spark, tuple(f"symbol:{p}" for p in texts))
    each = match_names(gen_symbols(spark, sf), name_patterns(parse_queries(asked)))
    score = symbol_score(F.col("name"), F.col("kind"), F.col("signature"), F.col("pattern"))
    return each.select("path", "name", "pattern", score.alias("score"))


# Requests with a pattern each: (query_id, text, kinds, pattern); ten rows are asked for.
ASKED = """asked(query_id, tuple_no, wanted, pattern) AS (VALUES
  (0, 0, 'function', 'm_1'), (0, 1, 'method', 'm_1'), (1, 2, 'class', 'C_1'), (2, 3, 'import', 'mod_3'),
  (3, 4, NULL, '_1'), (4, 0, 'function', 'f_1'), (4, 1, 'method', 'f_1'), (4, 4, NULL, 'f_1')),
found AS (
  SELECT a.*, s.*, row_number() OVER (PARTITION BY query_id, tuple_no ORDER BY name, repo, path, start_line) AS r
  FROM asked a JOIN syms s ON s.name ILIKE '%' || a.pattern || '%' AND (wanted IS NULL OR kind = wanted))"""
TEXTS = ("def:m_1", "class:C_1", "import:mod_3", "symbol:_1", "def:f_1 symbol:f_1")
SCORE = """9.0 + CASE WHEN lower(name) = lower(pattern) THEN 10.0 WHEN contains(lower(name), lower(pattern))
  THEN 5.0 ELSE 0.0 END + CASE WHEN signature IS NOT NULL THEN 2.0 ELSE 0.0 END
  + CASE kind WHEN 'class' THEN 2.0 WHEN 'import' THEN 1.0 ELSE 1.5 END"""


def _asked(spark):
    return parse_queries(C.requests(spark, TEXTS))


@query(
    "jon_05_name_patterns",
    f"WITH {SYMBOLS}, {ASKED} SELECT query_id, tuple_no, path, name FROM found",
)
def patterns(spark, sf):
    found = match_names(gen_symbols(spark, sf), name_patterns(_asked(spark)))
    return found.select("query_id", "tuple_no", "path", "name")


@query(
    "set_01_filters_concatenated",
    f"WITH {SYMBOLS}, {ASKED} SELECT query_id, path, name, count(*) AS times FROM found WHERE query_id = 4 GROUP BY ALL",
)
def concatenated(spark, sf):
    asked = _asked(spark).filter("query_id = 4")
    found = match_names(gen_symbols(spark, sf), name_patterns(asked))
    return found.groupBy("query_id", "path", "name").agg(F.count("*").alias("times"))


@query(
    "top_01_first_by_name",
    f"""WITH {SYMBOLS}, {ASKED}, best AS (
      SELECT *, {SCORE} AS score, row_number() OVER (
        PARTITION BY query_id ORDER BY {SCORE} DESC, repo, path, start_line, name) AS rank
      FROM found WHERE r <= 10)
    SELECT query_id, path, name, score FROM best WHERE rank <= 10""",
)
def first_by_name(spark, sf):
    best = top_symbols(gen_symbols(spark, sf), _asked(spark))
    return best.select("query_id", "path", "name", "score")


@query(
    "top_02_best_symbols",
    f"""WITH {SYMBOLS}, {ASKED}, best AS (
      SELECT *, {SCORE} AS score, row_number() OVER (
        PARTITION BY query_id ORDER BY {SCORE} DESC, repo, path, start_line, name) AS rank
      FROM found)
    SELECT query_id, path, name, score FROM best WHERE rank <= 10""",
)
def best_symbols(spark, sf):
    best = top_symbols(gen_symbols(spark, sf), _asked(spark), prelimit=False)
    return best.select("query_id", "path", "name", "score")


@query(
    "jon_01_symbols_with_files",
    f"""WITH {SYMBOLS} SELECT path, name, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END AS file_language
    FROM syms""",
)
def symbols_with_files(spark, sf):
    files = C.generated_files(spark, sf)
    owners = files.select("repo", "path", F.col("language").alias("file_language"))
    return extract_symbols(files).join(owners, ["repo", "path"]).select("path", "name", "file_language")
