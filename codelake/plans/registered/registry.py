"""Where registered queries and their SQL are collected, and the SQL views they share."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelake.plans import corpora as C
from codelake.settings import EXCLUDED_DIRS, LANGUAGES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def filled(template: str) -> str:
    """SQL for a template of the generated files."""
    text = quoted(template)
    for mark, value in (("%1$d", "p_partkey % 7"), ("%2$d", "p_partkey % 5"), ("%3$d", "p_partkey")):
        text = f"replace({text}, '{mark}', ({value})::VARCHAR)"
    return text


DOCS = """docs AS (
  SELECT 'docs' AS repo, source || '/doc_' || doc_id || '.md' AS path, lang AS language,
         0 AS mtime, n_chars AS size_bytes, sha256(text) AS content_hash, text AS content, doc_id
  FROM documents)"""

PAGES = """web AS (
  SELECT 'web' AS repo, 'pages/' || page_id || '.html' AS path, 'html' AS language, 0 AS mtime,
         length(html) AS size_bytes, sha256(html) AS content_hash, html AS content
  FROM pages)"""

GENERATED = f"""gen AS (
  SELECT 'gen' AS repo, 'gen/m_' || p_partkey || '.py' AS path, 'python' AS language,
         {filled(C.PYTHON_TEMPLATE)} AS content FROM part
  UNION ALL
  SELECT 'gen', 'gen/j_' || p_partkey || '.js', 'javascript', {filled(C.JS_TEMPLATE)} FROM part)"""

PATHS = f"""paths AS (
  SELECT 'paths' AS repo, p_partkey AS k,
         {sql_list(C.DIRECTORIES)}[p_partkey % {len(C.DIRECTORIES)} + 1] || '/' ||
         replace({sql_list(C.NAMES)}[p_partkey % {len(C.NAMES)} + 1], '%d', p_partkey::VARCHAR) AS path,
         2097151 + p_partkey % 3 AS size_bytes
  FROM part)"""

NAMED = """named AS (
  SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[:-2] AS dirs,
         lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix
  FROM paths)"""

LANGUAGE_OF = (
    "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in LANGUAGES.items()) + "}[suffix]"
)
EXCLUDED = sql_list(EXCLUDED_DIRS)

# Symbols of the generated files, from the part key alone.
SYMBOLS = """syms AS (
  SELECT 'gen' AS repo, u.f AS path, u.l AS language, u.n AS name, u.kind, u.s AS start_line,
         u.e AS end_line, u.sig AS signature
  FROM (SELECT p_partkey::VARCHAR AS k, (p_partkey % 7)::VARCHAR AS k7, (p_partkey % 5)::VARCHAR AS k5,
               'gen/m_' || p_partkey || '.py' AS py, 'gen/j_' || p_partkey || '.js' AS js FROM part),
  LATERAL (SELECT unnest([
    {'f': py, 'l': 'python', 'n': 'mod_' || k7, 'kind': 'import', 's': 1, 'e': 1, 'sig': NULL},
    {'f': py, 'l': 'python', 'n': 'pkg_' || k5 || '.x_' || k, 'kind': 'import', 's': 2, 'e': 2, 'sig': NULL},
    {'f': py, 'l': 'python', 'n': 'pkg_' || k5 || '.y_' || k, 'kind': 'import', 's': 2, 'e': 2, 'sig': NULL},
    {'f': py, 'l': 'python', 'n': 'C_' || k, 'kind': 'class', 's': 4, 'e': 6,
     'sig': 'class C_' || k || '(Base)'},
    {'f': py, 'l': 'python', 'n': 'C_' || k || '.m_' || k, 'kind': 'method', 's': 5, 'e': 6,
     'sig': 'def m_' || k || '(self, a, b=...)'},
    {'f': py, 'l': 'python', 'n': 'f_' || k, 'kind': 'function', 's': 8, 'e': 9,
     'sig': 'async def f_' || k || '(x, *args, key=..., **kw)'},
    {'f': js, 'l': 'javascript', 'n': 'g_' || k, 'kind': 'function', 's': 3, 'e': 3,
     'sig': 'function g_' || k || '(a, b)'},
    {'f': js, 'l': 'javascript', 'n': 'h_' || k, 'kind': 'function', 's': 12, 'e': 12,
     'sig': 'async h_' || k || ' = (x) =>'},
    {'f': js, 'l': 'javascript', 'n': 'J_' || k, 'kind': 'class', 's': 6, 'e': 6,
     'sig': 'class J_' || k || ' extends B'},
    {'f': js, 'l': 'javascript', 'n': 'J_' || k || '.run_' || k, 'kind': 'method', 's': 8, 'e': 8,
     'sig': 'run_' || k || '(x)'},
    {'f': js, 'l': 'javascript', 'n': 'lib_' || k7 || '.a_' || k, 'kind': 'import', 's': 1, 'e': 1, 'sig': NULL},
    {'f': js, 'l': 'javascript', 'n': 'lib_' || k7 || '.b_' || k, 'kind': 'import', 's': 1, 'e': 1, 'sig': NULL},
    {'f': js, 'l': 'javascript', 'n': 'fs_' || k5, 'kind': 'import', 's': 2, 'e': 2, 'sig': NULL}
  ]) AS u))"""


def chunk_views(files: str = "docs") -> str:
    """lines, chunks and tokens of a view with repo, path, language and content."""
    return f"""src AS (SELECT repo, path, language, content FROM {files}),
lines AS (
  SELECT *, ends_with(content, chr(10)) AS closed,
         CASE WHEN content = '' THEN []::VARCHAR[] ELSE
           string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1)
                             ELSE content END, chr(10)) END AS ls
  FROM src),
chunks AS (
  SELECT repo, path, language, (i // {C.CHUNK_LINES})::INTEGER AS chunk_id,
         array_to_string(ls[i + 1:i + {C.CHUNK_LINES}], chr(10)) ||
           CASE WHEN i + {C.CHUNK_LINES} < len(ls) OR closed THEN chr(10) ELSE '' END AS content,
         i + 1 AS start_line, greatest(least(i + {C.CHUNK_LINES}, len(ls)), 1) AS end_line
  FROM (SELECT *, unnest(range(0, greatest(len(ls), 1), {C.CHUNK_LINES})) AS i FROM lines)),
words AS (
  SELECT repo, path, language, chunk_id,
         regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS ws
  FROM chunks),
tok AS (
  SELECT repo, path, language, chunk_id, len(ws) AS dl, unnest(ws) AS term,
         generate_subscripts(ws, 1) - 1 AS pos
  FROM words),
post AS (
  SELECT term, repo, path, language, chunk_id, dl, count(*) AS tf, list(pos ORDER BY pos) AS positions
  FROM tok GROUP BY ALL),
corpus AS (
  SELECT count(*) AS n_chunks, coalesce(sum(len(ws)), 0)::BIGINT AS n_tokens, avg(len(ws)) AS avgdl
  FROM words)"""


def bm25_views(matches: str) -> str:
    """Scores of a view (query_id, phrase_id, repo, path, language, chunk_id, dl, tf)."""
    return f"""hold AS (SELECT query_id, phrase_id, count(*) AS n FROM {matches} GROUP BY ALL),
idfs AS (
  SELECT query_id, phrase_id, ln((n_chunks - n + 0.5) / (n + 0.5)) AS raw FROM hold, corpus),
scored AS (
  SELECT m.query_id, repo, path, language, chunk_id, count(*) AS n_phrases,
         round(sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {matches} m JOIN idfs USING (query_id, phrase_id), corpus
  GROUP BY ALL)"""
