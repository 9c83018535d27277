"""Selecting files, per-file columns, lines and snippets, text functions."""

from pyspark.sql import functions as F

from codelake.functions import lines as L
from codelake.functions import paths as P
from codelake.functions import text as X
from codelake.operators.chunks import chunk_files, file_lines
from codelake.operators.enrich import enrich_files, supported
from codelake.operators.queries import valid_request
from codelake.operators.results import hits_with_lines
from codelake.plans import corpora as C
from codelake.plans.registered.registry import (
    DOCS,
    EXCLUDED,
    LANGUAGE_OF,
    NAMED,
    PATHS,
    chunk_views,
    query,
)
from codelake.sources.selection import drop_ignored, ignore_patterns, is_binary

NAMES = f"WITH {PATHS}, {NAMED} "
CHUNKS = f"WITH {DOCS}, {chunk_views()} "


@query("src_02_excluded_dirs", NAMES + f"SELECT path FROM named WHERE NOT list_has_any(dirs, {EXCLUDED})")
def excluded_dirs(spark, sf):
    return C.path_files(spark, sf).filter(~P.in_excluded_dir(F.col("path"))).select("path")


IGNORE = {0: "# src", 1: "  docs  ", 2: "", 3: "tests/", 4: "*.log", 5: "app", 6: "targets"}


@query(
    "src_03_ignore_file",
    NAMES
    + """, ign AS (
  SELECT trim(MAP {0: '# src', 1: '  docs  ', 2: '', 3: 'tests/', 4: '*.log', 5: 'app', 6: 'targets'}
              [n_nationkey % 7]) AS l FROM nation)
  SELECT path FROM named
  WHERE NOT list_has_any(dirs, (SELECT list(l) FROM ign WHERE l <> '' AND NOT starts_with(l, '#')))""",
)
def ignore_file(spark, sf):
    shown = F.create_map(*[F.lit(x) for pair in IGNORE.items() for x in pair])
    lines = C.table(spark, sf, "nation").select(
        F.lit("paths").alias("repo"), shown[F.col("n_nationkey") % 7].alias("line")
    )
    return drop_ignored(C.path_files(spark, sf), ignore_patterns(lines)).select("path")


@query(
    "src_04_excluded_files",
    NAMES
    + r"""SELECT path FROM named
  WHERE NOT regexp_matches(name, '\.(pyc|pyo|so|dylib|dll|exe|bin|lock)$') AND NOT contains(name, 'min')""",
)
def excluded_files(spark, sf):
    patterns = (*P.EXCLUDED_FILES, "min")
    return C.path_files(spark, sf).filter(~P.is_excluded_file(F.col("path"), patterns)).select("path")


@query("src_05_size_limit", NAMES + "SELECT path, size_bytes FROM named WHERE size_bytes <= 2097152")
def size_limit(spark, sf):
    return C.path_files(spark, sf).filter(F.col("size_bytes") <= P_MAX).select("path", "size_bytes")


P_MAX = 2 * 1024 * 1024


@query("src_06_binary", f"WITH {DOCS} SELECT path, strlen(content) <= 8191 AS is_binary FROM docs")
def binary(spark, sf):
    ended = F.concat(F.col("content").cast("binary"), F.lit(b"\x00end"))
    return C.document_files(spark, sf).select("path", is_binary(ended).alias("is_binary"))


@query("src_07_decode", f"WITH {DOCS} SELECT path, content || 'zz' AS content FROM docs")
def decode(spark, sf):
    crlf = F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n")).cast("binary")
    damaged = F.concat(F.lit(b"\xff"), crlf, F.lit(b"\xc3z\xe2\x82z"))
    return C.document_files(spark, sf).select("path", X.decode_text(damaged).alias("content"))


@query("prj_01_language", NAMES + f"SELECT path, {LANGUAGE_OF} AS language FROM named")
def language(spark, sf):
    return C.path_files(spark, sf).select("path", P.detect_language(F.col("path")).alias("language"))


@query("prj_02_supported", NAMES + f"SELECT path FROM named WHERE {LANGUAGE_OF} IS NOT NULL")
def is_supported(spark, sf):
    found = C.path_files(spark, sf).withColumn("language", P.detect_language(F.col("path")))
    return supported(found).select("path")


@query(
    "prj_03_content_hash",
    f"WITH {DOCS} SELECT repo, path, size_bytes, sha256(content) AS content_hash FROM docs",
)
def content_hash(spark, sf):
    raw = C.document_files(spark, sf).withColumn("content", F.col("content").cast("binary"))
    return enrich_files(raw).select("repo", "path", "size_bytes", "content_hash")


@query("prj_04_text_hash", "SELECT p_partkey, sha256(p_name) AS hash FROM part")
def text_hash(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", X.hash_string(F.col("p_name")).alias("hash"))


@query(
    "prj_05_mtime_size",
    "SELECT event_id, floor(epoch(ts))::BIGINT AS mtime, strlen(props) AS size_bytes FROM events",
)
def mtime_size(spark, sf):
    raw = C.table(spark, sf, "events").select(
        F.lit("events").alias("repo"),
        F.concat("event_id", F.lit(".json")).alias("path"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("mtime"),
        F.octet_length("props").alias("size_bytes"),
        F.col("props").cast("binary").alias("content"),
    )
    event = F.substring_index("path", ".", 1).cast("bigint")
    return enrich_files(raw).select(event.alias("event_id"), "mtime", "size_bytes")


@query("prj_06_relative_path", NAMES + "SELECT path AS relative FROM named")
def relative_path(spark, sf):
    rooted = F.concat(F.lit("/srv/code/"), F.col("path"))
    return C.path_files(spark, sf).select(P.relative_to(rooted, "/srv/code").alias("relative"))


@query(
    "prj_10_request_bounds",
    """SELECT p_partkey::INTEGER AS query_id,
         (p_size * 3 - 5) BETWEEN 1 AND 100 AND p_partkey % 13 BETWEEN 0 AND 10 AS accepted FROM part""",
)
def request_bounds(spark, sf):
    ok = valid_request(F.col("topk"), F.col("context"))
    return C.part_requests(spark, sf).select("query_id", ok.alias("accepted"))


@query("chk_01_chunks", CHUNKS + "SELECT path, chunk_id, content, start_line, end_line FROM chunks")
def chunks(spark, sf):
    return C.document_chunks(spark, sf).select("path", "chunk_id", "content", "start_line", "end_line")


@query("chk_02_chunk_ids", CHUNKS + "SELECT path, max(chunk_id) AS last, count(*) AS n FROM chunks GROUP BY path")
def chunk_ids(spark, sf):
    found = chunk_files(C.document_files(spark, sf), C.CHUNK_LINES)
    return found.groupBy("path").agg(F.max("chunk_id").alias("last"), F.count("*").alias("n"))


@query(
    "chk_03_numbered_lines",
    CHUNKS + "SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM lines",
)
def numbered_lines(spark, sf):
    return file_lines(C.document_files(spark, sf)).select("path", "line_no", "line")


AT = "hash_line AS (SELECT *, length(content) % 40 + 1 AS spot FROM lines)"


def _at():
    return (F.length("content") % 40 + 1).cast("int")


@query(
    "chk_04_snippet",
    CHUNKS
    + f""", {AT} SELECT path, array_to_string(ls[greatest(1, spot - 2):least(len(ls), spot + 2)], chr(10)) AS snippet,
         greatest(1, spot - 2) AS start_line, least(len(ls), spot + 2) AS end_line FROM hash_line""",
)
def snippet(spark, sf):
    found = L.snippet_around(F.col("content"), _at(), 2)
    return C.document_files(spark, sf).select("path", found.alias("s")).select("path", "s.*")


@query(
    "chk_05_formatted_snippet",
    CHUNKS
    + f""", {AT} SELECT path, coalesce(array_to_string(list_transform(ls, lambda l, i:
           printf('%s %4d | %s', CASE WHEN spot - 1 + i = spot + 1 THEN '>' ELSE ' ' END, spot - 1 + i, l)), chr(10)), '') AS formatted
       FROM hash_line""",
)
def formatted_snippet(spark, sf):
    whole = C.document_files(spark, sf).select("path", "content", _at().alias("at"))
    return whole.select("path", L.format_snippet(F.col("content"), F.col("at"), F.col("at") + 1).alias("formatted"))


@query(
    "chk_06_line_at",
    CHUNKS + f", {AT} SELECT path, CASE WHEN spot - 3 >= 1 THEN coalesce(ls[spot - 3], '') ELSE '' END AS line FROM hash_line",
)
def line_at(spark, sf):
    return C.document_files(spark, sf).select("path", L.line_at(F.col("content"), _at() - 3).alias("line"))


@query("chk_07_head_snippet", CHUNKS + "SELECT path, array_to_string(ls[1:4], chr(10)) AS snippet FROM lines")
def head_snippet(spark, sf):
    return C.document_files(spark, sf).select("path", L.head_snippet(F.col("content")).alias("snippet"))


@query(
    "chk_08_context",
    CHUNKS
    + f""", {AT} SELECT path, array_to_string(list_transform(ls[greatest(1, spot - 3):least(len(ls), spot + 3)],
           lambda l, i: printf('%4d | %s', greatest(1, spot - 3) + i - 1, rtrim(l))), chr(10)) AS context
       FROM hash_line""",
)
def context(spark, sf):
    found = L.context_window(F.col("content"), _at(), F.lit(3))
    return C.document_files(spark, sf).select("path", F.array_join(found, "\n").alias("context"))


@query(
    "jon_07_lines_in_range",
    CHUNKS
    + f""", {AT}, n AS (SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM lines)
       SELECT path, spot AS line_number, line_no, line FROM hash_line JOIN n USING (path)
       WHERE line_no BETWEEN spot - 2 AND spot + 2""",
)
def lines_in_range(spark, sf):
    files = C.document_files(spark, sf)
    hits = files.select("repo", "path", _at().alias("line_number"))
    found = hits_with_lines(hits, file_lines(files), 2)
    return found.select("path", "line_number", "line_no", "line")


@query(
    "scl_01_truncate",
    f"WITH {DOCS} SELECT path, CASE WHEN length(content) <= 200 THEN content ELSE left(content, 197) || '...' END AS short FROM docs",
)
def truncate(spark, sf):
    return C.document_files(spark, sf).select("path", X.truncate_text(F.col("content")).alias("short"))


@query(
    "scl_02_highlight",
    f"WITH {DOCS} SELECT path, regexp_replace(content, '(the|\\.\\n)', '**\\1**', 'gi') AS marked FROM docs",
)
def highlight(spark, sf):
    once = X.highlight_match(F.col("content"), F.lit("THE"))
    both = X.highlight_match(once, F.lit(".\n"))
    return C.document_files(spark, sf).select("path", both.alias("marked"))


@query(
    "scl_05_whitespace",
    f"WITH {DOCS} SELECT path, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM docs",
)
def whitespace(spark, sf):
    return C.document_files(spark, sf).select("path", X.normalize_whitespace(F.col("content")).alias("flat"))


@query(
    "scl_06_lower_contains",
    f"WITH {DOCS} SELECT path, contains(lower(content), 'and') AS found, lower(content) AS low FROM docs",
)
def lower_contains(spark, sf):
    content = F.col("content")
    return C.document_files(spark, sf).select(
        "path",
        F.contains(F.lower(content), F.lit("and")).alias("found"),
        F.lower(content).alias("low"),
    )


@query(
    "scl_07_round",
    "SELECT event_id, round(value, 1) AS value, round(event_id / 1048576, 2) AS mb FROM events",
)
def rounding(spark, sf):
    return C.table(spark, sf, "events").select(
        "event_id", F.round("value", 1).alias("value"), F.round(F.col("event_id") / 1048576, 2).alias("mb")
    )
