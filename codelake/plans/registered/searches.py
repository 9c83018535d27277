"""Whole searches: many requests over documents and generated code at once."""

from pyspark.sql import functions as F

from codelake.operators.queries import parse_queries, refused_texts
from codelake.operators.results import (
    json_envelopes,
    merge_sides,
    result_json,
    symbol_rows,
    text_rows,
    total_results,
)
from codelake.operators.small import only, settled
from codelake.operators.symbol_search import top_symbols
from codelake.operators.text_search import score_text, top_text
from codelake.plans import corpora as C
from codelake.plans.index import index_from_files
from codelake.plans.registered.registry import (
    DOCS,
    GENERATED,
    SYMBOLS,
    bm25_views,
    chunk_views,
    query,
)
from codelake.plans.search import search, with_context

MIXED = """files AS (
  SELECT repo, path, language, content FROM docs UNION ALL SELECT repo, path, language, content FROM gen)"""

# The requests of C.REQUESTS, taken apart by hand.
RESULTS = f"""WITH {DOCS}, {GENERATED}, {MIXED}, {chunk_views("files")}, {SYMBOLS},
q(query_id, side, lang, sub, wanted) AS (VALUES
  (0, 10, NULL, NULL, 2), (1, 10, 'en', NULL, 2), (2, 10, NULL, 'src1', 1), (7, 5, NULL, NULL, 1),
  (11, 10, 'de', NULL, 1)),
ph(query_id, phrase_id, term) AS (VALUES
  (0, 0, 'the'), (0, 1, 'license'), (1, 0, 'the'), (1, 1, 'license'), (2, 0, 'and'), (7, 0, 'function'),
  (11, 0, 'and')),
m AS (SELECT query_id, phrase_id, post.* FROM ph JOIN post USING (term)), {bm25_views("m")},
texts AS (
  SELECT query_id, repo, path AS file_path, start_line AS line_number,
         array_to_string(string_split(rtrim(chunks.content, chr(10)), chr(10))[1:4], chr(10)) AS snippet,
         score, 'text' AS match_type, language, NULL AS symbol_name, NULL AS symbol_kind
  FROM (SELECT s.*, side, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, path, chunk_id) AS r
        FROM scored s JOIN q USING (query_id)
        WHERE n_phrases = wanted AND (lang IS NULL OR language = lang)
          AND (sub IS NULL OR path ILIKE '%' || sub || '%'))
  JOIN chunks USING (repo, path, language, chunk_id) WHERE r <= side),
asked(query_id, side, tuple_no, wanted, pattern) AS (VALUES
  (3, 10, 0, 'function', 'm_1'), (3, 10, 1, 'method', 'm_1'), (4, 10, 2, 'class', 'C_1'),
  (5, 10, 3, 'import', 'mod_3'), (6, 10, 4, NULL, '_1'), (7, 5, 0, 'function', 'f_1'), (7, 5, 1, 'method', 'f_1')),
found AS (
  SELECT a.*, s.*, row_number() OVER (PARTITION BY query_id, tuple_no ORDER BY name, repo, path, start_line) AS r
  FROM asked a JOIN syms s ON s.name ILIKE '%' || a.pattern || '%' AND (wanted IS NULL OR kind = wanted)),
valued AS (
  SELECT *, 9.0 + CASE WHEN lower(name) = lower(pattern) THEN 10.0 WHEN contains(lower(name), lower(pattern))
      THEN 5.0 ELSE 0.0 END + CASE WHEN signature IS NOT NULL THEN 2.0 ELSE 0.0 END
      + CASE kind WHEN 'class' THEN 2.0 WHEN 'import' THEN 1.0 ELSE 1.5 END AS score
  FROM found WHERE r <= side),
symbols AS (
  SELECT query_id, repo, path AS file_path, start_line AS line_number,
         coalesce(signature, kind || ': ' || name) AS snippet, score, 'symbol:' || kind AS match_type,
         language, name AS symbol_name, kind AS symbol_kind
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, path, start_line, name) AS s
        FROM valued) WHERE s <= side),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, file_path, line_number, symbol_name) AS rank
  FROM (SELECT * FROM texts UNION ALL SELECT * FROM symbols)),
results AS (SELECT * FROM ranked WHERE rank <= 10) """
INDEXED = f"WITH {DOCS}, {GENERATED}, {MIXED}"  # what the results are found in
ROW = "query_id, rank, repo, file_path, line_number, snippet, score, match_type, language, symbol_name, symbol_kind"


def results(spark, sf):
    return search(C.mixed_index(spark, sf), C.requests(spark))


@query("qry_04_batch_search", RESULTS + f"SELECT {ROW} FROM results")
def batch_search(spark, sf):
    return results(spark, sf)


@query("top_05_rank", RESULTS + "SELECT query_id, rank, file_path, line_number FROM results")
def ranks(spark, sf):
    return results(spark, sf).select("query_id", "rank", "file_path", "line_number")


@query("agg_07_total_results", RESULTS + """SELECT i::INTEGER AS query_id, count(results.query_id) AS total_results
  FROM range(12) t(i) LEFT JOIN results ON results.query_id = i GROUP BY i""")
def totals(spark, sf):
    return total_results(C.requests(spark), results(spark, sf))


OBJECT = """'{"file_path":' || to_json(file_path) || ',"line_number":' || line_number || ',"snippet":' || to_json(snippet)
  || ',"score":' || score || ',"match_type":' || to_json(match_type) || ',"language":' || to_json(language)
  || coalesce(',"symbol_name":' || to_json(symbol_name), '')
  || coalesce(',"symbol_kind":' || to_json(symbol_kind), '') || '}'"""


@query("prj_07_sparse_json", RESULTS + f"SELECT query_id, rank, {OBJECT} AS json FROM results")
def sparse_json(spark, sf):
    return result_json(results(spark, sf))


@query(
    "snk_05_json_envelope",
    RESULTS
    + f""", objects AS (SELECT query_id, count(*) AS n, string_agg({OBJECT}, ',' ORDER BY rank) AS body FROM results GROUP BY 1),
  asked_text(query_id, query) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(C.REQUESTS))})
  SELECT query_id, '{{"query":' || to_json(query) || ',"total_results":' || coalesce(n, 0) || ',"results":['
         || coalesce(body, '') || ']}}' AS json
  FROM asked_text LEFT JOIN objects USING (query_id)""",
)
def envelope(spark, sf):
    return json_envelopes(C.requests(spark), results(spark, sf))


@query(
    "top_04_hybrid",
    RESULTS + "SELECT rank, file_path, line_number, score, match_type FROM results WHERE query_id = 7",
)
def hybrid(spark, sf):
    found = search(C.mixed_index(spark, sf), C.requests(spark).filter("query_id = 7"))
    return found.select("rank", "file_path", "line_number", "score", "match_type")


@query(
    "set_02_sides_together",
    RESULTS + "SELECT query_id, match_type, count(*) AS n FROM results GROUP BY ALL",
)
def sides(spark, sf):
    index = C.mixed_index(spark, sf)
    parsed = parse_queries(C.requests(spark))
    by_text = parsed.filter(F.col("route").isin("text", "hybrid"))
    by_symbol = parsed.filter(F.col("route").isin("symbol", "hybrid"))
    hits = settled(top_text(score_text(index, by_text), by_text), "hits")
    texts = text_rows(hits, only(index.chunks, "path", hits))
    symbols = symbol_rows(top_symbols(index.symbols, by_symbol))
    return merge_sides(symbols, texts, parsed).groupBy("query_id", "match_type").agg(F.count("*").alias("n"))


# Text alone, over the documents.
TEXTS = ("the license", "and path:src1", "license lang:en", "lang:fr de la", "the")
TEXT_SQL = f"""WITH {DOCS}, {chunk_views()},
q(query_id, lang, sub, wanted) AS (VALUES
  (0, NULL, NULL, 2), (1, NULL, 'src1', 1), (2, 'en', NULL, 1), (3, 'fr', NULL, 2), (4, NULL, NULL, 1)),
ph(query_id, phrase_id, term) AS (VALUES
  (0, 0, 'the'), (0, 1, 'license'), (1, 0, 'and'), (2, 0, 'license'), (3, 0, 'de'), (3, 1, 'la'), (4, 0, 'the')),
m AS (SELECT query_id, phrase_id, post.* FROM ph JOIN post USING (term)), {bm25_views("m")},
best AS (
  SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, path, chunk_id) AS rank
  FROM scored s JOIN q USING (query_id)
  WHERE n_phrases = wanted AND (lang IS NULL OR language = lang) AND (sub IS NULL OR path ILIKE '%' || sub || '%')) """


def _texts(spark, sf):
    index = index_from_files(C.document_files(spark, sf), C.CHUNK_LINES, stem=False)
    parsed = parse_queries(C.requests(spark, TEXTS))
    return index, parsed, score_text(index, parsed)


@query("top_03_best_text", TEXT_SQL + "SELECT query_id, path, chunk_id, score FROM best WHERE rank <= 10")
def best_text(spark, sf):
    _, parsed, scored = _texts(spark, sf)
    return top_text(scored, parsed).select("query_id", "path", "chunk_id", "score")


@query(
    "jon_02_chunks_of_hits",
    TEXT_SQL
    + """SELECT query_id, path AS file_path, start_line AS line_number, score,
           array_to_string(string_split(rtrim(content, chr(10)), chr(10))[1:4], chr(10)) AS snippet
         FROM best JOIN chunks USING (repo, path, language, chunk_id) WHERE rank <= 10""",
)
def chunks_of_hits(spark, sf):
    index, parsed, scored = _texts(spark, sf)
    found = text_rows(top_text(scored, parsed), index.chunks)
    return found.select("query_id", "file_path", "line_number", "score", "snippet")


@query(
    "jon_06_terms_with_postings",
    TEXT_SQL + "SELECT query_id, phrase_id, path, chunk_id, tf FROM m",
)
def terms_with_postings(spark, sf):
    from codelake.operators.matching import match_phrases, phrase_rows
    from codelake.operators.queries import text_phrases

    index, parsed, _ = _texts(spark, sf)
    rows = phrase_rows(text_phrases(parsed), stem=False)
    found = match_phrases(index.postings, rows)
    return found.select("query_id", "phrase_id", "path", "chunk_id", "tf")


# Connectives, phrases and prefixes in the request text.
BOOLEAN = ("the OR de", "the and NOT is", "license NOT the of", '"of the"', "licen*", "^the", "the AND (", "NOT the")


@query(
    "qry_05_text_syntax",
    f"""WITH {DOCS}, {chunk_views()},
    has AS (SELECT path, chunk_id, list(term) AS ts, arg_min(term, pos) AS first_term,
              ' ' || string_agg(term, ' ' ORDER BY pos) || ' ' AS flat FROM tok GROUP BY ALL)
    SELECT query_id, path, chunk_id FROM (
      SELECT *, unnest([
        CASE WHEN list_contains(ts, 'the') OR list_contains(ts, 'de') THEN 0 END,
        CASE WHEN list_contains(ts, 'the') AND list_contains(ts, 'and') AND NOT list_contains(ts, 'is') THEN 1 END,
        CASE WHEN list_contains(ts, 'license') AND NOT (list_contains(ts, 'the') AND list_contains(ts, 'of')) THEN 2 END,
        CASE WHEN contains(flat, ' of the ') THEN 3 END,
        CASE WHEN contains(flat, ' licen') THEN 4 END,
        CASE WHEN first_term = 'the' THEN 5 END]) AS query_id FROM has) WHERE query_id IS NOT NULL""",
)
def text_syntax(spark, sf):
    index = index_from_files(C.document_files(spark, sf), C.CHUNK_LINES, stem=False)
    scored = score_text(index, parse_queries(C.requests(spark, BOOLEAN)))
    return scored.select("query_id", "path", "chunk_id")


@query(
    "chk_08_results_with_context",
    RESULTS
    + f"""SELECT {ROW}, array_to_string(list_transform(ls[greatest(1, line_number - 2):least(len(ls), line_number + 2)],
           lambda l, i: printf('%4d | %s', greatest(1, line_number - 2) + i - 1, rtrim(l))), chr(10)) AS context_lines
         FROM results JOIN (SELECT repo AS in_repo, path AS in_path, ls FROM lines) ON in_repo = repo AND in_path = file_path""",
)
def results_with_context(spark, sf):
    index = C.mixed_index(spark, sf)
    asked = C.requests(spark, context=2)
    found = with_context(index, search(index, asked), asked)
    return found.withColumn("context_lines", F.array_join("context_lines", "\n"))


@query("qry_06_stemmed_search")
def stemmed(spark, sf):
    return search(C.mixed_index(spark, sf, stem=True), C.requests(spark))


# Groups of near words in the request text; each pair of words is looked at from the rarer of the two.
NEAR_TEXTS = ("NEAR(the is, 3)", "NEAR(de la, 0)", "license NOT NEAR(the of, 2)", "NEAR(the license) OR NEAR(de la, 1)")


@query(
    "qry_08_near_in_text",
    f"""WITH {DOCS}, {chunk_views()},
    asked(a, b, distance) AS (VALUES ('the', 'is', 3), ('de', 'la', 0), ('the', 'of', 2), ('the', 'license', 10), ('de', 'la', 1)),
    near AS (SELECT DISTINCT a, b, distance, p.path, p.chunk_id
      FROM asked JOIN post p ON p.term = a JOIN post q ON q.term = b AND q.path = p.path AND q.chunk_id = p.chunk_id
      WHERE len(list_filter(p.positions, lambda x: len(list_filter(q.positions, lambda y: abs(x - y) - 1 <= distance)) > 0)) > 0)
    SELECT DISTINCT query_id, path, chunk_id FROM (
      SELECT 0 AS query_id, path, chunk_id FROM near WHERE b = 'is'
      UNION ALL SELECT 1, path, chunk_id FROM near WHERE distance = 0
      UNION ALL SELECT 2, path, chunk_id FROM post WHERE term = 'license'
        AND NOT EXISTS (FROM near n WHERE n.b = 'of' AND n.path = post.path AND n.chunk_id = post.chunk_id)
      UNION ALL SELECT 3, path, chunk_id FROM near WHERE b = 'license' OR distance = 1)""",
)
def near_in_text(spark, sf):
    index = index_from_files(C.document_files(spark, sf), C.CHUNK_LINES, stem=False)
    scored = score_text(index, parse_queries(C.requests(spark, NEAR_TEXTS)))
    return scored.select("query_id", "path", "chunk_id")


# One shape per part; what is wrong with each follows from its place in the list.
REFUSED_SHAPES = ("({n} OR zz) AND a", "a AND", 'say "{n}', "foo-{k}", "{n}", "NEAR({n}, x)", "NEAR({n}, 3)", "a.{k},b")


@query(
    "qry_09_refused_texts",
    """SELECT p_partkey::INTEGER AS query_id,
      CASE p_partkey % 8 WHEN 2 THEN 'a quotation mark without its other half'
        WHEN 0 THEN 'parentheses that are not those of NEAR(word word, distance)'
        WHEN 5 THEN 'parentheses that are not those of NEAR(word word, distance)'
        WHEN 1 THEN 'AND, OR or NOT without a word on each side'
        WHEN 3 THEN 'characters that have no meaning outside quotation marks: -'
        ELSE 'characters that have no meaning outside quotation marks: .,' END AS reason
      FROM part WHERE p_partkey % 8 NOT IN (4, 6)""",
)
def refused(spark, sf):
    k = F.col("p_partkey")
    shape = F.get(F.array(*map(F.lit, REFUSED_SHAPES)), (k % len(REFUSED_SHAPES)).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{n}"), F.col("p_name")), F.lit("{k}"), k.cast("string"))
    asked = C.table(spark, sf, "part").select(k.cast("int").alias("query_id"), text.alias("query"))
    return refused_texts(asked).select("query_id", "reason")
