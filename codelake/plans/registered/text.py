"""Tokens, postings, phrase matching and BM25 over the documents."""

from pyspark.sql import functions as F

from codelake.functions.stemming import stem
from codelake.functions.tokens import tokens
from codelake.operators import matching as M
from codelake.operators.postings import build_postings, corpus_stats, vocabulary
from codelake.operators.queries import parse_queries, valid_text
from codelake.operators.ranking import bm25
from codelake.operators.small import local_rows
from codelake.plans import corpora as C
from codelake.plans.registered.registry import DOCS, bm25_views, chunk_views, query

BASE = f"WITH {DOCS}, {chunk_views()}"


def phrases(spark, *rows):
    """(query_id, phrase_id, text, prefix, initial) from (query_id, phrase_id, text[, prefix, initial])."""
    full = [(*r, *(False, False)[len(r) - 3:]) if len(r) < 5 else r for r in rows]
    return local_rows(
        spark, full, "query_id int, phrase_id int, text string, prefix boolean, initial boolean"
    )


@query("fts_01_tokens", BASE + " SELECT path, chunk_id, pos, term FROM tok")
def token_rows(spark, sf):
    split = C.document_chunks(spark, sf).select("path", "chunk_id", F.posexplode(tokens(F.col("content"))))
    return split.select("path", "chunk_id", F.col("pos"), F.col("col").alias("term"))


@query("fts_02_stems")
def stems(spark, sf):
    words = vocabulary(C.document_postings(spark, sf))
    return words.select("term", stem(F.col("term")).alias("stem"))


# Endings of a word whose stem is known: tra<key>k has one vowel, and no rule looks at its last letter.
FORMS = {
    "": "", "s": "", "ing": "", "ings": "", "ed": "", "ness": "", "ful": "", "fulness": "", "sses": "ss", "ies": "i", "y": "i",
    "ly": "li", "ment": "ment", "ational": "at", "ization": "iz", "eed": "e",
}


@query(
    "fts_13_stems_of_forms",
    "SELECT concat('tra', p_partkey, 'k', form) AS term, concat('tra', p_partkey, 'k', ending) AS stem FROM part, (VALUES "
    + ", ".join(f"('{form}', '{ending}')" for form, ending in FORMS.items())
    + ") AS forms(form, ending)",
)
def stems_of_forms(spark, sf):
    forms = F.explode(F.array(*map(F.lit, FORMS))).alias("form")
    words = C.table(spark, sf, "part").select("p_partkey", forms).select(
        F.concat(F.lit("tra"), "p_partkey", F.lit("k"), "form").alias("term")
    )
    return words.select("term", stem(F.col("term")).alias("stem"))


@query(
    "fts_03_postings",
    BASE + " SELECT term, path, chunk_id, dl, tf, array_to_string(positions, ',') AS positions FROM post",
)
def postings(spark, sf):
    found = C.document_postings(spark, sf)
    return found.select(
        "term", "path", "chunk_id", "dl", "tf",
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
    )


@query("fts_04_corpus_stats", BASE + " SELECT n_chunks, n_tokens, round(avgdl, 6) AS avgdl FROM corpus")
def stats(spark, sf):
    found = corpus_stats(C.document_chunks(spark, sf))
    return found.select("n_chunks", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


@query("fts_04_document_frequency", BASE + " SELECT term, count(*) AS df FROM post GROUP BY term")
def frequencies(spark, sf):
    return vocabulary(C.document_postings(spark, sf))


WORDS = (
    (0, 0, "the"), (0, 1, "license"), (1, 0, "and"), (1, 1, "of"), (1, 2, "the"), (2, 0, "de"), (2, 1, "nowhere"),
)
MATCHES = BASE + """, ph(query_id, phrase_id, term) AS (VALUES
  (0, 0, 'the'), (0, 1, 'license'), (1, 0, 'and'), (1, 1, 'of'), (1, 2, 'the'), (2, 0, 'de'), (2, 1, 'nowhere')),
m AS (SELECT query_id, phrase_id, post.* FROM ph JOIN post USING (term)), """ + bm25_views("m")


def _scored(spark, sf, *rows):
    words = M.phrase_rows(phrases(spark, *rows), stem=False)
    chunks = C.document_chunks(spark, sf)
    found = build_postings(chunks, stem=False)
    return words, bm25(M.written(M.match_phrases(found, words)), corpus_stats(chunks))


@query(
    "fts_05_all_words",
    MATCHES
    + """ SELECT query_id, path, chunk_id, score FROM scored
  WHERE n_phrases = (SELECT count(*) FROM ph WHERE ph.query_id = scored.query_id)""",
)
def all_words(spark, sf):
    words, scored = _scored(spark, sf, *WORDS)
    return M.match_all(scored, words).select("query_id", "path", "chunk_id", "score")


@query("fts_06_any_word", MATCHES + " SELECT query_id, path, chunk_id, score FROM scored")
def any_word(spark, sf):
    _, scored = _scored(spark, sf, *WORDS)
    return M.match_any(scored).select("query_id", "path", "chunk_id", "score")


@query(
    "fts_07_not",
    MATCHES
    + """ SELECT query_id, path, chunk_id, score FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM post x WHERE x.path = s.path AND x.chunk_id = s.chunk_id AND x.term = 'is')""",
)
def without(spark, sf):
    _, scored = _scored(spark, sf, *WORDS)
    unwanted = M.phrase_rows(phrases(spark, (0, 0, "is"), (1, 0, "is"), (2, 0, "is")), stem=False)
    excluded = M.match_phrases(C.document_postings(spark, sf), unwanted)
    return M.match_none(scored, excluded).select("query_id", "path", "chunk_id", "score")


@query(
    "fts_08_phrase",
    BASE
    + """, pairs(query_id, a, b) AS (VALUES (0, 'of', 'the'), (1, 'the', 'the'), (2, 'en', 'la')),
  said AS MATERIALIZED (SELECT path, chunk_id, term, pos FROM tok WHERE term IN ('of', 'the', 'en', 'la'))
  SELECT query_id, p.path, p.chunk_id, count(*)::INTEGER AS tf
  FROM pairs JOIN said p ON p.term = a JOIN said q
    ON q.term = b AND q.path = p.path AND q.chunk_id = p.chunk_id AND q.pos = p.pos + 1
  GROUP BY ALL""",
)
def phrase(spark, sf):
    words = M.phrase_rows(phrases(spark, (0, 0, "of the"), (1, 0, "The_the"), (2, 0, "en-la")), stem=False)
    found = M.match_phrases(C.document_postings(spark, sf), words)
    return found.select("query_id", "path", "chunk_id", "tf")


@query(
    "fts_09_prefix",
    BASE
    + """, ph(query_id, prefix) AS (VALUES (0, 'th'), (1, 'tion'), (2, 'a')),
  m AS (SELECT query_id, 0 AS phrase_id, repo, path, language, chunk_id, dl, count(*) AS tf
        FROM ph JOIN tok ON starts_with(term, prefix) GROUP BY ALL), """
    + bm25_views("m")
    + " SELECT query_id, path, chunk_id, tf, score FROM scored JOIN m USING (query_id, path, chunk_id)",
)
def prefix(spark, sf):
    texts = phrases(spark, (0, 0, "th", True, False), (1, 0, "tion", True, False), (2, 0, "a", True, False))
    chunks = C.document_chunks(spark, sf)
    found = build_postings(chunks, stem=False)
    matches = M.written(M.match_phrases(found, M.phrase_rows(texts, stem=False), found.select("term")))
    scored = bm25(matches, corpus_stats(chunks))
    key = ["query_id", "path", "chunk_id"]
    return matches.select(*key, "tf").join(scored.select(*key, "score"), key)


@query(
    "fts_10_near",
    BASE
    + """, pairs(query_id, a, b) AS (VALUES (0, 'the', 'is'), (1, 'de', 'la')),
  both_ AS (SELECT query_id, p.path, p.chunk_id, p.positions AS xs, q.positions AS ys
           FROM pairs JOIN post p ON p.term = a JOIN post q
             ON q.term = b AND q.path = p.path AND q.chunk_id = p.chunk_id),
  near AS (SELECT query_id, 0 AS phrase_id, path, chunk_id,
             len(list_filter(xs, lambda x: len(list_filter(ys, lambda y: abs(x - y) - 1 <= 3)) > 0)) AS tf FROM both_
           UNION ALL
           SELECT query_id, 1, path, chunk_id,
             len(list_filter(ys, lambda y: len(list_filter(xs, lambda x: abs(x - y) - 1 <= 3)) > 0)) FROM both_)
  SELECT * FROM near WHERE tf > 0""",
)
def near(spark, sf):
    words = M.phrase_rows(
        phrases(spark, (0, 0, "the"), (0, 1, "is"), (1, 0, "de"), (1, 1, "la")), stem=False
    )
    matches = M.match_phrases(C.document_postings(spark, sf), words)
    return M.match_near(matches, words, 3).select("query_id", "phrase_id", "path", "chunk_id", "tf")


@query(
    "fts_11_first_word",
    BASE + " SELECT path, chunk_id, 1 AS tf FROM post WHERE term = 'the' AND list_contains(positions, 0)",
)
def first_word(spark, sf):
    words = M.phrase_rows(phrases(spark, (0, 0, "the", False, True)), stem=False)
    return M.match_phrases(C.document_postings(spark, sf), words).select("path", "chunk_id", "tf")


@query("fts_12_bm25", MATCHES + " SELECT query_id, path, chunk_id, n_phrases, score FROM scored")
def scores(spark, sf):
    _, scored = _scored(spark, sf, *WORDS)
    return scored.select("query_id", "path", "chunk_id", "n_phrases", "score")


REQUEST = """req AS (
  SELECT p_partkey::INTEGER AS query_id, replace(replace([
    'the {n}', 'the lang:en {n}', 'def:m_{k}', 'class:C_{k} path:gen', 'import:mod_{k} lang:python',
    'symbol:_{k} {n} token', 'def:a_{k} def:a_{k}b', 'LANG:en lang:de {n}', 'mongodb://x{k}',
    '  {n}   path:src{k}  Symbol:S{k} ', 'lang:en path:x_{k}', 'requests.get {n}'][p_partkey % 12 + 1],
    '{n}', p_name), '{k}', p_partkey::VARCHAR) AS query FROM part),
pairs AS (
  SELECT *, regexp_extract_all(query, '\\w+:[^\\s]+') AS ps,
         list_transform(regexp_extract_all(query, '(\\w+):([^\\s]+)', 1), lambda x: lower(x)) AS ops,
         regexp_extract_all(query, '(\\w+):([^\\s]+)', 2) AS vals
  FROM req),
parsed AS (
  SELECT query_id, query,
         trim(regexp_replace(list_reduce(list_prepend(query, ps), lambda acc, p: replace(acc, p, '')), '\\s+', ' ', 'g')) AS text_query,
""" + ",\n".join(
    f"         CASE WHEN list_contains(ops, '{op}') THEN "
    f"vals[len(ops) - list_position(list_reverse(ops), '{op}') + 1] END AS {op}_filter"
    for op in ("symbol", "def", "class", "import", "lang", "path")
) + " FROM pairs)"


@query(
    "qry_01_filters",
    f"WITH {REQUEST} SELECT query_id, symbol_filter, def_filter, class_filter, import_filter, lang_filter, path_filter FROM parsed",
)
def filters(spark, sf):
    parsed = parse_queries(C.part_requests(spark, sf))
    return parsed.select("query_id", *[f"{op}_filter" for op in ("symbol", "def", "class", "import", "lang", "path")])


@query("qry_02_remaining_text", f"WITH {REQUEST} SELECT query_id, text_query FROM parsed")
def remaining(spark, sf):
    return parse_queries(C.part_requests(spark, sf)).select("query_id", "text_query")


@query(
    "qry_03_route",
    f"""WITH {REQUEST} SELECT query_id, CASE
      WHEN coalesce(symbol_filter, def_filter, class_filter, import_filter) IS NOT NULL
        THEN CASE WHEN text_query <> '' THEN 'hybrid' ELSE 'symbol' END
      WHEN text_query <> '' THEN 'text' ELSE 'none' END AS route FROM parsed""",
)
def routes(spark, sf):
    return parse_queries(C.part_requests(spark, sf)).select("query_id", "route")


@query(
    "fts_13_valid_text",
    f"WITH {REQUEST} SELECT query_id, regexp_full_match(text_query, '[A-Za-z0-9_]+( [A-Za-z0-9_]+)*') AS valid FROM parsed",
)
def valid(spark, sf):
    parsed = parse_queries(C.part_requests(spark, sf))
    return parsed.select("query_id", valid_text(F.col("text_query")).alias("valid"))
