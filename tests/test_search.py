"""Searches against SQLite's FTS5 as an independent engine, and symbol ranking by hand."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from codelake.functions.stemming import porter_stem
from codelake.operators import matching as M
from codelake.operators.postings import build_postings, corpus_stats
from codelake.operators.queries import parse_queries, refused_texts, rejected_requests
from codelake.operators.ranking import bm25
from codelake.operators.text_search import score_text
from codelake.plans import corpora as C
from codelake.plans.index import index_from_files
from codelake.plans.search import search, with_context

WORDS = "run running runs handler handle café CAFE naïve the a_b Größe x1 relational relate жжжing flies".split()


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    return {
        f"f{i:02}.md": "".join(
            " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) + rng.choice([" ", ".", "\n", "-"])
            for _ in range(rng.randint(0, 8))
        )
        for i in range(n)
    }


class Fts5:
    def __init__(self, texts, stem=True):
        self.db = sqlite3.connect(":memory:")
        tokenizer = "porter unicode61" if stem else "unicode61"
        self.db.execute(f"CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, x, tokenize='{tokenizer}')")
        self.db.executemany("INSERT INTO t VALUES (?, ?)", texts.items())

    def search(self, text):
        try:
            rows = self.db.execute("SELECT path, -rank FROM t WHERE t MATCH ?", (text,)).fetchall()
        except sqlite3.OperationalError:
            return {}
        return {path: score for path, score in rows}


TEXTS = [
    "run", "running", "the handler", "cafe", "CAFÉ naive", "a_b", '"a b"', '"run the"', "han*", '"the han" *',
    "^the", "^ run handle", "run + the", "the OR flies", "run NOT the", "run NOT the handler", "run AND handle NOT cafe",
    "run NOT the AND cafe", "the OR run NOT cafe", "the handler OR cafe", "relational", "Größe", "grosse", "жжжings",
    "x1 AND", "AND x", "requests.get", "foo-bar", "print(", "a,b", "*", '""', "nowhere", "the nowhere", "fly",
    "NEAR(run the)", "NEAR(run the, 0)", "NEAR(the handler, 2)", 'NEAR("a b" cafe, 3)', "NEAR (run + the flies, 5 )",
    "NEAR(han* the cafe, 4)", "run NOT NEAR(the cafe, 1)", "NEAR(run the, 1) OR NEAR(cafe flies, 0) NOT x1", "NEAR(run)",
    'NEAR("" run, 2)', "NEAR run", "NEAR(run AND the)", "NEAR(run the, x)", "NEAR(^run the)", "^NEAR(run the)", "NEAR()",
    "cafe NEAR(run the, 2) x1", "run + AND", "AND*", "ANDx OR the", "NEAR(run run, 3)", "NEAR(the run, 99999999999)",
    '"the"* run', "run NOT the NOT cafe", "the OR", "NOT the", 'say "the', "the\tcafe",
]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_text_search_agrees_with_fts5(spark, files_of, texts):
    engine = Fts5(texts)
    index = index_from_files(files_of(texts))
    parsed = parse_queries(C.requests(spark, tuple(TEXTS)))
    found = {}
    for r in score_text(index, parsed).collect():
        found.setdefault(r.query_id, {})[r.path] = r.score
    for i, text in enumerate(TEXTS):
        expected = engine.search(text)
        assert set(found.get(i, {})) == set(expected), text
        for path, score in expected.items():
            assert found[i][path] == pytest.approx(score, abs=2e-6), (text, path)


def test_refused_texts_have_a_reason(spark):
    asked = ("(pass OR zz) AND def", "NEAR(def pass)", 'say "the', "the OR", "print(", "a-b", "def:x", "x1")
    found = {r.query_id: r.reason for r in refused_texts(C.requests(spark, asked)).collect()}
    assert sorted(found) == [0, 2, 3, 4, 5]
    assert "parentheses" in found[0] and "quotation" in found[2] and "AND" in found[3] and found[5].endswith(": -")


def test_unstemmed_search_agrees_with_fts5(spark, files_of, texts):
    engine = Fts5(texts, stem=False)
    index = index_from_files(files_of(texts), stem=False)
    asked = ("running", "handl*", '"run the"', "cafe OR flies")
    parsed = parse_queries(C.requests(spark, asked))
    found = {(r.query_id, r.path) for r in score_text(index, parsed).collect()}
    assert found == {(i, path) for i, text in enumerate(asked) for path in engine.search(text)}


@pytest.mark.parametrize("pair", [("run", "the"), ("the", "handler"), ("cafe", "a b")])
@pytest.mark.parametrize("distance", [0, 2, 10])
def test_near_agrees_with_fts5(spark, files_of, texts, pair, distance):
    engine = Fts5(texts)
    chunks = index_from_files(files_of(texts)).chunks
    wanted = spark.createDataFrame([(0, i, t) for i, t in enumerate(pair)], "query_id int, phrase_id int, text string")
    rows = M.phrase_rows(wanted)
    matches = M.match_phrases(build_postings(chunks), rows)
    near = M.match_near(matches, rows, distance)
    first, second = (f'"{t}"' for t in pair)
    expected = engine.search(f"NEAR({first} {second}, {distance})")
    assert {r.path for r in near.select("path").collect()} == set(expected)


def test_near_of_three_by_brute_force(spark, files_of, texts):
    index = index_from_files(files_of(texts), stem=False)
    names = ("the", "run", "handler")
    wanted = spark.createDataFrame([(0, i, t) for i, t in enumerate(names)], "query_id int, phrase_id int, text string")
    rows = M.phrase_rows(wanted, stem=False)
    near = M.match_near(M.match_phrases(index.postings, rows), rows, 4)
    found = {(r.path, r.phrase_id): list(r.starts) for r in near.collect()}
    places = {}
    for r in index.postings.filter(F.col("term").isin(*names)).collect():
        places.setdefault(r.path, {})[names.index(r.term)] = r.positions
    expected = {}
    for path, by_word in places.items():
        if len(by_word) < 3:
            continue
        for a in by_word[0]:
            for b in by_word[1]:
                for c in by_word[2]:
                    if max(a, b, c) - min(a, b, c) - 1 <= 4:
                        for i, p in enumerate((a, b, c)):
                            expected.setdefault((path, i), set()).add(p)
    assert found == {k: sorted(v) for k, v in expected.items()}


def test_bm25_values(spark):
    """Seven chunks of two tokens on average, three with the word."""
    texts = ["x a", "x a b c", "x", "a a", "b b", "c c", "d"]
    chunks = spark.createDataFrame(
        [("r", f"{i}", "md", 0, t, 1, 1) for i, t in enumerate(texts)],
        "repo string, path string, language string, chunk_id int, content string, start_line int, end_line int",
    )
    wanted = spark.createDataFrame([(0, 0, "x")], "query_id int, phrase_id int, text string")
    found = M.match_phrases(build_postings(chunks), M.phrase_rows(wanted))
    scores = {r.path: r.score for r in bm25(found, corpus_stats(chunks)).collect()}
    assert scores["0"] == 0.251314 and scores["1"] == 0.178352


def test_stems():
    assert [porter_stem(w) for w in ("running", "relational", "flies", "at", "sses", "eed", "yying")] == [
        "run", "relat", "fli", "at", "sse", "e", "y",
    ]


CODE = {
    "module.py": "import os\nfrom typing import List\n\nclass User:\n    def name(self):\n        return 1\n"
    "    def age(self): pass\ndef user_count(): pass\n",
    "app.js": "import { User } from 'models';\nfunction userCount(x) {}\nclass Users {}\n",
    "README.md": "The user guide.\nUsers read it.\n",
}


def run(spark, files_of, *asked, topk=10, context=0, prelimit=True, texts=CODE):
    index = index_from_files(files_of(texts))
    queries = C.requests(spark, asked, topk, context)
    found = search(index, queries, prelimit)
    if context:
        found = with_context(index, found, queries)
    return found.orderBy("query_id", "rank").collect()


def test_symbol_scores(spark, files_of):
    rows = run(spark, files_of, "class:user", "def:name", "def:user_count", "import:os", "import:o", "def:user_none")
    assert [(r.query_id, r.symbol_name, r.score) for r in rows] == [
        (0, "User", 23.0), (0, "Users", 18.0),
        (1, "User.name", 17.5),
        (2, "user_count", 22.5),
        (3, "os", 20.0),
        (4, "models.User", 15.0), (4, "os", 15.0),
    ]


def test_wildcards_in_names(spark, files_of):
    rows = run(spark, files_of, "def:user%nt")
    assert [(r.symbol_name, r.score) for r in rows] == [("userCount", 12.5), ("user_count", 12.5)]


def test_results_of_every_route(spark, files_of):
    rows = run(spark, files_of, "user lang:markdown", "def:user user", "lang:python", "symbol:User path:mod", "import:")
    by_query = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append((r.file_path, r.match_type))
    assert by_query[0] == [("README.md", "text")]
    assert {t for _, t in by_query[1]} == {"symbol:function", "symbol:method", "text"}
    assert 2 not in by_query and 4 not in by_query
    assert {p for p, _ in by_query[3]} == {"module.py"}


def test_repeated_filters_count_twice_and_last_wins(spark, files_of):
    rows = run(spark, files_of, "def:user_count symbol:user_count", "def:nothing def:user_count")
    assert [r.symbol_name for r in rows if r.query_id == 0] == ["user_count", "user_count"]
    assert [r.symbol_name for r in rows if r.query_id == 1] == ["user_count"]


def test_limits(spark, files_of):
    texts = {f"m{i:03}.py": f"def job_{i:03}(): pass\nclass Zjob: pass\n" for i in range(30)}
    rows = run(spark, files_of, "def:job", "def:job pass", "symbol:zjob", topk=7, texts=texts)
    counts = {q: sum(r.query_id == q for r in rows) for q in range(3)}
    assert counts == {0: 7, 1: 6, 2: 7}
    assert not run(spark, files_of, "def:job pass", topk=1, texts=texts)


def test_limit_by_name_comes_before_scoring(spark, files_of):
    texts = {"a.py": "def aa_x(): pass\ndef ab_x(): pass\ndef x(): pass\n"}
    assert [r.symbol_name for r in run(spark, files_of, "def:x", topk=2, texts=texts)] == ["aa_x", "ab_x"]
    best = run(spark, files_of, "def:x", topk=2, prelimit=False, texts=texts)
    assert best[0].symbol_name == "x"


def test_context_lines(spark, files_of):
    rows = run(spark, files_of, "def:name", context=1)
    assert list(rows[0].context_lines) == ["   4 | class User:", "   5 |     def name(self):", "   6 |         return 1"]


def test_requests_out_of_bounds_are_told_and_answered(spark, files_of):
    queries = spark.createDataFrame(
        [(0, "user", 0, 0), (1, "user", 101, 0), (2, "user", 100, 11), (3, "user", 100, 10)],
        "query_id int, query string, topk int, context int",
    )
    assert {r.query_id for r in rejected_requests(queries).collect()} == {0, 1, 2}
    index = index_from_files(files_of(CODE))
    assert {r.query_id for r in search(index, queries).collect()} == {1, 2, 3}


def test_parsing(spark):
    asked = ("hello world", "auth lang:python PATH:auth", "def:a def:ab", "mongodb://x y", "  a   def:b  c ")
    rows = parse_queries(C.requests(spark, asked)).orderBy("query_id").collect()
    assert [(r.text_query, r.route) for r in rows] == [
        ("hello world", "text"), ("auth", "text"), ("b", "hybrid"), ("y", "text"), ("a c", "hybrid"),
    ]
    assert (rows[1].lang_filter, rows[1].path_filter, rows[2].def_filter) == ("python", "auth", "ab")


@pytest.mark.parametrize("stored", [False, True])
def test_salted_joins_give_the_same_chunks(spark, files_of, texts, tmp_path, monkeypatch, stored):
    """As with more phrase rows than a plan holds: the postings of a term are dealt out by chunk."""
    from codelake.operators import text_search
    from codelake.plans.index import build_index, open_index

    if stored:
        for path, text in texts.items():
            (tmp_path / "src").mkdir(exist_ok=True)
            (tmp_path / "src" / path).write_text(text)
        build_index(spark, str(tmp_path / "src"), str(tmp_path / "index"), repo="r")
        index = open_index(spark, str(tmp_path / "index"))
    else:
        index = index_from_files(files_of(texts))
    asked = ["run the", '"run the"', "the OR flies", "han*", "run NOT the", "^the", "NEAR(run the, 2)", "the", "the"]
    requests = spark.createDataFrame([(i, q, 50, 0) for i, q in enumerate(asked)], "query_id int, query string, topk int, context int")
    parsed = parse_queries(requests)
    found = []
    for salted in (False, True):
        monkeypatch.setattr(text_search, "too_many", lambda rows, salted=salted: salted)
        rows = score_text(index, parsed).select("query_id", "path", "chunk_id", "score").collect()
        found.append(sorted(map(tuple, rows)))
    assert found[0] == found[1] and {r[0] for r in found[0]} == set(range(len(asked)))


def test_too_many_rows(spark):
    rows = spark.range(5).selectExpr("cast(id AS string) AS term")
    assert M.too_many(rows, 4) and not M.too_many(rows, 5)


def test_names_meet_symbols_without_sending_symbols_to_the_driver(spark):
    """Symbols made from a table that is small on disk are not few: only what was found, once counted, may be broadcast."""
    from codelake.operators.small import HELD
    from codelake.operators.symbol_search import match_names, name_patterns

    text = F.lit(None).cast("string")
    symbols = spark.range(2 * HELD).select(
        F.lit("r").alias("repo"), F.concat(F.lit("p"), "id").alias("path"), F.lit("python").alias("language"),
        F.concat(F.when(F.col("id") < HELD + 1, "many_").otherwise("few_"), F.col("id") % (2 * HELD - 3)).alias("name"),
        F.lit("class").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), text.alias("signature"),
    )
    for pattern, n, joins in (("many_", HELD + 1, 0), ("few_", HELD - 1, 1), ("few_9999", 0, 1)):
        found = match_names(symbols, name_patterns(parse_queries(C.requests(spark, (f"symbol:{pattern}",)))))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == joins and "BuildLeft" not in plan
        assert found.count() == n


def test_postings_are_made_once_for_a_search(spark, files_of, texts):
    """Scores need the number of chunks that hold a phrase and the chunks themselves: both read matches written once."""
    index = index_from_files(files_of(texts), 10, stem=False)
    asked = ("the handler", "NEAR(run the, 3)", "han* NOT cafe")
    scored = score_text(index, parse_queries(C.requests(spark, asked)))
    assert "inline(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.query_id for r in scored.collect()} == {0, 1, 2}


@pytest.mark.parametrize("name", ("fts_05_all_words", "fts_07_not", "fts_09_prefix"))
def test_queries_make_postings_once(spark, sf, name):
    from codelake.plans.registered import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Words that must not occur are matched, plain ones and phrases, by a plan of their own.
    assert plan.count("inline(") == (2 if name == "fts_07_not" else 0)


def test_hits_of_sides_are_few_when_they_meet_chunks(spark, sf):
    from codelake.plans.registered import QUERIES

    plan = QUERIES["set_02_sides_together"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" not in plan  # of postings: the hits are rows by now, and name the paths of their chunks


def test_near_is_shared_by_as_many_tasks_as_there_are_occurrences_for(spark, files_of, texts, monkeypatch):
    words = M.phrase_rows(spark.createDataFrame([(0, 0, "run"), (0, 1, "the")], "query_id int, phrase_id int, text string"), stem=False)
    chunks = index_from_files(files_of(texts), 10, stem=False)
    matches = M.match_phrases(chunks.postings, words)
    shown = ["phrase_id", "path", "chunk_id", "tf", "starts"]
    expected = sorted(M.match_near(matches, words, 3).select(*shown).collect())
    occurrences = matches.select(F.explode("starts")).count()
    monkeypatch.setattr(M, "OCCURRENCES", 2)
    near = M.match_near(matches, words, 3)
    tasks = -(-occurrences // 2)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"], {tasks}\n" in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(near.select(*shown).collect()) == expected and expected
