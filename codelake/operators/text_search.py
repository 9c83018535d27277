"""Ranked text search over postings."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.scoring import bm25_part, inverse_document_frequency
from codelake.functions.text import like_substring
from codelake.operators.matching import expand_prefixes, match_groups, match_phrases, phrase_rows, too_many, with_terms, written
from codelake.operators.queries import side_limit, text_phrases
from codelake.operators.ranking import holding_of, score_parts, top_rows
from codelake.operators.small import only, settled
from codelake.schemas import CHUNK_KEY
from codelake.settings import BM25_B, BM25_K1, SCORE_DIGITS


def score_chunks(parts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, chunk key, language, score) of the chunks that satisfy a query's phrases.

    An alternative holds if all its required phrases are there and no exclusion is complete; the
    score sums the required phrases of the alternatives that hold. All three groupings run on one
    shuffle by query and chunk.
    """
    group = ["query_id", "alternative", "exclusion"]
    sizes = phrases.groupBy(*group).agg(F.count("*").alias("wanted"))
    placed = phrases.select(*group, "phrase_id").join(sizes, group)
    chunk = ["query_id", *CHUNK_KEY, "language"]
    complete = F.col("n") == F.col("wanted")
    sums = (
        parts.repartition("query_id", *CHUNK_KEY)
        .join(placed, ["query_id", "phrase_id"])
        .groupBy(*chunk, "alternative", "exclusion", "wanted")
        .agg(F.sum("part").alias("part"), F.count("*").alias("n"))
    )
    alternatives = sums.groupBy(*chunk, "alternative").agg(
        F.max(F.when((F.col("exclusion") == 0) & complete, F.col("part"))).alias("part"),
        F.max((F.col("exclusion") > 0) & complete).alias("excluded"),
    )
    holding = alternatives.filter(F.col("part").isNotNull() & ~F.col("excluded"))
    return holding.groupBy(*chunk).agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))


def request_words(index, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The phrases of the requests' texts and the words of these; prefixes become the terms of the index they stand for."""
    phrases = settled(text_phrases(parsed), "phrases")
    words = settled(phrase_rows(phrases, index.stem), "words")
    if words.filter("prefix").isEmpty():
        return phrases, words
    return phrases, settled(expand_prefixes(words, index.vocabulary), "words")


def score_words(index, phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, chunk key, language, score) of every chunk that answers the phrases."""
    known = known_holding(index, words)
    salted = too_many(words)
    near = not phrases.filter("near IS NOT NULL").isEmpty()
    if known is None:
        # Read for the number of chunks that hold a phrase, and again for the scores.
        matches = written(match_phrases(index.postings, words, salted=salted))
        if near:  # A phrase's weight follows from all chunks that hold it, near the others or not.
            known, matches = holding_of(matches), match_groups(matches, phrases)
        return score_chunks(score_parts(matches, index.stats, known), phrases)
    # A stored index is read once for all words; phrases are put together from what was found.
    found = with_terms(only(index.postings, "term", words), words.select("term").distinct(), salted, "left_semi")
    found = settled(found.drop("level", "segment", "bucket"), "postings", held=0)
    matches = match_phrases(found, words, salted=salted)
    # Only phrases that the counts of terms say nothing about are matched twice: once for their number.
    unknown = settled(words.join(known, ["query_id", "phrase_id"], "left_anti"), "unknown")
    if not unknown.isEmpty():
        again = match_phrases(found, unknown, salted=salted)
        known = known.unionByName(holding_of(again))
    if near:
        matches = match_groups(matches, phrases)
    return score_chunks(score_parts(matches, index.stats, known), phrases)


def score_text(index, parsed: DataFrame) -> DataFrame:
    """Every chunk that answers the text of a request, scored, before filters and limits."""
    return score_words(index, *request_words(index, parsed))


def known_holding(index, words: DataFrame) -> DataFrame | None:
    """(query_id, phrase_id, holding) of phrases of one plain word, from the counts of terms that a stored index keeps."""
    if index.terms is None:
        return None
    plain = words.filter(_plain())
    counts = only(index.terms, "term", words).groupBy("term").agg(F.sum("n").alias("holding"))
    # Settled: counts of terms must not be joined anew wherever a phrase's weight is asked for.
    return settled(plain.join(counts, "term").filter("holding > 0").select("query_id", "phrase_id", "holding"), "holding")


def _plain() -> Column:
    """One word that stands for itself, anywhere in a chunk."""
    return (F.col("n_words") == 1) & ~F.col("prefix") & ~F.col("initial")


def best_text(index, parsed: DataFrame, most: int) -> DataFrame:
    """The best chunks of each request, as `top_text` of `score_text`.

    Requests of a single plain word over a stored index touch the levels of postings only that can hold one of their best
    chunks; all others score what they match.
    """
    phrases, words = request_words(index, parsed)
    if index.terms is None:
        return top_text(score_words(index, phrases, words), parsed, most)
    # A prefix that stands for several terms, or none any more, is not a single word.
    single = phrases.groupBy("query_id").agg(F.count("*").alias("n"), F.max("prefix").alias("p"))
    single = settled(single.filter("n = 1 AND NOT p").select("query_id"), "single")
    single = settled(words.filter(_plain()).join(single, "query_id", "left_semi").select("query_id", "term"), "single")
    rest, rest_words = (settled(t.join(single.select("query_id"), "query_id", "left_anti"), "rest") for t in (phrases, words))
    if rest.isEmpty():
        return best_of_levels(index, parsed, single, most)

    def others() -> DataFrame:
        return settled(top_text(score_words(index, rest, rest_words), parsed, most), "others")

    if single.isEmpty():
        return others()
    with ThreadPoolExecutor(2) as pool:
        found = [pool.submit(others), pool.submit(best_of_levels, index, parsed, single, most)]
        return found[0].result().unionByName(found[1].result())


def levels_of(index, parsed: DataFrame, single: DataFrame) -> DataFrame:
    """(query_id, term, level, n, weight, bound, first): what a request of one word may read, best levels first.

    ``n`` counts the postings its language filter lets through, ``bound`` is what none of them scores more than. ``first``
    marks the levels that together hold as many as it asks for; with a path filter these are all, as their number says
    nothing then.
    """
    corpus = index.stats.first()
    asked = single.join(parsed.select("query_id", "lang_filter", "path_filter", side_limit().alias("side")), "query_id")
    rows = only(index.terms, "term", single).join(asked, "term")
    passes = F.col("lang_filter").isNull() | (F.col("language") == F.col("lang_filter"))
    levels = rows.groupBy("query_id", "term", "side", "path_filter", "level").agg(
        F.sum("n").alias("every"), F.sum(F.when(passes, F.col("n")).otherwise(0)).alias("n"),
        F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio"),
    )
    of_query = Window.partitionBy("query_id")
    holding = F.sum("every").over(of_query)
    idf = inverse_document_frequency(F.lit(corpus["n_chunks"]), holding)
    before = F.sum("n").over(of_query.orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
    weighed = levels.withColumns({"weight": idf, "before": F.coalesce(before, F.lit(0)), "holding": holding})
    most_tf = F.col("max_tf").cast("double")
    ratio = F.lit(BM25_K1 * (1 - BM25_B)) / most_tf + F.lit(BM25_K1 * BM25_B) * F.col("min_ratio") / F.lit(corpus["avgdl"])
    bound = F.col("weight") * (BM25_K1 + 1) / (1 + ratio)
    first = F.col("path_filter").isNotNull() | (F.col("before") < F.col("side"))
    kept = weighed.filter((F.col("holding") > 0) & (F.col("n") > 0))
    # A hair more than the bound: sums of doubles may round either way.
    return kept.select("query_id", "term", "level", "n", "weight", (bound * (1 + 1e-9)).alias("bound"), first.alias("first"))


def read_levels(index, parsed: DataFrame, levels: DataFrame, most: int) -> DataFrame:
    """The best chunks of each request among the postings of some levels."""
    wanted = levels.select("query_id", "term", "level", "weight")
    deepest = wanted.agg(F.max("level")).first()[0]
    rows = only(index.postings, "term", wanted).filter(F.col("level") <= (-1 if deepest is None else deepest))
    hits = rows.drop("positions").join(wanted, ["term", "level"])
    avgdl = F.lit(index.stats.first()["avgdl"])
    part = bm25_part(F.col("tf"), F.col("dl"), avgdl, F.col("weight"))
    scored = hits.select("query_id", *CHUNK_KEY, "language", F.round(part, SCORE_DIGITS).alias("score"))
    return top_text(scored, parsed, most)


def best_of_levels(index, parsed: DataFrame, single: DataFrame, most: int) -> DataFrame:
    """The best chunks of requests of one word: first from as many of the best levels as hold enough, then from those
    others that could still hold a better one than the last of these."""
    first, more = planned_levels(index, parsed, single, most)
    if more is None:
        return first
    again = first.unionByName(read_levels(index, parsed, more, most))
    return again_top(again, parsed, most)


def planned_levels(index, parsed: DataFrame, single: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The best of the first levels, and which other levels have to be read, if any."""
    levels = settled(levels_of(index, parsed, single), "levels")
    first = settled(read_levels(index, parsed, levels.filter("first"), most), "first")
    asked = parsed.select("query_id", side_limit().alias("side"))
    last = first.groupBy("query_id").agg(F.count("*").alias("got"), F.min("score").alias("least"))
    state = levels.filter("NOT first").join(asked, "query_id").join(last, "query_id", "left")
    may = (F.coalesce("got", F.lit(0)) < F.col("side")) | (F.round("bound", SCORE_DIGITS) >= F.col("least"))
    more = settled(state.filter(may).select(*levels.columns), "more")
    return first, None if more.isEmpty() else more


def again_top(rows: DataFrame, parsed: DataFrame, most: int) -> DataFrame:
    limit = parsed.select("query_id", side_limit().alias("limit"))
    best = top_rows(rows.join(limit, "query_id"), ["query_id"], _best_first(), F.col("limit"), most=most)
    return best.drop("rank", "limit")


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc("repo"), F.asc("path"), F.asc("chunk_id")]


def passes_filters(language: Column, path: Column) -> Column:
    wanted_language, wanted_path = F.col("lang_filter"), F.col("path_filter")
    return (wanted_language.isNull() | (language == wanted_language)) & (
        wanted_path.isNull() | like_substring(path, wanted_path)
    )


def top_text(scored: DataFrame, parsed: DataFrame, most: int | None = None) -> DataFrame:
    """The best chunks of each request after its language and path filters."""
    wanted = parsed.select("query_id", "lang_filter", "path_filter", side_limit().alias("side"))
    kept = scored.join(wanted, "query_id").filter(passes_filters(F.col("language"), F.col("path")))
    return top_rows(kept, ["query_id"], _best_first(), F.col("side"), most=most).drop("rank", "lang_filter", "path_filter")
