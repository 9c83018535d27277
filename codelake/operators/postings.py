"""The inverted index: one row per (term, chunk)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.stemming import stem_each
from codelake.functions.tokens import tokens
from codelake.schemas import CHUNK_KEY
from codelake.settings import BM25_B, BM25_K1

CHUNK = [*CHUNK_KEY, "language"]


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """(chunk key, language, dl, pos, term), unstemmed, one row per token."""
    split = chunks.select(*CHUNK, tokens(F.col("content")).alias("tokens"))
    return split.select(*CHUNK, F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))


def build_postings(chunks: DataFrame, stem: bool = True) -> DataFrame:
    """``postings`` rows, without a shuffle: all the tokens of a chunk lie in its own row.

    They are sorted there and equal ones put together, so tokens never become rows. Stems are
    looked up once per distinct term of a chunk, and terms that share one are put together again.
    """
    split = chunks.select(*CHUNK, tokens(F.col("content")).alias("tokens"))
    pairs = F.transform("tokens", lambda term, pos: F.struct(term.alias("term"), pos.alias("at")))
    paired = split.select(*CHUNK, F.size("tokens").alias("dl"), F.sort_array(pairs).alias("entries"))
    found = _with_heads(paired)
    entries = _grouped(lambda same: F.transform(same, lambda e: e["at"]))
    if stem:
        grouped = found.select(*CHUNK, "dl", entries.alias("entries"))
        stemmed = grouped.withColumn("stems", stem_each(F.transform("entries", lambda e: e["term"])))
        renamed = F.zip_with(
            "stems",
            "entries",
            lambda term, e: F.struct(term.alias("term"), e["positions"].alias("positions")),
        )
        found = _with_heads(stemmed.select(*CHUNK, "dl", F.sort_array(renamed).alias("entries")))
        entries = _grouped(
            lambda same: F.sort_array(F.flatten(F.transform(same, lambda e: e["positions"])))
        )
    # The generator takes the expression itself. Of a column Spark would first ask that it is not
    # empty, and push that question, sorting included, below the projections above.
    return found.select(*CHUNK, "dl", F.inline(entries)).select(
        "term", "repo", "path", "language", "chunk_id", "dl", F.size("positions").alias("tf"), "positions"
    )


def _with_heads(rows: DataFrame) -> DataFrame:
    """Add where each run of equal terms begins in the sorted array ``entries``."""
    entries = F.col("entries")

    def is_head(i: Column) -> Column:
        return (i == 0) | (F.get(entries, i)["term"] != F.get(entries, i - 1)["term"])

    places = F.sequence(F.lit(0), F.greatest(F.size(entries) - 1, F.lit(0)))
    none = F.array().cast("array<int>")
    return rows.withColumn("heads", F.when(F.size(entries) > 0, F.filter(places, is_head)).otherwise(none))


def _grouped(positions: Callable[[Column], Column]) -> Column:
    """Put equal terms of ``entries`` together, in time linear in its length."""
    entries, heads = F.col("entries"), F.col("heads")

    def one(head: Column, number: Column) -> Column:
        last = F.coalesce(F.get(heads, number + 1), F.size(entries)) - 1
        same = F.transform(F.sequence(head, last), lambda i: F.get(entries, i))
        return F.struct(
            F.get(entries, head)["term"].alias("term"), positions(same).alias("positions")
        )

    return F.transform(heads, one)


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df): in how many chunks each term occurs."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def with_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("n_tokens", F.size(tokens(F.col("content"))))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks (empty ones too) and of tokens, and their ratio."""
    counted = chunks if "n_tokens" in chunks.columns else with_lengths(chunks)
    n_tokens = F.coalesce(F.sum(F.col("n_tokens").cast("bigint")), F.lit(0))
    totals = counted.agg(F.count("*").alias("n_chunks"), n_tokens.alias("n_tokens"))
    return totals.withColumn("avgdl", F.try_divide(F.col("n_tokens"), F.col("n_chunks")))


LEVELS = 16
USUAL_TOKENS = 256.0  # of a chunk; only says where levels part


def level_of(tf: Column, dl: Column) -> Column:
    """0 for postings that give the best scores, up to LEVELS - 1 for those that give the least.

    What a posting adds to a score grows with tf / (tf + norm), and norm with dl; how the mean length moves later changes
    what a level is worth, not which postings it holds.
    """
    norm = BM25_K1 * ((1 - BM25_B) + BM25_B * dl / USUAL_TOKENS)
    return F.greatest(F.lit(0), F.floor((1 - tf / (tf + norm)) * LEVELS)).cast("int")


def with_levels(postings: DataFrame) -> DataFrame:
    return postings.withColumn("level", level_of(F.col("tf"), F.col("dl")))


def term_counts(postings: DataFrame) -> DataFrame:
    """``terms`` rows of postings: their number per term, language and level, and what bounds a score among them."""
    ratio = F.col("dl") / F.col("tf")
    return postings.groupBy("term", "language", "level").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min(ratio).alias("min_ratio")
    )


def taken_away(terms: DataFrame) -> DataFrame:
    """The same counts with the sign turned, and nothing to say about scores."""
    nothing = [F.lit(0).alias("max_tf"), F.lit(float("inf")).alias("min_ratio")]
    return terms.select("term", "language", "level", (-F.col("n")).alias("n"), *nothing)


def summed_terms(terms: DataFrame) -> DataFrame:
    """Signed counts added up, one row per term, language and level that still occurs."""
    return (
        terms.groupBy("term", "language", "level")
        .agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio"))
        .filter("n <> 0")
    )
