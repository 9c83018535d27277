"""Top-k per query, and BM25 over phrase matches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.scoring import bm25_part, inverse_document_frequency
from codelake.schemas import CHUNK_KEY
from codelake.settings import SCORE_DIGITS


def top_rows(
    rows: DataFrame, partition: list[str], order: list[Column], limit: Column, rank: str = "rank",
    most: int | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each partition, ranked from 1.

    ``limit`` is a column. Where its largest value is known, ``most`` names it: the literal bound
    lets Spark cut every partition to ``most`` rows before the shuffle, so a query that matches a
    third of all rows still sends only a handful per task.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    ranked = rows.withColumn(rank, F.row_number().over(window))
    within = F.col(rank) <= limit
    return ranked.filter(within if most is None else (F.col(rank) <= most) & within)


def bm25(matches: DataFrame, stats: DataFrame) -> DataFrame:
    """Scores (query_id, chunk key, language, score, n_phrases) of match rows.

    ``stats`` is the one-row frame of `corpus_stats`; its values enter as scalar subqueries.
    """
    return (
        score_parts(matches, stats)
        .groupBy("query_id", *CHUNK_KEY, "language")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"), F.count("*").alias("n_phrases"))
    )


def holding_of(matches: DataFrame) -> DataFrame:
    """(query_id, phrase_id, holding): in how many chunks each phrase occurs."""
    return matches.groupBy("query_id", "phrase_id").agg(F.count("*").alias("holding"))


def score_parts(matches: DataFrame, stats: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What each phrase adds to the score of each chunk that holds it, as column ``part``.

    A phrase's document frequency is counted over its own matches, unless ``known`` (query_id, phrase_id, holding) gives
    it for all phrases.
    """
    holding = holding_of(matches) if known is None else known
    # One subquery for both values; asked for twice, it runs once.
    corpus = stats.select(F.struct("n_chunks", "avgdl")).scalar()
    idf = inverse_document_frequency(corpus["n_chunks"], F.col("holding"))
    weights = holding.select("query_id", "phrase_id", idf.alias("idf"))
    part = bm25_part(F.col("tf"), F.col("dl"), corpus["avgdl"], F.col("idf"))
    return matches.join(weights, ["query_id", "phrase_id"]).withColumn("part", part)
