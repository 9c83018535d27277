"""Phrase matching over postings.

A phrase is the unit that is matched and scored: one word, or several in a row. Phrase rows are
(query_id, phrase_id, offset, term, prefix, initial): one row per word of the phrase; ``prefix``
marks a last word that stands for every term it begins, ``initial`` a phrase bound to the start
of its chunk. Match rows are
(query_id, phrase_id, chunk key, language, dl, n_words, tf, starts).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.stemming import stem as stem_of
from codelake.functions.tokens import tokens
from codelake.operators.small import HELD, NAMED, settled
from codelake.schemas import CHUNK_KEY

CHUNK = [*CHUNK_KEY, "language", "dl"]  # the last two follow from the key
MATCH = ["query_id", "phrase_id", *CHUNK, "n_words"]
OCCURRENCES = 250_000  # of phrases, that a task sorts to find those near each other
SALTS = 32  # tasks that share the postings of a term, where there are too many phrase rows to send to all tasks


def phrase_rows(phrases: DataFrame, stem: bool = True) -> DataFrame:
    """Phrase texts (query_id, phrase_id, text[, prefix, initial]) to one row per word."""
    for flag in ("prefix", "initial"):
        if flag not in phrases.columns:
            phrases = phrases.withColumn(flag, F.lit(False))
    words = phrases.withColumn("words", tokens(F.col("text")))
    rows = words.select(
        "query_id",
        "phrase_id",
        F.size("words").alias("n_words"),
        "initial",
        "prefix",
        F.posexplode("words").alias("offset", "term"),
    ).withColumn("prefix", F.col("prefix") & (F.col("offset") == F.col("n_words") - 1))
    return rows.withColumn("term", stem_of(F.col("term"))) if stem else rows


def expand_prefixes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Replace each prefix word by the terms of the vocabulary it begins.

    A vocabulary that is sorted by term is read in the prefixes' ranges only, as long as the prefixes are few. Terms are
    joined by their beginnings of just the lengths that are asked for. The vocabulary (term, ...) may repeat terms, such as
    a bare scan of the postings.
    """
    word = F.col("term")
    prefixes = settled(rows.filter("prefix"), "prefixes")
    asked = {r[0] for r in prefixes.select("term").limit(HELD + 1).collect()}
    if 0 < len(asked) <= NAMED:
        in_range = F.lit(False)
        for p in sorted(asked):
            in_range |= F.startswith(word, F.lit(p))
        vocabulary = vocabulary.filter(in_range)
        sizes = F.lit(sorted({len(p) for p in asked}))
    else:
        sizes = prefixes.agg(F.array_sort(F.collect_set(F.length("term"))).alias("sizes")).scalar()
    long_enough = F.filter(sizes, lambda n: n <= F.length("term"))
    heads = F.transform(long_enough, lambda n: F.substring(word, F.lit(1), n))
    keyed = vocabulary.select(word.alias("candidate"), F.explode(heads).alias("term"))
    expanded = prefixes.join(keyed, "term").withColumn("term", F.col("candidate"))
    return rows.filter("NOT prefix").unionByName(expanded.select(*rows.columns).distinct())


def with_terms(postings: DataFrame, rows: DataFrame, salted: bool, how: str = "inner") -> DataFrame:
    """Postings joined by term with phrase rows. Salted, the postings of a term found everywhere are dealt over several tasks
    by their chunk, and each phrase row goes to all of these."""
    if not salted:
        return postings.join(rows, "term", how)
    salt = F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(SALTS)).cast("int")
    copies = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", salt).join(copies, ["term", "salt"], how).drop("salt")


def too_many(rows: DataFrame, held: int = HELD) -> bool:
    """Whether phrase rows are more than what lives in a plan."""
    return rows.select("term").limit(held + 1).count() > held


def match_words(postings: DataFrame, rows: DataFrame, salted: bool = False) -> DataFrame:
    """`match_phrases` for single words without a prefix: every posting is a match as it stands."""
    hits = with_terms(postings, rows, salted)
    starts = F.when(F.col("initial"), F.array(F.lit(0))).otherwise(F.col("positions"))
    first = F.get("positions", F.lit(0)) == 0
    return hits.filter(~F.col("initial") | first).select(
        *MATCH, F.when(F.col("initial"), 1).otherwise(F.col("tf")).alias("tf"), starts.alias("starts")
    )


def match_phrases(
    postings: DataFrame, rows: DataFrame, vocabulary: DataFrame | None = None, salted: bool = False
) -> DataFrame:
    """Where each phrase occurs. Give a vocabulary if any phrase ends in a prefix, and ask for salts if there are `too_many` rows.

    Positions are shifted back by the word's place in the phrase; a phrase begins wherever all
    its words agree. The groups are one phrase in one chunk. Single words need no grouping.
    """
    single = (F.col("n_words") == 1) & ~F.col("prefix")
    words, others = rows.filter(single), rows.filter(~single)
    if vocabulary is not None:
        others = expand_prefixes(others, vocabulary)
    hits = with_terms(postings, others, salted).select(
        *MATCH,
        "initial",
        F.transform("positions", lambda p: p - F.col("offset")).alias("begins"),
    )
    gathered = hits.groupBy(*MATCH, "initial").agg(
        F.sort_array(F.flatten(F.collect_list("begins"))).alias("begins")
    )
    starts = _agreed_by_all("begins", "n_words")
    kept = F.when(F.col("initial"), F.filter(starts, lambda s: s == 0)).otherwise(starts)
    grouped = (
        gathered.select(*MATCH, kept.alias("starts"))
        .filter(F.size("starts") > 0)
        .select(*MATCH, F.size("starts").alias("tf"), "starts")
    )
    return match_words(postings, words, salted).unionByName(grouped)


def _agreed_by_all(begins: str, n_words: str) -> Column:
    """Values that appear ``n_words`` times in the sorted array; none can appear more often."""
    ahead = F.col(n_words) - 1
    agreed = F.filter(
        F.col(begins), lambda start, i: start == F.get(F.col(begins), i + ahead)
    )
    return F.when(F.col(n_words) == 1, F.col(begins)).otherwise(agreed)


def chunks_of_query(matches: DataFrame) -> DataFrame:
    return matches.select("query_id", *CHUNK_KEY)


def phrase_counts(rows: DataFrame) -> DataFrame:
    """(query_id, wanted): how many phrases a query has; those that never match count too."""
    return rows.groupBy("query_id").agg(F.countDistinct("phrase_id").alias("wanted"))


def match_any(scored: DataFrame) -> DataFrame:
    """OR: a chunk with at least one phrase; `bm25` output as it is."""
    return scored


def match_all(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """AND: keep scored chunks that hold every phrase of their query."""
    return (
        scored.join(phrase_counts(rows), "query_id")
        .filter(F.col("n_phrases") == F.col("wanted"))
        .drop("wanted")
    )


def match_none(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """NOT: drop scored chunks where an excluded phrase occurs; those add nothing to the score."""
    return scored.join(chunks_of_query(excluded), ["query_id", *CHUNK_KEY], "left_anti")


def written(matches: DataFrame) -> DataFrame:
    """Match rows from a table in the shared folder: what reads them several times does not make postings as often."""
    return settled(matches, "matches", held=0)


def near_tasks(matches: DataFrame) -> int:
    """How many tasks look for near occurrences: at most about `OCCURRENCES` each, whatever the shuffle's partitions are."""
    occurrences = matches.agg(F.sum(F.size("starts").cast("bigint"))).first()[0] or 0
    return max(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-occurrences // OCCURRENCES))


def match_near(matches: DataFrame, rows: DataFrame, distance: int | Column = 10) -> DataFrame:
    """NEAR: the occurrences of a query's phrases with at most ``distance`` words in between.

    A group of occurrences ends where its last phrase begins; every other phrase must begin no
    later and end at most ``distance`` words earlier. Each occurrence therefore covers a stretch
    of possible ends. Cut at the next occurrence of the same phrase the stretches are disjoint, so
    a running count of open ones says how many phrases cover a position: no pairs are formed.
    The occurrences are counted first, and so many tasks share them that what one sorts does not grow.
    """
    matches = written(matches)
    dealt = matches.repartition(near_tasks(matches), "query_id", *CHUNK_KEY)
    occurrences = dealt.select(*MATCH, F.explode("starts").alias("start"))
    reach = F.col("start") + F.col("n_words") + distance
    following = F.lead("start").over(Window.partitionBy(*MATCH).orderBy("start"))
    spans = (
        occurrences.withColumn("reach", reach)
        .withColumn("closes", F.least(F.col("reach"), F.coalesce(following - 1, F.col("reach"))) + 1)
        .withColumn(
            "edge",
            F.explode(
                F.array(
                    F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
                    F.struct(F.col("closes").alias("at"), F.lit(-1).alias("step")),
                )
            ),
        )
    )
    along = Window.partitionBy("query_id", *CHUNK_KEY).orderBy("edge.at")
    up_to_here = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = along.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    opening = F.col("edge.step") == 1
    covered = spans.withColumn("covering", F.sum("edge.step").over(up_to_here)).join(
        phrase_counts(rows), "query_id"
    )
    is_end = opening & (F.col("covering") == F.col("wanted"))
    kept = (
        covered.withColumn("next_end", F.min(F.when(is_end, F.col("start"))).over(from_here))
        .filter(opening & (F.col("next_end") <= F.col("reach")))
    )
    return kept.groupBy(*MATCH).agg(
        F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("start")).alias("starts")
    )


def match_groups(matches: DataFrame, phrases: DataFrame) -> DataFrame:
    """Matches of phrases with a ``near`` are kept where their group is near enough; all others as they are.

    Each group is treated as a query of its own, named by its query, its number and its distance.
    """
    key = ["query_id", "phrase_id"]
    named = phrases.filter("near IS NOT NULL").select(*key, F.struct("query_id", "near", "distance").alias("group"))
    grouped = matches.join(named, key)
    wanted = named.select(F.col("group").alias("query_id"), "phrase_id")
    near = match_near(
        grouped.withColumn("query_id", F.col("group")).drop("group"), wanted, F.col("query_id.distance")
    )
    others = matches.join(named, key, "left_anti")
    return others.unionByName(near.withColumn("query_id", F.col("query_id.query_id")))
