"""Ranked symbol search: name patterns of many requests against the symbol table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.scoring import symbol_score
from codelake.functions.text import ascii_lower, is_ascii, like_substring
from codelake.operators.queries import side_limit
from codelake.operators.ranking import top_rows
from codelake.operators.small import beside, only, settled
from codelake.operators.text_search import passes_filters

_GRAM = 3

# Which kinds a filter asks for, in the order they are answered.
WANTED = (
    ("def", "function"),
    ("def", "method"),
    ("class", "class"),
    ("import", "import"),
    ("symbol", None),
)


def name_patterns(parsed: DataFrame) -> DataFrame:
    """One row per request and kind asked for: (query_id, tuple_no, wanted_kind, pattern, ...)."""
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("tuple_no"),
                F.lit(kind).cast("string").alias("wanted_kind"),
                F.col(f"{op}_filter").alias("pattern"),
            )
            for i, (op, kind) in enumerate(WANTED)
        ]
    )
    return (
        parsed.select(
            "query_id", "lang_filter", "path_filter", side_limit().alias("side"), F.inline(wanted)
        )
        .filter(F.col("pattern").isNotNull())
    )


def pattern_grams(pattern: Column) -> Column:
    """The grams of the longest part of the pattern without a wildcard; of a part too short for one, the empty gram."""
    parts = F.transform(
        F.split(ascii_lower(pattern), "[%_]"), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))
    )

    def made(part: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(part) - (_GRAM - 1), F.lit(1)))
        grams = F.array_distinct(F.transform(places, lambda i: F.substring(part, i, F.lit(_GRAM))))
        return F.when(F.length(part) >= _GRAM, grams).otherwise(F.array(F.lit("")))

    return F.transform(F.slice(F.array_sort(parts), 1, 1), lambda p: made(p["p"]))[0]


def name_grams(name: Column) -> Column:
    """What `pattern_grams` may ask a matching name for: its parts of three characters, and the empty one."""

    def made(folded: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(folded) - (_GRAM - 1), F.lit(1)))
        parts = F.transform(places, lambda i: F.substring(folded, i, F.lit(_GRAM)))
        return F.when(F.length(folded) >= _GRAM, parts).otherwise(F.array().cast("array<string>"))

    # In ASCII every character is one of Java's, so a lookahead finds the parts in one call.
    plain = F.regexp_extract_all(F.lower(name), F.lit(rf"(?s)(?=(.{{{_GRAM}}}))"), F.lit(1))
    # Folded once, as an array of one: what a lambda mentions besides its own variables is computed for every element.
    others = F.transform(F.array(ascii_lower(name)), made)[0]
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(is_ascii(name), plain).otherwise(others)))


def gram_rows(symbols: DataFrame) -> DataFrame:
    """(gram, name) of the distinct names; an index writes this table once and sorts it by gram."""
    return symbols.select("name").distinct().select(F.explode(name_grams(F.col("name"))).alias("gram"), "name")


def rarest_grams(patterns: DataFrame, grams: DataFrame) -> DataFrame:
    """The patterns with the one of their grams that the fewest names hold; without any name there is no row."""
    asked = patterns.withColumn("gram", F.explode(pattern_grams(F.col("pattern"))))
    # An empty gram needs no count: it has no rival.
    wanted = settled(asked.filter("gram <> ''").select("query_id", "tuple_no", "gram"), "grams")
    counts = only(grams, "gram", wanted).groupBy("gram").agg(F.count("*").alias("n"))
    counted = wanted.join(counts, "gram", "left").groupBy("query_id", "tuple_no")
    rarest = counted.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    least = rarest.filter("least.n > 0").select("query_id", "tuple_no", "least.gram")
    return patterns.join(least, ["query_id", "tuple_no"])


def match_names(symbols: DataFrame, patterns: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Symbols whose name holds a pattern (LIKE rules), of the kind, language and path asked for.

    Joined by hash on one gram per pattern, its rarest, and then tested in full, instead of testing every pattern on
    every symbol; a pattern has one gram, so no pair comes twice. Patterns too short for a gram are tested on every distinct
    name: no index tells more about them. ``grams`` is the table of `gram_rows`, which may
    hold names that are gone and rows twice; without it, it is made of the symbols, which are then written down first: they
    are read three times. Only names that are found meet their symbols.
    """
    if grams is None:
        symbols = settled(symbols, "symbols", held=0)
        grams = gram_rows(symbols)
    grams = grams.select("gram", "name")
    holds = like_substring(F.col("name"), F.col("pattern"))
    keyed = settled(rarest_grams(patterns, grams), "patterns")
    found = only(grams, "gram", keyed).join(keyed, "gram").filter(holds).drop("gram")
    short = settled(patterns.filter(F.array_contains(pattern_grams(F.col("pattern")), "")), "short")
    if not short.isEmpty():
        names = grams.filter("gram = ''").select("name")
        found = found.unionByName(names.join(F.broadcast(short), holds))  # requests against all names
    kind = F.col("wanted_kind")
    return (
        beside(symbols, found.distinct(), "name")
        .filter(kind.isNull() | (F.col("kind") == kind))
        .filter(passes_filters(F.col("language"), F.col("path")))
        .drop("wanted_kind", "lang_filter", "path_filter")
    )


def top_symbols(
    symbols: DataFrame, parsed: DataFrame, prelimit: bool = True, most: int | None = None,
    grams: DataFrame | None = None,
) -> DataFrame:
    """The best symbols of each request.

    With ``prelimit`` each kind asked for gives only its first rows by name before any is scored,
    which may leave out a better one further on; without it all are scored.
    """
    found = match_names(symbols, name_patterns(parsed), grams)
    if prelimit:
        by_name = [F.asc("name"), F.asc("repo"), F.asc("path"), F.asc("start_line")]
        found = top_rows(found, ["query_id", "tuple_no"], by_name, F.col("side"), most=most)
    scored = found.withColumn(
        "score", symbol_score(F.col("name"), F.col("kind"), F.col("signature"), F.col("pattern"))
    )
    order = [F.desc("score"), F.asc("repo"), F.asc("path"), F.asc("start_line"), F.asc("name")]
    return top_rows(scored, ["query_id"], order, F.col("side"), most=most).drop("rank")
