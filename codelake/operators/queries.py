"""Search requests: one row per request, all of the syntax as native columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import BLANK, WORD, normalize_whitespace
from codelake.functions.tokens import tokens
from codelake.settings import MAX_CONTEXT, MAX_TOPK

NEAR_WORDS = 10  # between the phrases of NEAR where it names no distance
FARTHEST = 1 << 30
FILTERS = ("symbol", "def", "class", "import", "lang", "path")

_PAIR = rf"([{WORD}]+):([^{BLANK}]+)"
# Text syntax: words, "quoted phrases", a + b, trailing *, leading ^, AND / OR / NOT, NEAR(a "b c", 3).
_BARE = r"[A-Za-z0-9_\x1a\x{80}-\x{10FFFF}]"
_CONNECTIVE = rf"(?:AND|OR|NOT)(?!{_BARE})"
# Possessive throughout: a NEAR that never closes is given up in one pass.
_STRING = rf'(?:(?!{_CONNECTIVE}){_BARE}++|"[^"]*+(?:""[^"]*+)*+")'
_PHRASE = rf"{_STRING}(?:[{BLANK}]*\+[{BLANK}]*{_STRING})*(?:[{BLANK}]*\*)?"
_NEAR = rf"NEAR[{BLANK}]*\([{BLANK}]*(?:{_PHRASE}[{BLANK}]*+)++(?:,[{BLANK}]*[0-9]+[{BLANK}]*)?\)"
_UNIT = rf"{_NEAR}|{_CONNECTIVE}|(?:\^[{BLANK}]*)?{_PHRASE}"
_DISTANCE = rf",[{BLANK}]*([0-9]+)[{BLANK}]*\)\z"


def valid_request(topk: Column, context: Column) -> Column:
    return F.coalesce(
        topk.between(1, MAX_TOPK) & context.between(0, MAX_CONTEXT), F.lit(False)
    )


def rejected_requests(queries: DataFrame) -> DataFrame:
    """Requests beyond the bounds of a public form; `search` itself answers them."""
    return queries.filter(~valid_request(F.col("topk"), F.col("context")))


def parse_queries(queries: DataFrame) -> DataFrame:
    """Split requests into filters and remaining text, and decide how each is answered.

    Of a repeated filter the last counts. Unknown operators are taken out as well.
    """
    q = F.col("query")
    pairs = queries.withColumn("_pairs", F.regexp_extract_all(q, F.lit(_PAIR), F.lit(0))).withColumn(
        "_named",
        F.arrays_zip(
            F.transform(F.regexp_extract_all(q, F.lit(_PAIR), F.lit(1)), F.lower).alias("op"),
            F.regexp_extract_all(q, F.lit(_PAIR), F.lit(2)).alias("value"),
        ),
    )

    def last_value(op: str) -> Column:
        same = F.filter("_named", lambda p: p["op"] == op)
        return F.try_element_at(F.transform(same, lambda p: p["value"]), F.lit(-1))

    rest = F.aggregate("_pairs", q, lambda text, pair: F.replace(text, pair, F.lit("")))
    parsed = pairs.select(
        *queries.columns,
        normalize_whitespace(rest).alias("text_query"),
        *[last_value(op).alias(f"{op}_filter") for op in FILTERS],
    )
    return parsed.withColumn("route", route())


def route() -> Column:
    by_symbol = F.coalesce(*[F.col(f"{op}_filter") for op in FILTERS[:4]]).isNotNull()
    has_text = F.col("text_query") != ""
    return (
        F.when(by_symbol & has_text, "hybrid")
        .when(by_symbol, "symbol")
        .when(has_text, "text")
        .otherwise("none")
    )


def side_limit() -> Column:
    """How many rows each side of a request may give: half each when both are asked."""
    topk = F.col("topk")
    return F.when(F.col("route") == "hybrid", F.floor(topk / 2).cast("int")).otherwise(topk)


def text_units(text: Column) -> Column:
    """Words, phrases and connectives of a text query, in order."""
    return F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0))


def _is_connective(unit: Column) -> Column:
    return unit.isin("AND", "OR", "NOT")


def valid_text(text: Column) -> Column:
    """Nothing but units, and connectives only between two of them; other text finds nothing."""
    units = text_units(text)
    odd = F.exists(
        F.transform(units, lambda u, i: F.struct(u.alias("u"), i.alias("i"))),
        lambda e: _is_connective(e["u"])
        & (
            (e["i"] == 0)
            | (e["i"] == F.size(units) - 1)
            | _is_connective(F.coalesce(F.get(units, e["i"] + 1), F.lit("")))
        ),
    )
    return (_beside_units(text) == "") & (F.size(units) > 0) & ~odd


def _beside_units(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _UNIT, ""), f"[{BLANK}]+", "")


def refused_texts(queries: DataFrame) -> DataFrame:
    """(query_id, text_query, reason) of requests whose text finds nothing because of how it is written."""
    text = F.col("text_query")
    rest = _beside_units(text)
    reason = (
        F.when(F.contains(rest, F.lit('"')), "a quotation mark without its other half")
        .when(rest.rlike(r"[()]"), "parentheses that are not those of NEAR(word word, distance)")
        .when(rest != "", F.concat(F.lit("characters that have no meaning outside quotation marks: "), rest))
        .otherwise("AND, OR or NOT without a word on each side")
    )
    asked = parse_queries(queries).filter((text != "") & ~valid_text(text))
    return asked.select("query_id", "text_query", reason.alias("reason"))


def _phrases_of(unit: Column) -> Column:
    """The phrases a unit asks for: those listed in NEAR, or the unit itself."""
    is_near = F.rlike(unit, F.lit(f"^{_NEAR}$"))
    listed = F.regexp_replace(F.regexp_replace(unit, rf"^NEAR[{BLANK}]*\(", ""), rf"(?:{_DISTANCE}|\)\z)", "")
    return F.when(is_near, F.regexp_extract_all(listed, F.lit(_PHRASE), F.lit(0))).otherwise(F.array(unit))


def _distance_of(unit: Column) -> Column:
    """How many words may lie between the phrases of a NEAR unit; null for other units."""
    digits = F.regexp_extract(unit, _DISTANCE, 1)
    given = F.least(F.coalesce(digits.try_cast("bigint"), F.lit(FARTHEST)), F.lit(FARTHEST)).cast("int")
    is_near = F.rlike(unit, F.lit(f"^{_NEAR}$"))
    return F.when(is_near, F.when(digits == "", NEAR_WORDS).otherwise(given))


def text_phrases(parsed: DataFrame) -> DataFrame:
    """(query_id, phrase_id, alternative, exclusion, text, prefix, initial, near, distance) of valid text queries.

    ``alternative`` counts the sides of OR. ``exclusion`` is 0 for what must be there; phrases
    that share a higher number must not all be there. Words side by side bind tightest, then NOT,
    then AND, then OR. Phrases of a query that share a ``near`` must lie within ``distance`` words; it is null for all
    others.
    """
    state = F.struct(
        F.lit(0).alias("alternative"),
        F.lit(0).alias("exclusion"),
        F.lit(0).alias("used"),
        F.array().cast("array<struct<alternative:int,exclusion:int,text:string>>").alias("out"),
    )

    def step(s: Column, unit: Column) -> Column:
        alternative = F.when(unit == "OR", s["alternative"] + 1).otherwise(s["alternative"])
        used = F.when(unit == "OR", 0).when(unit == "NOT", s["used"] + 1).otherwise(s["used"])
        exclusion = (
            F.when(unit.isin("OR", "AND"), 0).when(unit == "NOT", used).otherwise(s["exclusion"])
        )
        phrase = F.struct(
            alternative.alias("alternative"), exclusion.alias("exclusion"), unit.alias("text")
        )
        grown = F.when(_is_connective(unit), s["out"]).otherwise(F.concat(s["out"], F.array(phrase)))
        return F.struct(
            alternative.alias("alternative"), exclusion.alias("exclusion"), used.alias("used"),
            grown.alias("out"),
        )

    text = F.col("text_query")
    asked = parsed.filter((text != "") & valid_text(text))
    units = F.aggregate(text_units(text), state, step)["out"]
    phrases = F.flatten(
        F.transform(
            units,
            lambda u, i: F.transform(
                _phrases_of(u["text"]),
                lambda phrase: F.struct(
                    u["alternative"].alias("alternative"),
                    u["exclusion"].alias("exclusion"),
                    phrase.alias("text"),
                    F.when(_distance_of(u["text"]).isNotNull(), i).alias("near"),
                    _distance_of(u["text"]).alias("distance"),
                ),
            ),
        )
    )
    return (
        asked.select("query_id", F.posexplode(phrases).alias("phrase_id", "p"))
        .select(
            "query_id",
            "phrase_id",
            "p.alternative",
            "p.exclusion",
            "p.text",
            F.endswith(F.col("p.text"), F.lit("*")).alias("prefix"),
            F.startswith(F.col("p.text"), F.lit("^")).alias("initial"),
            "p.near",
            "p.distance",
        )
        .filter(F.size(tokens(F.col("text"))) > 0)
    )
