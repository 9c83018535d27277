"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Words are runs of anything but ASCII blanks; lines are what newlines separate. Everything is counted over the whole
text by Spark's own functions, so the projection pipelines with the scan and shuffles nothing.
"""

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import whole

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on", "not", "this",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "par", "pour",
    "el", "los", "las", "y", "del", "se", "con", "por", "para", "una", "su", "al", "lo", "como", "no",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht",
)


@dataclass(frozen=True)
class Rule:
    """A document fails if `value`, an SQL expression over the counts, leaves [low, high] and `when` holds."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    when: str = "true"


# The last column says from which length on a ratio says anything.
RULES = (
    Rule("words", "n_words", low=20),
    Rule("repeated_words", "100 * n_repeat_words / greatest(n_words, 1)", high=30),
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=2, high=20),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", high=0.3),
    Rule("letter_words", "n_letter_words / greatest(n_words, 1)", low=0.5),
    Rule("stop_words", "n_stop_words", low=1, when="n_words >= 50"),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5, when="n_lines >= 4"),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", high=0.9, when="n_lines >= 4"),
    Rule("cut_lines", "n_cut_lines / greatest(n_lines, 1)", high=0.3, when="n_lines >= 4"),
)
LISTED = ("en", "fr", "es", "de")  # the languages of STOP_WORDS
BASE_RULES = ("words", "repeated_words")
COUNT = r"\b(n_\w+|word_chars)\b"


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, counts): each document whole, as a struct, and what is counted in its text."""
    pair = "transform({0}, (h, i) -> xxhash64(h, get({0}, i + {1})))"
    out = docs.select(whole(docs).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    trimmed = F.btrim("_body", F.lit(BLANKS))
    out = out.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+")),
            "_lines": F.filter(F.split("_body", "\n"), lambda x: x.rlike("[^ \t-\r]")),
        }
    )
    out = out.withColumns({"_h1": F.expr("transform(_words, w -> xxhash64(w))"), "_n": F.size("_words")})
    for name, of, step in (("_h2", "_h1", 1), ("_h4", "_h2", 2), ("_h8", "_h4", 4)):
        out = out.withColumn(name, F.expr(pair.format(of, step)))
    # Windows by their hash; positions are sorted only where some window comes twice.
    out = out.withColumn("_w", F.expr(f"slice(_h8, 1, greatest(_n - {WINDOW - 1}, 0))"))
    out = out.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_w)) < size(_w) "
            "THEN sort_array(transform(_w, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    out = out.withColumn(
        "_starts",
        F.expr(
            "sort_array(transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i, "
            "coalesce(x.h = get(_sorted, k - 1).h, false) OR coalesce(x.h = get(_sorted, k + 1).h, false) AS twice)), "
            "x -> x.twice), x -> x.i))"
        ),
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    counts = {
        "n_words": "_n",
        "word_chars": f"char_length(translate(_body, '{_sql(BLANKS)}', ''))",
        "n_symbols": f"char_length(_body) - char_length(translate(_body, '{SYMBOLS}', ''))",
        "n_lines": "size(_lines)",
        "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
        "n_repeat_words": "coalesce(aggregate(transform(_starts, (p, k) -> "
        f"least({WINDOW}, coalesce(get(_starts, k + 1) - p, {WINDOW}))), 0, (a, x) -> a + x), 0)",
        "n_letter_words": "size(filter(_words, w -> w rlike '\\\\p{L}'))",
        "n_stop_words": f"size(filter(_words, w -> lower(w) IN ({stop})))",
        "n_bullet_lines": "size(filter(_lines, x -> x rlike '^[ \\t]*[-*•]'))",
        "n_cut_lines": "size(filter(_lines, x -> x rlike '(\\\\.\\\\.\\\\.|…)[ \\t\\r]*$'))",
    }
    made = F.struct(*[F.expr(e).cast("bigint").alias(n) for n, e in counts.items()])
    # Given out by a generator, so that a filter on the counts is not pushed below them and counts everything again.
    return out.select("row", F.explode_outer(F.array(made)).alias("counts"))


def _sql(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


def failed_rules(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL for the names of the rules that a row with `counts` fails."""

    def fails(rule: Rule) -> str:
        bounds = [f"{rule.value} < {rule.low}"] * (rule.low is not None)
        bounds += [f"{rule.value} > {rule.high}"] * (rule.high is not None)
        return re.sub(COUNT, r"counts.\g<0>", f"CASE WHEN ({rule.when}) AND ({' OR '.join(bounds)}) ") + f"THEN '{rule.name}' END"

    return "array_compact(array(" + ", ".join(map(fails, rules)) + "))"


def rules_where_listed(lang: str = "lang") -> tuple[Rule, ...]:
    """RULES for documents with a column of language codes: stop words are asked only of languages that have a list."""
    code = f"lower(split(row.`{lang.replace('`', '``')}`, '[-_]')[0])"
    listed = f"coalesce({code} IN ({', '.join(f"'{x}'" for x in LISTED)}), false)"
    return tuple(replace(r, when=f"{r.when} AND {listed}") if r.name == "stop_words" else r for r in RULES)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, counts, failed): `failed` names the rules a document fails; none failed means kept.

    A null or empty text has no words and no lines and fails the rule on words. Rows are judged one by one, so
    repeated rows get the same verdict. All columns are carried along inside `row`, whatever their names; an empty
    table gives no rows.
    """
    return with_counts(docs, text).withColumn("failed", F.expr(failed_rules(rules)))
