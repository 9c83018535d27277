"""Search tokens: runs of letters, numbers and private-use characters, folded."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions.text import is_ascii


def _fold_table() -> tuple[str, str]:
    """Letters that are a base plus one mark map to the base; lone marks are deleted.

    Built from the Unicode decompositions. `translate` drops source characters past the end of
    the target string, so the lone marks come last.
    """
    pairs = {"ς": "σ"}
    for code in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        single_mark = len(parts) == 2 and parts[0].isalpha() and unicodedata.combining(parts[1])
        if letter.lower() == letter and single_mark:
            pairs[letter] = parts[0]
    marks = "".join(map(chr, range(0x300, 0x332)))
    return "".join(pairs) + marks, "".join(pairs.values())


_FROM, _TO = _fold_table()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(text: Column) -> Column:
    """Tokens of a text, in order. Nothing in ASCII has to be folded beyond its case."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    folded = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    return F.when(is_ascii(text), plain).otherwise(folded)
