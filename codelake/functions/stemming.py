"""Porter stems of search tokens.

The rules of M.F. Porter, "An algorithm for suffix stripping" (1980), applied to tokens of 3 to 64
bytes; other tokens stay as they are. Words repeat, so each Python worker keeps what it has stemmed.
"""

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tables of steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _vowels(word: str) -> list[bool]:
    flags: list[bool] = []
    for i, letter in enumerate(word):
        flags.append(letter in "aeiou" or (letter == "y" and i > 0 and not flags[-1]))
    return flags


def _measure(word: str) -> int:
    flags = _vowels(word)
    return sum(1 for a, b in zip(flags, flags[1:]) if a and not b)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiou"


def _ends(word: str, ending: str) -> bool:
    return len(word) > len(ending) and word.endswith(ending)


def _short_end(word: str) -> bool:
    return (
        len(word) > 2 and _vowels(word)[-3:] == [False, True, False] and word[-1] not in "wxy"
    )


def _swap(word: str, table: tuple[tuple[str, str], ...]) -> str:
    for ending, other in sorted(table, key=lambda pair: -len(pair[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + other if _measure(stem) > 0 else word
    return word


def _plural(word: str) -> str:
    if _ends(word, "sses") or _ends(word, "ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if _ends(word, "eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if not any(_vowels(stem)):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _suffix(word: str) -> str:
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            droppable = _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t")))
            return stem if droppable else word
    return word


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    if not 3 <= len(word.encode()) <= 64:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    word = _suffix(_swap(_swap(word, STEP_2), STEP_3))
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _stems(terms: pa.Array) -> pa.Array:
    coded = terms.dictionary_encode()
    distinct = pa.array([porter_stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    return distinct.take(coded.indices)


def stem(term: Column) -> Column:
    @F.arrow_udf("string")
    def stems(terms: pa.Array) -> pa.Array:
        return _stems(terms)

    return stems(term)


def stem_each(terms: Column) -> Column:
    """Stems of an array of terms; every distinct term of a batch is looked up once."""

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        starts = pc.subtract(lists.offsets, lists.offsets[0])
        return pa.ListArray.from_arrays(starts, _stems(lists.flatten()))

    return stems(terms)
