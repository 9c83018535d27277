"""Text column functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes spelled out: Java's \s and \w cover other characters than the ones wanted
# here (the separators U+001C..U+001F are blanks, combining marks are not word characters).
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks become one space; none is left at either end."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{BLANK}]+\z", "")


def truncate_text(text: Column, max_length: int = 200) -> Column:
    """Cut to ``max_length`` characters, the last three of them dots."""
    if max_length < 3:
        raise ValueError("max_length must leave room for the dots")
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    )


def highlight_match(text: Column, term: Column, start: str = "**", end: str = "**") -> Column:
    """Wrap every case-insensitive occurrence of the literal ``term``, keeping its case."""
    quoted = F.concat(
        F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    wrap = "{}$0{}".format(*(re.sub(r"([\\$])", r"\\\1", mark) for mark in (start, end)))
    return F.regexp_replace(text, quoted, F.lit(wrap))


def hash_string(text: Column) -> Column:
    return F.sha2(text, 256)


def is_ascii(text: Column) -> Column:
    """Whether every character is one byte; asked in one pass, where `translate` looks each character up."""
    return F.char_length(text) == F.octet_length(text)


def ascii_lower(text: Column) -> Column:
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def like_substring(text: Column, pattern: Column) -> Column:
    """``text LIKE '%pattern%'``: ASCII case folded, % and _ stay wildcards, no escape character."""
    folded, needle = ascii_lower(text), ascii_lower(pattern)
    escaped = F.replace(needle, F.lit("\\"), F.lit("\\\\"))
    wild = F.like(folded, F.concat(F.lit("%"), escaped, F.lit("%")))
    return F.when(needle.rlike("[%_]"), wild).otherwise(F.contains(folded, needle))


def decode_text(content: Column) -> Column:
    """UTF-8 text of raw bytes: invalid bytes are left out, line ends become LF."""
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit(chr(0xFFFD)), F.lit(""))
    valid = F.when(F.is_valid_utf8(text), text).otherwise(repaired)
    return F.when(F.contains(valid, F.lit("\r")), F.regexp_replace(valid, r"\r\n?", "\n")).otherwise(valid)
