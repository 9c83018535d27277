"""Line splitting, chunking and snippets, all within one row."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions.text import strip_end

# Two notions of a line: the wide one ends at any of these, the narrow one only at LF.
_RARE = r"\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}"
_RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_WIDE_END = rf"\r\n|[\n{_RARE}]"
_KEEPING_ENDS = rf"[^\n{_RARE}]*(?:{_WIDE_END})|[^\n{_RARE}]+"


def _has_rare_ends(content: Column) -> Column:
    """Asked of every text, so as searches for bytes; a regular expression takes several times as long."""
    return reduce(or_, (F.contains(content, F.lit(end)) for end in _RARE_ENDS))


# What a lambda over an array mentions besides its own variables is computed anew for every element,
# so lines are split into a column first and only then walked over.


def _lines(content: Column, parts: Column) -> Column:
    return F.when(content == "", F.array().cast("array<string>")).otherwise(parts)


def _without_last_end(content: Column) -> Column:
    shorter = F.substring(content, F.lit(1), F.char_length(content) - 1)
    return F.when(F.endswith(content, F.lit("\n")), shorter).otherwise(content)


def lf_lines(content: Column) -> Column:
    return _lines(content, F.split(_without_last_end(content), "\n", -1))


def wide_lines(content: Column) -> Column:
    rare = F.split(F.regexp_replace(content, rf"(?:{_WIDE_END})\z", ""), _WIDE_END, -1)
    common = F.split(_without_last_end(content), "\n", -1)
    return _lines(content, F.when(_has_rare_ends(content), rare).otherwise(common))


def joinable_lines(content: Column) -> Column:
    """(lines, between, tail): the lines, what goes between two of them, and after the last one.

    Most text has LF ends only and is split without a regular expression; otherwise every line
    keeps its own end and nothing goes between.
    """
    keeping = F.regexp_extract_all(content, F.lit(_KEEPING_ENDS), F.lit(0))
    ended = F.when(F.endswith(content, F.lit("\n")), "\n").otherwise("")
    return F.when(
        _has_rare_ends(content),
        F.struct(keeping.alias("lines"), F.lit("").alias("between"), F.lit("").alias("tail")),
    ).otherwise(
        F.struct(lf_lines(content).alias("lines"), F.lit("\n").alias("between"), ended.alias("tail"))
    )


def chunks_of(lines: Column, between: Column, tail: Column, chunk_lines: int) -> Column:
    """Array of (content, start_line, end_line), ``chunk_lines`` lines each; one empty chunk for no lines."""
    n = F.size(lines)
    nothing = F.array(
        F.struct(F.lit("").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    )
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(chunk_lines))

    def piece(first: Column) -> Column:
        last = F.least(first + (chunk_lines - 1), n)
        # Picked one by one: slice copies the whole array each time.
        picked = F.transform(F.sequence(first, last), lambda i: F.get(lines, i - 1))
        end = F.when(last < n, between).otherwise(tail)
        return F.struct(
            F.concat(F.call_function("array_join", picked, between), end).alias("content"),
            first.alias("start_line"),
            last.alias("end_line"),
        )

    return F.when(n == 0, nothing).otherwise(F.transform(starts, piece))


def snippet_around(content: Column, line: Column, context: Column | int = 2) -> Column:
    """(snippet, start_line, end_line) of the lines within ``context`` of ``line``, clamped to the text."""
    context = context if isinstance(context, Column) else F.lit(context)
    lines = wide_lines(content)
    first = F.greatest(F.lit(1), line - context)
    last = F.least(F.size(lines), line + context)
    text = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.struct(text.alias("snippet"), first.alias("start_line"), last.alias("end_line"))


def format_snippet(snippet: Column, start_line: Column, highlight: Column | None = None) -> Column:
    """Number the lines of a snippet, marking the highlighted one."""
    marked = F.lit(-1) if highlight is None else F.coalesce(highlight, F.lit(-1))

    def numbered(line: Column, i: Column) -> Column:
        mark = F.when(start_line + i == marked, ">").otherwise(" ")
        return F.format_string("%s %4d | %s", mark, start_line + i, line)

    return F.array_join(F.transform(wide_lines(snippet), numbered), "\n")


def line_at(content: Column, line: Column) -> Column:
    """One line by its 1-based number, empty when out of range."""
    return F.when(line >= 1, F.coalesce(F.get(wide_lines(content), line - 1), F.lit(""))).otherwise("")


def head_snippet(content: Column) -> Column:
    """What a text hit shows: the first four lines of its chunk."""
    return F.array_join(F.slice(wide_lines(content), 1, 4), "\n")


def context_window(content: Column, line: Column, context: Column, before: Column | int = 0) -> Column:
    """Numbered lines within ``context`` of ``line``, right-stripped, as an array; ``before`` lines precede the content."""
    before = before if isinstance(before, Column) else F.lit(before)
    lines = lf_lines(content)
    first = F.greatest(F.lit(1), line - context)
    last = F.least(F.size(lines), line + context)
    window = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.transform(
        window, lambda text, i: F.format_string("%4d | %s", before + first + i, strip_end(text))
    )
