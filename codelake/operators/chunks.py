"""Files to chunks and to lines; everything stays within the row's own task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.lines import chunks_of, joinable_lines, lf_lines, wide_lines
from codelake.settings import CHUNK_LINES


def chunk_files(files: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``chunks`` rows without ``n_tokens``; line ends are kept, so a file's chunks add up to its text.

    ``odd`` marks the chunks of files with line ends other than LF, where chunks don't begin at every n-th LF line.
    """
    owner = ["repo", "path", "language"]
    split = files.select(*owner, joinable_lines(F.col("content")).alias("s"))
    pieces = split.select(
        *owner,
        (F.col("s.between") == "").alias("odd"),
        F.posexplode(chunks_of(*map(F.col, ("s.lines", "s.between", "s.tail")), chunk_lines)),
    )
    return pieces.select(
        *owner, F.col("pos").alias("chunk_id"), "col.content", "col.start_line", "col.end_line", "odd"
    )


def file_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, line), lines ended by LF only."""
    return files.select(
        "repo", "path", F.posexplode(lf_lines(F.col("content"))).alias("pos", "line")
    ).select("repo", "path", (F.col("pos") + 1).alias("line_no"), "line")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(repo, path, line_no, line) straight from chunks, numbered within the file."""
    return chunks.select(
        "repo", "path", "start_line", F.posexplode(wide_lines(F.col("content"))).alias("pos", "line")
    ).select("repo", "path", (F.col("start_line") + F.col("pos")).alias("line_no"), "line")


def file_text(chunks: DataFrame) -> DataFrame:
    """(repo, path, content) put together again from chunks; a file is at most a few MiB."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "content")))
    return chunks.groupBy("repo", "path").agg(
        F.array_join(F.transform(ordered, lambda c: c["content"]), "").alias("content")
    )
