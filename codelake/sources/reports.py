"""Benchmark results as JSON and as a Markdown table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators.small import local_rows
from codelake.schemas import BENCHMARKS

# The table's heading.
HEADING = (
    "## Benchmark Results\n",
    "| Repository | LOC | Files | Symbols | Index Time | Index Size | p50 Latency | p95 Latency |",
    "|-----------|-----|-------|---------|------------|------------|-------------|-------------|",
)
NUMBERS = (
    "repo_size_loc", "file_count", "symbol_count", "index_time_seconds", "index_size_mb",
    "query_p50_ms", "query_p95_ms",
)
_DIGITS = (0, 0, 0, 2, 2, 2, 2)
_UNITS = ("", "", "", "s", " MB", " ms", " ms")


def write_benchmarks(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_benchmarks(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Saved results: one array per file or, ``by_line``, one object per line as written here."""
    return spark.read.schema(BENCHMARKS).json(path, multiLine=not by_line)


def _line(name: Column, mark: str = "") -> Column:
    def number(column: str, digits: int, unit: str) -> Column:
        # Grouping of thousands is for counts only.
        shown = F.format_number(column, 0) if digits == 0 else F.format_string("%.2f", F.col(column))
        return F.concat(F.lit(mark), shown, F.lit(unit + mark))

    cells = [number(*cell) for cell in zip(NUMBERS, _DIGITS, _UNITS)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.lit(mark), name, F.lit(mark)), *cells), F.lit(" |"))


def markdown_table(rows: DataFrame) -> DataFrame:
    """(part, place, line): heading, one line per result, and averages if there are several."""
    spark = rows.sparkSession
    lines = [("heading", str(i), line) for i, line in enumerate(HEADING)]
    heading = local_rows(spark, lines, "part string, place string, line string")
    body = rows.select(F.lit("row").alias("part"), F.col("repo_name").alias("place"), _line(F.col("repo_name")).alias("line"))
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in NUMBERS]).filter("n > 1")
    total = means.select(
        F.lit("average").alias("part"), F.lit("").alias("place"), _line(F.lit("AVERAGE"), "**").alias("line")
    )
    return heading.unionByName(body).unionByName(total)
