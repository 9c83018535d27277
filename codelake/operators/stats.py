"""Index statistics and line counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.lines import lf_lines
from codelake.functions.paths import suffix
from codelake.settings import CODE_SUFFIXES


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, count), most frequent first."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(key))


def _count_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    # One entry per language or kind: a few dozen at most.
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull())
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"total_{name}"),
        F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(f"{name}_by_{key}"),
    )


def metadata_map(metadata: DataFrame) -> DataFrame:
    return metadata.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def index_stats(files: DataFrame, symbols: DataFrame, metadata: DataFrame, size: DataFrame) -> DataFrame:
    """One row: totals, counts per language and kind, size on disk, metadata."""
    by_language = _count_map(files, "language", "files")
    by_kind = _count_map(symbols, "kind", "symbols")
    info = metadata_map(metadata)
    return size.select(
        "size_bytes",
        F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb"),
        *[by_language.select(c).scalar().alias(c) for c in by_language.columns],
        *[by_kind.select(c).scalar().alias(c) for c in by_kind.columns],
        info.scalar().alias("metadata"),
    )


def size_on_disk(*tables: DataFrame) -> DataFrame:
    """One row: bytes of the Parquet files behind the given scans, each file counted once."""
    parts = [
        t.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
        for t in tables
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size_bytes"))


def is_code(path: Column) -> Column:
    return suffix(path).isin(*CODE_SUFFIXES)


def lines_of_code(files: DataFrame) -> DataFrame:
    """(repo, loc, size_mb) over files with a code suffix."""
    code = files.filter(is_code(F.col("path")))
    return code.groupBy("repo").agg(
        F.sum(F.size(lf_lines(F.col("content")))).alias("loc"),
        (F.sum("size_bytes") / 1048576).alias("size_mb"),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def averages(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])
