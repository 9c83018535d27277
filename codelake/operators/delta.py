"""Comparing a scan with the last index, and carrying the difference over."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.schemas import FILE_KEY

CHANGED = ("new", "updated")
COUNTERS = tuple(f"files_{c}" for c in ("scanned", "new", "updated", "unchanged", "deleted", "skipped", "failed", "indexed"))


def plan_delta(scan: DataFrame, old_files: DataFrame, force: bool = False) -> DataFrame:
    """One row per file seen in either, with ``status`` new, updated, unchanged or deleted.

    Both sides carry (repo, path, content_hash, ...) and only the scanned columns are kept. With
    ``force`` everything scanned is new and nothing counts as deleted.
    """
    if force:
        return scan.withColumn("status", F.lit("new"))
    old = old_files.select(*FILE_KEY, F.col("content_hash").alias("old_hash"))
    joined = scan.join(old, FILE_KEY, "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("content_hash").isNull(), "deleted")
        .when(F.col("content_hash") == F.col("old_hash"), "unchanged")
        .otherwise("updated")
    )
    return joined.withColumn("status", status).drop("old_hash")


def changed_files(delta: DataFrame) -> DataFrame:
    """What has to be chunked and parsed."""
    return delta.filter(F.col("status").isin(*CHANGED)).drop("status")


def deleted_paths(scan: DataFrame, old_files: DataFrame) -> DataFrame:
    return old_files.select(*FILE_KEY).join(scan.select(*FILE_KEY), FILE_KEY, "left_anti")


def keep_untouched(table: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of an index table whose file was neither rewritten nor deleted."""
    gone = delta.filter(F.col("status") != "unchanged").select(*FILE_KEY)
    return table.join(gone, FILE_KEY, "left_anti")


def next_table(table: DataFrame, delta: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after the change: what was untouched, and the fresh rows."""
    return keep_untouched(table, delta).unionByName(fresh)


def counter_columns() -> list[Column]:
    """The counters of a run, over one row per file seen with its status."""

    def count(*values: str) -> Column:
        return F.count_if(F.col("status").isin(*values))

    return [
        F.count_if(F.col("status") != "deleted").alias("files_scanned"),
        count("new").alias("files_new"),
        count("updated").alias("files_updated"),
        count("unchanged").alias("files_unchanged"),
        count("deleted").alias("files_deleted"),
        count("skipped").alias("files_skipped"),
        count("failed").alias("files_failed"),
        count(*CHANGED).alias("files_indexed"),
    ]


def run_counters(statuses: DataFrame) -> DataFrame:
    """One row of counters over (status) rows, one per file seen."""
    return statuses.agg(*counter_columns())


def latest_versions(versions: DataFrame) -> DataFrame:
    """Of several versions of a path, the one with the latest mtime; aggregated before the shuffle.

    Where two share it, one that is ``gone`` counts more than one that is not, then the greater hash: an order of all
    versions, so it does not matter how they arrive.
    """
    payload = [c for c in versions.columns if c not in FILE_KEY]
    order = F.struct("mtime", *[c for c in ("gone", "content_hash") if c in payload])
    best = versions.groupBy(*FILE_KEY).agg(F.max_by(F.struct(*payload), order).alias("v"))
    return best.select(*FILE_KEY, "v.*")
