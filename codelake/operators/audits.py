"""Batch jobs over an index: pattern audits, dependency inventories, missing docstrings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators.python_symbols import parse_undocumented

# What the audits look for.
AUDIT_PATTERNS = {
    "secret": r"(?i)(api_key|password|secret)\s*=\s*['\"]",
    "connection": r"(?i)(mongodb|postgres)://",
    "debug": r"console\.log|print\(",
    "todo": r"TODO|FIXME",
}


def audit(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(repo, path, line_no, label, line): every line that matches a pattern, once per pattern.

    The patterns are constants, so each line is tested where it lies; only hits are expanded.
    """
    line = F.col("line")
    labels = F.array_compact(
        F.array(*[F.when(line.rlike(regex), F.lit(label)) for label, regex in patterns.items()])
    )
    return (
        lines.withColumn("labels", labels)
        .filter(F.size("labels") > 0)
        .select("repo", "path", "line_no", F.explode("labels").alias("label"), "line")
    )


def audit_counts(hits: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """(label, hits, exceeded): counts against the highest number allowed."""
    allowed = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    counts = hits.groupBy("label").agg(F.count("*").alias("hits"))
    limit = F.coalesce(F.try_element_at(allowed, F.col("label")), F.lit(0))
    return counts.withColumn("exceeded", F.col("hits") > limit)


def import_inventory(symbols: DataFrame) -> DataFrame:
    """(name, importers): each imported name and how many files import it.

    Counted in two steps, so a name imported by a third of all files is spread by file first.
    """
    imports = symbols.filter(F.col("kind") == "import")
    per_file = imports.groupBy("repo", "path", "name").agg(F.lit(1).alias("one"))
    return per_file.groupBy("name").agg(F.count("*").alias("importers"))


def remaining_imports(symbols: DataFrame, module: str) -> DataFrame:
    """Imports whose name begins at the given module: what a migration still has to change."""
    name = F.col("name")
    return symbols.filter(
        (F.col("kind") == "import") & ((name == module) | F.startswith(name, F.lit(module + ".")))
    )


def undocumented(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files that have no docstring, as the parser sees it."""
    return parse_undocumented(files)
