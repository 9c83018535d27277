"""One symbol table for all languages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators.js_symbols import parse_javascript
from codelake.operators.python_symbols import parse_python

COLUMNS = ["repo", "path", "language", "name", "kind", "start_line", "end_line", "signature"]


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of every parsed language, with an ``error`` column for files that broke a parser."""
    return parse_python(files).unionByName(parse_javascript(files), allowMissingColumns=True)


def extract_symbols(files: DataFrame) -> DataFrame:
    """``symbols`` rows of files (repo, path, language, content)."""
    return parse_symbols(files).filter(F.col("error").isNull()).select(*COLUMNS)
