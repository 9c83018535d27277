"""Path and file-name column functions."""

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.settings import EXCLUDED_DIRS, EXCLUDED_FILES, LANGUAGES


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """Last dotted ending of the file name, empty for ``.name``, ``name`` and ``name.``"""
    return F.regexp_extract(file_name(path), r"^[^/]+(\.[^./]+)\z", 1)


def detect_language(path: Column, languages: Mapping[str, str] = LANGUAGES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.try_element_at(table, F.lower(suffix(path)))


def in_excluded_dir(path: Column, names: Iterable[str] = EXCLUDED_DIRS) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(n) for n in names]))


def is_excluded_file(path: Column, patterns: Iterable[str] = EXCLUDED_FILES) -> Column:
    name = file_name(path)
    tests = [
        name.endswith(p[1:]) if p.startswith("*.") else F.contains(name, F.lit(p)) for p in patterns
    ]
    return reduce(or_, tests, F.lit(False))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)
