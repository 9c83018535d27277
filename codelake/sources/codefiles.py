"""Listing and reading a source tree, hidden files included.

Spark's own file sources leave out names that begin with ``_`` or ``.``, and code has many (``__init__.py``). The tree is
opened in rounds: tasks share the directories that are still closed, each opens what lies below its own until it has
seen enough, and hands on what is closed by then, to be shared anew. Sizes and times are asked for in a second step and
contents read in a third (`with_content`), each after the files have been dealt out evenly, so neither one huge subtree
nor one huge directory becomes one task's work.
"""

import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators.small import local_rows, schema_of, settled
from codelake.schemas import RAW_FILES
from codelake.settings import (
    BINARY_PROBE_BYTES,
    EXCLUDED_DIRS,
    EXCLUDED_FILES,
    IGNORE_FILE,
    MAX_FILE_BYTES,
)

LISTING = "path string, size_bytes bigint, mtime bigint"
BATCH_BYTES = 16 << 20  # of file contents in a batch
TASK_BYTES = 128 << 20  # of listed files for a reading task
OPENED = 5_000  # entries a task of the first round sees before it hands on closed directories; each round doubles it
TASK_FILES = 10_000  # whose sizes one task asks for
BATCH_ROWS = 1_000


def _opened(root: str, start: list[str], skip: frozenset[str], enough: int) -> Iterator[tuple[str, bool]]:
    """What lies below some directories, breadth first, as (path, whether it is a directory left closed).

    Links to directories are not followed. Directories that cannot be read and names that are not UTF-8 are left out.
    """
    closed, seen = deque(start), 0
    while closed and seen < enough:
        directory = closed.popleft()
        try:
            with os.scandir(os.path.join(root, directory)) as entries:
                for entry in entries:
                    seen += 1
                    if not entry.name.isascii() and entry.name.encode(errors="replace").decode() != entry.name:
                        continue
                    path = f"{directory}/{entry.name}" if directory else entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in skip:
                            closed.append(path)
                    elif not entry.is_dir():
                        yield path, False
        except OSError:
            continue
    for directory in closed:
        yield directory, True


def _in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _open_round(closed: DataFrame, root: str, skip: frozenset[str], enough: int) -> DataFrame:
    schema = pa.schema([("path", pa.string()), ("closed", pa.bool_())])

    def go(batches):
        # All of a task's directories at once: what it sees is counted over all of them.
        start = [path for batch in batches for path in batch.column("path").to_pylist()]
        yield from _in_batches(_opened(root, start, skip, enough), schema)

    return closed.select("path").mapInArrow(go, "path string, closed boolean")


def _with_stat(files: DataFrame, root: str) -> DataFrame:
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.int64())])

    def asked(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    stat = os.stat(os.path.join(root, path))
                except OSError:
                    continue  # vanished or dangling
                yield path, stat.st_size, int(stat.st_mtime)

    return files.select("path").mapInArrow(lambda batches: _in_batches(asked(batches), schema), LISTING)


def list_files(
    spark: SparkSession, root: str, exclude_dirs: list[str] = (), partitions: int = 64,
    wanted: Column | None = None, opened: int = OPENED,
) -> DataFrame:
    """Every file below ``root``: relative path, size, whole-second mtime.

    ``wanted`` is a condition on the path; other files are never asked for their size. The directories a round leaves
    closed lie in a table in the shared folder, so that the driver holds none of them. A root that is not there gives
    no rows.
    """
    root, skip = os.path.realpath(root), frozenset(exclude_dirs)
    closed, rounds, left = local_rows(spark, [("",)], "path string"), [], 1
    while left:
        shared = closed if left == 1 else closed.repartition(min(left, partitions * 16))
        found = settled(_open_round(shared, root, skip, opened << len(rounds)), "opened", held=0)
        rounds.append(found.filter("NOT closed").select("path"))
        closed = found.filter("closed")
        left = closed.count()
    files = reduce(DataFrame.unionByName, rounds)
    if wanted is not None:
        files = files.filter(wanted)
    return _with_stat(files.repartition(max(partitions, -(-files.count() // TASK_FILES))), root)


def with_content(listing: DataFrame, root: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add the raw bytes of each listed file, or the reason it could not be read.

    A worker holds at most ``batch_bytes`` and one more file at a time.
    """
    schema = pa.schema(
        [
            ("path", pa.string()),
            ("size_bytes", pa.int64()),
            ("mtime", pa.int64()),
            ("content", pa.binary()),
            ("error", pa.string()),
        ]
    )

    def read(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "size_bytes", "mtime")))
            held, weight = [], 0
            for path, size, mtime in rows:
                content, error = None, None
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = type(e).__name__
                held.append((path, size, mtime, content, error))
                weight += len(content or b"")
                if weight >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held, weight = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return listing.select("path", "size_bytes", "mtime").mapInArrow(
        read, LISTING + ", content binary, error string"
    )


def ignored_names(text: str) -> list[str]:
    """Names in an ignore file: stripped lines that are neither blank nor comments."""
    lines = (line.strip() for line in text.splitlines())
    return sorted({line for line in lines if line and not line.startswith("#")})


def read_repo(
    spark: SparkSession,
    root: str,
    repo: str,
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS,
    exclude_files: tuple[str, ...] = EXCLUDED_FILES,
    max_bytes: int = MAX_FILE_BYTES,
    partitions: int = 64,
) -> DataFrame:
    """The text files of a source tree as ``raw_files`` rows; names and sizes are tested before reading."""
    from codelake.sources.selection import is_binary, wanted_names

    if not os.path.exists(root):
        raise FileNotFoundError(f"no such repository: {root}")
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    root = os.path.realpath(root)
    names = list(exclude_dirs)
    ignore_file = os.path.join(root, IGNORE_FILE)
    if os.path.exists(ignore_file):
        with open(ignore_file, encoding="utf-8", errors="ignore") as f:
            names += ignored_names(f.read())
    listing = list_files(spark, root, names, partitions, wanted_names(F.col("path"), names, exclude_files))
    wanted = listing.filter(F.col("size_bytes") <= max_bytes)
    # Deal files out evenly before the reading: subtrees differ in size. The listing is settled first,
    # so that it is not made twice and its bytes tell how many tasks should share the reading.
    wanted = settled(wanted, "listing")
    listed = wanted.agg(F.sum("size_bytes")).first()[0] or 0
    spread = wanted.repartition(max(partitions, -(-listed // TASK_BYTES)))
    raw = with_content(spread, root).withColumn("repo", F.lit(repo))
    # A file that vanished or cannot be read counts as binary, like one with a NUL near its start.
    text = raw.filter(F.col("error").isNull() & ~is_binary(F.col("content"), BINARY_PROBE_BYTES))
    return text.to(schema_of(RAW_FILES))
