"""The index on disk: Parquet tables in append-only segments, and one small snapshot file that says which count.

``<dir>/<table>/segment=<id>/bucket=<b>/`` holds what one refresh has added; nothing written is ever changed. A file that
is replaced or deleted is named in ``superseded`` with the segment its rows lie in, and an anti join on files leaves those
rows out. So a refresh writes in proportion to what changed. ``<dir>/snapshots/<n>.json`` lists the live segments and the
corpus totals; it is written under another name and renamed, so readers see the old index or the new one, and a run that
dies leaves nothing that counts. Small segments of similar size are merged now and then, as are segments of which much is
superseded. What no snapshot within a retention time names is removed by `sweep`.

Terms are kept as signed counts: a segment adds its own, and takes away those of the files it supersedes.
"""

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import schemas
from codelake.operators.postings import summed_terms
from codelake.operators.small import local_rows, schema_of
from codelake.operators.symbol_search import gram_rows
from codelake.schemas import FILE_KEY

TABLES = {
    "files": schemas.FILES,
    "chunks": schemas.CHUNKS,
    "symbols": schemas.SYMBOLS,
    "postings": schemas.POSTINGS,
}
# Beside them: what is superseded, signed counts of terms, names by the grams they hold, and deletions a stream brought.
SIDE_TABLES = {
    "superseded": "repo string, path string, at bigint",
    "terms": schemas.TERMS,
    "grams": schemas.GRAMS,
    "deleted": "repo string, path string, mtime bigint",
}
EVERY = {**TABLES, **SIDE_TABLES}
SORTED_BY = {
    "files": ["path"],
    "chunks": ["path", "chunk_id"],
    "symbols": ["kind", "name"],
    "postings": ["term", "level", "path", "chunk_id"],
    "superseded": ["path"],
    "terms": ["term", "level"],
    "grams": ["gram", "name"],
    "deleted": ["path"],
}
BUCKET_BYTES = 2 << 20  # of text, so that a small refresh makes few files
MERGE_FACTOR = 8  # so many segments of one order of size become one
SPENT = 0.5  # share of superseded files from which a segment is written anew
ROW_GROUP = {"parquet.block.size": str(8 << 20)}  # small row groups: a scan for a few terms skips most


def bucket_of(buckets: int | Column) -> Column:
    number = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(F.xxhash64("repo", "path"), number).cast("int")


@dataclass(frozen=True)
class Segment:
    id: int
    buckets: int
    files: int
    superseded: int = 0  # of its files


@dataclass(frozen=True)
class Snapshot:
    n: int
    buckets: int
    segments: tuple[Segment, ...] = ()
    superseding: tuple[int, ...] = ()  # segments that name superseded files
    n_chunks: int = 0
    n_tokens: int = 0
    metadata: dict[str, str] = field(default_factory=dict)
    made_at: int = 0

    @property
    def ids(self) -> list[int]:
        return [s.id for s in self.segments]


class IndexStore:
    def __init__(self, spark: SparkSession, directory: str, buckets: int = 64):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.buckets = buckets

    # -- snapshots

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _listed(self, path: str) -> list:
        store, target = self._path(path)
        return list(store.listStatus(target)) if store.exists(target) else []

    def snapshot_numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed(f"{self.directory}/snapshots")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, n: int | None = None) -> Snapshot:
        """The latest snapshot, or that of a number."""
        numbers = self.snapshot_numbers() if n is None else [n]
        if not numbers:
            return Snapshot(0, self.buckets)
        store, target = self._path(f"{self.directory}/snapshots/{numbers[-1]}.json")
        stream = store.open(target)
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        segments = tuple(Segment(**s) for s in found.pop("segments"))
        return Snapshot(**{**found, "segments": segments, "superseding": tuple(found["superseding"])})

    def publish(self, following: Snapshot) -> Snapshot:
        """Make a snapshot the latest: one small file, renamed into its place. One writer at a time."""
        following = replace(following, made_at=time.time_ns())
        store, target = self._path(f"{self.directory}/snapshots/{following.n}.json")
        _, temporary = self._path(f"{self.directory}/snapshots/.{following.n}-{following.made_at}")
        stream = store.create(temporary, True)
        stream.write(json.dumps(asdict(following)).encode())
        stream.close()
        if not store.rename(temporary, target):
            raise RuntimeError(f"snapshot {following.n} was written by another run")
        return following

    # -- tables

    def segments(self, name: str, ids: list[int]) -> DataFrame:
        """All rows of a table in some segments, superseded ones too, with ``segment`` and ``bucket``."""
        shape = EVERY[name] + ", segment bigint, bucket int"
        paths = [f"{self.directory}/{name}/segment={i}" for i in ids]
        paths = [p for p in paths if self._path(p)[0].exists(self._path(p)[1])]
        if not paths:
            return local_rows(self.spark, [], shape)
        return self.spark.read.schema(shape).option("basePath", f"{self.directory}/{name}").parquet(*paths)

    def superseded(self, snapshot: Snapshot) -> DataFrame:
        """(repo, path, segment) of the files whose rows in a live segment don't count any more."""
        rows = self.segments("superseded", list(snapshot.superseding)).select(*FILE_KEY, F.col("at").alias("segment"))
        return rows.filter(F.col("segment").isin(snapshot.ids))

    def live(self, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Rows with repo, path and segment, without those of superseded files."""
        spent = [s.id for s in snapshot.segments if s.superseded]
        if not spent:
            return rows
        return rows.join(self.superseded(snapshot), [*FILE_KEY, "segment"], "left_anti").select(*rows.columns)

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows of a table as of a snapshot, with the ``segment`` and ``bucket`` they lie in."""
        snapshot = snapshot or self.snapshot()
        rows = self.segments(name, snapshot.ids)
        return self.live(rows, snapshot) if name in TABLES else rows

    def write(self, name: str, rows: DataFrame, segment: Segment) -> None:
        """Add the rows as a segment of a table; big buckets are split into several files."""
        columns = schema_of(EVERY[name]).names
        bucket = bucket_of(segment.buckets) if name in TABLES else F.lit(0)
        placed = rows.select(*columns, F.lit(segment.id).cast("bigint").alias("segment"), bucket.alias("bucket"))
        if name in TABLES:
            placed = placed.hint("rebalance", F.col("bucket"))
        elif name == "terms":  # a prefix is a range of terms
            placed = placed.repartitionByRange("term")
        (
            placed.sortWithinPartitions("segment", "bucket", *SORTED_BY[name])
            .write.mode("append")
            .options(**ROW_GROUP)
            .partitionBy("segment", "bucket")
            .parquet(f"{self.directory}/{name}")
        )

    def write_all(self, tables: dict[str, DataFrame], segment: Segment) -> None:
        """Several tables at once: one's last tasks leave room for the next one's first."""
        with ThreadPoolExecutor(max(len(tables), 1)) as pool:
            list(pool.map(lambda name: self.write(name, tables[name], segment), tables))

    def stage(self, rows: DataFrame, version: int, name: str, *by: str) -> DataFrame:
        """Write an intermediate table below the index and read it back: lineage ends there."""
        path = f"{self.directory}/staging/{version}/{name}"
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop_stage(self, version: int) -> None:
        store, target = self._path(f"{self.directory}/staging/{version}")
        store.delete(target, True)

    def purge(self) -> Snapshot:
        """Forget everything indexed; metadata stays. `sweep` frees the space."""
        previous = self.snapshot()
        return self.publish(Snapshot(previous.n + 1, previous.buckets, metadata=previous.metadata))

    @staticmethod
    def new_version() -> int:
        return time.time_ns()

    # -- merging and sweeping

    def due(self, snapshot: Snapshot, factor: int | None = None) -> list[Segment]:
        """Segments to be merged: `factor` of one order of size, and those that are mostly superseded with all smaller ones."""
        factor = factor or MERGE_FACTOR
        orders: dict[int, list[Segment]] = {}
        for s in snapshot.segments:
            orders.setdefault(int(math.log(max(s.files, 1), factor)), []).append(s)
        crowded = [s for same in orders.values() if len(same) >= factor for s in same]
        spent = max((s.files for s in snapshot.segments if s.superseded > SPENT * s.files), default=-1)
        found = [s for s in snapshot.segments if s in crowded or s.files <= spent]
        return found if len(found) > 1 or any(s.superseded for s in found) else []

    def merge(self, snapshot: Snapshot, due: list[Segment]) -> Snapshot:
        """One segment with the live rows of `due` in their place; totals and counts of terms stay what they are."""
        ids = [s.id for s in due]
        version = self.new_version()
        rest = tuple(s for s in snapshot.segments if s.id not in ids)
        files = sum(s.files - s.superseded for s in due)
        merged = Segment(version, max(s.buckets for s in due), files)
        tables = {name: self.live(self.segments(name, ids), snapshot) for name in TABLES}
        tables["terms"] = summed_terms(self.segments("terms", ids))
        # Names that went with their files stay listed until here.
        tables["grams"] = gram_rows(tables["symbols"])
        tables["deleted"] = self.segments("deleted", ids).groupBy(*FILE_KEY).agg(F.max("mtime").alias("mtime"))
        others = [s.id for s in rest if s.superseded]
        if others:
            gone = self.superseded(snapshot).filter(F.col("segment").isin(others))
            tables["superseded"] = gone.select(*FILE_KEY, F.col("segment").alias("at"))
        self.write_all(tables, merged)
        # Even without files it counts: its signed counts of terms do.
        following = replace(snapshot, n=snapshot.n + 1, segments=(*rest, merged), superseding=(version,) if others else ())
        return self.publish(following)

    def sweep(self, retention_seconds: float = 3600.0) -> int:
        """Remove segments that no snapshot names which is the latest or younger than the retention time.

        Readers that opened an older snapshot must be done by then. Segments a run is still writing are younger than
        that and stay. Returns how many segment folders were removed.
        """
        horizon = time.time_ns() - int(retention_seconds * 1e9)
        numbers = self.snapshot_numbers()
        named, last = set(), self.snapshot()
        for n in numbers:
            found = last if n == last.n else self.snapshot(n)
            if n == last.n or found.made_at >= horizon:
                named |= {*found.ids, *found.superseding}
            else:
                store, target = self._path(f"{self.directory}/snapshots/{n}.json")
                store.delete(target, False)
        removed = 0
        for name in EVERY:
            for status in self._listed(f"{self.directory}/{name}"):
                label = status.getPath().getName()
                if label.startswith("segment=") and int(label[8:]) not in named and int(label[8:]) < horizon:
                    store, target = self._path(str(status.getPath()))
                    removed += store.delete(target, True)
        return removed

    def bytes_on_disk(self, snapshot: Snapshot | None = None) -> dict[str, int]:
        """Bytes of the data files of each table's live segments, as the file system counts them."""
        snapshot = snapshot or self.snapshot()
        out = {}
        for name in EVERY:
            ids = {*snapshot.ids, *(snapshot.superseding if name == "superseded" else ())}
            out[name] = 0
            for i in sorted(ids):
                store, target = self._path(f"{self.directory}/{name}/segment={i}")
                if store.exists(target):
                    out[name] += store.getContentSummary(target).getLength()
        return out
