"""Building, refreshing and opening an index."""

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codelake.operators.chunks import chunk_files
from codelake.operators.delta import CHANGED, COUNTERS, changed_files, counter_columns, plan_delta
from codelake.operators.enrich import enrich_files
from codelake.operators.postings import (
    build_postings, corpus_stats, summed_terms, taken_away, term_counts, with_levels, with_lengths,
)
from codelake.operators.small import local_rows, measured
from codelake.operators.stats import index_stats
from codelake.operators.symbol_search import gram_rows
from codelake.operators.symbols import extract_symbols, parse_symbols
from codelake.schemas import FILE_KEY, METADATA
from codelake.settings import CHUNK_LINES, SCHEMA_VERSION
from codelake.sources.codefiles import read_repo
from codelake.sources.store import BUCKET_BYTES, TABLES, IndexStore, Segment, Snapshot


@dataclass(frozen=True)
class Index:
    """The tables a search reads. A stored index adds those it keeps for searching, and where its rows lie."""

    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    postings: DataFrame
    stem: bool = True
    chunk_lines: int = CHUNK_LINES
    terms: DataFrame | None = None
    grams: DataFrame | None = None
    snapshot: Snapshot | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def stats(self) -> DataFrame:
        """Chunks, tokens and their ratio: kept with the snapshot, or counted."""
        if self.snapshot is None:
            return corpus_stats(self.chunks)
        n, tokens = self.snapshot.n_chunks, self.snapshot.n_tokens
        shape = "n_chunks bigint, n_tokens bigint, avgdl double"
        return local_rows(self.files.sparkSession, [(n, tokens, tokens / n if n else None)], shape)

    @property
    def vocabulary(self) -> DataFrame:
        """(term), with repeats; in order if the index is stored."""
        return (self.postings if self.terms is None else self.terms).select("term")

    def placed(self, rows: DataFrame, path: str = "path") -> tuple[DataFrame, list[str]]:
        """Rows with each segment and bucket their file may lie in: joins on these skip all others."""
        if self.snapshot is None or not self.snapshot.segments:
            return rows, []
        segments = F.array(*[F.struct(F.lit(s.id).alias("segment"), F.lit(s.buckets).alias("buckets")) for s in self.snapshot.segments])
        spread = rows.withColumn("_segment", F.explode(segments))
        bucket = F.pmod(F.xxhash64("repo", path), F.col("_segment.buckets")).cast("int")
        return spread.withColumns({"segment": F.col("_segment.segment"), "bucket": bucket}).drop("_segment"), ["segment", "bucket"]


def index_from_files(files: DataFrame, chunk_lines: int = CHUNK_LINES, stem: bool = True) -> Index:
    """An index over files (repo, path, language, ..., content) that lives only in query plans."""
    chunks = chunk_files(files, chunk_lines)
    return Index(files, chunks, extract_symbols(files), build_postings(chunks, stem), stem, chunk_lines)


def open_index(spark: SparkSession, directory: str) -> Index:
    store = IndexStore(spark, directory)
    snapshot = store.snapshot()
    tables = {name: store.table(name, snapshot) for name in (*TABLES, "terms", "grams")}
    stem = snapshot.metadata.get("stem", "true") == "true"
    lines = int(snapshot.metadata.get("chunk_lines", CHUNK_LINES))
    return Index(**tables, stem=stem, chunk_lines=lines, snapshot=snapshot, metadata=snapshot.metadata)


def build_index(
    spark: SparkSession,
    root: str,
    directory: str,
    repo: str,
    force: bool = False,
    buckets: int = 64,
    partitions: int = 64,
    chunk_lines: int = CHUNK_LINES,
) -> dict:
    """Index a source tree, or bring its index up to date; returns the run's counters."""
    started = time.time()
    raw = read_repo(spark, root, repo, partitions=partitions)
    counters = refresh(spark, raw, directory, repo, force, buckets, chunk_lines)
    counters["duration_seconds"] = round(time.time() - started, 2)
    return counters


def refresh(
    spark: SparkSession,
    raw: DataFrame,
    directory: str,
    repo: str,
    force: bool = False,
    buckets: int = 64,
    chunk_lines: int = CHUNK_LINES,
    stem: bool = True,
) -> dict:
    """Bring the index of one repository in line with ``raw_files`` rows, all of it scanned."""
    store = IndexStore(spark, directory, buckets)
    snapshot = store.snapshot()
    scan = enrich_files(raw)
    old = store.table("files", snapshot).filter(F.col("repo") == repo)
    delta = plan_delta(scan.filter(F.col("language").isNotNull()), old, force)
    skipped = scan.filter(F.col("language").isNull()).withColumn("status", F.lit("skipped"))
    # An unchanged file needs no text any more; a skipped one is only counted.
    content = F.when(F.col("status").isin("new", "updated"), F.col("content"))
    return apply_delta(
        store, delta.unionByName(skipped).withColumn("content", content), chunk_lines, stem
    )


def apply_delta(
    store: IndexStore, delta: DataFrame, chunk_lines: int = CHUNK_LINES, stem: bool = True
) -> dict:
    """Carry a delta (file columns, content, status) into the store; returns the counters.

    Whether terms are stemmed and how long chunks are is decided when the index is made; later runs keep to it. The
    delta is written once and read back, so reading, hashing and decoding are not repeated for each table. What is written
    is a new segment with the changed files' rows, the keys of those that no longer count, and the difference they make
    to the counts of terms. All counters come from the writing jobs.
    """
    snapshot = store.snapshot()
    stem = snapshot.metadata.get("stem", str(stem).lower()) == "true"
    chunk_lines = int(snapshot.metadata.get("chunk_lines", chunk_lines))
    version = store.new_version()
    seen = Observation()
    bytes_ = F.sum(F.when(F.col("status").isin(*CHANGED), F.octet_length("content").cast("bigint")))
    buried = F.count_if("buried") if "buried" in delta.columns else F.count_if(F.lit(False))
    watched = delta.observe(seen, *counter_columns(), F.coalesce(bytes_, F.lit(0)).alias("bytes"), buried.alias("buried"))
    staged = store.stage(watched, version, "delta", "status")
    counters = measured(seen, *COUNTERS, "bytes", "buried")
    weight, buried = counters.pop("bytes"), counters.pop("buried")
    counters |= {"symbols_extracted": 0, "chunks_created": 0}
    metadata = {
        "schema_version": SCHEMA_VERSION, "stem": str(stem).lower(), "chunk_lines": str(chunk_lines),
        "created_at": snapshot.metadata.get("created_at", str(int(time.time()))),
    }
    if counters["files_indexed"] + counters["files_deleted"] + buried:
        buckets = max(1, min(snapshot.buckets, -(-weight // BUCKET_BYTES)))
        segment = Segment(version, buckets, counters["files_indexed"])
        following, made = add_segment(store, snapshot, segment, staged, chunk_lines, stem)
        snapshot = store.publish(replace(following, metadata={**snapshot.metadata, **metadata}))
        counters["files_failed"] += made["failed"]
        counters["symbols_extracted"], counters["chunks_created"] = made["symbols"], made["chunks"]
        if due := store.due(snapshot):
            store.merge(snapshot, due)
    elif snapshot.n == 0:
        store.publish(replace(snapshot, n=1, metadata=metadata))
    store.drop_stage(version)
    return counters


def add_segment(
    store: IndexStore, snapshot: Snapshot, segment: Segment, staged: DataFrame, chunk_lines: int, stem: bool
) -> tuple[Snapshot, dict[str, int]]:
    """Write a staged delta as a segment; returns the snapshot that counts it, and what was made."""
    fresh = changed_files(staged)
    chunks = with_lengths(chunk_files(fresh, chunk_lines))
    of_chunks, of_symbols, of_gone, of_lost = (Observation() for _ in range(4))
    n_tokens = F.coalesce(F.sum(F.col("n_tokens").cast("bigint")), F.lit(0)).alias("tokens")
    error = F.col("error")
    parsed = parse_symbols(fresh).observe(
        of_symbols, F.count_if(error.isNull()).alias("symbols"), F.count_if(error.isNotNull()).alias("failed")
    )
    tables = {
        "postings": with_levels(build_postings(chunks, stem)),
        "chunks": chunks.observe(of_chunks, F.count("*").alias("chunks"), n_tokens),
        "symbols": parsed.filter(error.isNull()),
        "files": fresh,
    }
    if "buried" in staged.columns:
        tables["deleted"] = staged.filter("buried").select(*FILE_KEY, "mtime")
    lost = {}
    if snapshot.segments:
        moved = staged.filter(~F.col("status").isin("unchanged", "skipped")).select(*FILE_KEY)
        gone = store.table("files", snapshot).select(*FILE_KEY, F.col("segment").alias("at")).join(moved, FILE_KEY, "left_semi")
        each = [F.count_if(F.col("at") == s.id).alias(str(s.id)) for s in snapshot.segments]
        tables["superseded"] = gone.observe(of_gone, *each)
    store.write_all(tables, segment)
    added = [term_counts(store.segments("postings", [segment.id]))]
    side = {"grams": gram_rows(store.segments("symbols", [segment.id]))}
    if snapshot.segments:
        found = measured(of_gone, *map(str, snapshot.ids))
        lost = {i: found[str(i)] for i in snapshot.ids}
    if any(lost.values()):
        where = [i for i, n in lost.items() if n]
        keys = store.segments("superseded", [segment.id]).select(*FILE_KEY, F.col("at").alias("segment"))
        by_file = [*FILE_KEY, "segment"]
        spent = store.segments("postings", where).join(keys, by_file, "left_semi")
        added.append(taken_away(term_counts(spent)))
        old = store.segments("chunks", where).join(keys, by_file, "left_semi").select("n_tokens")
        side["_lost"] = old.observe(of_lost, F.count("*").alias("chunks"), n_tokens)
    terms = added[0] if len(added) == 1 else summed_terms(added[0].unionByName(added[1]))
    counted = side.pop("_lost", None)
    jobs = [lambda: store.write_all({**side, "terms": terms}, segment)]
    if counted is not None:
        jobs.append(lambda: counted.write.format("noop").mode("overwrite").save())
    with ThreadPoolExecutor(len(jobs)) as pool:
        list(pool.map(lambda job: job(), jobs))
    minus = measured(of_lost, "chunks", "tokens") if counted is not None else {"chunks": 0, "tokens": 0}
    plus = measured(of_chunks, "chunks", "tokens")
    older = tuple(replace(s, superseded=s.superseded + lost.get(s.id, 0)) for s in snapshot.segments)
    following = replace(
        snapshot, n=snapshot.n + 1, segments=(*older, segment),
        superseding=(*snapshot.superseding, segment.id) if any(lost.values()) else snapshot.superseding,
        n_chunks=snapshot.n_chunks + plus["chunks"] - minus["chunks"], n_tokens=snapshot.n_tokens + plus["tokens"] - minus["tokens"],
    )
    return following, {**measured(of_symbols, "symbols", "failed"), "chunks": plus["chunks"]}


def stats(spark: SparkSession, directory: str) -> DataFrame:
    """One row of index statistics."""
    index = open_index(spark, directory)
    metadata = local_rows(spark, list(index.metadata.items()), METADATA)
    sizes = IndexStore(spark, directory).bytes_on_disk(index.snapshot)
    size = local_rows(spark, [(sum(sizes.values()),)], "size_bytes bigint")
    return index_stats(index.files, index.symbols, metadata, size)


def purge(spark: SparkSession, directory: str) -> None:
    """Forget everything indexed; metadata stays, and `sweep` frees the space."""
    IndexStore(spark, directory).purge()


def sweep(spark: SparkSession, directory: str, retention_seconds: float = 3600.0) -> int:
    """Remove what no snapshot names that is the latest or younger than the retention time."""
    return IndexStore(spark, directory).sweep(retention_seconds)
