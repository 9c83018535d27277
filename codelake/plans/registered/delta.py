"""Comparing snapshots, and the index on disk kept up to date."""

import uuid

from pyspark.sql import functions as F

from codelake.operators import delta as D
from codelake.operators.chunks import chunk_files
from codelake.operators.postings import build_postings
from codelake.plans import corpora as C
from codelake.plans.index import open_index, purge, refresh, stats
from codelake.plans.registered.registry import DOCS, GENERATED, SYMBOLS, chunk_views, query
from codelake.plans.registered.searches import INDEXED, RESULTS, ROW
from codelake.session import shared_folder
from codelake.sources.reports import read_benchmarks, write_benchmarks
from codelake.sources.store import IndexStore
from codelake.streaming.refresh import VERSIONS, refresh_stream

SNAPS = f"""{DOCS},
old AS (SELECT * FROM docs WHERE doc_id % 7 <> 0),
new AS (SELECT repo, path, language, mtime, size_bytes, doc_id,
          CASE WHEN doc_id % 5 = 0 THEN content || ' x' ELSE content END AS content,
          sha256(CASE WHEN doc_id % 5 = 0 THEN content || ' x' ELSE content END) AS content_hash
        FROM docs WHERE doc_id % 11 <> 0),
status AS (
  SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
    WHEN n.content_hash = o.content_hash THEN 'unchanged' ELSE 'updated' END AS status
  FROM new n FULL OUTER JOIN old o USING (path))"""
WITH = f"WITH {SNAPS} "


def _delta(spark, sf, force=False):
    return D.plan_delta(C.new_snapshot(spark, sf), C.old_snapshot(spark, sf), force)


@query("jon_03_scan_with_index", WITH + "SELECT path, status FROM status")
def scan_with_index(spark, sf):
    return _delta(spark, sf).select("path", "status")


@query("dlt_01_status_counts", WITH + "SELECT status, count(*) AS n FROM status GROUP BY 1")
def status_counts(spark, sf):
    return _delta(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("jon_04_deleted", WITH + "SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def deleted(spark, sf):
    return D.deleted_paths(C.new_snapshot(spark, sf), C.old_snapshot(spark, sf)).select("path")


@query("set_03_paths_except", WITH + "SELECT path FROM old EXCEPT SELECT path FROM new")
def paths_except(spark, sf):
    return D.deleted_paths(C.new_snapshot(spark, sf), C.old_snapshot(spark, sf)).select("path")


CHANGED = f"""WITH {SNAPS}, fresh AS (SELECT new.* FROM new JOIN status USING (path) WHERE status IN ('new', 'updated')),
{chunk_views("fresh")} """


@query("dlt_02_changed_chunks", CHANGED + "SELECT path, chunk_id, content, start_line, end_line FROM chunks")
def changed_chunks(spark, sf):
    found = chunk_files(D.changed_files(_delta(spark, sf)), C.CHUNK_LINES)
    return found.select("path", "chunk_id", "content", "start_line", "end_line")


KEPT = f"""WITH {SNAPS}, kept AS (SELECT old.* FROM old JOIN status USING (path) WHERE status = 'unchanged'),
{chunk_views("kept")} """


@query("dlt_03_kept_postings", KEPT + "SELECT term, path, chunk_id, tf FROM post")
def kept_postings(spark, sf):
    old = build_postings(chunk_files(C.old_snapshot(spark, sf), C.CHUNK_LINES), stem=False)
    return D.keep_untouched(old, _delta(spark, sf)).select("term", "path", "chunk_id", "tf")


NEXT = f"WITH {SNAPS}, {chunk_views('new')} "


@query("dlt_04_next_chunks", NEXT + "SELECT path, chunk_id, content FROM chunks")
def next_chunks(spark, sf):
    delta = _delta(spark, sf)
    old = chunk_files(C.old_snapshot(spark, sf), C.CHUNK_LINES)
    fresh = chunk_files(D.changed_files(delta), C.CHUNK_LINES)
    return D.next_table(old, delta, fresh).select("path", "chunk_id", "content")


@query("dlt_05_force", WITH + "SELECT path, 'new' AS status, content_hash FROM new")
def force(spark, sf):
    return _delta(spark, sf, force=True).select("path", "status", "content_hash")


@query(
    "agg_06_run_counters",
    WITH
    + """SELECT count(*) FILTER (status <> 'deleted') AS files_scanned, count(*) FILTER (status = 'new') AS files_new,
      count(*) FILTER (status = 'updated') AS files_updated, count(*) FILTER (status = 'unchanged') AS files_unchanged,
      count(*) FILTER (status = 'deleted') AS files_deleted, 0 AS files_skipped, 0 AS files_failed,
      count(*) FILTER (status IN ('new', 'updated')) AS files_indexed FROM status""",
)
def run_counters(spark, sf):
    return D.run_counters(_delta(spark, sf))


@query(
    "dlt_07_failures_counted",
    """SELECT count(*) FILTER (p_partkey % 4 = 0) AS failed, count(*) FILTER (p_partkey % 4 > 1) AS parsed FROM part""",
)
def failures(spark, sf):
    """Deep nesting breaks the parser (failed), bad syntax just gives nothing; the rest goes on."""
    from codelake.operators.python_symbols import parse_python

    k = F.col("p_partkey")
    deep = F.concat(F.lit("x = "), F.repeat(F.lit("-"), 100_000), F.lit("1\n"))
    content = F.when(k % 4 == 0, deep).when(k % 4 == 1, "def broken(\n").otherwise("def ok(): pass\n")
    files = C.table(spark, sf, "part").select(
        F.lit("fail").alias("repo"), F.concat(k, F.lit(".py")).alias("path"),
        F.lit("python").alias("language"), content.alias("content"),
    )
    return parse_python(files).agg(
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("error").isNull()).alias("parsed"),
    )


def _raw(files):
    return files.select(
        "repo", "path", "size_bytes", F.lit(1).cast("bigint").alias("mtime"),
        F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"),
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark, sf) -> str:
    """An index of both snapshots of the documents in turn, and of the generated code; made once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        directory = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        options = {"buckets": 8, "chunk_lines": C.CHUNK_LINES, "stem": False}
        refresh(spark, _raw(C.old_snapshot(spark, sf)), directory, "docs", **options)
        refresh(spark, _raw(C.new_snapshot(spark, sf)), directory, "docs", **options)
        refresh(spark, _raw(C.generated_files(spark, sf)), directory, "gen", **options)
        _STORED[key] = directory
    return _STORED[key]


LATEST = f"""WITH {SNAPS}, {GENERATED}, everything AS (
  SELECT repo, path, 'markdown' AS language, content FROM new UNION ALL SELECT repo, path, language, content FROM gen) """


def stored_results() -> str:
    """The batch search's SQL over what is stored: the last snapshot of the documents and the code."""
    return RESULTS.replace(INDEXED, LATEST.replace("everything AS", "files AS").rstrip())


@query("src_08_read_index", LATEST + "SELECT repo, count(*) AS n FROM everything GROUP BY repo")
def read_index(spark, sf):
    files = open_index(spark, stored_index(spark, sf)).files
    return files.groupBy("repo").agg(F.count("*").alias("n"))


@query("snk_01_files", LATEST + "SELECT repo, path, language, sha256(content) AS content_hash FROM everything")
def stored_files(spark, sf):
    return open_index(spark, stored_index(spark, sf)).files.select("repo", "path", "language", "content_hash")


@query(
    "snk_02_chunks",
    LATEST + f", {chunk_views('everything')} SELECT repo, path, chunk_id, content, start_line, end_line FROM chunks",
)
def stored_chunks(spark, sf):
    chunks = open_index(spark, stored_index(spark, sf)).chunks
    return chunks.select("repo", "path", "chunk_id", "content", "start_line", "end_line")


@query("snk_03_symbols", f"WITH {SYMBOLS} SELECT path, name, kind, start_line, end_line, signature FROM syms")
def stored_symbols(spark, sf):
    symbols = open_index(spark, stored_index(spark, sf)).symbols
    return symbols.select("path", "name", "kind", "start_line", "end_line", "signature")


@query(
    "snk_04_metadata",
    "SELECT * FROM (VALUES ('schema_version', '1.0'), ('created_at', 'a time'), ('stem', 'false'), ('chunk_lines', '10')) t(key, value)",
)
def stored_metadata(spark, sf):
    found = stats(spark, stored_index(spark, sf)).select(F.explode("metadata").alias("key", "value"))
    passed = (F.col("key") == "created_at") & (F.col("value").cast("bigint") > 1_700_000_000)
    return found.withColumn("value", F.when(passed, "a time").otherwise(F.col("value")))


@query("agg_04_size_on_disk")
def size(spark, sf):
    """Bytes of each table's files; SQL knows nothing of them, so pytest compares them with the files' lengths."""
    from codelake.operators.small import local_rows

    sizes = IndexStore(spark, stored_index(spark, sf)).bytes_on_disk()
    total = stats(spark, stored_index(spark, sf)).select(F.lit("all").alias("name"), "size_bytes")
    return local_rows(spark, list(sizes.items()), "name string, size_bytes bigint").unionByName(total)


@query(
    "agg_06_counters_of_a_run",
    """SELECT count(*) AS files_scanned, count(*) FILTER (p_partkey % 5 <> 0) AS files_indexed,
      count(*) FILTER (p_partkey % 5 = 0) AS files_skipped, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 4 = 0) AS files_failed,
      count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 4 > 1) AS symbols_extracted,
      count(*) FILTER (p_partkey % 5 <> 0) AS chunks_created FROM part""",
)
def counters_of_a_run(spark, sf):
    """A scan with files of no known language and files that break the parser, counted while it is written."""
    from codelake.operators.small import local_rows

    k = F.col("p_partkey")
    deep = F.concat(F.lit("x = "), F.repeat(F.lit("-"), 100_000), F.lit("1\n"))
    content = F.when(k % 4 == 0, deep).when(k % 4 == 1, "def broken(\n").otherwise("def ok(): pass\n")
    files = C.table(spark, sf, "part").select(
        F.lit("run").alias("repo"), F.concat(k, F.when(k % 5 == 0, ".unknown").otherwise(".py")).alias("path"),
        content.alias("content"), F.octet_length(content).cast("bigint").alias("size_bytes"),
    )
    counters = refresh(spark, _raw(files), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "run", buckets=4)
    shown = ("files_scanned", "files_indexed", "files_skipped", "files_failed", "symbols_extracted", "chunks_created")
    return local_rows(spark, [tuple(counters[c] for c in shown)], ", ".join(f"{c} bigint" for c in shown))


@query("fts_04_kept_counts", LATEST + f", {chunk_views('everything')} SELECT term, count(*) AS n FROM post GROUP BY term")
def kept_counts(spark, sf):
    """Counts of terms after two snapshots of the documents, from signed counts alone."""
    counts = open_index(spark, stored_index(spark, sf)).terms.groupBy("term").agg(F.sum("n").alias("n"))
    return counts.filter("n <> 0")


@query("qry_07_stored_search", stored_results() + f"SELECT {ROW} FROM results")
def stored_search(spark, sf):
    from codelake.plans.search import search

    return search(open_index(spark, stored_index(spark, sf)), C.requests(spark))


@query("dlt_06_purge", f"WITH {SNAPS} SELECT count(*) AS before, 0 AS after FROM old")
def purged(spark, sf):
    directory = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    refresh(spark, _raw(C.old_snapshot(spark, sf)), directory, "docs", buckets=4)
    before = open_index(spark, directory).files.agg(F.count("*").alias("before"))
    purge(spark, directory)
    after = open_index(spark, directory).files.agg(F.count("*").alias("after"))
    return before.select("before", after.scalar().cast("bigint").alias("after"))


ARRIVING = 64 << 20  # bytes of content in a file of an arrival


def arrive(rows, folder: str) -> None:
    """Append file versions to a folder that is read as a stream.

    Four files at least, more as the contents grow: the shuffle's partitions must not decide how many triggers, each of
    which refreshes the index, the rows are spread over.
    """
    weight = rows.agg(F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0))).first()[0]
    rows.repartition(max(4, -(-weight // ARRIVING))).write.mode("append").parquet(folder)


@query("str_01_stream", f"WITH {SNAPS} SELECT path, content_hash FROM new")
def streamed(spark, sf):
    """Old versions, new versions and deletions arrive as a stream, newest file last or not."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    doc = F.regexp_extract("path", r"_(\d+)\.md", 1).cast("bigint")

    def version(files, mtime, deleted):
        raw = _raw(files).drop("error")
        return raw.withColumn("mtime", F.lit(mtime).cast("bigint")).withColumn("deleted", F.lit(deleted))

    old, new = C.old_snapshot(spark, sf), C.new_snapshot(spark, sf)
    late = C.document_files(spark, sf).filter(doc % 11 == 0)  # older than the deletion that came before
    gone = C.document_files(spark, sf).filter(doc % 11 == 0)
    for rows in (
        version(old.filter(doc % 2 == 0), 1, False),
        version(new, 2, False).unionByName(version(gone, 3, True)),
        version(old.filter(doc % 2 == 1).filter(doc % 11 != 0), 1, False).unionByName(version(late, 2, False)),
    ):
        arrive(rows, f"{folder}/in")
    stream = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    refresh_stream(stream, f"{folder}/index", f"{folder}/state", buckets=4).awaitTermination()
    return open_index(spark, f"{folder}/index").files.select("path", "content_hash")


@query("src_09_saved_benchmarks", "SELECT event_type AS repo_name, count(*) AS repo_size_loc FROM events GROUP BY 1")
def saved_benchmarks(spark, sf):
    from codelake.plans.registered.statistics import benchmark_rows

    path = f"{shared_folder(spark)}/benchmarks-{uuid.uuid4().hex}"
    write_benchmarks(benchmark_rows(spark, sf), path)
    return read_benchmarks(spark, path, by_line=True).select("repo_name", "repo_size_loc")
