"""Index statistics, percentiles, averages and benchmark reports."""

from pyspark.sql import functions as F

from codelake.operators.percentiles import percentiles
from codelake.operators.stats import averages, count_by, index_stats, is_code, lines_of_code, metadata_map, ratio
from codelake.operators.symbols import extract_symbols
from codelake.plans import corpora as C
from codelake.plans.registered.registry import DOCS, GENERATED, NAMED, PATHS, SYMBOLS, query
from codelake.sources.reports import HEADING, markdown_table

POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _metadata(spark, sf):
    """Entries counted from the documents, one per language."""
    counts = C.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").cast("string").alias("value"))
    return counts.select(F.col("lang").alias("key"), "value")


def _stats(spark, sf):
    size = C.table(spark, sf, "documents").agg(F.sum("n_chars").alias("size_bytes"))
    files = C.document_files(spark, sf)
    return index_stats(files, extract_symbols(C.generated_files(spark, sf)), _metadata(spark, sf), size)


@query("agg_01_totals", f"WITH {DOCS}, {SYMBOLS} SELECT (SELECT count(*) FROM docs) AS total_files, (SELECT count(*) FROM syms) AS total_symbols")
def totals(spark, sf):
    return _stats(spark, sf).select("total_files", "total_symbols")


@query("agg_02_files_by_language", f"WITH {DOCS} SELECT language, count(*) AS count FROM docs GROUP BY 1")
def by_language(spark, sf):
    return count_by(C.document_files(spark, sf), "language")


@query("agg_03_symbols_by_kind", f"WITH {SYMBOLS} SELECT kind, count(*) AS count FROM syms GROUP BY 1")
def by_kind(spark, sf):
    return count_by(extract_symbols(C.generated_files(spark, sf)), "kind")


@query("srt_01_ordered_counts", f"WITH {PATHS}, {NAMED} SELECT suffix, count(*) AS count FROM named GROUP BY 1 ORDER BY 2 DESC, 1")
def ordered(spark, sf):
    from codelake.functions.paths import suffix

    files = C.path_files(spark, sf).withColumn("suffix", F.lower(suffix(F.col("path"))))
    return count_by(files, "suffix")


@query(
    "agg_05_metadata_map",
    """WITH c AS (SELECT lang || '=' || count(*) AS e FROM documents GROUP BY lang)
    SELECT string_agg(e, ',' ORDER BY e) AS entries, count(*) AS n FROM c""",
)
def metadata(spark, sf):
    found = metadata_map(_metadata(spark, sf))
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(F.array_join(entries, ",").alias("entries"), F.size("metadata").alias("n"))


@query(
    "agg_stats_row",
    f"""WITH {DOCS}, {SYMBOLS}, l AS (SELECT language || ':' || count(*) AS e FROM docs GROUP BY language),
    k AS (SELECT kind || ':' || count(*) AS e FROM syms GROUP BY kind)
    SELECT (SELECT count(*) FROM docs) AS total_files, (SELECT string_agg(e, ',' ORDER BY e) FROM l) AS languages,
           (SELECT string_agg(e, ',' ORDER BY e) FROM k) AS kinds,
           (SELECT round(sum(n_chars) / 1048576, 2) FROM documents) AS size_mb""",
)
def stats_row(spark, sf):
    def shown(name):
        entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        return F.array_join(F.array_sort(entries), ",")

    return _stats(spark, sf).select(
        "total_files",
        shown("files_by_language").alias("languages"),
        shown("symbols_by_kind").alias("kinds"),
        "size_mb",
    )


@query(
    "agg_08_lines_of_code",
    f"""WITH {GENERATED} SELECT repo, sum(len(string_split(rtrim(content, chr(10)), chr(10)))) AS loc,
      round(sum(strlen(content)) / 1048576, 6) AS size_mb FROM gen GROUP BY repo""",
)
def loc(spark, sf):
    found = lines_of_code(C.generated_files(spark, sf))
    return found.select("repo", "loc", F.round("size_mb", 6).alias("size_mb"))


@query(
    "flt_09_code_suffix",
    f"WITH {PATHS}, {NAMED} SELECT path FROM named WHERE regexp_extract(name, '^.+(\\.[^.]+)$', 1) IN "
    "('.py', '.js', '.ts', '.tsx', '.jsx', '.java', '.go', '.rs', '.cpp', '.c', '.h')",
)
def code_suffix(spark, sf):
    return C.path_files(spark, sf).filter(is_code(F.col("path"))).select("path")


@query(
    "agg_09_percentiles",
    """SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.5::DOUBLE)::INTEGER + 1] AS p50,
         list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::INTEGER + 1] AS p95,
         list_sort(list(value))[floor(count(*) * 0.99::DOUBLE)::INTEGER + 1] AS p99
       FROM events GROUP BY event_type""",
)
def latency_percentiles(spark, sf):
    return percentiles(C.table(spark, sf, "events"), "event_type", "value", POINTS)


def benchmark_rows(spark, sf):
    """Benchmark results, one per event type, with the event values as latencies."""
    events = C.table(spark, sf, "events")
    points = percentiles(events, "event_type", "value", POINTS)
    sums = events.groupBy("event_type").agg(
        F.count("*").alias("repo_size_loc"),
        F.countDistinct("user_id").alias("file_count"),
        (F.count("*") % 1000).alias("symbol_count"),
        F.round(F.avg("value"), 2).alias("index_time_seconds"),
        F.round(F.max("value"), 2).alias("index_size_mb"),
    )
    return sums.join(points.drop("n"), "event_type").select(
        F.col("event_type").alias("repo_name"),
        F.concat(F.lit("/srv/"), "event_type").alias("repo_path"),
        "repo_size_loc",
        F.col("index_size_mb").alias("repo_size_mb"),
        "file_count",
        "symbol_count",
        "index_time_seconds",
        "index_size_mb",
        *[F.round(p, 2).alias(f"query_{p}_ms") for p in POINTS],
    )


BENCH = """bench AS (
  SELECT event_type AS repo_name, count(*) AS repo_size_loc, count(DISTINCT user_id) AS file_count,
    count(*) % 1000 AS symbol_count, round(avg(value), 2) AS index_time_seconds, round(max(value), 2) AS index_size_mb,
    round(list_sort(list(value))[floor(count(*) * 0.5::DOUBLE)::INTEGER + 1], 2) AS p50,
    round(list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::INTEGER + 1], 2) AS p95
  FROM events GROUP BY event_type)"""


@query(
    "agg_10_averages",
    f"""WITH {BENCH} SELECT round(avg(repo_size_loc), 4) AS avg_repo_size_loc, round(avg(index_size_mb), 4) AS avg_index_size_mb,
      round(avg(p50), 4) AS avg_query_p50_ms FROM bench""",
)
def average_rows(spark, sf):
    found = averages(benchmark_rows(spark, sf), ["repo_size_loc", "index_size_mb", "query_p50_ms"])
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query(
    "agg_11_ratios",
    """SELECT user_id, CASE WHEN sum(event_id % 3) > 0 THEN round(count(*) / sum(event_id % 3), 6) ELSE 0.0 END AS per_file
       FROM events GROUP BY user_id""",
)
def ratios(spark, sf):
    sums = C.table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.col("event_id") % 3).alias("d")
    )
    return sums.select("user_id", F.round(ratio(F.col("n"), F.col("d")), 6).alias("per_file"))


@query(
    "snk_06_markdown_table",
    f"""WITH {BENCH} SELECT '| ' || repo_name || ' | ' || format('{{:,}}', repo_size_loc) || ' | ' || format('{{:,}}', file_count)
      || ' | ' || format('{{:,}}', symbol_count) || ' | ' || printf('%.2f', index_time_seconds) || 's | '
      || printf('%.2f', index_size_mb) || ' MB | ' || printf('%.2f', p50) || ' ms | ' || printf('%.2f', p95) || ' ms |' AS line
    FROM bench UNION ALL
    SELECT '| **AVERAGE** | ' || concat_ws(' | ', '**' || format('{{:,}}', round_even(avg(repo_size_loc), 0)::BIGINT) || '**',
      '**' || format('{{:,}}', round_even(avg(file_count), 0)::BIGINT) || '**', '**' || format('{{:,}}', round_even(avg(symbol_count), 0)::BIGINT) || '**',
      '**' || printf('%.2f', avg(index_time_seconds)) || 's**', '**' || printf('%.2f', avg(index_size_mb)) || ' MB**',
      '**' || printf('%.2f', avg(p50)) || ' ms**', '**' || printf('%.2f', avg(p95)) || ' ms**') || ' |' FROM bench
    UNION ALL SELECT unnest([{", ".join("'" + line.strip(chr(10)) + "'" for line in HEADING)}])""",
)
def markdown(spark, sf):
    lines = markdown_table(benchmark_rows(spark, sf))
    return lines.select(F.rtrim("line", F.lit("\n")).alias("line"))
