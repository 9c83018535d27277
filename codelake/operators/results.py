"""Search results: rows, context lines, counts and JSON."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.lines import context_window, head_snippet
from codelake.functions.scoring import match_type, symbol_snippet
from codelake.operators.chunks import file_text
from codelake.operators.ranking import top_rows
from codelake.operators.small import only, settled
from codelake.schemas import CHUNK_KEY, FILE_KEY

ROW = [
    "query_id", "repo", "file_path", "line_number", "snippet", "score", "match_type", "language",
    "symbol_name", "symbol_kind",
]


def symbol_rows(hits: DataFrame) -> DataFrame:
    name, kind, signature = F.col("name"), F.col("kind"), F.col("signature")
    return hits.select(
        "query_id",
        "repo",
        F.col("path").alias("file_path"),
        F.col("start_line").alias("line_number"),
        symbol_snippet(name, kind, signature).alias("snippet"),
        "score",
        match_type(kind).alias("match_type"),
        "language",
        name.alias("symbol_name"),
        kind.alias("symbol_kind"),
    )


def text_rows(hits: DataFrame, chunks: DataFrame, keys: list[str] = CHUNK_KEY) -> DataFrame:
    found = chunks.drop("language", "n_tokens").join(hits, keys)
    return found.select(
        "query_id",
        "repo",
        F.col("path").alias("file_path"),
        F.col("start_line").alias("line_number"),
        head_snippet(F.col("content")).alias("snippet"),
        "score",
        F.lit("text").alias("match_type"),
        "language",
        F.lit(None).cast("string").alias("symbol_name"),
        F.lit(None).cast("string").alias("symbol_kind"),
    )


def merge_sides(symbols: DataFrame, texts: DataFrame, parsed: DataFrame, most: int | None = None) -> DataFrame:
    """Both sides together, best first, ranked from 1; ties go by place and name."""
    both = symbols.select(*ROW).unionByName(texts.select(*ROW))
    order = [F.desc("score"), *map(F.asc, ("repo", "file_path", "line_number", "symbol_name"))]
    limited = both.join(parsed.select("query_id", "topk"), "query_id")
    return top_rows(limited, ["query_id"], order, F.col("topk"), most=most).select("query_id", "rank", *ROW[1:])


def with_context(
    results: DataFrame, queries: DataFrame, chunks: DataFrame, chunk_lines: int, placed=lambda rows: (rows, [])
) -> DataFrame:
    """Add ``context_lines``: numbered lines around each hit, from the stored text.

    The ids of the chunks that hold the lines follow from the line's number, so a hit reads the chunks it touches by their
    keys, and none without context. In files with odd line ends chunks begin elsewhere: their hits, where there are any,
    get the whole file put together. ``placed`` adds to rows with repo and path where their file lies.
    """
    none = F.array().cast("array<string>")
    asked = settled(results.join(queries.select("query_id", "context"), "query_id"), "asked")
    hit = ["query_id", "rank", "repo", F.col("file_path").alias("path"), "line_number", "context"]
    wanted = asked.filter("context > 0").select(*hit)
    line, size = F.col("line_number") - 1, F.lit(chunk_lines)
    ids = F.sequence(
        F.floor(F.greatest(line - F.col("context"), F.lit(0)) / size).cast("int"), F.floor((line + F.col("context")) / size).cast("int")
    )
    near, extra = placed(wanted.withColumn("chunk_id", F.explode(ids)))
    parts = only(chunks, "path", wanted).select(*CHUNK_KEY, *extra, "content", "start_line", "odd").join(near, CHUNK_KEY + extra)
    # A handful of chunks a hit.
    held = F.array_sort(F.collect_list(F.struct("chunk_id", "start_line", "content")))
    one = parts.groupBy("query_id", "rank", "line_number", "context").agg(held.alias("held"), F.max("odd").alias("odd"))
    text = F.array_join(F.transform("held", lambda c: c["content"]), "")
    before = F.get("held", F.lit(0))["start_line"] - 1
    lines = context_window(text, F.col("line_number") - before, F.col("context"), before)
    found = settled(one.select("query_id", "rank", "odd", F.when(~F.col("odd"), lines).alias("lines")), "contexts")
    if not found.filter("odd").isEmpty():
        odd, extra = placed(wanted.join(found.filter("odd").select("query_id", "rank"), ["query_id", "rank"]))
        keys = FILE_KEY + extra
        texts = file_text(chunks.join(odd.select(*keys).distinct(), keys, "left_semi"))
        whole = context_window(F.col("content"), F.col("line_number"), F.col("context"))
        more = odd.join(texts, FILE_KEY).select("query_id", "rank", F.lit(False).alias("odd"), whole.alias("lines"))
        found = found.filter("NOT odd").unionByName(more)
    return (
        asked.join(found.select("query_id", "rank", "lines"), ["query_id", "rank"], "left")
        .withColumn("context_lines", F.coalesce("lines", none))
        .select("query_id", "rank", *ROW[1:], "context_lines")
    )


def hits_with_lines(hits: DataFrame, lines: DataFrame, context: int) -> DataFrame:
    """Context as rows: each hit (repo, path, line_number) with the lines around it."""
    near = F.col("line_no").between(F.col("line_number") - context, F.col("line_number") + context)
    return hits.join(lines, ["repo", "path"]).filter(near)


def total_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, total_results), zero for requests that found nothing."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("total_results")
    )


def result_json(results: DataFrame) -> DataFrame:
    """(query_id, rank, json): one object per result, without the fields it does not have."""
    fields = ["file_path", "line_number", "snippet", "score", "match_type", "language"]
    optional = ["symbol_name", "symbol_kind"]
    columns = [F.col(c) for c in fields] + [F.nullif(F.col(c), F.lit("")).alias(c) for c in optional]
    if "context_lines" in results.columns:
        some = F.when(F.size("context_lines") > 0, F.col("context_lines"))
        columns.append(some.alias("context_lines"))
    return results.select("query_id", "rank", F.to_json(F.struct(*columns)).alias("json"))


def json_envelopes(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, json): the request, how much it found, and the results; at most top-k objects."""
    lists = result_json(results).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "json"))).alias("found")
    )
    found = F.coalesce("found", F.array().cast("array<struct<rank:int,json:string>>"))
    head = F.to_json(F.struct("query", F.size(found).alias("total_results")))
    objects = F.array_join(F.transform(found, lambda r: r["json"]), ",")
    body = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"results":['), objects, F.lit("]}"))
    return (
        queries.select("query_id", "query")
        .join(lists, "query_id", "left")
        .withColumn("head", head)
        .select("query_id", body.alias("json"))
    )
