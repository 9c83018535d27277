"""Answering a table of search requests in one job."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators.queries import parse_queries
from codelake.operators.results import merge_sides, symbol_rows, text_rows
from codelake.operators.results import with_context as add_context
from codelake.operators.symbol_search import top_symbols
from codelake.operators.text_search import best_text
from codelake.operators.small import only, settled
from codelake.plans.index import Index
from codelake.schemas import CHUNK_KEY


def search(index: Index, queries: DataFrame, prelimit: bool = True) -> DataFrame:
    """Ranked results of the requests (query_id, query, topk, context).

    Text, symbol and mixed requests share one plan, whatever their number: each side answers the
    requests routed to it, and chunks are read for the hits alone, by a join on their keys. What is
    made of the requests alone, and the best chunks, are computed on the way.
    """
    parsed = settled(parse_queries(queries), "requests")
    most = parsed.agg(F.max("topk")).first()[0] or 0
    by_text = settled(parsed.filter(F.col("route").isin("text", "hybrid")), "requests")
    by_symbol = settled(parsed.filter(F.col("route").isin("symbol", "hybrid")), "requests")

    def texts() -> DataFrame:
        found, extra = index.placed(best_text(index, by_text, most))
        hits = settled(found, "hits")
        return text_rows(hits, only(index.chunks, "path", hits), CHUNK_KEY + extra)

    def symbols() -> DataFrame:
        return symbol_rows(top_symbols(index.symbols, by_symbol, prelimit, most, index.grams))

    # Both sides ask small questions first; neither waits for the other's.
    with ThreadPoolExecutor(2) as pool:
        sides = [pool.submit(side) for side in (symbols, texts)]
        return merge_sides(*(s.result() for s in sides), parsed, most)


def with_context(index: Index, results: DataFrame, queries: DataFrame) -> DataFrame:
    return add_context(results, queries, index.chunks, index.chunk_lines, index.placed)
