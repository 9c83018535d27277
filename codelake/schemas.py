"""Explicit schemas; nothing in this package is inferred from data."""

RAW_FILES = "repo string, path string, size_bytes bigint, mtime bigint, content binary, error string"
FILES = "repo string, path string, language string, mtime bigint, size_bytes bigint, content_hash string"
# The language rides along on chunks, symbols and postings, so that searches need no join for it.
CHUNKS = (
    "repo string, path string, language string, chunk_id int, content string, "
    "start_line int, end_line int, odd boolean, n_tokens int"
)
SYMBOLS = (
    "repo string, path string, language string, name string, kind string, start_line int, "
    "end_line int, signature string"
)
POSTINGS = (
    "term string, level int, repo string, path string, language string, chunk_id int, dl int, tf int, "
    "positions array<int>"
)
# Signed counts: in how many chunks of a level a term occurs, and what bounds its score there.
TERMS = "term string, language string, level int, n bigint, max_tf int, min_ratio double"
GRAMS = "gram string, name string"
QUERIES = "query_id int, query string, topk int, context int"
METADATA = "key string, value string"
BENCHMARKS = (
    "repo_name string, repo_path string, repo_size_loc bigint, repo_size_mb double, "
    "file_count bigint, symbol_count bigint, index_time_seconds double, index_size_mb double, "
    "query_p50_ms double, query_p95_ms double, query_p99_ms double"
)

FILE_KEY = ["repo", "path"]
CHUNK_KEY = ["repo", "path", "chunk_id"]
