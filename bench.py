"""Headline timings on one machine: prints one JSON line.

Data: the documents and one Python and one JavaScript file per part. `BENCH_SF_DIR` names the
tables, `BENCH_CPUS` the cores.
"""

import json
import os
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from codelake.operators.delta import plan_delta  # noqa: E402
from codelake.operators.audits import AUDIT_PATTERNS, audit, import_inventory  # noqa: E402
from codelake.operators.chunks import chunk_files, chunk_lines  # noqa: E402
from codelake.operators.percentiles import percentiles  # noqa: E402
from codelake.operators.postings import build_postings  # noqa: E402
from codelake.operators.symbols import extract_symbols  # noqa: E402
from codelake.plans import corpora as C  # noqa: E402
from codelake.plans.index import open_index, refresh  # noqa: E402
from codelake.plans.search import search, with_context  # noqa: E402
from codelake.schemas import RAW_FILES  # noqa: E402
from codelake.session import local_session, shared_folder  # noqa: E402

REQUESTS = (
    "function", "import", "class", "async", "export", "def:main", "class:C_1", "import:os", "symbol:parse",
    "symbol:run_1", "function lang:python", "class lang:javascript", "the license lang:en", "def:f_1 function",
    '"of the"', "licen*",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codelake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, run):
        started = time.perf_counter()
        result = run()
        took[name] = round(time.perf_counter() - started, 3)
        return result

    def drained(frame):
        frame.write.format("noop").mode("overwrite").save()

    docs, code = C.document_files(spark, sf), C.generated_files(spark, sf)
    size = docs.unionByName(code).agg(
        F.sum(F.octet_length("content")).alias("bytes"),
        F.sum(F.size(F.split("content", "\n"))).alias("lines"),
        F.count("*").alias("files"),
    ).first()

    timed("chunks", lambda: drained(chunk_files(docs, C.CHUNK_LINES)))
    timed("postings", lambda: drained(build_postings(chunk_files(docs, C.CHUNK_LINES), stem=False)))
    timed("postings_stemmed", lambda: drained(build_postings(chunk_files(docs, C.CHUNK_LINES))))
    timed("symbols", lambda: drained(extract_symbols(code)))
    timed("import_inventory", lambda: drained(import_inventory(extract_symbols(code))))
    timed("delta", lambda: drained(plan_delta(C.new_snapshot(spark, sf), C.old_snapshot(spark, sf))))
    timed("audit", lambda: drained(audit(chunk_lines(chunk_files(docs, C.CHUNK_LINES)), AUDIT_PATTERNS)))
    events = C.table(spark, sf, "events")
    timed("percentiles", lambda: drained(percentiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95})))

    directory = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    shape = spark.createDataFrame([], RAW_FILES).schema

    def raw(files):
        filled = files.withColumn("error", F.lit(None).cast("string"))
        return filled.withColumn("content", F.col("content").cast("binary")).to(shape)

    def index(files):
        return refresh(spark, raw(files), directory, "bench", buckets=16)

    files = docs.unionByName(code).withColumn("repo", F.lit("bench"))
    timed("index_full", lambda: index(files))
    touched = F.pmod(F.xxhash64("path"), F.lit(100)) == 0
    edited = files.withColumn("content", F.when(touched, F.concat("content", F.lit("\n# edited\n"))).otherwise(F.col("content")))
    timed("index_one_percent_changed", lambda: index(edited))
    timed("index_unchanged", lambda: index(edited))

    requests = C.requests(spark, REQUESTS, context=2)

    def answer():
        opened = open_index(spark, directory)
        return with_context(opened, search(opened, requests), requests).count()

    timed("search_first", answer)
    timed("search_again", answer)

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf,
                "corpus": {"mb": round(size.bytes / 1048576, 2), "lines": size.lines, "files": size.files},
                "index_mb_per_sec": round(size.bytes / 1048576 / took["index_full"], 3),
                "index_lines_per_sec": round(size.lines / took["index_full"]),
                "searches_per_sec": round(len(REQUESTS) / took["search_again"], 3),
            }
        )
    )


if __name__ == "__main__":
    main()
