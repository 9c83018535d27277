"""Source trees on disk: documents are written as files below the shared folder, listed and read back."""

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from codelake.plans import corpora as C
from codelake.plans.registered.registry import query
from codelake.session import shared_folder
from codelake.settings import MAX_FILE_BYTES
from codelake.sources.codefiles import read_repo

# Where a document goes: a deep directory, a shallow one, a hidden one, one that is left out, a name that is left out.
PLACES = (
    "a/b/c/d/e/doc_{k}.md", "src{m}/doc_{k}.md", ".hidden/_{m}/doc_{k}.py", "x/node_modules/y{m}/doc_{k}.md", "src{m}/doc_{k}.pyc",
)


def written_tree(documents, root: str) -> None:
    """Write (path, text) rows as files. A file gets its name when complete, so a task that runs again replaces its own."""

    def write(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                # Left by a task that was lost, it would be listed: it has a name that is left out.
                temporary = f"{target}-{uuid.uuid4().hex}.lock"
                with open(temporary, "wb") as f:
                    f.write(text.encode())
                os.replace(temporary, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    documents.select("path", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


@query(
    "src_01_scan",
    f"""SELECT replace(replace(CASE doc_id % 5 WHEN 0 THEN '{PLACES[0]}' WHEN 1 THEN '{PLACES[1]}' ELSE '{PLACES[2]}' END,
        '{{k}}', doc_id::VARCHAR), '{{m}}', (doc_id % 7)::VARCHAR) AS path,
      strlen(text) AS size_bytes, sha256(text) AS content_hash
    FROM documents WHERE text IS NOT NULL AND doc_id % 5 < 3 AND strlen(text) <= {MAX_FILE_BYTES}""",
)
def scan(spark, sf):
    k = F.col("doc_id")
    shape = F.get(F.array(*map(F.lit, PLACES)), (k % len(PLACES)).cast("int"))
    path = F.replace(F.replace(shape, F.lit("{k}"), k.cast("string")), F.lit("{m}"), (k % 7).cast("string"))
    root = f"{shared_folder(spark).removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    written_tree(C.table(spark, sf, "documents").filter("text IS NOT NULL").select(path.alias("path"), "text"), root)
    found = read_repo(spark, root, "tree")
    return found.select("path", "size_bytes", F.sha2("content", 256).alias("content_hash"))
