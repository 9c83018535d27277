"""File, symbol and request tables derived from the driver tables, for the registered queries."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators.chunks import chunk_files
from codelake.plans.index import Index, index_from_files
from codelake.operators.postings import build_postings
from codelake.operators.small import local_rows
from codelake.schemas import QUERIES

CHUNK_LINES = 10  # the texts are short; at the usual size nearly every file is one chunk


WIDE = ("documents", "pages", "part")  # tables whose rows become texts to be parsed


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Rows that become texts are dealt out first: a row group would be one task, however long it takes."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if name in WIDE else rows


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown files of repository ``docs``, in their natural language."""
    return table(spark, sf, "documents").select(
        F.lit("docs").alias("repo"),
        F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"),
        F.col("lang").alias("language"),
        F.lit(0).cast("bigint").alias("mtime"),
        F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as HTML files of repository ``web``."""
    return table(spark, sf, "pages").select(
        F.lit("web").alias("repo"),
        F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"),
        F.lit("html").alias("language"),
        F.lit(0).cast("bigint").alias("mtime"),
        F.length("html").cast("bigint").alias("size_bytes"),
        F.sha2("html", 256).alias("content_hash"),
        F.col("html").alias("content"),
    )


PYTHON_TEMPLATE = (
    "import mod_%1$d\n"
    "from pkg_%2$d import x_%3$d, y_%3$d\n"
    "\n"
    "class C_%3$d(Base):\n"
    "    def m_%3$d(self, a, b=1):\n"
    "        return a\n"
    "\n"
    "async def f_%3$d(x, *args, key=None, **kw):\n"
    "    return x\n"
)

JS_TEMPLATE = (
    "import { a_%3$d, b_%3$d } from 'lib_%1$d';\n"
    "const fs_%3$d = require('fs_%2$d');\n"
    "function g_%3$d(a, b) {\n"
    "    return a;\n"
    "}\n"
    "\n"
    "class J_%3$d extends B {\n"
    "    run_%3$d(x) {\n"
    "        return x;\n"
    "    }\n"
    "}\n"
    "const h_%3$d = async (x) => {\n"
    "    return x;\n"
    "};\n"
)


def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    """One Python and one JavaScript file per part, repository ``gen``."""
    k = F.col("p_partkey")

    def filled(template: str) -> Column:
        return F.format_string(template, k % 7, k % 5, k)

    kinds = F.array(
        F.struct(
            F.format_string("gen/m_%d.py", k).alias("path"),
            F.lit("python").alias("language"),
            filled(PYTHON_TEMPLATE).alias("content"),
        ),
        F.struct(
            F.format_string("gen/j_%d.js", k).alias("path"),
            F.lit("javascript").alias("language"),
            filled(JS_TEMPLATE).alias("content"),
        ),
    )
    files = table(spark, sf, "part").select(F.lit("gen").alias("repo"), F.inline(kinds))
    return files.select(
        "repo",
        "path",
        "language",
        F.lit(0).cast("bigint").alias("mtime"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"),
        "content",
    )


# Directories and names for paths; every combination of them turns up.
DIRECTORIES = (
    "src", "lib/node_modules/x", ".git", "app/build/out", "tests", "bin", "a/env/b", "docs",
    "targets", "src/environment", "pkg/__pycache__",
)
NAMES = (
    "m_%d.py", "j_%d.JS", ".bashrc", "Makefile", "x_%d.pyc", "y_%d.lock", "z_%d.tar.gz",
    "w_%d.TSX", "__init__.py", "v_%d.min.js", "u_%d.", "q_%d.html", "p_%d.SQL",
)


def path_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of many shapes with sizes around the limit, one per part: (repo, k, path, size_bytes)."""
    k = F.col("p_partkey")
    directory = F.get(F.array(*map(F.lit, DIRECTORIES)), (k % len(DIRECTORIES)).cast("int"))
    name = F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int"))
    return table(spark, sf, "part").select(
        F.lit("paths").alias("repo"),
        k.alias("k"),
        F.concat(directory, F.lit("/"), F.replace(name, F.lit("%d"), k.cast("string"))).alias("path"),
        (F.lit(2097151) + k % 3).cast("bigint").alias("size_bytes"),
    )


def old_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.regexp_extract("path", r"_(\d+)\.md", 1).cast("bigint")
    return document_files(spark, sf).filter(doc % 7 != 0)


def new_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.regexp_extract("path", r"_(\d+)\.md", 1).cast("bigint")
    text = F.when(doc % 5 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content"))
    changed = document_files(spark, sf).filter(doc % 11 != 0).withColumn("content", text)
    return changed.withColumn("content_hash", F.sha2("content", 256))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(document_files(spark, sf), CHUNK_LINES)


def document_postings(spark: SparkSession, sf: str, stem: bool = False) -> DataFrame:
    return build_postings(document_chunks(spark, sf), stem)


def mixed_index(spark: SparkSession, sf: str, stem: bool = False) -> Index:
    """Documents and generated code in one index."""
    files = document_files(spark, sf).unionByName(generated_files(spark, sf))
    return index_from_files(files, CHUNK_LINES, stem)


# Requests the searches answer; the tables searched grow with the data.
REQUESTS = (
    "the license",
    "the license lang:en",
    "and path:src1",
    "def:m_1",
    "class:C_1",
    "import:mod_3",
    "symbol:_1",
    "def:f_1 function",
    "mongodb://x",
    "requests.get",
    "lang:en",
    "LANG:en lang:de and",
)


def requests(spark: SparkSession, texts: tuple[str, ...] = REQUESTS, topk: int = 10, context: int = 0):
    rows = [(i, text, topk, context) for i, text in enumerate(texts)]
    return local_rows(spark, rows, QUERIES)


# Shapes of requests; one is filled in per part, so parsing works on as many rows as there are parts.
REQUEST_SHAPES = (
    "the {n}",
    "the lang:en {n}",
    "def:m_{k}",
    "class:C_{k} path:gen",
    "import:mod_{k} lang:python",
    "symbol:_{k} {n} token",
    "def:a_{k} def:a_{k}b",
    "LANG:en lang:de {n}",
    "mongodb://x{k}",
    "  {n}   path:src{k}  Symbol:S{k} ",
    "lang:en path:x_{k}",
    "requests.get {n}",
)


def part_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    shape = F.get(F.array(*map(F.lit, REQUEST_SHAPES)), (k % len(REQUEST_SHAPES)).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{n}"), F.col("p_name")), F.lit("{k}"), k.cast("string"))
    return table(spark, sf, "part").select(
        k.cast("int").alias("query_id"),
        text.alias("query"),
        (F.col("p_size") * 3 - 5).alias("topk"),
        (k % 13).cast("int").alias("context"),
    )
