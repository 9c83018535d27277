"""The batch jobs: audits, dependency inventory, migration check, missing docstrings."""

from pyspark.sql import functions as F

from codelake.operators import audits as A
from codelake.operators.chunks import chunk_lines
from codelake.operators.symbols import extract_symbols
from codelake.plans import corpora as C
from codelake.plans.registered.registry import DOCS, PAGES, SYMBOLS, chunk_views, query

PATTERNS = {**A.AUDIT_PATTERNS, "license": "(?i)licen[cs]e", "digits": "[0-9]{4,}", "tracking": r"track\([0-9]+\)"}

AUDITED = f"""WITH {DOCS}, {PAGES}, texts AS (
  SELECT repo, path, language, content FROM docs UNION ALL SELECT repo, path, language, content FROM web),
{chunk_views("texts")},
numbered AS (SELECT repo, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM lines),
pats(label, re) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in PATTERNS.items())}),
hits AS (SELECT repo, path, line_no, label FROM numbered JOIN pats ON regexp_matches(line, re)) """


def _hits(spark, sf):
    from codelake.operators.chunks import chunk_files

    files = C.document_files(spark, sf).unionByName(C.page_files(spark, sf))
    return A.audit(chunk_lines(chunk_files(files, C.CHUNK_LINES)), PATTERNS)


@query("job_01_audit", AUDITED + "SELECT repo, path, line_no, label FROM hits")
def audit(spark, sf):
    return _hits(spark, sf).select("repo", "path", "line_no", "label")


@query(
    "job_01_audit_counts",
    AUDITED + "SELECT label, count(*) AS hits, count(*) > CASE label WHEN 'license' THEN 50 ELSE 0 END AS exceeded FROM hits GROUP BY label",
)
def audit_counts(spark, sf):
    return A.audit_counts(_hits(spark, sf), {"license": 50})


@query(
    "job_02_import_inventory",
    f"WITH {SYMBOLS} SELECT name, count(DISTINCT path) AS importers FROM syms WHERE kind = 'import' GROUP BY name",
)
def inventory(spark, sf):
    return A.import_inventory(extract_symbols(C.generated_files(spark, sf)))


@query(
    "job_03_remaining_imports",
    f"WITH {SYMBOLS} SELECT path, name, start_line FROM syms WHERE kind = 'import' AND (name = 'lib_3' OR starts_with(name, 'lib_3.'))",
)
def remaining(spark, sf):
    found = A.remaining_imports(extract_symbols(C.generated_files(spark, sf)), "lib_3")
    return found.select("path", "name", "start_line")


@query(
    "job_04_undocumented",
    """SELECT 'm_' || p_partkey || '.py' AS path, u.name FROM part, LATERAL (SELECT unnest(CASE p_partkey % 6
      WHEN 0 THEN ['d_' || p_partkey] WHEN 2 THEN ['C', 'C.m'] WHEN 4 THEN ['d_' || p_partkey] ELSE [] END) AS name) u""",
)
def undocumented(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("d_"), k)
    # Plain, after a form feed and with a wide signature, an undocumented class, a raw string, in one line, decorated.
    source = (
        F.when(k % 6 == 0, F.concat(F.lit("def "), name, F.lit("():\n\n    return 1\n")))
        .when(k % 6 == 1, F.concat(F.lit("\f\ndef "), name, F.lit('(\n    a,\n    b,\n):\n    """What it does."""\n')))
        .when(k % 6 == 2, F.lit('class C:\n    x = """no docstring"""\n\n    def m(self):\n        return "x"\n'))
        .when(k % 6 == 3, F.concat(F.lit("async def "), name, F.lit("():\n\n    # why\n    r'x'\n")))
        .when(k % 6 == 4, F.concat(F.lit("def "), name, F.lit("(): return 'x'\n")))
        .otherwise(F.concat(F.lit("@cached\ndef "), name, F.lit('(): "What it does."\n')))
    )
    files = C.table(spark, sf, "part").select(
        F.lit("doc").alias("repo"), F.concat(F.lit("m_"), k, F.lit(".py")).alias("path"),
        F.lit("python").alias("language"),
        F.concat(F.lit("import os\n\n"), source).alias("content"),
    )
    return A.undocumented(files).select("path", "name")
