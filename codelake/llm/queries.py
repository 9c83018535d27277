"""Registered queries of the numbered operators, with equivalent SQL where there is any."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from codelake.llm import (
    brown, chat, decontamination, neardup, negatives, packing, quality, records, runs, secrets, sharding, vecdup, warc,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_shards")
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


@query(
    "op7_quality_rules",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: {'i': i, 'g': array_to_string(ws[i:i + 7], ' ')})) AS u
      FROM w WHERE len(ws) >= 8),
r AS (SELECT doc_id, u.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, u.g) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
      FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
             len(list_filter(ws, lambda x: lower(x) IN (STOPS))) AS n_stops,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_cut
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.3
       AND n_letters / n_words >= 0.5 AND (n_words < 50 OR n_stops >= 1)
       AND (n_lines < 4 OR (n_dup_lines / n_lines <= 0.5 AND n_bullets / n_lines <= 0.9 AND n_cut / n_lines <= 0.3)) AS kept
FROM b""".replace("STOPS", ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))),
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.arrays_overlap("failed", F.array(*map(F.lit, quality.BASE_RULES)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "row.doc_id", *[F.col(f"counts.{n}") for n in names], base.alias("base_failed"), (F.size("failed") == 0).alias("kept")
    )


@query(
    "op8_chat_formatting",
    r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 8 + 8 + 7 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR from_end = 1)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.lay_out(rows))


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, capacity=1024, end=2)


@query("op10_binary_records")
def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = records.write(table(spark, sf_dir, "documents"), VOCABULARY, end=2)
    back = records.read(written, records.with_start(written.index))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "offset")


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), least=0)
    rows = warc.read(archives, with_data=False).filter("last")
    # A revisit holds no payload; its header has length and digest.
    full = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query(
    "op9_decontamination",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(ws), 5) AS k,
              unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s
       FROM b WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS s
       FROM d, (SELECT DISTINCT k FROM bs)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::INTEGER AS n_shared, any_value(n)::INTEGER AS n_shingles
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n)""",
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles")


@query("op4_secret_scans")
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans")
    )


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "documents"), words=4, least=0.8)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


@query("op2_brown_scores")
def op2_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


# Components only exist where there are links, which keeps the recursion short.
@query(
    "op12_embedding_near_dedup",
    r"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT DISTINCT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, vec_id) AS component_id,
       vec_id = coalesce(c.component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id""",
)
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.groups(table(spark, sf_dir, "embeddings"), least=0.93)


@query(
    "op11_hard_negatives",
    r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.col("vec_id") % 7 == 0
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    )
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


# crc32 bit by bit over the digits of doc_id, then the lags at which words stand again, their unbroken stretches, and of
# equal stretches the smallest lag.
@query(
    "op13_periodic_runs",
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws, doc_id::VARCHAR AS s FROM documents),
h AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        range(1, len(s) + 1), lambda i: list_prepend(ascii(s[i])::BIGINT, list_transform(range(8), lambda x: -1::BIGINT))))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h FROM t),
g AS (SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS loops, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, (h // 10) % 8 AS m FROM h),
f AS (SELECT doc_id, CASE WHEN NOT loops THEN ws ELSE list_transform(range(n), lambda i:
        ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) END AS ws, n FROM g),
w AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM f),
p AS (SELECT x.doc_id, y.i - x.i AS q, y.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w
        AND y.i > x.i AND 4 * (y.i - x.i) <= y.n),
k AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z, i FROM p),
v AS (SELECT doc_id, q, min(i) - q AS s, max(i) + 1 - (min(i) - q) AS len FROM k GROUP BY doc_id, q, z
      HAVING max(i) + 1 - (min(i) - q) >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM v GROUP BY doc_id, s, len),
d AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN d USING (doc_id, i) GROUP BY w.doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) = 1),
o AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(o.n, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
       sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.looped(table(spark, sf_dir, "documents"))))
