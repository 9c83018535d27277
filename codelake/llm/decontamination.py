"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n distinct word shingles counts as contained in a document that holds at least `least` of them, as a
share. The item's k smallest shingle hashes are its bottom-k MinHash sketch. With k = n - ceil(least * n) + 1 a document
that shares none of the k lacks more shingles than allowed, so every contained item shares a sketch value: the search
has no false negatives. Items are partitioned by size into classes of doubling n. A class is searched only in
documents that are long enough for it, and a document keeps only its hashes up to the largest sketch value of those
classes, about a fifth of them. Candidates are verified on the shingles themselves.

An item of fewer words than a shingle is its whole word sequence as one shingle. Documents are asked for sequences of so
many words only where there are such items; a document contains the item if it has the sequence.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import small, stored, whole

SHINGLE = 5
LEAST = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def with_hashes(rows: DataFrame, text: str) -> DataFrame:
    """Adds `hashes`: one per shingle of SHINGLE words, repeats included; a shorter text has none."""
    pair = "transform({0}, (h, i) -> xxhash64(h, get({1}, i + {2})))"
    out = rows.withColumn("_words", words_of(F.col(text))).withColumn("_h1", F.expr("transform(_words, w -> xxhash64(w))"))
    out = out.withColumn("_h2", F.expr(pair.format("_h1", "_h1", 1))).withColumn("_h4", F.expr(pair.format("_h2", "_h2", 2)))
    out = out.withColumn("_h5", F.expr(pair.format("_h4", "_h1", 4)))
    hashes = F.expr(f"slice(_h5, 1, greatest(size(_words) - {SHINGLE - 1}, 0))")
    return out.withColumn("hashes", hashes).drop("_h1", "_h2", "_h4", "_h5")


def shingles_of(words: Column) -> Column:
    def made(w: Column) -> Column:
        starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))

    # As a lambda's argument the words are computed once, not once for each shingle.
    return F.transform(F.array(words), made)[0]


def contained(
    docs: DataFrame, items: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", row: str | None = None,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment, row_key) of documents and the items they contain.

    An item of fewer than SHINGLE words is one shingle, its whole word sequence; null texts and texts without words hold
    nothing and are held nowhere. Repeated rows are searched each, and their equal pairs given once; of rows that share a
    doc_id but not a text, `row_key` tells which one it was: the column `row` of distinct numbers if it is named, else a
    hash of id and text. A null id stays null. A very long text is one row of one task. Other columns are ignored; an
    empty table on either side gives no pairs.
    """
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item_text")).distinct()
    sized = with_hashes(wanted, "item_text").select(
        "item_id", "_words", shingles_of(F.col("_words")).alias("shingles"), F.array_sort(F.array_distinct("hashes")).alias("hashes")
    )
    n = F.size("hashes")
    lists = stored(
        sized.filter(n > 0).select(
            F.monotonically_increasing_id().alias("item"), "item_id", "shingles",
            F.floor(F.log2(n)).cast("int").alias("class"),
            F.slice("hashes", 1, (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int")).alias("sketch"),
        ),
        "items",
    )
    # At most one row per power of two. A class needs a document of least * 2^class shingles.
    classes = lists.groupBy("class").agg(F.max(F.element_at("sketch", -1)).alias("top")).orderBy("class").collect()
    sketches = stored(lists.select("item", F.explode("sketch").alias("hash")), "sketches")

    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    raw = raw.withColumn("row_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    if row:
        raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(row).alias("row_key"))
    top = F.lit(None).cast("bigint")
    highest = None
    for c in classes:  # ascending, so the last condition that holds has the largest class
        highest = c["top"] if highest is None else max(highest, c["top"])
        top = F.when(F.size("hashes") >= least * 2 ** c["class"], F.lit(highest)).otherwise(top)
    kept = with_hashes(raw, "text").select("row_key", "hashes", top.alias("top"))
    # The outer form: else Spark would filter on the size first and compute the hashes twice.
    kept = kept.select("row_key", F.explode_outer(F.filter("hashes", lambda h: h <= F.col("top"))).alias("hash"))
    candidates = stored(kept.join(small(sketches), "hash").select("row_key", "item").distinct(), "candidates")

    found = raw.join(small(candidates), "row_key").join(small(lists.select("item", "item_id", "shingles")), "item")
    shared = F.size(F.array_intersect(shingles_of(words_of(F.col("text"))), "shingles"))
    # Given out by a generator, so that the filter is not pushed below it and counts again.
    counted = found.select(
        "doc_id", "item_id", "row_key", F.explode_outer(F.array(shared)).alias("n_shared"), F.size("shingles").alias("n_shingles")
    )
    enough = counted.filter(F.col("n_shared") >= F.ceil(F.lit(least) * F.col("n_shingles") - 1e-9))
    short = sized.filter(F.size("_words").between(1, SHINGLE - 1)).select("item_id", F.col("_words").alias("words"))
    every = enough.unionByName(holding_short(raw, stored(short, "short-items")))
    return every.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).distinct()


def holding_short(raw: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id, row_key, n_shared, n_shingles) of documents and the short items (item_id, words) they hold."""

    def sequence(words: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])

    sizes = [r["n"] for r in short.select(F.size("words").alias("n")).distinct().collect()]  # fewer than SHINGLE
    if not sizes:
        none = F.lit(None)
        return raw.limit(0).select("doc_id", none.cast(short.schema["item_id"].dataType).alias("item_id"), "row_key", *[F.lit(1).alias(c) for c in ("n_shared", "n_shingles")])
    own = F.coalesce(*[F.when(F.size("words") == n, sequence(F.col("words"), F.lit(0), n)) for n in sizes])
    hashed = stored(short.select("item_id", own.alias("hash"), F.array_join("words", " ").alias("phrase")), "short-hashes")

    def made(words: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: sequence(words, i, n))

        return F.array_distinct(F.concat(*map(of, sizes)))

    # As a lambda's argument the words are computed once; the outer form keeps Spark from computing all of it twice.
    held = raw.select("row_key", F.explode_outer(F.transform(F.array(words_of(F.col("text"))), made)[0]).alias("hash"))
    candidates = stored(held.join(small(hashed.select("hash").distinct()), "hash").select("row_key", "hash").distinct(), "short-candidates")
    found = raw.join(small(candidates), "row_key").join(small(hashed), "hash")
    text = F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" "))
    sure = F.contains(text, F.concat(F.lit(" "), "phrase", F.lit(" ")))
    return found.filter(sure).select("doc_id", "item_id", "row_key", F.lit(1).alias("n_shared"), F.lit(1).alias("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Rows are numbered once and written with their numbers, so each is judged by its own text, whatever its doc_id, and of
    repeated rows all stay or all go. Null and empty texts stay. An empty table on either side leaves `docs` as it is.
    """
    placed = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole(docs).alias("document")), "placed")
    found = contained(placed.select("row", "document.doc_id", "document.text"), items, least, row="row")
    hits = stored(found.select(F.col("row_key").alias("row")).distinct(), "contaminated")
    return placed.join(small(hits), "row", "left_anti").select("document.*")
