"""Near-duplicates by SetSketch registers: banded, compared by joint likelihood, then verified on full sets.

A document is its set of distinct word shingles. A register is the minimum of exponential variates over the set, put on
a logarithmic scale and truncated to a byte; registers merge by maximum, and two sets agree in one with a probability
that grows with their similarity. The steps:

1. One pass over the texts gives set size, a 128-bit fingerprint of the set and its registers. Documents with equal sets
   become one class; from here on only classes are compared.
2. Bands of registers are buckets. In each bucket every member is compared with one pivot, so a bucket of any size gives
   one pair per member. Pairs are estimated by the likelihood of their register comparisons, given the known sizes, and
   those that may be similar are verified by intersecting the full sets. Links merge classes into components.
3. Members outside the largest component of their bucket are compared with the other members on their full sets, in
   blocks of bounded size, across components only, the likeliest partners first. Nothing that shares a bucket goes
   unseen, while groups of copies are never expanded into all their pairs: a block gives only the links that join
   components.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.components import components
from codelake.llm.scratch import joined, small, stored, whole
from codelake.llm.textkernel import blocks, lower_words, mixed, ranges, span_hashes, utf8

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.1, 20.0, 255  # spacing of the scale, rate of the variates, largest register value
SLACK = 4.75  # standard errors by which an estimate may fall short and still be verified
BLOCK_ROWS = 1024
BLOCK_BYTES = 64 << 20  # of sets and sketches; documents are long now and then

_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 2**64, 3, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all rows one after another, and their number per row.

    A row with fewer words than a shingle has its whole sequence as the only one; a row without words has none.
    """
    low, starts, ends, first = lower_words(data, offsets)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    if not len(row):
        return np.zeros(0, np.uint64), count
    h = span_hashes(low, starts, ends)
    begin = ranges(first[:-1], count)
    long = np.minimum(n, words)[row]
    out = mixed(h[begin] + _SALTS[0])
    for j in range(1, words):
        more = long > j
        out[more] = mixed(out[more] ^ (h[begin[more] + j] * np.uint64(0x9E3779B97F4A7C15)))
    out = mixed(out ^ long.astype(np.uint64))
    keep = ~pd.Series(out + mixed(row.astype(np.uint64))).duplicated().to_numpy()
    return out[keep], np.bincount(row[keep], minlength=len(n))


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set, whatever the order of its elements."""
    return tuple(np.add.reduceat(mixed(hashes ^ s), starts).view(np.int64) for s in _SALTS[1:])


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set, one row per set."""
    out = np.empty((len(starts), REGISTERS), np.uint8)
    for j, factor in enumerate(_FACTORS):
        smallest = np.minimum.reduceat(hashes * factor, starts)
        variate = -np.log1p(-(smallest.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, TOP)
    return out


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from their registers and their known sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    above, below = p(u - v * j), p(v - u * j)
    chance = more * np.log(above) + less * np.log(below) + same * np.log(np.maximum(1 - above - below, 1e-12))
    return j[np.arange(len(j)), chance.argmax(axis=1)]


def floor_of(least: float) -> float:
    return least - SLACK * (least * (1 - least) / REGISTERS) ** 0.5


def sketch(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, text_hash, n, f1, f2, sketch) per document; an empty set has n = 0 and no sketch.

    `row` names a column of distinct numbers; without it rows are numbered here, for this reading only.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets):
                hashes, n = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                made: list = [None] * (hi - lo)
                if len(full):
                    starts = (np.cumsum(n) - n)[full]
                    f1[full], f2[full] = fingerprints(hashes, starts)
                    for i, r in zip(full.tolist(), registers(hashes, starts), strict=True):
                        made[i] = r.tobytes()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("text_hash"), pa.array(n.astype(np.int64)),
                        pa.array(f1), pa.array(f2), pa.array(made, pa.binary()),
                    ],
                    names=["row", "doc_id", "text_hash", "n", "f1", "f2", "sketch"],
                )

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(body).alias("text_hash"), body.alias("text"),
    )
    return rows.mapInArrow(find, "row bigint, doc_id bigint, text_hash bigint, n bigint, f1 bigint, f2 bigint, sketch binary")


def full_sets(docs: DataFrame, needed: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(class, shingles) for the classes in `needed` (class, text_hash, n, f1, f2), recomputed from one of their texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets):
                hashes, n = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                f1, f2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                if (full := np.flatnonzero(n)).size:
                    f1[full], f2[full] = fingerprints(hashes, (np.cumsum(n) - n)[full])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(lo, hi - lo), pa.array(f1), pa.array(f2), lists], names=["class", "g1", "g2", "shingles"]
                )

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("text_hash"), body.alias("text"))
    needed = stored(needed, "needed")
    # Copies of a needed text each give the set; one stays. A text that only shares the 64-bit hash is told by its sums.
    found = texts.join(small(needed.select("text_hash", "class")), "text_hash").select("class", "text")
    found = found.mapInArrow(find, "class bigint, g1 bigint, g2 bigint, shingles array<bigint>")
    one = found.groupBy("class", "g1", "g2").agg(F.first("shingles").alias("shingles"))
    expected = needed.select("class", F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    return stored(one.join(expected, ["class", "g1", "g2"]).select("class", "shingles"), "sets")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """Those of `pairs` (a, b) of classes whose similarity is at least `least`, by their full sets."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = full_sets(docs, classes.join(wanted, "class").select("class", "text_hash", "n", "f1", "f2"), words)
    a, b = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return stored(
        both.withColumn("shared", shared).filter(F.col("shared") >= F.lit(least) * union - 1e-9).select("a", "b"), "links"
    )


def with_estimates(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sizes allow the similarity and whose estimate comes near it."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(likeliest(x, y, na.to_numpy(float), nb.to_numpy(float)))

    a, b = (classes.select(F.col("class").alias(c), F.col("sketch").alias(f"r{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    fits = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9
    return both.filter(fits).filter(estimate("ra", "rb", "na", "nb") >= floor_of(least)).select("a", "b")


def across(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of a bucket that have different labels.

    `members` has bucket, size, bytes, lefts, left_bytes, left, class, label, n, sketch, shingles: left rows are compared
    with every row of their bucket, likeliest partners first, on the full sets; lefts and left_bytes count them. Rows
    that a link joins in a task are not compared there again, so a task gives at most one link for each left row and
    label. A task holds about BLOCK_ROWS rows of each kind, or as many as fill BLOCK_BYTES.
    """
    blocks_of, chunks_of = (
        F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
        for rows, size in (("size", "bytes"), ("lefts", "left_bytes"))
    )
    own = [F.pmod(F.xxhash64("class", F.lit(s)), n).cast("int") for s, n in ((1, blocks_of), (2, chunks_of))]
    # A row stands in its block for all chunks of left rows, and a left row asks in its chunk in all blocks.
    placed = members.withColumns({"own_block": own[0], "own_chunk": own[1], "blocks": blocks_of, "chunks": chunks_of})
    stands = "transform(sequence(0, chunks - 1), c -> named_struct('block', own_block, 'chunk', c))"
    asks = "transform(sequence(0, blocks - 1), b -> named_struct('block', b, 'chunk', own_chunk))"
    places = F.expr(f"IF(left, array_distinct(concat({stands}, {asks})), {stands})")
    rows = placed.select("*", F.inline(places)).select(
        "bucket", "block", "chunk", "class", "label", "n", "sketch", "shingles",
        (F.col("block") == F.col("own_block")).alias("stands"),
        (F.col("left") & (F.col("chunk") == F.col("own_chunk"))).alias("asks"),
    )
    shape = F.struct("class", "label", "n", "stands", "asks", "sketch", "shingles")
    tasks = rows.groupBy("bucket", "block", "chunk").agg(F.collect_list(shape).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                found += links_in(batch.column("rows")[k].values, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return tasks.select("rows").mapInArrow(compare, "a bigint, b bigint")


def links_in(rows: pa.StructArray, least: float) -> list[tuple[int, int]]:
    """Links among the rows of one block."""
    ids, root, n, stands, asks = (
        rows.field(c).to_numpy(zero_copy_only=False).copy() for c in ("class", "label", "n", "stands", "asks")
    )
    regs = np.frombuffer(b"".join(x.as_py() for x in rows.field("sketch")), np.uint8).reshape(-1, REGISTERS)
    shingles = rows.field("shingles")
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.sort(shingles[i].values.to_numpy())
        return sets[i]

    def linked(i: int, j: int) -> bool:
        a, b = sorted((of(i), of(j)), key=len)
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return shared >= least * (len(a) + len(b) - shared) - 1e-9

    out = []
    for i in np.flatnonzero(asks).tolist():
        y = np.flatnonzero(stands & (root != root[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-9))
        # Registers agree at least as often as the sets are similar: most pairs end here.
        y = y[(regs[y] == regs[i]).sum(axis=1) >= floor_of(least) * REGISTERS]
        if not len(y):
            continue
        j = likeliest(np.broadcast_to(regs[i], (len(y), REGISTERS)), regs[y], np.full(len(y), float(n[i])), n[y].astype(float))
        for k in y[np.argsort(-j, kind="stable")][: int((j >= floor_of(least)).sum())].tolist():
            if root[k] != root[i] and linked(i, k):
                out.append((int(ids[i]), int(ids[k])))
                root[root == root[k]] = root[i]
    return out


def groups(
    docs: DataFrame, words: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """One row (row, doc_id, n_shingles, component_id, first_row) per document.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least `least`; `component_id` is the
    smallest doc_id reachable, and `first_row` the row that has it (the first one, if rows repeat). Null and empty
    texts, and texts without words, have empty sets and are linked with nothing, not even with each other. A null
    doc_id sorts last: it is a component's id only if the component has no other. Repeated rows fall into one component.
    Other columns are ignored; an empty table gives no rows. A text of any length is one task's slice; of very long sets
    fewer are compared in a task. The table is read again to verify, so `docs` must give the
    same texts each time. `row` names a column of distinct numbers that tell the rows apart, if there is one.
    """
    sketched = stored(sketch(docs, words, doc_id, text, row), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = stored(
        sketched.filter("n > 0").groupBy("n", "f1", "f2")
        .agg(F.min(order).alias("top"), F.min("text_hash").alias("text_hash"), F.first("sketch").alias("sketch"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    spread = classes.select("class", "n", "sketch", band.alias("band")).select(
        "class", "n", F.xxhash64("band", F.substring("sketch", F.col("band") * ROWS + 1, F.lit(ROWS))).alias("bucket")
    )
    pivots = stored(
        spread.groupBy("bucket").agg(F.min("class").alias("pivot"), F.count("*").alias("size")).filter("size > 1"), "pivots"
    )
    inside = stored(spread.join(small(pivots), "bucket"), "members")  # buckets of one are gone
    star = inside.filter("class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(docs, stored(with_estimates(star, classes, least), "pairs"), classes, words, least)
    labels = components(links)

    known = inside.filter("size > 2").select("bucket", "class", "n").join(small(labels.withColumnRenamed("v", "class")), "class", "left")
    known = stored(known.withColumn("label", F.coalesce("label", "class")), "labelled")
    # Members outside their bucket's largest component ask; a bucket of one component is done.
    by_label = known.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum(8 * F.col("n") + REGISTERS).alias("bytes"))
    shape = by_label.groupBy("bucket").agg(
        F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes")
    )
    open_buckets = shape.filter(F.col("size") > F.col("most.n")).select(
        "bucket", "size", "bytes", (F.col("size") - F.col("most.n")).alias("lefts"),
        (F.col("bytes") - F.col("most.bytes")).alias("left_bytes"), F.col("most.label").alias("main"),
    )
    members = known.join(small(stored(open_buckets, "open")), "bucket").withColumn("left", F.col("label") != F.col("main"))
    members = stored(members.drop("main"), "askers")
    asked = classes.join(members.select("class").distinct(), "class")
    sets = full_sets(docs, asked.select("class", "text_hash", "n", "f1", "f2"), words)
    # Repeats in members are written in little space, so Spark would take it to be small.
    members = members.join(asked.select("class", "sketch").hint("merge"), "class").join(sets.hint("merge"), "class")
    more = stored(across(members, least).distinct(), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    merged = classes.join(small(labels.withColumnRenamed("v", "class")), "class", "left").withColumn("label", F.coalesce("label", "class"))
    tops = stored(merged.groupBy("label").agg(F.min("top").alias("first")), "tops")
    named = stored(
        joined(merged, tops, "label").select("n", "f1", "f2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")),
        "components",
    )
    empty = sketched.filter("n = 0").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("first_row")
    )
    full = sketched.filter("n > 0").join(small(named), ["n", "f1", "f2"])
    return full.select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", "first_row").unionByName(empty)


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, one of each group of near-duplicates, with all their columns.

    Rows are numbered once and written with their numbers: a later reading may split files differently and would number
    them differently.
    """
    placed = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole(docs).alias("document")), "placed")
    found = groups(placed.select("row", "document.doc_id", "document.text"), words, least, row="row")
    keep = stored(found.filter("row = first_row").select("row"), "kept")
    return placed.join(small(keep, 1_000_000), "row", "left_semi").select("document.*")
