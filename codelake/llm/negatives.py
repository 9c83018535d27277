"""Hard negatives by slots: every row is scored against the anchors, and every window is answered from a few kept rows.

An anchor asks for one window of scores for each of its positives: from `low` to `high` hundredths of the positive's
score. The windows overlap, and a row may fall into all of them. The positives' upper limits cut the scores of an anchor
into disjoint slots, so a row falls into one slot at most:

1. Vectors become blocks of integers, written once. Anchors are cut into waves of bounded bytes; a wave is broadcast to
   the blocks, and a block is multiplied with all anchors of the wave at once.
2. The first pass keeps the best rows of an anchor's own label: its positives. Their limits give its slots.
3. The second pass keeps the best rows of other labels in each slot. A task keeps `negatives` rows for an anchor and slot
   while its blocks go by and gives only those: they are combined before they are shuffled.
4. Slots are disjoint, so what is best below an upper limit is the slots below it one after another, cut off after
   `negatives` rows. These suffixes are built once per anchor; a window is the part of its suffix above its lower limit.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.scratch import stored

BLOCK_BYTES = 1 << 20  # of 8-byte components; a longer vector is a block of its own
WAVE_BYTES = 8 << 20  # of 8-byte components of the anchors that are broadcast together
ANCHORS_AT_ONCE = 256
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1

BLOCKS = "dims int, rows array<bigint>, ids array<bigint>, nameless array<boolean>, labels array<bigint>, vectors binary"
KEPT = "anchor bigint, slot int, score bigint, nameless boolean, id bigint, row bigint"


def finite(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    x_fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & x_fits


def matrix_of(column: pa.ListArray, dims: int, which: np.ndarray) -> np.ndarray:
    """The chosen rows of a list column, all of length `dims`, as doubles."""
    if not dims:
        return np.zeros((len(which), 0))
    return column.take(pa.array(which)).flatten().to_numpy().astype(np.float64).reshape(len(which), dims)


def blocks_of(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (row, id, label, vector) as blocks of vectors of one length, each component scaled and rounded down."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            length = vectors.value_lengths().to_numpy()
            for dims in np.unique(length).tolist():
                at = np.flatnonzero(length == dims)
                size = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
                for lo in range(0, len(at), size):
                    part = batch.take(pa.array(at[lo : lo + size]))
                    ids = part.column("id")
                    whole = np.floor(scale * matrix_of(vectors, dims, at[lo : lo + size]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dims], pa.int32()), one(part.column("row")), one(ids.fill_null(0)), one(ids.is_null()),
                            one(part.column("label")), pa.array([whole.tobytes()], pa.binary()),
                        ],
                        names=["dims", "rows", "ids", "nameless", "labels", "vectors"],
                    )

    return rows.mapInArrow(pack, BLOCKS)


def one(column: pa.Array) -> pa.ListArray:
    """A whole column as a single list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as 64-bit integers; what is beyond those becomes the nearest of them."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 2**24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (x @ y.T).astype(np.int64)
    big = [[int(v) for v in row] for row in y.tolist()]
    out = np.empty((len(x), len(y)), np.int64)
    for i, row in enumerate(x.tolist()):
        own = [int(v) for v in row]
        out[i] = [max(LEAST_LONG, min(MOST_LONG, sum(a * b for a, b in zip(own, other, strict=True)))) for other in big]
    return out


class Best:
    """The first `k` rows of each key, higher scores first, then smaller ids (none last), then smaller row numbers."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.floor = np.full(keys, LEAST_LONG, np.int64)  # a lower score is not needed any more
        self.kept = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]

    def add(self, *more: np.ndarray) -> None:
        """More rows: key, score, nameless, id, row."""
        key, score, nameless, id_, row = (np.concatenate(both) for both in zip(self.kept, more, strict=True))
        order = np.lexsort((row, id_, nameless, ~score, key))
        sorted_key = key[order]
        begin = np.searchsorted(sorted_key, sorted_key)
        place = np.arange(len(order)) - begin
        order = order[place < self.k]
        self.kept = [c[order] for c in (key, score, nameless, id_, row)]
        last = place[place < self.k] == self.k - 1
        self.floor[self.kept[0][last]] = self.kept[1][last]


def kept_rows(blocks: DataFrame, anchors: DataFrame, k: int, positive: bool, slots: int = 1) -> DataFrame:
    """(anchor, slot, rank, score, id): the first `k` rows of each anchor and slot among all `blocks`.

    `anchors` has row, label, dims, vector; positives are other rows of the same label. Else it has `uppers` (limits of
    the slots, descending) and `lowest` too, and only rows of other labels count.
    """
    fields = ["row", "label", "vector", *([] if positive else ["uppers", "lowest"])]
    width = anchors.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    waves = -(-width["n"] * 8 * max(width["dims"] or 0, 1) // WAVE_BYTES)
    numbered = anchors.withColumn("wave", F.pmod(F.xxhash64("row"), F.lit(max(waves, 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column("dims")[i].as_py()
                if dims not in known:
                    wave = pa.RecordBatch.from_struct_array(batch.column("wave")[i].values)
                    known[dims] = (asked(wave, dims, slots), Best(wave.num_rows * slots, k))
                score_block(batch.slice(i, 1), dims, *known[dims], positive, slots)
        for wave, best in known.values():
            key, score, nameless, id_, row = best.kept
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(wave["row"][key // slots]), pa.array((key % slots).astype(np.int32)), pa.array(score),
                    pa.array(nameless), pa.array(id_, mask=nameless), pa.array(row),
                ],
                names=["anchor", "slot", "score", "nameless", "id", "row"],
            )

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "nameless", "id", "row")
    found = []
    for w in range(waves):
        wave = numbered.filter(F.col("wave") == w).groupBy("dims").agg(F.collect_list(F.struct(*fields)).alias("wave"))
        # One row per vector length, and WAVE_BYTES of vectors in all of them on average.
        best = blocks.join(F.broadcast(wave), "dims").mapInArrow(search, KEPT)
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(stored(ranked.select("anchor", "slot", "rank", "score", "id"), "kept"))
    if not found:
        return blocks.sparkSession.createDataFrame([], "anchor bigint, slot int, rank int, score bigint, id bigint")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def asked(wave: pa.RecordBatch, dims: int, slots: int) -> dict[str, np.ndarray]:
    """What a wave's anchors ask for, as arrays."""
    raw = b"".join(wave.column("vector").to_pylist())
    out = {
        "row": wave.column("row").to_numpy(),
        "label": wave.column("label").to_numpy(),
        "vector": np.frombuffer(raw, np.float64).reshape(wave.num_rows, dims),
    }
    if "uppers" in wave.schema.names:
        uppers = np.full((wave.num_rows, slots), LEAST_LONG, np.int64)
        for i, limits in enumerate(wave.column("uppers").to_pylist()):
            uppers[i, : len(limits)] = limits
        out |= {"uppers": uppers, "lowest": wave.column("lowest").to_numpy()}
    return out


def score_block(block: pa.RecordBatch, dims: int, wave: dict, best: Best, positive: bool, slots: int) -> None:
    rows, ids, labels = (block.column(c)[0].values.to_numpy() for c in ("rows", "ids", "labels"))
    nameless = block.column("nameless")[0].values.to_numpy(zero_copy_only=False)
    vectors = np.frombuffer(block.column("vectors")[0].as_py(), np.float64).reshape(len(rows), dims)
    for lo in range(0, len(wave["row"]), ANCHORS_AT_ONCE):
        part = slice(lo, lo + ANCHORS_AT_ONCE)
        score = products(vectors, wave["vector"][part])
        same = labels[:, None] == wave["label"][part]
        if positive:
            fits = same & (rows[:, None] != wave["row"][part]) & (score >= best.floor[part])
            r, a = np.nonzero(fits)
            s, key = score[r, a], a + lo
        else:
            uppers = wave["uppers"][part]
            r, a = np.nonzero(~same & (score >= wave["lowest"][part]) & (score <= uppers[:, 0]))
            s = score[r, a]
            # As many upper limits as a score is not above, so many slots down it lies.
            slot = sum((s <= uppers[a, j]).astype(np.int64) for j in range(slots)) - 1
            key = (a + lo) * slots + slot
            high = s >= best.floor[key]
            r, s, key = r[high], s[high], key[high]
        if len(key):
            best.add(key, s, nameless[r], ids[r], rows[r])


def mine(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Components become
    floor(scale * x) as doubles; a score is the exact integer inner product with the anchor (beyond 64 bits it becomes
    the nearest 64-bit number, whatever the vectors' size). `anchor` says which rows are anchors (null: no). An anchor's
    positives are its first `positives` other rows of the same label; for each, the first `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score are given, ranked from 1.

    Higher scores come first, ties by smaller id, a null id last, then by position in the table. Rows are told apart by
    position: of repeated rows each counts, as anchor, positive and negative. A vector is compared with vectors of its own
    length only; empty vectors score 0. A very long vector is a block of its own. Labels are whole numbers. Other columns
    are ignored; an empty table gives no rows, and so does an anchor without positives or with none in its windows.
    """
    whole = F.col(vector).cast("array<double>")
    base = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"), whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter(F.col("label").isNotNull() & finite(F.col("vector")))
    # Written once: the row numbers of this reading tell rows apart from here on.
    numbered = base.withColumn("row", F.col("row") * 2 + F.col("anchor").cast("bigint"))
    blocks = stored(blocks_of(numbered.select("row", "id", "label", "vector"), scale), "blocks")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, ids, labels = (batch.column(c)[i].values for c in ("rows", "ids", "labels"))
                ids = pa.array(ids.to_numpy(), mask=batch.column("nameless")[i].values.to_numpy(zero_copy_only=False))
                at = np.flatnonzero(numbers.to_numpy() % 2)
                raw, width = batch.column("vectors")[i].as_py(), 8 * batch.column("dims")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        numbers.take(pa.array(at)), ids.take(pa.array(at)), labels.take(pa.array(at)),
                        pa.array(np.full(len(at), width // 8, np.int32)),
                        pa.array([raw[j * width : (j + 1) * width] for j in at.tolist()], pa.binary()),
                    ],
                    names=["row", "id", "label", "dims", "vector"],
                )

    asking = stored(blocks.mapInArrow(pick, "row bigint, id bigint, label bigint, dims int, vector binary"), "anchors")
    own = kept_rows(blocks, asking, positives, positive=True)
    score = F.col("score").cast("decimal(20,0)")
    # Without a score of 0 or more a window is empty.
    own = own.filter("score >= 0").select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.floor(score * high / 100).cast("bigint").alias("upper"), F.ceil(score * low / 100).cast("bigint").alias("lower"),
    )
    own = stored(own, "positives")
    limits = own.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("lowest")
    )
    limited = stored(asking.join(limits, "row"), "limits")
    others = kept_rows(blocks, limited, negatives, positive=False, slots=positives)
    entry = F.struct("rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    lists = others.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(entry)).alias("kept"))
    lists = lists.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kept"))).alias("slots"))
    joined = limited.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "uppers").join(lists, "anchor")
    suffixes = joined.withColumn("suffixes", F.expr(merged_suffixes(positives, negatives)))
    place = (F.array_position("uppers", F.col("upper")) - 1).cast("int")
    window = F.filter(F.get(F.col("suffixes"), place), lambda n: n["negative_score"] >= F.col("lower"))
    answered = own.join(suffixes, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "negative")
    )
    return answered.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "negative.negative_id", "positive_score", "negative.negative_score"
    )


def merged_suffixes(slots: int, k: int) -> str:
    """SQL for the first `k` rows of each slot and all below it, from the map `slots`, by one walk from the lowest slot up."""
    kind = "array<struct<rank:int,negative_score:bigint,negative_id:bigint>>"
    none = f"CAST(array() AS {kind})"
    step = f"slice(concat(coalesce(slots[s], {none}), coalesce(get(done, 0), {none})), 1, {k})"
    return (
        f"aggregate(sequence({slots - 1}, 0, -1), CAST(array() AS array<{kind}>), "
        f"(done, s) -> concat(array({step}), done))"
    )
