"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Documents are cut into pieces, pieces are range-sorted by length, and gaps by their free room. A superstep takes all
pieces of one length, longest first: a sweep over the sorted gaps gives them their successors, the smallest gaps that
are large enough; pieces that want the same gap are told apart by their rank; the gaps are updated, and the next
length follows. Pieces that find no gap open new sequences.

Lengths and gaps are whole numbers up to the capacity, so the sorted order is that of at most `capacity` classes on
either side, whatever the corpus size, and equal gaps are runs of consecutive sequence numbers. The sweeps therefore
match runs (rank from, count) with runs (sequence from, count); this table of runs is all the driver holds. Spark
encodes the texts, ranks the pieces within their length (ranks of a task are shifted by the counts of the tasks
before it, so no length is gathered anywhere) and sends every piece to its place by a range join with the runs.
"""

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import stored
from codelake.llm.textkernel import parts
from codelake.llm.tokenids import encoder, with_end

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
RUNS = "length bigint, first bigint, count bigint, sequence bigint, each bigint, offset bigint"
BROADCAST_RUNS = 200_000  # rows of 48 bytes


def cut(docs: DataFrame, tokenizer: str, capacity: int, end: int, with_ids: bool = False, ordinary: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids; only the first piece of a document may be shorter than that.

    `nth` counts the earlier pieces of the same length in the same task, `part`.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in parts(batches):
            ids, sizes = with_end(*encoder(tokenizer, ordinary=ordinary).encode(batch.column("text")), end)
            if not len(sizes):
                continue
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            short = sizes - (count - 1) * capacity
            length = np.where(number == 0, short[row], capacity)
            stop = np.cumsum(length)
            words = ids.astype("<u4")
            spans = list(zip((stop - length).tolist(), stop.tolist(), strict=True))
            crc = np.fromiter((zlib.crc32(words[a:b]) for a, b in spans), np.int64, len(spans))
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - (np.cumsum(many) - many)[length[order]]
            nth += seen[length]
            seen += many
            columns = [
                batch.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)),
                pa.array(stop - length - np.repeat(np.cumsum(sizes) - sizes, count)), pa.array(length), pa.array(crc),
                pa.array(np.full(len(row), part, np.int32)), pa.array(nth),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The runs that place `counts[length]` pieces of each length.

    A run (length, first, count, sequence, each, offset) puts the pieces of ranks first .. first + count - 1 into
    consecutive sequences from `sequence`, `each` per sequence, the first of them at `offset`.
    """
    runs, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room: runs of sequences (first, count)
    rooms: list[int] = []  # its keys in order

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, have = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, first, have = capacity, opened, -(-left // (capacity // length))
                opened += have
            each = room // length
            used = min(have, -(-left // each))
            count = min(left, used * each)
            runs.append((length, rank, count, first, each, capacity - room))
            filled = count // each
            leave(room - each * length, first, filled)
            leave(room - (count % each) * length, first + filled, used - filled)
            leave(room, first + used, have - used)
            rank, left = rank + count, left - count
    return runs


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, with_ids: bool = False, ordinary: bool = False
) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed as documents of their
    own. Columns other than doc_id and text are ignored; an empty table gives no rows. Equal lengths are ranked by
    task and position, so ties are placed in the order in which they were read. With `ordinary` the string of a special
    token inside a text is encoded as ordinary text. A very long text is encoded whole, in one task.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, tokenizer, capacity, end, with_ids, ordinary), "pieces")
    cells = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = spark.createDataFrame(supersteps(counts, capacity), RUNS)
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    base = cells.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS base")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    p, r = ranked.alias("p"), runs.alias("r")
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first")) & (
        F.col("rank") < F.col("first") + F.col("count")
    )
    beyond = F.col("rank") - F.col("first")
    return p.join(r, inside).select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("sequence") + F.floor(beyond / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + beyond % F.col("each") * F.col("p.length")).alias("offset"),
        *["ids"] * with_ids,
    )
