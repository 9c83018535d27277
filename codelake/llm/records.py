"""Token ids in files of length-delimited binary records, with a separate offset index.

Record: length of the payload (8 bytes), masked CRC-32C of that length (4), payload, masked CRC-32C of the payload
(4), all little-endian. A payload is one document's ids with the end id, as 16-bit numbers where the vocabulary
allows, else 32-bit. The index is a Parquet table (doc_id, part, offset, n_tokens, before); with it a reader fetches
any records in any order, and checks both checksums of each.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.checksums import crc32c, masked
from codelake.llm.scratch import new_folder
from codelake.llm.textkernel import parts
from codelake.llm.tokenids import encoder, with_end

HEAD, TAIL = 12, 4
READ = 8 << 20  # bytes fetched at a time

FILE_BYTES = 256 << 20  # of text in one file
INDEX = "doc_id bigint, part int, offset bigint, n_tokens bigint, before bigint"


@dataclass(frozen=True)
class Records:
    """A written data set: the folder of the data files, bytes per id, and the index."""

    folder: str
    width: int
    index: DataFrame


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def framed(ids: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The records' bytes, and where each begins."""
    unit = np.dtype(f"<u{width}")
    head, tail = HEAD // width, TAIL // width
    whole = sizes + head + tail
    begin = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()), unit)
    body = np.ones(len(out), bool)
    lengths = (sizes * width).astype("<u8")
    header = np.empty((len(sizes), HEAD), np.uint8)
    header[:, :8] = lengths.view(np.uint8).reshape(-1, 8)
    header[:, 8:] = masked(crc32c(lengths.view("<u2"), np.full(len(sizes), 4))).astype("<u4").view(np.uint8).reshape(-1, 4)
    at = (begin[:, None] + np.arange(head)).ravel()
    out[at] = header.view(unit).ravel()
    body[at] = False
    payload = ids.astype(unit)
    at = (begin[:, None] + head + sizes[:, None] + np.arange(tail)).ravel()
    out[at] = masked(crc32c(payload.view("<u2"), sizes * (width // 2))).astype("<u4").view(unit)
    body[at] = False
    out[body] = payload
    return out, begin * width


def write(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 2, width: int = 2, ordinary: bool = False
) -> Records:
    """Encode the documents and write them in ascending doc_id order, one file per range of doc_ids.

    A null or empty text is a record of the end id alone. Null doc_ids come first; rows equal in doc_id are all kept,
    in the order they were read. Only doc_id and text are used; an empty table gives no files. A file is written under
    a name of the attempt and then renamed, so a task that runs again replaces its own file with the same bytes. There
    are as many files as shuffle partitions, or more where a file would hold over FILE_BYTES of text; a very long text is
    a single record. With `ordinary` the string of a special token inside a text is encoded as ordinary text.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    texts = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint")), F.lit(0)).alias("n"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.first()["n"] // FILE_BYTES))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = rows.repartitionByRange(files, "doc_id", "at").sortWithinPartitions("doc_id", "at")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(f"{folder}/data")
        task = TaskContext.get()
        part, offset, before, stream = task.partitionId(), 0, 0, None
        temporary = f"{path}/.{part}-{task.taskAttemptId()}"
        for batch in parts(batches):
            ids, sizes = with_end(*encoder(tokenizer, ordinary=ordinary).encode(batch.column("text")), end)
            if not len(sizes):
                continue
            if width == 2 and int(ids.max()) > 0xFFFF:
                raise ValueError("ids need width 4")
            data, begin = framed(ids, sizes, width)
            if stream is None:
                store.create_dir(path, recursive=True)
                stream = store.open_output_stream(temporary)
            stream.write(data.data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(begin + offset),
                    pa.array(sizes), pa.array(np.cumsum(sizes) - sizes + before),
                ],
                names=["doc_id", "part", "offset", "n_tokens", "before"],
            )
            offset += data.nbytes
            before += int(sizes.sum())
        if stream is not None:
            stream.close()
            store.move(temporary, file_name(path, part))

    order.mapInArrow(put, INDEX).write.parquet(f"{folder}/index")
    return Records(folder, width, spark.read.schema(INDEX).parquet(f"{folder}/index"))


def file_name(path: str, part: int) -> str:
    return f"{path}/ids-{part:06d}.rec"


def with_start(index: DataFrame) -> DataFrame:
    """The index with `start`, the ids of all documents before; sums run over files, then inside a file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).selectExpr(
        "part", "sum(n) OVER (ORDER BY part) - n AS base"
    )  # one row per file
    return index.join(totals, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read(records: Records, index: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """The records that the rows of `index` name: its columns, ids_crc32, and the ids as well if asked for.

    `ids_crc32` is the CRC-32 of the ids as little-endian 32-bit numbers. A record whose length or checksum is wrong
    raises an error.
    """
    import zlib

    index = records.index if index is None else index
    folder, width = f"{records.folder}/data", records.width
    schema = index.schema.simpleString()[7:-1].replace(":", " ") + ", ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def runs(part: np.ndarray, offset: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        """Rows that follow each other in one file, in runs of about READ bytes."""
        order = np.lexsort((offset, part))
        p, o, s = part[order], offset[order], size[order]
        gap = np.flatnonzero((p[1:] != p[:-1]) | (o[1:] != o[:-1] + s[:-1])) + 1
        for run in np.split(order, gap):
            sums = np.cumsum(size[run])
            yield from (x for x in np.split(run, np.searchsorted(sums, np.arange(READ, sums[-1], READ))) if len(x))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        unit = np.dtype(f"<u{width}")
        head, tail = HEAD // width, TAIL // width
        name, stream = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False)
            offset = batch.column("offset").to_numpy(zero_copy_only=False)
            tokens = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            size = tokens * width + HEAD + TAIL
            crc = np.zeros(n, np.int64)
            ids: list = [None] * n
            for run in runs(part, offset, size):
                if name != part[run[0]]:
                    name, stream = part[run[0]], store.open_input_file(file_name(path, part[run[0]]))
                raw = stream.read_at(int(size[run].sum()), int(offset[run[0]]))
                data = np.frombuffer(raw, unit)
                begin = (offset[run] - offset[run[0]]) // width
                body = np.ones(len(data), bool)
                body[(begin[:, None] + np.arange(head)).ravel()] = False
                body[(begin[:, None] + head + tokens[run][:, None] + np.arange(tail)).ravel()] = False
                payload = data[body]
                expected, _ = framed(payload, tokens[run], width)
                if not np.array_equal(expected, data):
                    raise ValueError(f"damaged record in {file_name(path, part[run[0]])}")
                wide, stop = payload.astype("<u4"), np.cumsum(tokens[run])
                for i, hi, length in zip(run.tolist(), stop.tolist(), tokens[run].tolist(), strict=True):
                    crc[i] = zlib.crc32(wide[hi - length : hi])
                    if with_ids:
                        ids[i] = payload[hi - length : hi]
            columns = [*batch.columns, pa.array(crc)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids_crc32", *["ids"] * with_ids])

    return index.mapInArrow(get, schema)
