"""WARC archives through a table of payload chunks.

A payload is a sequence of rows (record, chunk, data) of bounded size, cut before anything is shuffled or sent to Python.
The writer carries a record's digest from chunk to chunk and checks it at the last one. A row that is read back has the
length and digest of all bytes up to its end, so the last row of a record has those of the whole payload. Neither side
holds a whole record. Archives are `.warc.gz` files, one gzip member per record, one file per task.
"""

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.records import opened
from codelake.llm.scratch import new_folder, stored

CHUNK = 256 << 10
FEW = 200_000  # revisits (rows of 60 bytes) that are broadcast
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

CHUNKS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, chunk int, "
    "last boolean, bytes_so_far bigint, digest_so_far string, payload_bytes bigint, data binary"
)


def bare(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row (page_id, sha1, refers_to) per distinct page_id and payload.

    Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is written in full and
    the others refer to it. Rows equal in page_id and payload get the same treatment. Pages without a page_id refer to
    the group's largest page_id; a group of such pages alone is written in full.
    """
    slim = stored(digested(pages).select("page_id", "sha1", "bytes").distinct(), "digests")
    # Groups of one need no lookup. Written down, so that the join below shuffles plain rows and splits a hot payload.
    groups = slim.filter(F.col("bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1").select("sha1", "top"), "payload-groups")
    return slim.join(groups, "sha1", "left").select(
        "page_id", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")
    )


def digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))


def chunked(pages: DataFrame, least: int = 0, size: int = CHUNK, most: int = FEW) -> DataFrame:
    """The chunk rows to write; a record's rows follow each other. A revisit is one row without data.

    Up to `most` revisits are broadcast, and the payloads stay where they are read. Beyond that the chunk rows are
    shuffled and sorted: the rows of a record come from one task, so a page split among several tasks stays in order.
    """
    revisits = stored(plan(pages, least).filter("refers_to IS NOT NULL"), "revisits")
    few = revisits.count() <= most
    n = F.greatest(F.ceil(F.col("bytes") / size), F.lit(1)).cast("int")
    rows = digested(pages).select("*", F.monotonically_increasing_id().alias("row"), n.alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    data = F.substring("payload", F.col("chunk") * size + 1, F.lit(size))
    p = rows.select("page_id", "url", "sha1", "bytes", "row", "n", "chunk", data.alias("data")).alias("p")
    d = (F.broadcast(revisits) if few else revisits).alias("d")
    found = p.join(d, F.col("p.page_id").eqNullSafe(F.col("d.page_id")) & (F.col("p.sha1") == F.col("d.sha1")), "left")
    again = F.col("refers_to").isNotNull()
    kept = found.filter(~again | (F.col("chunk") == 0)).select(
        "p.page_id", "url", "p.sha1", "bytes", "refers_to", "row", "chunk",
        (again | (F.col("chunk") + 1 == F.col("n"))).alias("last"), F.when(~again, F.col("data")).alias("data"),
    )
    return (kept if few else kept.sortWithinPartitions("row", "chunk")).drop("row")


def head(page_id: int | None, url: str | None, sha1: str, size: int, refers_to: int | None) -> tuple[bytes, bytes]:
    """WARC and HTTP headers of a record. Line ends in an address are percent-encoded.

    A record's id is that of its page and payload: only rows equal in both give records with one id.
    """
    http = HTTP % size
    name = f"<urn:page:{{}}:{sha1}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name.format("" if page_id is None else page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + bare(bytes.fromhex(sha1))),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (size if refers_to is None else 0))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", name.format(refers_to)), ("WARC-Profile", PROFILE)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode(), http


def write(pages: DataFrame, folder: str | None = None, least: int = 0, size: int = CHUNK, most: int = FEW) -> DataFrame:
    """Write the pages to archives below `folder`; one row (file, records) per archive.

    Null payloads are empty and null addresses are left out. Repeated rows become repeated records. Columns other than
    page_id, url and html are ignored; an empty table gives no archive. A very long payload is chunk rows. An archive is renamed when complete, so a task
    that runs again replaces its own.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        task = TaskContext.get()
        temporary, name = f"{path}/data/.{task.partitionId()}-{task.taskAttemptId()}", f"data/{task.partitionId():06d}.warc.gz"
        out, records, sha, gz = None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(f"{path}/data", recursive=True)
                    out = store.open_output_stream(temporary)
                if row["chunk"] == 0:
                    gz, sha = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
                    for part in head(row["page_id"], row["url"], row["sha1"], row["bytes"], row["refers_to"]):
                        out.write(gz.compress(part))
                if row["data"]:
                    sha.update(row["data"])
                    out.write(gz.compress(row["data"]))
                if row["last"]:
                    if row["refers_to"] is None and sha.hexdigest() != row["sha1"]:
                        raise ValueError(f"chunks of page {row['page_id']} are not its payload")
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    records += 1
        if out is not None:
            out.close()
            store.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [records]})

    files = chunked(pages, least, size, most).mapInArrow(put, "file string, records bigint")
    return stored(files, "archives")


def read(files: DataFrame, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives in column `file`, read as streams; a wrong payload digest raises an error.

    `bytes_so_far` and `digest_so_far` (base32 SHA-1) cover a record's payload up to the end of the row's chunk;
    `payload_digest` and `payload_bytes` are what the record's header says. A revisit has one row without data.
    """

    def number(uri: str | None) -> int | None:
        digits = (uri or "").removeprefix("<urn:page:").partition(":")[0]
        return int(digits) if digits else None

    def rows(file: str) -> Iterator[dict]:
        store, path = opened(file)
        with store.open_input_file(path) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as f:
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no record where one should begin in {file}")
                fields = headers(f)
                left = int(fields["content-length"])
                start = f.readline()
                http = headers(f)
                left -= len(start) + http.pop("")
                sha, done, chunk = hashlib.sha1(), 0, 0
                common = {
                    "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
                    "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
                    "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                    "payload_bytes": int(fields["x-payload-length"]),
                }
                while True:
                    data = f.read(min(size, left))
                    if len(data) < min(size, left):
                        raise ValueError(f"{file} ends inside a record")
                    sha.update(data)
                    left, done = left - len(data), done + len(data)
                    digest = bare(sha.digest())
                    if not left and common["record_type"] == "response" and digest != common["payload_digest"]:
                        raise ValueError(f"damaged payload of page {common['page_id']} in {file}")
                    yield common | {
                        "chunk": chunk, "last": not left, "bytes_so_far": done, "digest_so_far": digest,
                        "data": data if with_data else None,
                    }
                    chunk += 1
                    if not left:
                        break
                f.read(4)

    def headers(f: io.BufferedReader) -> dict:
        """Fields by lower-case name, and under the empty name the bytes they took."""
        out: dict = {"": 0}
        while line := f.readline():
            out[""] += len(line)
            if line == b"\r\n":
                return out
            key, _, value = line.decode().partition(":")
            out[key.strip().lower()] = value.strip()
        raise ValueError("an archive ends inside a header")

    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()),
            ("digest_so_far", pa.string()), ("payload_bytes", pa.int64()), ("data", pa.binary()),
        ]
    )

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for row in rows(file):
                    held.append(row)
                    weight += 1000 + len(row["data"] or b"")
                    if weight >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(get, CHUNKS)
