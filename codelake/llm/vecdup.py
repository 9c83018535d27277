"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

1. Rows are numbered and written. Equal vectors of one label become one class with a count; from here on one row per
   class is compared.
2. Each label has cells by spherical k-means: a few rounds over all vectors, each giving sums per cell that are combined
   in the tasks. There are never more than `MOST_CELLS` centroids in all, whatever the number of rows.
3. A vector lies in the cell of its nearest centroid. Two vectors of different cells c and d can only be as near as the
   threshold if both lie that near the great circle that parts c and d, so a vector is also a guest in each such cell,
   of the two that with the smaller number. Thus cells lose no link.
4. A cell is cut into blocks of bounded bytes. A task gets two blocks, multiplies them, and gives for each vector the
   number of links it found and the smallest vector it is connected with there: a group of copies never becomes a list
   of its pairs.
5. Counts are added up, and connections merged into components. The representative is the smallest id of its component.

Where vectors lie in all directions alike, nearly every vector is a guest in half of the cells, and the products are
those of all pairs of a label: the price of losing no link.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.components import components
from codelake.llm.negatives import finite, matrix_of
from codelake.llm.scratch import joined, small, stored

CELL_ROWS = 2048  # vectors that a cell is meant to have
MOST_CELLS = 4096  # centroids of all labels together
ROUNDS = 4
BLOCK_BYTES = 4 << 20  # of 8-byte components
STRIP = 512  # rows of a block that are multiplied at once
GROUP = ["label", "dims"]
CELL = [*GROUP, "cell"]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(label, dims), row places and unit vectors of each group of a batch with label and vector."""
    label = batch.column("label").to_numpy()
    dims = batch.column("vector").value_lengths().to_numpy()
    for key in sorted(set(zip(label.tolist(), dims.tolist(), strict=True))):
        at = np.flatnonzero((label == key[0]) & (dims == key[1]))
        yield key, at, unit(matrix_of(batch.column("vector"), key[1], at))


def centroids_of(rows: DataFrame, cell_rows: int, rounds: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit centroids of each (label, dims) with more than `cell_rows` rows, by spherical k-means over all rows.

    The list is bounded by MOST_CELLS: a label gets a cell for every `cell_rows` rows, or for every 1/MOST_CELLS of all
    rows if that is more. The first centroids are rows chosen by a hash of their number, about two for each cell, of
    which the first are taken.
    """
    sizes = stored(rows.groupBy(*GROUP).agg(F.count("*").alias("n")), "labels")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = max(cell_rows, -(-total // MOST_CELLS))
    # At most MOST_CELLS / 2 labels have two cells or more.
    wanted = {(r.label, r.dims): r.n // each for r in sizes.filter(F.col("n") >= 2 * each).collect()}
    if not wanted:
        return {}
    share = sizes.filter(F.col("n") >= 2 * each).select(*GROUP, (F.lit(2.0) / each).alias("share"))
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    first = rows.join(F.broadcast(share), GROUP).filter(draw < F.col("share")).select(*GROUP, "row", "vector")
    drawn: dict[tuple[int, int], list] = {}
    for r in first.orderBy(*GROUP, F.xxhash64("row"), "row").toLocalIterator():
        chosen = drawn.setdefault((r.label, r.dims), [])
        if len(chosen) < wanted[r.label, r.dims]:
            chosen.append(list(r.vector))
    found = {key: unit(np.array(v)) for key, v in drawn.items()}
    for _ in range(rounds):
        found = moved(rows, found)
    return found


def moved(rows: DataFrame, found: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """One round: every vector goes to its nearest centroid, every centroid into the direction of its vectors' sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros_like(c) for key, c in found.items()}
        for batch in batches:
            for key, _, x in by_group(batch):
                if key in found:
                    np.add.at(sums[key], (x @ found[key].T).argmax(axis=1), x)
        for (label, dims), s in sums.items():
            cells, places = np.nonzero(s)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cells), label, np.int64)), pa.array(np.full(len(cells), dims, np.int32)),
                    pa.array(cells.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(s[cells, places]),
                ],
                names=[*CELL, "place", "x"],
            )

    parts = rows.select("label", "vector").mapInArrow(add, "label bigint, dims int, cell int, place int, x double")
    # MOST_CELLS vectors at most.
    table = parts.groupBy(*CELL, "place").agg(F.sum("x").alias("x")).toArrow()
    out = {key: np.zeros_like(c) for key, c in found.items()}
    columns = [table.column(c).to_numpy() for c in (*CELL, "place", "x")]
    for label, dims, cell, place, x in zip(*columns, strict=True):
        out[label, dims][cell, place] = x
    for key, c in out.items():
        empty = ~c.any(axis=1)
        c[empty] = found[key][empty]
        out[key] = unit(c)
    return out


def placed(rows: DataFrame, centroids: dict[tuple[int, int], np.ndarray], least: float) -> DataFrame:
    """(label, dims, cell, guest, row, copies, vector): each row in its own cell, and as a guest in those it may have
    links in."""
    reach = float(np.sqrt(max(0.0, 1 - least * least))) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dims), at, x in by_group(batch):
                own, rows_, cells = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
                if (c := centroids.get((label, dims))) is not None:
                    near = x @ c.T
                    own = near.argmax(axis=1)
                    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 1e-30))
                    # The sine of the angle to the great circle between the two cells; equal centroids part nothing.
                    sine = (near[np.arange(len(at)), own][:, None] - near) / apart[own]
                    may = (sine <= reach) & (np.arange(len(c)) < own[:, None])
                    rows_, cells = np.nonzero(may)
                    rows_, cells = np.append(np.arange(len(at)), rows_), np.append(own, cells)
                guest = np.arange(len(rows_)) >= len(at)
                part = batch.take(pa.array(at[rows_]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows_), label, np.int64)), pa.array(np.full(len(rows_), dims, np.int32)),
                        pa.array(cells.astype(np.int32)), pa.array(guest), part.column("row"), part.column("copies"), part.column("vector"),
                    ],
                    names=[*CELL, "guest", "row", "copies", "vector"],
                )

    vector = rows.schema["vector"].dataType.simpleString()
    schema = f"label bigint, dims int, cell int, guest boolean, row bigint, copies bigint, vector {vector}"
    return rows.select("label", "row", "copies", "vector").mapInArrow(place, schema)


def found_in(rows: DataFrame, least: float, block_bytes: int) -> DataFrame:
    """(row, links, root) of `placed` rows: in each pair of blocks, the links of a row and the smallest row it is connected
    with there.

    A row of block b meets block c in the task (b, c), a guest every block in the task of its own block of guests; the
    first block of guests shares a task with each block's own.
    """
    member, guest = F.count_if(~F.col("guest")), F.count_if("guest")
    in_block = F.greatest(F.lit(1), F.lit(block_bytes).cast("bigint") / (8 * F.greatest("dims", F.lit(1))))
    sizes = rows.groupBy(*CELL).agg(member.alias("members"), guest.alias("guests"))
    sizes = stored(
        sizes.select(
            *CELL, F.greatest(F.lit(1), F.ceil(F.col("members") / in_block)).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("guests") / in_block)).cast("int").alias("guest_blocks"),
        ),
        "cells",
    )
    cut = rows.join(small(sizes), CELL)
    own = F.pmod(F.xxhash64("row"), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("blocks"))).cast("int")
    # Tasks are (a, b): blocks a <= b, or the block of guests -a with the block b.
    as_member = (
        "concat(transform(sequence(0, blocks - 1), c -> struct(least(c, own) AS a, greatest(c, own) AS b)), "
        "filter(transform(sequence(0, guest_blocks - 1), g -> struct(-g AS a, own AS b)), t -> t.a < 0))"
    )
    as_guest = "transform(sequence(0, blocks - 1), b -> struct(IF(own = 0, b, -own) AS a, b AS b))"
    tasks = cut.withColumn("own", own).select(
        *CELL, F.inline(F.expr(f"IF(guest, {as_guest}, {as_member})")).alias("a", "b"),
        F.struct("guest", "own", "row", "copies", "vector").alias("entry"),
    )
    shared = tasks.groupBy(*CELL, "a", "b").agg(F.collect_list("entry").alias("entries"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, dims = (batch.column(c)[i].as_py() for c in ("a", "b", "dims"))
                entries = batch.column("entries")[i].values
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in linked(entries, a, b, dims, least)], names=["row", "links", "root"])

    return shared.select("a", "b", "dims", "entries").mapInArrow(compare, "row bigint, links bigint, root bigint")


def linked(entries: pa.StructArray, a: int, b: int, dims: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one task that have links there, with their number and the smallest row of their component in the task."""
    guest = entries.field("guest").to_numpy(zero_copy_only=False)
    own, row, copies = (entries.field(c).to_numpy() for c in ("own", "row", "copies"))
    x = unit(matrix_of(entries.field("vector"), dims, np.arange(len(row))))
    short = x.astype(np.float32)
    slack = 1e-6 + dims * 1.2e-7  # what a product of single precision may be off
    inside = np.flatnonzero(~guest & (own == b))
    other = inside if a == b else np.flatnonzero(~guest & (own == a)) if a >= 0 else np.zeros(0, np.int64)
    root, links = np.arange(len(row)), np.zeros(len(row), np.int64)
    for asking in (other, np.flatnonzero(guest)):
        for lo in range(0, len(asking), STRIP):
            strip = asking[lo : lo + STRIP]
            maybe = short[strip] @ short[inside].T >= least - slack
            if asking is inside:
                maybe &= strip[:, None] < inside[None, :]
            left, right = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(left):
                continue
            sure = maybe[np.ix_(left, right)] & (x[strip[left]] @ x[inside[right]].T >= least)
            i, j = strip[left], inside[right]
            links[i] += sure @ copies[j]
            links[j] += copies[i] @ sure
            for k in range(len(i)):
                if len(mine := j[sure[k]]):
                    roots = np.unique(np.append(root[mine], root[i[k]]))
                    if len(roots) > 1:
                        root[np.isin(root, roots)] = roots[0]
    hit = np.flatnonzero(links)
    smallest = np.full(len(row), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, row)
    return row[hit], links[hit], smallest[root[hit]]


def groups(
    rows: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    cell_rows: int = CELL_ROWS, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Two rows are linked if their labels are equal, their vectors equally long, and the cosine is at least `least` (above
    0), in double precision. `component_id` is the smallest vec_id reachable by links, itself included; `kept` tells the
    representative. Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null label
    have no links. Rows are told apart by position: repeated rows are linked with each other, count each, and are all
    kept if theirs is the smallest id. A null vec_id sorts last and is a component's id only where there is no other. A
    very long vector is a block of its own. Labels are whole numbers. Other columns are ignored; an empty table gives no
    rows.
    """
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    fits = F.col("label").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    base = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).cast("bigint").alias("label"), F.col(vector).cast(kind).alias("vector"),
    )
    # Written once: the row numbers of this reading tell rows apart from here on.
    numbered = stored(
        base.withColumn("fits", F.coalesce(fits, F.lit(False))).select(
            "row", "vec_id", "label", F.when(F.col("fits"), F.col("vector")).alias("vector"), "fits",
            F.xxhash64(F.lit(1), "label", "vector").alias("h1"), F.xxhash64(F.lit(2), "vector", "label").alias("h2"),
        ),
        "vectors",
    )
    order = F.struct(F.col("vec_id").isNull().alias("nameless"), "vec_id")
    repeats = stored(
        numbered.filter("fits").groupBy("h1", "h2").agg(F.min("row").alias("class"), F.count("*").alias("copies"), F.min(order).alias("top"))
        .filter("copies > 1"),
        "repeats",
    )
    of_class = repeats.select("h1", F.struct("h2", "class", "copies").alias("same"))
    of_class = stored(of_class.groupBy("h1").agg(F.collect_list("same").alias("same")), "repeats")
    slim = joined(numbered.select("row", "vec_id", "fits", "h1", "h2"), of_class, "h1", "left")
    # Where different vectors share one 64-bit hash, the other tells them apart.
    same = F.get(F.filter("same", lambda s: s["h2"] == F.col("h2")), F.lit(0))
    slim = stored(
        slim.select("row", "vec_id", "fits", F.when(F.col("fits"), same).alias("same")).select(
            "row", "vec_id", "fits", F.coalesce("same.class", "row").alias("class"), F.coalesce("same.copies", F.lit(1)).alias("copies")
        ),
        "classes",
    )
    spare = stored(slim.filter("row <> class").select("row"), "spare")
    alone = numbered.filter("fits").withColumn("dims", F.size("vector")).join(small(spare), "row", "left_anti")
    counted = joined_copies(alone, repeats)
    centroids = centroids_of(counted, cell_rows, rounds)
    found = stored(found_in(placed(counted, centroids, least), least, block_bytes), "found")

    labels = components(found.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("row").alias("class")).agg(F.sum("links").alias("links"))
    tops = slim.filter("fits").groupBy("class").agg(F.min(order).alias("top"))
    joint = labels.withColumnRenamed("v", "class").join(tops, "class")
    smallest = stored(joint.groupBy("label").agg(F.min("top").alias("top")), "tops")
    merged = joined(joint.select("class", "label"), smallest, "label").select("class", F.col("top.vec_id").alias("linked_id"))
    copied = repeats.select("class", F.col("top.vec_id").alias("copied_id"))
    named = links.join(merged, "class", "full").join(copied, "class", "full")
    named = stored(
        named.select("class", "links", F.coalesce("linked_id", "copied_id").alias("top_id"), F.lit(True).alias("named")), "named"
    )
    out = joined(slim, named, "class", "left")
    component = F.when(F.col("named"), F.col("top_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def joined_copies(alone: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows that are compared, with the number of rows each stands for."""
    counts = repeats.select(F.col("class").alias("row"), "copies")
    return alone.join(small(counts), "row", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
