"""Shards by jump consistent hashing, without a ring table.

The jump hash walks through growing shard counts: from bucket b it draws the next shard count at which a key would
move, so adding a shard moves exactly the keys whose next jump lands on it. The draws come from a 64-bit linear
congruential generator seeded by the key, written here in decimal arithmetic because BIGINT would overflow.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import stored

# The generator of the published jump hash, and the modulus of 64-bit unsigned arithmetic.
MULTIPLIER = "2862933555777941757BD"
MODULUS = "18446744073709551616BD"
HIGH = "8589934592BD"  # the upper 31 bits of the state count


def jump_shards(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a BIGINT key among `shards` shards, and among one more. A null key counts as 0.

    One walk gives both: it ends at the first jump past the larger count, and keeps the last bucket below each.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    seed = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(seed < 0, seed + F.expr(MODULUS)).otherwise(seed).cast("decimal(38,0)")

    def step(s: Column, _: Column) -> Column:
        state = ((s["state"] * F.expr(MULTIPLIER) + 1) % F.expr(MODULUS)).cast("decimal(38,0)")
        # Division of a multiple is exact; of other numbers Spark would round the quotient at six places.
        high = (state - state % F.expr(HIGH)) / F.expr(HIGH)
        draw = high.cast("double") + 1
        there = F.floor((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / draw)).cast("bigint")
        moved = F.struct(
            state.alias("state"),
            there.alias("next"),
            F.when(there < shards, there).otherwise(s["now"]).alias("now"),
            F.when(there < shards + 1, there).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["next"] > shards, s).otherwise(moved)

    start = F.struct(
        unsigned.alias("state"),
        F.lit(0).cast("bigint").alias("next"),
        F.lit(0).cast("bigint").alias("now"),
        F.lit(0).cast("bigint").alias("grown"),
    )
    # Every jump goes up by one at least, so so many steps always suffice.
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return walk["now"].cast("int"), walk["grown"].cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", cell_rows: int = 5_000) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the UTF-8 length of the text (null: 0) plus 1. The key and the shard count alone decide the shard.
    Slots count 0, 1, 2, ... within a shard. They are dealt in cells: a cell is a residue class of the key within a
    shard, of about `cell_rows` rows; a cell that repeats of one key have made larger is cut into pieces by row
    position. Cells are numbered on their own and shifted by the rows of the cells before them, so no task ever holds
    a whole shard. Rows equal in key get neighbouring slots in no fixed order. A null key is placed as 0 and stays
    null. Other columns are ignored; an empty table gives no rows.
    """
    now, grown = jump_shards(F.col(key), shards)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(key).cast("bigint").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            now.alias("shard"),
            grown.alias("grown_shard"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shards",
    )
    cells = max(1, rows.count() // (shards * cell_rows))
    rows = rows.withColumn("cell", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("pieces"))
    # At most one row per cell, a few thousandths of the rows; Spark picks the join.
    rows = rows.join(counts, ["shard", "cell"]).withColumn(
        "piece", F.when(F.col("pieces") == 1, 0).otherwise(F.pmod("at", "pieces"))
    )
    lengths = stored(rows.groupBy("shard", "cell", "piece").agg(F.count("*").alias("n")), "cells")
    before = lengths.selectExpr(
        "shard", "cell", "piece",
        "sum(n) OVER (PARTITION BY shard ORDER BY cell, piece) - n AS before",
    )
    inside = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY shard, cell, piece ORDER BY doc_id NULLS FIRST, at) AS nth"
    )
    return inside.join(before, ["shard", "cell", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("nth") - 1).alias("slot"), "grown_shard",
    )
