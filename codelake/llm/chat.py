"""Chat formatting by prefix-target expansion: one training example per assistant turn.

An example holds every turn before the reply as context and the reply as the only trainable part. Turns after the
last reply train nothing; they follow in one example without a target, so that no turn is lost.

All examples of a conversation are prefixes of one text. `lay_out` gives that text as a table of turns, each with where
it begins; the turn that ends an example carries the example's number and loss mask. `write_out` makes the examples of it,
each with its whole context, and `digest` reads these back. No conversation is put together in one row.

Template of a turn: START role SEP text END. Control strings begin with `<|`; inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so a control string there can never be read as one and unescaping gives the text back.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.scratch import joined, stored

START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
CELL = 1000  # turn numbers whose rows are put in order together
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP), escape(text), F.lit(END))


def lay_out(conversations: DataFrame, cell: int = CELL) -> DataFrame:
    """Turns (conv_id, conversation, nth, start, formatted, example, loss_start, loss_length) from rows (conv_id, turn, role, text).

    `nth` counts a conversation's turns from 0 and `start` the code points of the turns before. A turn that ends an
    example has its number (from 0, in the order of the replies), else null; the example is all text up to the end of
    that turn, and `loss_start` (from 0) and `loss_length` give its trainable code points, length 0 without a target.

    Null roles and texts count as empty. Turns are ordered by number (null first), then role, then text, so ties and
    repeated rows come in one order and are all kept. Rows without a conv_id belong to no other row: each is a
    conversation of its own. Other columns are ignored; an empty table gives no rows. A long conversation is put in order
    in cells of `cell` turn numbers, each shifted by the sums of those before it, so only rows that share a stretch of
    numbers are in one task, and those may spill. A very long text is one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    number = F.col("turn").cast("bigint")
    conv = F.col("conv_id").cast("bigint")
    rows = conversations.select(
        conv.alias("conv_id"),
        F.coalesce(conv.cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id())).alias("conversation"),
        F.coalesce(F.floor(number / cell), F.lit(-(2**63))).alias("cell"),
        number.alias("turn"), role.alias("role"), text.alias("text"),
        F.char_length(format_turn(role, text)).cast("bigint").alias("chars"), (role == TRAINED_ROLE).alias("trained"),
    )
    order = Window.partitionBy("conversation", "cell").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.count(F.lit(1)), "nth"), (F.sum("chars"), "start"), (F.sum(F.col("trained").cast("bigint")), "example")]
    placed = rows.select(
        "*", *[F.coalesce(s.over(before), F.lit(0)).alias(c) for s, c in sums], F.lead(F.lit(1)).over(order).isNull().alias("last")
    )
    placed = stored(placed.select(
        "conv_id", "conversation", "cell", "nth", "start", "example", "chars", "trained", "last",
        F.char_length(escape(F.col("text"))).alias("reply"), format_turn(F.col("role"), F.col("text")).alias("formatted"),
    ), "turns")

    cells = placed.groupBy("conversation", "cell").agg(*[s.alias(c) for s, c in sums])
    along = Window.partitionBy("conversation").orderBy("cell")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(
        place(), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for _, c in sums],
        F.lead(F.lit(1)).over(along).isNotNull().alias("followed"), F.count("*").over(Window.partitionBy("conversation")).alias("n"),
    )
    bases = stored(bases.filter("n > 1").drop("n"), "cells")

    turns = joined(placed.withColumn("place", place()), bases, "place", "left")
    nth, start, example = (F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for _, c in sums)
    ends = F.col("trained") | (F.col("last") & ~F.coalesce("followed", F.lit(False)))
    length = F.when(F.col("trained"), F.col("reply")).otherwise(0)
    return turns.select(
        "conv_id", "conversation", nth.alias("nth"), start.alias("start"), "formatted", example.alias("first"),
        F.when(ends, example).alias("example"),
        F.when(ends, start + F.col("chars") - len(END) - length).alias("loss_start"), F.when(ends, length).alias("loss_length"),
    )


def place() -> Column:
    return F.concat("conversation", F.lit(" "), F.col("cell").cast("string")).alias("place")


def write_out(turns: DataFrame) -> DataFrame:
    """The examples of `lay_out`'s turns, written out in full and read back: rows (conv_id, conversation, example, nth, start,
    formatted, loss_start, loss_length, last), the turns of an example side by side in a file.

    Each example has all turns up to its reply; its text is their `formatted` in order, and the row that ends it says where
    the mask lies in that text. `last` marks a conversation's last example, which holds all its turns. What this writes grows
    with the square of a conversation's length. An example is never one row, and those of a conversation are dealt over tasks.
    """
    final = turns.filter("example IS NOT NULL").groupBy("conversation").agg(F.max("example").alias("final"))
    held = joined(turns, stored(final, "final"), "conversation").withColumn("of", F.explode(F.sequence("first", "final")))
    mask = [F.when(F.col("example") == F.col("of"), F.col(c)).alias(c) for c in ("loss_start", "loss_length")]
    last = (F.col("of") == F.col("final")).alias("last")
    rows = held.select("conv_id", "conversation", F.col("of").alias("example"), "nth", "start", "formatted", *mask, last)
    dealt = rows.repartition("conversation", "example").sortWithinPartitions("conversation", "example", "nth")
    return stored(dealt, "examples")


def expand(turns: DataFrame) -> DataFrame:
    """The examples (conv_id, conversation, example, formatted, loss_start, loss_length) of `lay_out`'s turns, a whole text in a row.

    Where a text is too much for a row, train from the rows of `write_out`.
    """
    held = F.array_sort(F.collect_list(F.struct("nth", "formatted")))
    return write_out(turns).groupBy("conv_id", "conversation", "example").agg(
        F.max("loss_start").alias("loss_start"), F.max("loss_length").alias("loss_length"),
        F.array_join(F.transform(held, lambda t: t["formatted"]), "").alias("formatted"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|text\|>"))
    return F.transform(body, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, length))


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation of `lay_out`'s turns, read back from its written examples alone.

    What was said is read from the last example, a reply under its mask from its own example, and the length from all of them.
    The digests of a conversation are carried from row to row of its turns; a task holds one batch of them.
    """
    written = write_out(turns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, said, learnt, sums = None, None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def row() -> dict:
            return {
                "conv_id": conv_id, "n_turns": sums[0], "turns_sha256": said.hexdigest(), "loss_chars": sums[1],
                "loss_sha256": learnt.hexdigest(), "formatted_chars": sums[2],
            }

        schema = pa.schema([(f, pa.string() if "sha" in f else pa.int64()) for f in row()])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["conversation"] != now:
                    if now is not None:
                        done.append(row())
                    now, conv_id, sums = r["conversation"], r["conv_id"], [0, 0, 0]
                    said, learnt = hashlib.sha256(), hashlib.sha256()
                if r["said"] is not None:
                    said.update(r["said"].encode())
                    sums[0] += 1
                if r["loss"] is not None:
                    learnt.update(r["loss"].encode())
                    sums[1] += len(r["loss"])
                sums[2] += r["chars"] or 0
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    turn = read_turns(F.col("formatted"))[0]
    loss = read_loss(F.col("formatted"), (F.col("loss_start") - F.col("start")).cast("int"), F.col("loss_length"))
    read = written.filter("last OR loss_start IS NOT NULL").select(
        "conv_id", "conversation", "nth",
        F.when(F.col("last"), F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))).alias("said"),
        loss.alias("loss"), F.lit(None).cast("bigint").alias("chars"),
    )
    lengths = written.groupBy("conv_id", "conversation").agg(F.sum(F.char_length("formatted")).cast("bigint").alias("chars"))
    nothing = F.lit(None).cast("string")
    sizes = lengths.select("conv_id", "conversation", F.lit(-1).alias("nth"), nothing.alias("said"), nothing.alias("loss"), "chars")
    rows = read.unionByName(sizes).repartition("conversation").sortWithinPartitions("conversation", "nth")
    return rows.select("conv_id", "conversation", "said", "loss", "chars").mapInArrow(fold, DIGESTS)
