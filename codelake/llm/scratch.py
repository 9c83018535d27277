"""Intermediate tables in the folder all executors share."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from a written table: lineage ends here, and a lost executor costs nothing already done."""
    path = new_folder(frame.sparkSession, name)
    schema = frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)


def small(frame: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows, else for a merge join on equal keys.

    Without a mark Spark may broadcast either side by the size of its files, which says little of rows that were
    compressed well or are exploded on their way to the join.
    """
    return F.broadcast(frame) if frame.count() <= rows else frame.hint("merge")


def whole(frame: DataFrame) -> Column:
    """All columns as one struct, so that names added beside it clash with none."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in frame.columns])


def joined(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """`rows` with the columns of `named`, which has one row per key, while any share of `rows` may have one key.

    `named` is broadcast if it was counted to be small; else every row of it is given `salts` times, and the rows of a
    key are dealt over so many tasks. Spark would size the copies as if each row were given once, so they are named a
    merge join: a table of some 200,000 rows is below its threshold, and its copies do not fit the driver.
    """
    if named.count() <= 200_000:
        return rows.join(F.broadcast(named), key, how)
    salted = rows.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    copies = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")
