"""Tables made on the way: a few given rows, and what is derived from requests."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelake.session import shared_folder


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few given rows that lives in the plan, without a task to make it."""
    shape = schema_of(schema)
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in shape]
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(shape)), schema=shape)


def schema_of(schema: str) -> StructType:
    return StructType.fromDDL(schema)


HELD = 5_000  # rows that live in a plan


def settled(frame: DataFrame, name: str, held: int = HELD) -> DataFrame:
    """The frame's rows, computed now: within the plan if they are at most ``held``, else from a table in the shared folder.

    What is derived from requests is used several times in a plan. This way it is computed once, and Spark
    knows its size when it chooses how to join, however many requests there are.
    """
    if held:
        few = frame.limit(held + 1).toArrow()
        if few.num_rows <= held:
            return frame.sparkSession.createDataFrame(few, schema=frame.schema)
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


NAMED = 500  # values that are named to a scan


def only(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose value of ``column`` is among those of ``wanted``, if these are few; else all rows.

    Named as literals the values reach the scan, and a sorted table skips what lies between them. The join that follows
    is needed all the same. ``wanted`` is settled, so asking it costs no job while it is small.
    """
    values = {r[0] for r in wanted.select(column).limit(HELD + 1).collect()}
    return rows if len(values) > NAMED else rows.filter(F.col(column).isin(sorted(v for v in values if v is not None)))


def beside(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Rows joined by ``column`` with what was found for them.

    How to join follows from the number of rows found, which are written down for that: few go to all tasks, many are
    shuffled. What Spark estimates of rows made from other rows says nothing, and may send all ``rows`` to the driver.
    """
    found = settled(found, "found", held=0)
    few = found.limit(HELD + 1).count() <= HELD
    return rows.join(F.broadcast(found) if few else found.hint("merge"), column)


def measured(watch: Observation, *names: str) -> dict[str, int]:
    """The observed values; zeros where Spark saw that no row can come and left the observed part out of the job."""
    return dict(watch.get) if watch._jo.getRow().size() else dict.fromkeys(names, 0)
