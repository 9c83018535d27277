"""Exact percentiles per group: the value at 0-based place ``floor(n * p)`` of the sorted values."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators.small import settled

CUTS = 64  # parts into which a round divides what is in question
LEFT = 20_000  # distinct values of a group that a task may sort


def percentiles(
    rows: DataFrame, group: str, value: str, points: dict[str, float], left: int = LEFT, cuts: int = CUTS
) -> DataFrame:
    """(group, n, one column per point); a group without values has n = 0 and 0.0 everywhere.

    No task ever sorts a whole group, however its values are spread. Equal values are counted first. Then a mergeable
    quantile sketch of the distinct values in question gives cuts of about equal numbers, the rows between two cuts are
    counted exactly, and the part that holds the wanted place stays in question. This is repeated until that is at most
    ``left`` values. Infinities are values like others, NaN sorts above all; the sketch is made of the rest, and both end
    up in its last part.
    """
    kind = rows.schema[value].dataType
    values = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    names = F.array(*[F.struct(F.lit(name).alias("point"), F.lit(p).alias("p")) for name, p in points.items()])
    totals = values.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"))
    wanted = settled(
        totals.select(group, "n", "distinct", F.inline(names)).select(
            group, "point", "n", F.floor(F.col("n") * F.col("p")).alias("place"), "distinct",
            F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"),
        ),
        "places",
    )
    while not (wide := wanted.filter(F.col("distinct") > left)).isEmpty():
        narrowed = _narrowed(_in_question(values, wide, group), group, cuts)
        wanted = settled(wanted.filter(F.col("distinct") <= left).unionByName(narrowed.select(*wanted.columns)), "places")
    running = Window.partitionBy(group, "point").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = _in_question(values, wanted, group)
    reached = rest.withColumn("upto", F.sum("c").over(running)).filter(F.col("upto") > F.col("place"))
    found = reached.groupBy(group, F.col("n")).agg(
        *[F.min(F.when(F.col("point") == name, F.col("v"))).alias(name) for name in points]
    )
    empty = rows.groupBy(group).agg(F.count(value).alias("n")).filter("n = 0")
    zero = F.lit(0).cast(kind)
    return found.unionByName(empty.select(group, "n", *[zero.alias(name) for name in points]))


def _in_question(values: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    """Values from ``low`` on and below ``high``; null is no bound."""
    v, low, high = map(F.col, ("v", "low", "high"))
    return values.join(wanted, group).filter((low.isNull() | (v >= low)) & (high.isNull() | (v < high)))


def _narrowed(rows: DataFrame, group: str, cuts: int) -> DataFrame:
    """The part between two cuts that holds each wanted place, and the place counted from its beginning."""
    key = [group, "point", "n", "place", "low", "high"]
    shares = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    usual = F.when(~F.isnan(F.col("v").cast("double")) & (F.abs(F.col("v").cast("double")) < float("inf")), F.col("v"))
    sketch = settled(rows.groupBy(group, "point").agg(F.percentile_approx(usual, shares, 100 * cuts).alias("cuts")), "cuts")
    placed = rows.join(sketch, [group, "point"])
    v = F.col("v")
    below = F.array_max(F.filter("cuts", lambda c: c <= v))
    above = F.array_min(F.filter("cuts", lambda c: c > v))
    parts = placed.groupBy(*key, below.alias("below"), above.alias("above")).agg(F.sum("c").alias("c"), F.count("*").alias("distinct"))
    order = Window.partitionBy(group, "point").orderBy(F.asc_nulls_first("below"))  # as many rows as cuts
    before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    place = F.col("place")
    hit = parts.withColumn("before", before).filter((F.col("before") <= place) & (place < F.col("before") + F.col("c")))
    return hit.select(
        group, "point", "n", (place - F.col("before")).alias("place"), "distinct",
        F.coalesce("below", "low").alias("low"), F.coalesce("above", "high").alias("high"),
    )
