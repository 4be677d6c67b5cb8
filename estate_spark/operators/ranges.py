"""Ranges of a numeric column that each hold fewer rows than a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of one result list and of the covered area.
ROW_CAP = 2400
STEP = 50
MAX_VALUE = 500


def unit_histogram(df: DataFrame, column: str = "living_area", low: int = 0, high: int = MAX_VALUE) -> DataFrame:
    """Rows per whole unit: at most ``high - low + 3`` rows whatever the input size.

    All values of at least ``high`` count under the unit ``high``, all below
    ``low`` under ``low - 1``, and missing ones under a null unit, so the counts
    add up to the table.
    """
    unit = F.least(F.greatest(F.floor(F.col(column)), F.lit(low - 1)), F.lit(high)).cast("int")
    return (
        df.select(F.when(F.col(column).isNotNull(), unit).alias("unit"))
        .groupBy("unit")
        .agg(F.count("*").alias("n"))
    )


def range_counts(histogram: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows in each half-open range ``[lo, hi)``, summed from one unit histogram.

    Any number of ranges costs one scan of the data: the histogram is the only
    thing read per range.
    """
    units = ranges.select("lo", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("unit"))
    return (
        units.join(histogram, "unit", "left")
        .groupBy("lo", "hi")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    )


def density_ranges(
    histogram: DataFrame,
    low: int = 0,
    high: int = MAX_VALUE,
    cap: int = ROW_CAP,
    step: int = STEP,
) -> DataFrame:
    """Chain of half-open ranges ``[lo, hi)`` covering ``[low, high)``.

    From each start the widest range is taken that is at most ``step`` wide and
    holds fewer than ``cap`` rows; when the whole step is empty the range is one
    unit wide, as is one whose first unit alone reaches the cap
    (``over_cap``). The fold runs over the unit histogram, whose length is
    ``high - low`` whatever the size of the data.
    """
    spark = histogram.sparkSession
    units = spark.range(low, high).select(F.col("id").cast("int").alias("unit"))
    dense = units.join(histogram, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).alias("n"))
    # rows in the step ahead of each unit, to tell an empty step from a sparse one
    ahead = Window.orderBy("unit").rowsBetween(0, step - 1)
    dense = dense.withColumn("in_step", F.sum("n").over(ahead))
    packed = dense.agg(F.array_sort(F.collect_list(F.struct("unit", "n", "in_step"))).alias("units"))

    kind = "struct<lo:int,n:bigint,done:array<struct<lo:int,hi:int,n:bigint>>>"
    start = F.lit(None).cast(kind)

    def advance(state: Column, u: Column) -> Column:
        lo, n, done = state["lo"], state["n"], state["done"]
        lone = F.struct(
            u["unit"].alias("lo"),
            u["n"].alias("n"),
            F.coalesce(done, F.array().cast("array<struct<lo:int,hi:int,n:bigint>>")).alias("done"),
        )
        closed = F.array_append(done, F.struct(lo.alias("lo"), u["unit"].alias("hi"), n.alias("n")))
        fresh = F.struct(u["unit"].alias("lo"), u["n"].alias("n"), closed.alias("done"))
        grown = F.struct(lo.alias("lo"), (n + u["n"]).alias("n"), done.alias("done"))
        start_empty = F.element_at(F.col("units"), lo - low + 1)["in_step"] == 0
        must_close = (n + u["n"] >= cap) | (u["unit"] - lo >= step) | start_empty
        return F.when(state.isNull(), lone).when(must_close, fresh).otherwise(grown).cast(kind)

    folded = packed.select("units", F.aggregate("units", start, advance).alias("s"))
    last = F.struct(F.col("s.lo").alias("lo"), F.lit(high).alias("hi"), F.col("s.n").alias("n"))
    return (
        folded.select(F.explode(F.array_append("s.done", last)).alias("r"))
        .select("r.lo", "r.hi", F.col("r.n").alias("n_rows"))
        .withColumn("over_cap", F.col("n_rows") >= cap)
    )


def assign_ranges(df: DataFrame, ranges: DataFrame, column: str = "living_area") -> DataFrame:
    """Every row with its range, by equality on the whole unit.

    Rows beyond the last range get an open one (``lo`` is its end, ``hi`` null),
    rows before the first one ``hi`` alone, rows without a value neither. Ranges
    are opened into units (at most the covered span, a few hundred rows), which
    lets Spark broadcast them by measured size.
    """
    span = ranges.agg(F.min("lo").alias("low"), F.max("hi").alias("high")).first()
    by_unit = ranges.select(
        "lo", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("_unit")
    )
    unit = F.floor(F.col(column))
    inside = F.when((unit >= span.low) & (unit < span.high), unit).cast("int")
    found = df.withColumn("_unit", inside).join(by_unit, "_unit", "left").drop("_unit")
    above, below = F.col(column) >= F.lit(span.high), F.col(column) < F.lit(span.low)
    return found.withColumn("lo", F.when(above, F.lit(span.high)).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(below, F.lit(span.low)).otherwise(F.col("hi"))
    )
