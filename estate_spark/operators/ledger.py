"""What has been collected: a ledger of half-open intervals, their union, and what a plan still lacks.

A chain of ranges is cut anew on fresh data, so its bounds move. Completed
work is therefore kept as intervals, whatever plan they came from, and a plan
is compared with their union instead of looking its ranges up.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def record_completed(done: DataFrame, path: str, name: str, run_id: str, recorded_at) -> None:
    """Append completed intervals ``lo, hi, n_rows`` of the ledger ``name``; recording one again changes nothing."""
    entry = done.select("lo", "hi", F.col("n_rows").cast("long").alias("n_rows"), F.lit(run_id).alias("run_id"))
    stamped = entry.withColumns({"recorded_at": F.lit(recorded_at).cast("timestamp_ntz"), "name": F.lit(name)})
    stamped.write.mode("append").partitionBy("name").parquet(path)


def read_ledger(spark: SparkSession, path: str, name: str, kind: str = "int") -> DataFrame:
    """All entries of one ledger; none where nothing was recorded yet. ``kind`` is the type of the bounds."""
    schema = f"lo {kind}, hi {kind}, n_rows long, run_id string, recorded_at timestamp_ntz"
    try:
        return spark.read.schema(f"{schema}, name string").parquet(path).filter(F.col("name") == name).drop("name")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def total_collected(ledger: DataFrame) -> DataFrame:
    """Distinct intervals and the rows found in them, by the latest entry of each."""
    latest = ledger.groupBy("lo", "hi").agg(F.max_by("n_rows", F.struct("recorded_at", "run_id")).alias("n_rows"))
    return latest.agg(F.count("*").alias("n_intervals"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def _steps(df: DataFrame, by: Sequence[str], **marks: Column) -> DataFrame:
    """One event where each interval begins and one where it ends; empty and unbounded ones make none."""
    real = df.filter("lo < hi")
    names = list(marks)
    begin = real.select(*by, F.col("lo").alias("x"), F.lit(1).alias("step"), *[marks[n].alias(n) for n in names])
    return begin.unionByName(real.select(*by, F.col("hi").alias("x"), F.lit(-1).alias("step")), allowMissingColumns=True)


def covered(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Union of half-open intervals: the fewest disjoint ones, overlapping and touching ones joined.

    Events of one place are added up first, so a sweep sees each bound once.
    """
    keys = list(by) or [F.lit(0)]
    at = Window.partitionBy(*keys).orderBy("x")
    net = _steps(intervals, by).groupBy(*by, "x").agg(F.sum("step").alias("step")).filter("step <> 0")
    open_ = F.sum("step").over(at.rowsBetween(Window.unboundedPreceding, 0))
    bounds = net.withColumn("open", open_).filter((F.col("open") == 0) | (F.col("open") == F.col("step")))
    paired = bounds.withColumn("hi", F.lead("x").over(at))
    return paired.filter("open > 0").select(*by, F.col("x").alias("lo"), "hi")


def uncovered(planned: DataFrame, done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pieces of planned ranges that no completed interval holds: ``lo, hi, plan_lo, plan_hi``.

    Planned ranges of one key are disjoint, as a chain's are. One sweep over
    the bounds of both: nothing is joined, however the bounds lie.
    """
    keys = list(by) or [F.lit(0)]
    plan = _steps(planned, by, plan=F.struct(F.col("lo").alias("plan_lo"), F.col("hi").alias("plan_hi")))
    both = plan.withColumn("kind", F.lit("plan")).unionByName(_steps(done, by).withColumn("kind", F.lit("done")), allowMissingColumns=True)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("step")).otherwise(0))
    points = both.groupBy(*by, "x").agg(of("plan").alias("planned"), of("done").alias("done"), F.max("plan").alias("plan"))
    at = Window.partitionBy(*keys).orderBy("x")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(
        *by,
        F.col("x").alias("lo"),
        F.lead("x").over(at).alias("hi"),
        F.sum("planned").over(upto).alias("planned"),
        F.sum("done").over(upto).alias("done"),
        F.last("plan", ignorenulls=True).over(upto).alias("plan"),
    )
    return swept.filter("planned > 0 AND done = 0").select(*by, "lo", "hi", "plan.plan_lo", "plan.plan_hi")


def calendar_months(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Months from that of ``first`` to that of ``last`` as half-open date ranges."""
    months = F.sequence(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("lo")).select("lo", F.add_months("lo", 1).alias("hi"))


def months_left(spark: SparkSession, first: date, last: date, ledger: DataFrame) -> DataFrame:
    """Days still to be collected, cut by month: ``month, lo, hi``."""
    left = uncovered(calendar_months(spark, first, last), ledger.select("lo", "hi"))
    return left.select(F.date_format("plan_lo", "yyyy-MM").alias("month"), "lo", "hi")
