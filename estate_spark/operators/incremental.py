"""Work still to do, processed sets, slices, batches and samples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.functions.ordering import number_rows, ordered_layout
from estate_spark.functions.text import blank_to_null, fingerprint, listing_id


def with_fingerprint(df: DataFrame, property_id: str | None = "property_id", url: str | None = "url") -> DataFrame:
    """Hash of the id, or of the URL's id part when the row carries none.

    Deriving the id from the URL first gives a row the same hash whether it
    arrives with its id or with its URL only.
    """
    pid = F.col(property_id) if property_id in df.columns else None
    link = F.col(url) if url in df.columns else None
    if link is not None:
        from_url = F.when(F.contains(link, F.lit("-")), listing_id(link))
        pid = from_url if pid is None else F.coalesce(blank_to_null(pid), from_url)
    return df.withColumn("fingerprint", fingerprint(pid, link))


def packed(df: DataFrame) -> DataFrame:
    """Fingerprints as bytes, in the same order: half the size wherever they are moved."""
    return df.withColumn("fingerprint", F.unhex("fingerprint"))


def unpacked(df: DataFrame) -> DataFrame:
    """Fingerprints as they are kept in tables."""
    return df.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def not_processed(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows whose fingerprint is not recorded; rows without any identifier stay."""
    return rows.join(processed.select("fingerprint"), "fingerprint", "left_anti")


def new_fingerprints(successes: DataFrame, processed: DataFrame) -> DataFrame:
    """Distinct fingerprints to append to the processed set."""
    fresh = successes.filter(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    return not_processed(fresh, processed)


def months_to_do(spark: SparkSession, first: date, last: date, completed: DataFrame) -> DataFrame:
    """Calendar months from ``first`` to ``last`` without those in ``completed(month)``."""
    months = spark.range(1).select(
        F.explode(
            F.sequence(
                F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month")
            )
        ).alias("month_start")
    )
    labelled = months.withColumn("month", F.date_format("month_start", "yyyy-MM"))
    return labelled.join(completed.select("month"), "month", "left_anti")


def ranges_to_do(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.join(completed.select("lo", "hi"), ["lo", "hi"], "left_anti")


def slice_rows(
    rows: DataFrame, order: Sequence[str], processed: DataFrame, offset: int = 0, limit: int = 0
) -> DataFrame:
    """Skip ``offset`` rows in order, leave out processed ones, keep the next ``limit`` (0: all).

    Processed rows are marked before the rows are laid out in order, so that
    one layout serves both countings: all rows for the offset, and what is
    left of them for the limit. Rows without a fingerprint are never processed;
    a key of their own keeps them from meeting in one task.
    """
    marked = with_fingerprint(rows)
    key = F.coalesce("fingerprint", F.hex(F.xxhash64(*marked.columns)))
    done = processed.select(F.col("fingerprint").alias("_key")).distinct().withColumn("_done", F.lit(True))
    marked = marked.withColumn("_key", key).join(done, "_key", "left").drop("_key")
    return cut_slice(marked, order, "_done", offset, limit).drop("_done", "kept_index")


def cut_slice(rows: DataFrame, order: Sequence[str], done: str, offset: int = 0, limit: int = 0, ranges: int | None = None) -> DataFrame:
    """Rows from ``offset`` on that are not ``done``, ``limit`` of them (0: all), with ``row_index`` and ``kept_index``."""
    numbered = number_rows(ordered_layout(rows, order, ranges))
    left = number_rows(numbered.filter((F.col("row_index") >= offset) & F.col(done).isNull()), "kept_index")
    return left if limit <= 0 else left.filter(F.col("kept_index") < limit)


def slice_counts(rows: DataFrame, processed: DataFrame, written: DataFrame) -> DataFrame:
    """Total input rows, rows written and rows skipped as processed, in one line."""
    seen = processed.select("fingerprint", F.lit(1).alias("hit")).distinct()
    source = with_fingerprint(rows).join(seen, "fingerprint", "left")
    marks = source.select(F.lit(1).alias("t"), F.coalesce("hit", F.lit(0)).alias("p"), F.lit(0).alias("w"))
    marks = marks.unionByName(written.select(F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("w")))
    return marks.agg(
        F.sum("t").alias("total"), F.sum("w").alias("written"), F.sum("p").alias("already_processed")
    )


def with_batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Batch number by global position: the first ``size`` rows in order are batch 0."""
    numbered = number_rows(ordered_layout(rows, order))
    return numbered.withColumn("batch_id", F.floor(F.col("row_index") / size))


def batches_between(batched: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Batches ``first`` up to but not including ``last``."""
    out = batched.filter(F.col("batch_id") >= first)
    return out if last is None else out.filter(F.col("batch_id") < last)


def exact_sample(df: DataFrame, n: int, identity: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, picked by a seeded hash of their identity.

    Ordering by a hash is repeatable across retries and layouts, and a limit on
    top of it keeps only ``n`` rows per task.
    """
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    return df.withColumn("_pick", pick).orderBy("_pick", *identity).limit(n).drop("_pick")


def batch_metrics(results: DataFrame, keys: Sequence[str] = ("run_id", "batch_id")) -> DataFrame:
    """Processed, successful, failed and success rate per batch, from ``success`` flags."""
    ok = F.count_if(F.col("success"))
    return results.groupBy(*keys).agg(
        F.count("*").alias("processed"),
        ok.alias("successful"),
        (F.count("*") - ok).alias("failed"),
        (ok / F.count("*") * 100).alias("success_rate"),
    )


def listed_within(df: DataFrame, as_of: Column, days: int, last_seen: str = "last_seen") -> DataFrame:
    """Retention: rows seen within ``days`` before ``as_of``; a negative number keeps all."""
    return df if days < 0 else df.filter(F.col(last_seen) >= F.date_sub(as_of, days))
