"""Streaming forms of the incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.functions.ordering import previous_value
from estate_spark.operators.history import day_bucket


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1000, glob: str | None = None) -> DataFrame:
    """New files of a folder, each taken up once."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _with_event_time(stream: DataFrame, time: str) -> DataFrame:
    """Zone-free times as instants read in UTC, which watermarks need; the session zone plays no part."""
    if dict(stream.dtypes)[time] != "timestamp_ntz":
        return stream
    wall_clock = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time))
    return stream.withColumn(time, wall_clock.cast("timestamp"))


def _zone_free(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def deduplicate(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """First arrival per key; repeats within the watermark delay are dropped.

    State older than the delay is released. Later repeats are the task of the
    anti join with the processed set.
    """
    return _with_event_time(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def weekly_activity(
    df: DataFrame, time: str = "recorded_at", delay: str = "7 days", slide: str | None = None
) -> DataFrame:
    """Events per week and kind; works on a stream and on a table alike."""
    timed = _with_event_time(df, time)
    source = timed.withWatermark(time, delay) if df.isStreaming else timed
    week = F.window(time, "7 days", slide) if slide else F.window(time, "7 days")
    return (
        source.groupBy(week.alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"))
        .select(_zone_free(F.col("w.start")).alias("week_start"), "event_type", "n_events")
    )


def empty_state(batch: DataFrame) -> DataFrame:
    """State before the first batch, with the batch's own types."""
    types = dict(batch.dtypes)
    return batch.sparkSession.createDataFrame(
        [],
        f"property_id {types['property_id']}, last_time {types['recorded_at']}, last_event {types['event_id']}, last_price {types['price']}",
    )


def news(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Priced rows of a batch that come after what is known of their listing, with that.

    Rows without a price or time tell nothing; rows at or before the listing's
    latest known one are late: they neither alert nor change what is latest.
    """
    priced = batch.filter("property_id IS NOT NULL AND price IS NOT NULL AND recorded_at IS NOT NULL")
    later = F.col("last_time").isNull() | (F.struct("recorded_at", "event_id") > F.struct("last_time", "last_event"))
    return priced.join(state, "property_id", "left").filter(later)


def alerts_for_batch(batch: DataFrame, state: DataFrame) -> DataFrame:
    """New-listing and price-drop alerts of one batch, given the latest price per listing before it."""
    seen = previous_value(news(batch, state), "property_id", "recorded_at", "price", "event_id", day_bucket, "within")
    alert = F.when(F.col("old_price").isNull(), F.lit("new_listing")).when(
        F.col("price") < F.col("old_price"), F.lit("price_drop")
    )
    return (
        seen.withColumn("old_price", F.coalesce("within", "last_price"))
        .withColumn("alert", alert)
        .filter(F.col("alert").isNotNull())
        .select("property_id", "event_id", "alert", "old_price", F.col("price").alias("new_price"))
    )


def advance_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Latest price per listing after the batch; map-side combine keeps a hot listing to one row per task."""
    latest = F.max_by(F.struct("recorded_at", "event_id", "price"), F.struct("recorded_at", "event_id"))
    fresh = news(batch, state).groupBy("property_id").agg(latest.alias("fresh"))
    return state.join(fresh, "property_id", "full_outer").select(
        "property_id",
        F.coalesce("fresh.recorded_at", "last_time").alias("last_time"),
        F.coalesce("fresh.event_id", "last_event").alias("last_event"),
        F.coalesce("fresh.price", "last_price").alias("last_price"),
    )


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def price_alerts(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Alerts over a price stream, with the latest price per listing as a versioned table.

    Each micro-batch reads the state of the batch before and writes its own
    alerts and state under its number, so a repeated batch replaces itself;
    states before that are removed. A hot listing is worked on in day-sized
    pieces instead of in one state call.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        needed = batch.select("property_id", "event_id", "price", "recorded_at")
        state = empty_state(needed)
        if number > 0:
            state = session.read.schema(state.schema).parquet(f"{out}/state/batch={number - 1}")
        alerts_for_batch(needed, state).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        advance_state(needed, state).write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        _remove(session, f"{out}/state/batch={number - 2}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/alerts").drop("batch")


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Work through everything available; the whole result after the last batch, groups still open among it.

    Each batch writes its result under its number, so a repeated one replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        _remove(batch.sparkSession, f"{out}/batch={number - 2:09d}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = stream.sparkSession.read.parquet(out)
    last = written.agg(F.max("batch").alias("last")).first()["last"]
    return written.filter(F.col("batch") == last).drop("batch")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work through everything available, then return the written table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
