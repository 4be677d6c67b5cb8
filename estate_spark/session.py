"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STAGED_CODEC = "zstd"  # of tables that only steps of one job read


def local_session(cores: int | str = "*", app: str = "estate_spark", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is used only when the session names none and runs in
    local mode, where driver and executors are one machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder shared by the cluster")
    fallback = tempfile.mkdtemp(prefix="estate-spark-")
    spark.conf.set(CHECKPOINT_CONF, fallback)
    return fallback


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when the action ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(RELEASE_CONF, None)
    spark.conf.set(RELEASE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE_CONF) if before is None else spark.conf.set(RELEASE_CONF, before)


def releasing(job: Callable) -> Callable:
    """A job of several actions, whose first argument is its session or a table, with :func:`shuffles_released`."""

    @functools.wraps(job)
    def run(source: SparkSession | DataFrame, *args, **kwargs):
        with shuffles_released(source.sparkSession if isinstance(source, DataFrame) else source):
            return job(source, *args, **kwargs)

    return run


@releasing
def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read one fixed result instead of recomputing it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.select("*").checkpoint(eager=True)  # a table planned before would keep its shuffle files


@releasing
def staged(df: DataFrame) -> DataFrame:
    """Written once as compressed columns to the shared folder and read back; the order of rows is not kept.

    For wide rows whose layout does not matter: a checkpoint holds them
    uncompressed, and each reader takes whole rows of it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", STAGED_CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of a job's own steps that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that filters on it, or on what follows from it, do not repeat it.

    Spark pushes a filter below a projection by copying the expressions it
    needs. It does not push filters on a generator's output, and an outer
    generator infers none, so one explode of a one-element array keeps the
    value where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
