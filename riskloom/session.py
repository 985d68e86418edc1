"""Session defaults and the shared folder in which long plans are cut.

A cluster names its shared folder in ``spark.checkpoint.dir``.  Only where that is unset (tests, a laptop) does
``shared_dir`` make a folder of its own, and only on a local master: elsewhere executors could not read it.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The folder of the innermost ``scratch``.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def by_value(module: str) -> None:
    """Send this module's functions to executors inside the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with UTC days, adaptive execution and dynamic partition overwrite."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-riskloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    scope = _SCRATCH.get()
    return f"{scope or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates that are written inside go when it ends.  For a result that is itself written by then, to a path from outside: a lazy
    table would still read them."""
    scope = fresh_path(spark, "scratch")
    token = _SCRATCH.set(scope)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(scope)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files; only for plans whose result is written and read back."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It survives lost executors, unlike cached or locally checkpointed blocks, and what reads it is pruned by column.
    """
    return written(df, fresh_path(df.sparkSession, label), *partition_by)


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df``, written to ``path`` and read from there."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Write ``df`` once, dealt by ``keys``: later joins on just these keys move only the other side.  Its name in the catalog goes at once; the files, in
    the shared folder, are what the table that is returned reads."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").option("path", fresh_path(spark, label)).saveAsTable(name)
    out = spark.table(name).select("*")
    out.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
