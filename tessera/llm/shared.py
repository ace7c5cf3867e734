"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes the shuffle files of a query when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch on its way to a Python worker, so that rows of long texts come in smaller batches.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def on_path(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, whatever their working folder is; bounds their batches, unless the session says how."""
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    on_path(spark)
    return spark.read.options(**options or {}).parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; an error on a cluster, whose machines would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


class _Made(threading.local):
    """Paths of tables that stash() wrote and nobody deleted yet."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were stashed within, but for the paths put into the list that it gives."""
    before, kept = set(_made.paths), []
    try:
        yield kept
    finally:
        drop(spark, *[x for x in _made.paths if x not in before and x not in kept])


@contextmanager
def eager_cleanup(spark: SparkSession):
    """Within, finished queries leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder, and returns that table and its path. options: of the writer.

    This cuts the lineage: later jobs read the files, and a lost executor costs no
    more than the tasks that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with eager_cleanup(spark):
        df.write.options(**options or {}).parquet(path)
    _made.paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that stash() wrote and no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in _made.paths:
            _made.paths.remove(path)


def text_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns that an operator needs, under names of its own, so that extra columns cannot clash."""
    on_path(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
