"""Tables staged between the jobs of an iterative operator."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete a query's shuffle files at its end, not when the driver's JVM next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Local sessions without a checkpoint folder, and the folder of our own that serves each instead.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster no folder can be taken
    for shared, so that raises. The session's settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="driftwell-")
        root = _own[app]
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone by then
        pass


@contextlib.contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Queries inside delete their shuffle files when they are done; the session's setting is as before afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Nothing reads the shuffles behind the table once it stands, so their files go at once. A lost executor then costs at most the stage that was running. The table goes with ``drop``, at the
    latest when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftwell/{label}-{uuid.uuid4().hex}"
    with _cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftwell_path = path
    return out


def drop(*staged: DataFrame | None) -> None:
    """Delete tables made by ``stage`` that nothing will read any more."""
    for df in staged:
        path = getattr(df, "_driftwell_path", None)
        if path:
            _remove(df.sparkSession, path)
