"""Session factory, and tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weftline", cpus: str = "*") -> SparkSession:
    """A local session with the settings the library expects (UTC, ANSI, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("WEFT_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Paths of tables made by cut; no session, as modules that import this one are sent to executors by value.
_made: set[str] = set()
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; only where it is unset and there is but one machine
    (tests), one of our own. On a cluster it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _own[0]


def cut(df: DataFrame, drop: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends here, and lost executors cost nothing.

    Tables given in drop are deleted, which is for the caller to know to be needed no longer; what is left goes when the
    program ends. The shuffle files of the write are freed at once, those of plans that nobody holds as well.
    """
    spark = df.sparkSession
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, None)
    spark.conf.set(freed, "true")  # a table's shuffle files go once it is written
    path = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(freed, before) if before is not None else spark.conf.unset(freed)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    _made.add(path)
    del df
    discard(*drop)
    trim()
    spark.sparkContext._jvm.System.gc()  # the driver's cleaner removes shuffle files of collected plans only
    return out


def trim() -> None:
    """Give this process's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut."""
    for t in tables:
        path = getattr(t, "_weftline_path", None)
        if path in _made:
            _made.remove(path)
            _delete(t.sparkSession.sparkContext, path)


def _delete(context: SparkContext, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_made):
        try:
            _delete(SparkContext._active_spark_context, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
