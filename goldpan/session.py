"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def local_session(cores: int | str = 8, name: str = "goldpan") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that runs in one process
    may do without: it gets a temporary folder that goes when the process ends.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="goldpan-")
        atexit.register(shutil.rmtree, _LOCAL_FALLBACK[app], ignore_errors=True)
        context.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nothing has written to yet, under the shared folder."""
    path = f"{shared_dir(spark)}/goldpan-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this session has written; results that still read from
    them must have been stored before. Returns the number of folders."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside drop their shuffle files when they end, rather than when the driver happens to
    collect its garbage. For steps whose results are written or checkpointed."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._goldpan_path
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
        _SCRATCH[spark.sparkContext.applicationId].remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder, so that a lost executor costs no
    recomputation and later plans know the real size and read only the columns they need."""
    return written(df, "cut")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to a new table folder and read it back with the same schema."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._goldpan_path = path
    return table
