"""Session helpers: building one, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; everything else is the cluster's business.
REQUIRED_CONF = {"spark.sql.session.timeZone": "UTC"}
#: Spark then deletes a query's shuffle files when it is over, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("engramlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``, which counts whenever it
    is set; else the folder the session was given counts. A temporary folder of
    this machine is made only where driver and executors are one process; on a
    cluster without the setting this raises, since each executor would write
    to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="engramlake-ckpt-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Folder of this session's written tables, by application; deleted when Python ends.
_FOLDERS: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/engramlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_leave, spark, app)
    return _FOLDERS[app]


def _leave(spark: SparkSession, app: str) -> None:
    folder = _FOLDERS.pop(app, None)
    try:
        _delete(spark, folder)
    except Exception:  # the session is gone already: only a folder of this machine can still be deleted
        shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def scratch(spark: SparkSession) -> str:
    """A new path in this session's folder, which all executors share."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from its files.

    The lineage ends there, so iterative plans stay small and a lost executor
    costs a re-read, not a recomputation of all rounds. A written table rather
    than ``checkpoint()``: it is compressed, later reads prune columns, and the
    optimiser does not carry the constraints of all earlier rounds along. The
    tables of a session lie in one folder, which is deleted at its end; tables
    of rounds that are over go earlier, by ``drop``. The shuffle files behind
    the table are of no use any more and go at once.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _TABLES[out] = path
    return out


_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(*tables: DataFrame | None) -> None:
    """Delete tables ``cut`` has written that no later plan reads; other DataFrames are left alone."""
    for df in tables:
        path = _TABLES.pop(df, None) if df is not None else None
        if path is not None:
            _delete(df.sparkSession, path)
