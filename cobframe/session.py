"""Spark session settings and the shared checkpoint folder.

The library never creates a session on its own inside operators; callers
pass one in.  ``local_session`` is for tests, the bench and the driver smoke
check.  On a cluster the session comes from the platform and
``spark.checkpoint.dir`` names the shared folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Settings that matter for every job of this library, independent of size.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # partition overwrite of one cob_date must never drop other dates (K4)
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cobframe") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("COBFRAME_DRIVER_MEMORY", "16g")))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    # a test session has no platform-provided shared folder: give it a scratch one
    builder = builder.config("spark.checkpoint.dir",
                             os.environ.get("COBFRAME_CHECKPOINT_DIR")
                             or tempfile.mkdtemp(prefix="cobframe-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, as ``spark.checkpoint.dir`` names it.

    Only a session whose executors are this very process (``local[...]``) may
    go without the setting; it gets a scratch folder.  Elsewhere a folder of
    one machine would be written by every executor on its own disk, so a
    missing setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cobframe-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


WORK_FOLDER = "cobframe.work"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *others: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what follows may read it often,
    and a lost executor repeats nothing before it.  ``others``: further rows,
    written after it one by one."""
    spark = df.sparkSession
    folder = spark.sparkContext.getLocalProperty(WORK_FOLDER) or ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/cobframe-{name}-{uuid.uuid4().hex}"
    for i, rows in enumerate((df, *others)):
        rows.write.mode("append" if i else "errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived(spark: SparkSession, folder: str | None = None) -> Iterator[None]:
    """Inside, a write's shuffle files go when it has ended, not when the driver
    happens to collect garbage, and ``written`` puts its tables below ``folder``, where
    one is given: the caller removes it when nothing reads them any more.  For steps that
    run each plan once: a plan run again would have to make its shuffles again."""
    sc, cleanup, work = spark.sparkContext, spark.conf.get(FILE_CLEANUP, None), spark.sparkContext.getLocalProperty(WORK_FOLDER)
    spark.conf.set(FILE_CLEANUP, "true")
    if folder is not None:
        sc.setLocalProperty(WORK_FOLDER, folder)
    try:
        yield
    finally:
        sc.setLocalProperty(WORK_FOLDER, work)
        if cleanup is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, cleanup)


def together(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """The results of steps that do not need each other, run side by side: one
    step's few last or only tasks leave the other cores to the others.  Jobs keep
    the caller's properties; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        waited = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [w.result() for w in waited]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cobframe`` importable in the Python workers (the hash runs in
    ``mapInPandas``): zip the package once per application and hand it to
    ``addPyFile``, which distributes it to every executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="cobframe-pkg-"), "cobframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
