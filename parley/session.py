"""A session with the settings that the package is tested with."""

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """ANSI mode stays on; adaptive execution coalesces and splits partitions. master: as spark-submit sets it if left out."""
    made = SparkSession.builder.appName("parley").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config(
        "spark.sql.adaptive.skewJoin.enabled", "true",
    )
    if master:
        made = made.master(master)
    if partitions:
        made = made.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        made = made.config(key.replace("__", "."), value)
    return made.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job that runs meanwhile go when it is over, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows as a table that is written at once, below shared_dir() without a path. What they were made from needs no disk any more."""
    path = path or f"{shared_dir(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    with freed(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: spark.checkpoint.dir; without it a temporary folder in local mode, else one below the warehouse.

    A warehouse on a machine's own disk isn't taken on a cluster: executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = tempfile.mkdtemp(prefix="parley-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/parley-checkpoints"
            if base.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base
