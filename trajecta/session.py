"""Session helpers: the shared folder, lineage cuts and scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


WIDE_BATCH = 256  # rows of thousands of numbers
_LOCAL: dict[str, str] = {}
_STAGES: dict[str, list[str]] = {}  # stage tables by application


def build_session(cores: str = "*", partitions: int = 8, app: str = "trajecta") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import the functions of Arrow steps by name; without this
    they find them only where the driver's folder happens to be on their path.
    """
    sc = spark.sparkContext
    if _LOCAL.get("shipped") == sc.applicationId:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="trajecta-code-"), "trajecta_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(target)
    _LOCAL["shipped"] = sc.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="trajecta-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its own type."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, at = folder(spark, path)
    return system.exists(at)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession, wide: bool = False) -> Iterator[None]:
    """Shuffle files of the queries made here go when the query has ended, not when the driver
    happens to collect its garbage.  ``wide``: at most ``WIDE_BATCH`` rows are read and sent to Python at once."""
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if wide:
        for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
            now = int(spark.conf.get(key))
            new[key] = str(min(now, WIDE_BATCH) if now > 0 else WIDE_BATCH)
    before = {key: spark.conf.get(key, None) for key in new}
    try:
        for key, value in new.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def cut_lineage(df: DataFrame, name: str = "stage", wide: bool = False) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Later steps then start from a plain scan: a lost executor costs one file
    split, not the whole history, and plans stay small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freeing_shuffles(spark, wide):
        df.write.parquet(path)
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, keep: int = 0) -> int:
    """Delete the stage tables this application has written since it had ``keep``
    of them; nothing that reads them may run any more.  Returns how many are left."""
    made = _STAGES.get(spark.sparkContext.applicationId, [])
    while len(made) > keep:
        system, at = folder(spark, made.pop())
        system.delete(at, True)
    return len(made)


def stage_count(spark: SparkSession) -> int:
    return len(_STAGES.get(spark.sparkContext.applicationId, []))
