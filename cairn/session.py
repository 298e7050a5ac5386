"""Session factory, shared folder, stored tables and package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of records.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def session(app: str = "cairn", **conf: str) -> SparkSession:
    """A session with the settings this library assumes: UTC, adaptive execution, ANSI arithmetic."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever their Python path is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small (never larger than they were): records are long, and a batch is in memory on both sides."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Hadoop resolves the name, so one without a scheme is on the cluster's default file system.  Only
    a local master gets a temporary folder where none is named; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new name below the application's own part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/cairn/{app}"
    if _folders.get(app) != top:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[app] = top
    return f"{top}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: evaluated once, safe from lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
