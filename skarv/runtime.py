"""What every operator needs of the session: a shared place for intermediate tables."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_serial = itertools.count()
_run = uuid.uuid4().hex[:12]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once: they need not have it installed or on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skarv-code-"), f"skarv-{_run}.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("skarv", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset.

    The temporary folder is only taken on a local master (tests); a cluster has to name its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="skarv-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; it is removed when the driver ends."""
    if not _made:
        atexit.register(clean)
    path = f"{shared_dir(spark)}/skarv-{_run}/{next(_serial)}-{name}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that nothing upstream runs twice.

    The table outlives lost executors, unlike a cache or a localCheckpoint.
    """
    path = table_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The line in a pointer file, None where there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return stream.readLine()
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, line: str) -> None:
    """Write a line beside a pointer file and put it in its place."""
    fs, new = _hadoop(spark, path + ".new")
    stream = fs.create(new, True)
    stream.writeBytes(line + "\n")
    stream.close()
    _, p = _hadoop(spark, path)
    fs.delete(p, False)
    fs.rename(new, p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Remove the folder of this driver's intermediate tables, as far as its sessions still live."""
    folders = {path.rpartition("/")[0]: spark for spark, path in _made}
    _made.clear()
    for folder, spark in folders.items():
        try:
            remove(spark, folder)
        except Exception:  # the session has ended; its shared folder goes with it
            pass
