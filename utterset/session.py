"""Session helpers: a local session for tests and a shared scratch location.

On a cluster the scratch location comes from ``spark.checkpoint.dir`` (a
shared folder every executor and the driver can reach). Only when that
setting is absent -- local runs and tests -- do we pick a folder ourselves.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "utterset") -> SparkSession:
    """A ``local[N]`` session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.speculation", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_shipped(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="utterset-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def ensure_shipped(spark: SparkSession) -> None:
    """Make the ``utterset`` package importable in the Python workers.

    Arrow UDFs and ``mapInPandas`` functions are pickled by reference to their
    module, so executors must be able to import the package. It is zipped once
    per session into the shared checkpoint folder and added with ``addPyFile``
    (a no-op when already done, e.g. when installed on the cluster image).
    """
    if spark.conf.get("spark.utterset.shipped", "false") == "true":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    # written by the file system that the folder belongs to, whatever its scheme
    target = os.path.join(ensure_checkpoint_dir(spark), f"utterset-{uuid.uuid4().hex[:8]}.zip")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target)
    spark.conf.set("spark.utterset.shipped", "true")


def cut_lineage(df):
    """Checkpoint ``df`` (eagerly) into the shared checkpoint folder, making
    sure the folder is known to the context first (a session created by
    someone else may carry ``spark.checkpoint.dir`` only as a setting)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever store the path's scheme names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store the path's scheme names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


SPREAD_MIN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table (one parquet file or folder) by name.

    A table that is read in fewer partitions than there are cores (the test tables are
    single files with one row group, i.e. one scan task) is spread over the
    cores right after the scan, so per-row work does not run in one task.
    Filters and column pruning still reach the scan. On a cluster the data
    arrives as many files and this is a no-op.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return df.repartition(cores) if size >= SPREAD_MIN_BYTES else df
