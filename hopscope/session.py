"""Session factory and the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hopscope", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; local unless the environment names a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_hopscope_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="hopscope-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "hopscope.zip", "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(folder / "hopscope.zip"))
    sc._hopscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a session without one (tests on one machine) gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    base = tempfile.mkdtemp(prefix="hopscope-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/hopscope/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut, columns stay."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over: it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
