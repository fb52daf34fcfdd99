"""Session helpers shared by every module.

Nothing here starts work by itself: the functions read settings of the session they are given
and fall back to test-friendly values only where the session has none.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallyloom", cores: int = 8, partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests, the bench and interactive use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in a local session where it
    is unset. On a cluster without the setting this is a RuntimeError: a machine's own folder would
    be lost with the machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage, survives
    the loss of any executor, and lets later branches reuse the rows without recomputing them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the context drop the shuffle files of plans that nothing refers to any more; call after
    cut(), when a large shuffle has served its purpose. It only asks: nothing in use is dropped."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context; call before using it in a worker."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already imported from an archive
        return
    fd, path = tempfile.mkstemp(prefix="tallyloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    context.addPyFile(path)
    context._tallyloom_shipped = True
