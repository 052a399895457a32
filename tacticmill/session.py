"""Session and shared-storage helpers.

Nothing here is read on executors; operators take a session or a DataFrame.
"""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tacticmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, once for each context, so that they need neither an installation nor a path."""
    context = spark.sparkContext
    if getattr(context, "_tacticmill_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tacticmill-"), "tacticmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    # served to the executors by the driver; they do not read the driver's folder
    context.addPyFile(archive)
    context._tacticmill_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir.

    Only where that setting is unset, no folder was given to the context and the master is
    local (tests) a temporary one is made; executors elsewhere could not read it.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted is None and current.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = "file://" + tempfile.mkdtemp(prefix="tacticmill-ckpt-")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(wanted)
    return wanted or current.get()


def written(spark: SparkSession) -> list[str]:
    """Paths this session has handed out inside the shared folder, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_tacticmill_written"):
        context._tacticmill_written = []
    return context._tacticmill_written


def clear_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables written to cut a lineage; results that still read them must have been stored."""
    known = written(spark)
    for path in list(known if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in known:
            known.remove(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    written(spark).append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage like checkpoint(), but columnar and compressed; the copy
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
