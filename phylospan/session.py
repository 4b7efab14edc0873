"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("phylospan")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a context, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_phylospan_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="phylospan-package-")
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, "phylospan.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for at, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(at, name)
                file.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._phylospan_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none and is local (tests).

    On a cluster without that setting this is an error, since executors don't share a machine's own folders.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="phylospan-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back; more compact than cut_lineage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
