"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rasters are large rows: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Capturing a Python call site for every column operation dominates plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "leafwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the toolkit's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application.

    Workers then import it wherever they run; without that, only a driver started in the source folder could.
    """
    context = spark.sparkContext
    if getattr(context, "_leafwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="leafwise-package-")) / "leafwise.zip"  # on the driver; Spark serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for file in sorted(root.rglob("*.py")):
            target.write(file, str(Path("leafwise") / file.relative_to(root)))
    context.addPyFile(str(archive))
    context._leafwise_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder shared by the cluster for stored tables, from ``spark.checkpoint.dir``.

    Only a local session without that setting, which has no other machine to share with, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="leafwise-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: columns and filters are pruned."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
