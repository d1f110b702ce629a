"""Where intermediate results live.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names. Only a
``local`` master without that setting (unit tests) gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from descria.errors import DescriaError


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; set up on first use in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured or current:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured or current
    if not spark.sparkContext.master.startswith("local"):
        raise DescriaError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage reliably: the copy survives the loss of any executor, and
    later readers still get column pruning and filter push-down.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # The driver's copy; Spark hands it to the executors itself.
    archive = Path(folder) / "descria_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
