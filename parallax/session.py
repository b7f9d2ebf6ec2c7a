"""Session helpers: shared checkpoints and table access."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder named in ``spark.checkpoint.dir``.

    A folder of our own is made only where a local session names none (tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master that names none, an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if folder is None and not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="parallax-checkpoint-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers: by its path where they share it, and as an archive on a cluster. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_parallax_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    known = context.environment.get("PYTHONPATH", "")
    if str(root) not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(root), known) if p)
    if not context.master.startswith("local"):
        archive = Path(tempfile.mkdtemp(prefix="parallax-ship-")) / "parallax.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted((root / "parallax").rglob("*.py")):
                z.write(p, p.relative_to(root))
        context.addPyFile(str(archive))
    context._parallax_shipped = True
