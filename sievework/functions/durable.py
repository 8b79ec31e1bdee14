"""What jobs share: tables that a loop leaves behind, cut by a checkpoint in the folder that all executors see, and this package's code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only in local mode with none set."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, **sums) -> tuple[DataFrame, dict]:
    """``durable`` with its number of rows as ``rows`` and the named sums of columns, taken on the way."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]))
    return out, seen.get


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once a context, for steps that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_sievework_code", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._sievework_code = True
