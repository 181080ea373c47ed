"""Tables written once into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a default only where it is unset and all run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes as the tables of :func:`materialise` do."""
    path = f"{shared_dir(spark)}/occulta-{label}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(remove)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back; the folder, which may hold personal data, goes when the driver ends or :func:`remove` is called."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove() -> None:
    """Delete all tables written so far; results that still read from them must be stored before."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may already be gone
            continue
