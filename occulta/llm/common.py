"""Shared plumbing of the training-data operators: tables, shared folders, files.

Driver and executors share only ``spark.checkpoint.dir`` and the inputs, so
every intermediate result goes through :func:`materialise` into that folder.
"""

from __future__ import annotations

import atexit
import os
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parents[2]
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()
_created: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default only if none is set and all run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/occulta-{label}-{uuid.uuid4().hex[:12]}"
    if not _created:
        atexit.register(_clean)
    _created.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _created:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't see the repository.

    Also, unless the session says otherwise, let a batch of rows that goes to
    Python hold 2000 rows, not 10,000: whole texts are large rows.
    """
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, "2000")
    if str(PACKAGE_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import tempfile

    archive = Path(tempfile.mkdtemp(prefix="occulta-")) / "occulta_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((PACKAGE_ROOT / "occulta").rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def _file_system(uri: str):
    """(filesystem or None for local files, path)."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> None:
    """``write(file)`` into a temporary name, then rename: no half file is ever seen."""
    fs, path = _file_system(uri)
    part = f"{path}.part"
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            write(f)
        os.replace(part, path)
    else:
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(part) as f:
            write(f)
        fs.move(part, path)


def open_file(uri: str):
    """A seekable binary reader of a shared file."""
    fs, path = _file_system(uri)
    return open(path, "rb") if fs is None else fs.open_input_file(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(n: int, sizes, most_bytes: int = 3 << 19):
    """(start, end) runs of rows whose byte sizes add up to about ``most_bytes``."""
    start, total = 0, 0
    for i in range(n):
        total += sizes[i]
        if total >= most_bytes:
            yield start, i + 1
            start, total = i + 1, 0
    if start < n:
        yield start, n
