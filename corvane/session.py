"""Session-level helpers: tables, the shared folder and intermediate tables in it."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the dataset folder ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for the Python workers of all executors, once per context.

    The archive is written to the shared folder, so it doesn't matter what is installed where.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f.relative_to(root.parent).as_posix()), f.read_bytes())
    data = buffer.getvalue()
    path = f"{shared_dir(spark)}/corvane-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target):
        out = fs.create(target)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    sc._corvane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local master (tests, a laptop) gets a folder once per session; on a
    cluster that is an error, as a folder of the driver's machine isn't shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage at a durable copy: later stages survive the loss of executors and a
    result that is used twice is computed once. Parquet is used instead of ``checkpoint()``
    because it is compressed and lets later scans prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    sc._corvane_tables = [*getattr(sc, "_corvane_tables", []), path]
    table = spark.read.schema(df.schema).parquet(path)
    table._corvane_path = path
    return table


def gathered(df: DataFrame, most: int) -> DataFrame:
    """A result of at most ``most`` rows by its parameters, computed once, held by the plan itself and broadcast in joins; a larger one is written like any other."""
    rows = df.limit(most + 1).collect()  # at most ``most`` + 1
    return materialize(df, "gathered") if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _delete(spark: SparkSession, folders: list[str]) -> int:
    sc = spark.sparkContext
    for folder in folders:
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    sc._corvane_tables = [f for f in getattr(sc, "_corvane_tables", []) if f not in folders]
    return len(folders)


def discard(table: DataFrame) -> None:
    """Delete the table that :func:`materialize` returned, once no plan reads it any more; any other DataFrame is left alone."""
    if path := getattr(table, "_corvane_path", None):
        _delete(table.sparkSession, [path])


def drop_materialized(spark: SparkSession) -> int:
    """Delete all tables that :func:`materialize` wrote in this session; call it once no plan reads them any more."""
    return _delete(spark, list(getattr(spark.sparkContext, "_corvane_tables", [])))


@contextmanager
def intermediates(spark: SparkSession):
    """A block after which the tables written in it are deleted: results have to be written or collected within it."""
    before = set(getattr(spark.sparkContext, "_corvane_tables", []))
    try:
        yield
    finally:
        _delete(spark, [f for f in getattr(spark.sparkContext, "_corvane_tables", []) if f not in before])
