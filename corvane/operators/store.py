"""Stored collections of chunks: layout, width of the vectors, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import unicode_trim
from corvane.sources.scan import indexable


def write_collection(chunks: DataFrame, path: str, collection: str, dimension: int, mode: str = "overwrite", recreate: bool = False) -> None:
    """Write chunks partitioned by collection, replacing only the collections that are written.

    A vector of another width than ``dimension`` is an error; null vectors are stored as they are. With ``recreate`` a table that holds vectors of another
    width (of a model before) is dropped as a whole first.
    """
    if recreate and _exists(chunks.sparkSession, path):
        old = chunks.sparkSession.read.parquet(path)
        if old.where(F.size("embedding") != dimension).limit(1).count():
            _remove(chunks.sparkSession, path)
    ok = F.assert_true(F.col("embedding").isNull() | (F.size("embedding") == dimension), F.lit(f"a vector isn't of width {dimension}"))
    checked = chunks.withColumn("__ok", ok).where("__ok IS NULL").drop("__ok")
    checked.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(collection).parquet(path)


def read_collection(spark: SparkSession, path: str, collection: str, name: str) -> DataFrame:
    """One collection; only its folder is read."""
    return spark.read.parquet(path).where(F.col(collection) == name)


def fragmentation(spark: SparkSession, path: str, small_bytes: int = 16 << 20) -> DataFrame:
    """Files, small files and their share of a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") < small_bytes).alias("small")).withColumn("ratio", F.when(F.col("files") > 0, F.round(F.col("small") / F.col("files"), 4)))


def compact_if_needed(spark: SparkSession, path: str, target: str, collection: str, least_files: int = 100, least_ratio: float = 0.15) -> bool:
    """Rewrite a table of many small files to ``target``, one file for each collection and task; whether it was needed."""
    f = fragmentation(spark, path).first()
    if f.small < least_files or (f.ratio or 0) < least_ratio:
        return False
    spark.read.parquet(path).repartition(collection).write.mode("overwrite").partitionBy(collection).parquet(target)
    return True


def usable_hits(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Hits from code files with a body, the first of each body (white space around it doesn't count), in their order."""
    body = unicode_trim("content")
    ok = hits.where(indexable("source_file") & (F.length(body) > 0)).withColumn("__b", body)
    w = Window.partitionBy("__b").orderBy(rank)
    return ok.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i", "__b")


def graph_status(links: DataFrame, around: DataFrame) -> DataFrame:
    """One row: ``absent`` without a graph, ``empty`` without neighbours, else ``hit``, with numbers of neighbours and callers."""
    n = around.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.coalesce("is_caller", F.lit(False))).alias("callers"))
    some = links.limit(1).agg(F.count(F.lit(1)).alias("any"))
    status = F.when(F.col("any") == 0, "absent").when(F.col("hits") == 0, "empty").otherwise("hit")
    return n.join(F.broadcast(some)).select(status.alias("status"), "hits", "callers")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    (fs, a), (_, b) = _path(spark, source), _path(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be renamed")


def delete_folders(spark: SparkSession, folders: list[str], quarantine: str, unregister=lambda: None) -> int:
    """Delete the stored tables of a project or collection as one step: all or none.

    Every folder is first renamed into ``quarantine``; if one fails, or ``unregister`` does, those renamed go back and the error is raised. Only then are they
    erased. Folders that don't exist are passed over. Returns how many were deleted.
    """
    moved: list[tuple[str, str]] = []
    try:
        for i, folder in enumerate(folders):
            if _exists(spark, folder):
                target = f"{quarantine}/{uuid.uuid4().hex}-{i}"
                _rename(spark, folder, target)
                moved.append((folder, target))
        unregister()
    except Exception:
        for folder, target in reversed(moved):
            _rename(spark, target, folder)
        raise
    for _, target in moved:
        _remove(spark, target)
    return len(moved)


def _builds(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete builds of a versioned table."""
    fs, p = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("build=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def write_build(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write a new version of a table beside the old ones and keep the last ``keep``; returns its number. A build that breaks off is never read."""
    spark = df.sparkSession
    done = _builds(spark, path)
    number = (done[-1] if done else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/build={number}")
    for old in (done + [number])[:-keep]:
        _remove(spark, f"{path}/build={old}")
    return number


def read_build(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a table."""
    return spark.read.parquet(f"{path}/build={_builds(spark, path)[-1]}")


def pending(units: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Units of a long build that a run before didn't finish; ``progress`` has the keys of those that are done."""
    return units.join(progress.select(key).distinct(), key, "left_anti")
