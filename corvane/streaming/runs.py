"""Runs over many projects: one at a time by a lock, paused, aborted and tried again, with an outcome for each."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("done", "failed", "aborted", "paused")
OUTCOME_SCHEMA = "project string, outcome string, attempts int, error string"


class Aborted(Exception):
    """Raised by a step that saw that it should stop."""


@contextmanager
def exclusive(spark: SparkSession, lock: str, stale_seconds: float = 6 * 3600):
    """Hold a lock file in the shared folder for a block; yields whether it was got.

    The file is created only if it isn't there, which the file system decides for all drivers at once. One older than ``stale_seconds`` belongs to a run that died and is taken over.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lock)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale_seconds:
        fs.delete(p, False)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
        got = True
    except Exception:
        if not fs.exists(p):
            raise
        got = False
    try:
        yield got
    finally:
        if got:
            fs.delete(p, False)


def run_projects(spark: SparkSession, projects: list[str], step: Callable[[str], None], may_start: Callable[[], bool] = lambda: True, attempts: int = 3) -> DataFrame:
    """project, outcome, attempts, error of a step over each project in order.

    ``may_start`` is asked before every project (a pause, working hours, pressure on the machine): once it says no the rest are ``paused``. A step that
    raises :class:`Aborted` is not tried again; one that fails otherwise is, up to ``attempts`` times.
    """
    rows: list[tuple] = []
    going = True
    for project in projects:
        going = going and may_start()
        if not going:
            rows.append((project, "paused", 0, None))
            continue
        for attempt in range(1, attempts + 1):
            try:
                step(project)
                rows.append((project, "done", attempt, None))
                break
            except Aborted as e:
                rows.append((project, "aborted", attempt, str(e)))
                break
            except Exception as e:
                if attempt == attempts:
                    rows.append((project, "failed", attempt, str(e)[:500]))
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


def task_changes(before: DataFrame, after: DataFrame, key: str = "id", stamp: str = "modified_at") -> DataFrame:
    """``key`` and change (``added``, ``changed``, ``removed``) between two snapshots of task files, by their times of change."""
    old, new = before.select(key, F.col(stamp).alias("__old")), after.select(key, F.col(stamp).alias("__new"))
    both = old.withColumn("__a", F.lit(True)).join(new.withColumn("__b", F.lit(True)), key, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def session_records(events: DataFrame, session: str, kind: str, ts: str) -> DataFrame:
    """State of each session out of its log: when it was started, resumes, when it ended (null while it runs) and its other events.

    ``kind`` is ``start``, ``resume``, ``end`` or any other event. A session that was resumed after its end runs again. A second start counts as a resume.
    """
    n = lambda *names: F.count_if(F.coalesce(F.col(kind), F.lit("")).isin(*names))
    last_begin = F.max(F.when(F.col(kind).isin("start", "resume"), F.col(ts)))
    last_end = F.max(F.when(F.col(kind) == "end", F.col(ts)))
    g = events.where(F.col(session).isNotNull()).groupBy(session).agg(
        F.min(F.when(F.col(kind) == "start", F.col(ts))).alias("started_at"), (n("resume") + F.greatest(n("start") - 1, F.lit(0))).alias("resumes"), last_begin.alias("__b"), last_end.alias("__e"),
        (F.count(F.lit(1)) - n("start", "resume", "end")).alias("n_events"),
    )
    ended = F.when(F.col("__b").isNull() | (F.col("__e") >= F.col("__b")), F.col("__e"))
    return g.select(session, "started_at", "resumes", ended.alias("ended_at"), "n_events")
