"""Maintaining an index: difference, upsert, deletion, manifests, gates. All steps are set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path

UNREADABLE = "__unreadable__"


def diff(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """file and state of each file: new, changed, deleted, unchanged or unreadable.

    ``scan``, ``manifest``: file, hash. A file that couldn't be read before (hash ``__unreadable__``) and still can't is
    ``unreadable``; once it can it is ``changed``.
    """
    s = scan.select("file", F.col("hash").alias("new_hash"))
    m = manifest.select("file", F.col("hash").alias("old_hash"))
    state = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when((F.col("new_hash") == UNREADABLE) & (F.col("old_hash") == UNREADABLE), "unreadable")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    return s.join(m, "file", "full_outer").select("file", state.alias("state"))


def last_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with equal key the last one in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The table after the rows of ``new`` replaced those with equal key; the last of several in ``new`` counts."""
    fresh = last_by(new, [key], order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_by(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` isn't among ``keys``; null keys stay."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def ended_files(manifest: DataFrame) -> DataFrame:
    """file: the canonical paths whose lives have all ended; a file with a second, living row isn't gone. Null files give none."""
    lives = manifest.where("file IS NOT NULL").groupBy(canonical_path("file").alias("file"))
    return lives.agg(F.every(F.col("deleted_at").isNotNull()).alias("ended")).where("ended").select("file")


def delete_files(df: DataFrame, files: DataFrame, column: str = "source_file") -> DataFrame:
    """Rows whose ``column`` names none of ``files`` (file), in whatever spelling; null paths stay."""
    gone = files.select(canonical_path("file").alias("__f")).distinct()
    return df.join(gone, canonical_path(column) == F.col("__f"), "left_anti")


def carry_over(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; a column that ``new`` doesn't know (null) keeps its old value."""
    other = [c for c in old.columns if c not in key]
    renamed = old.select(*key, *(F.col(c).alias(f"__old_{c}") for c in other))
    joined = new.join(renamed, key, "full_outer")
    return joined.select(*key, *(F.coalesce(F.col(c), F.col(f"__old_{c}")).alias(c) if c in new.columns else F.col(f"__old_{c}").alias(c) for c in other))


def drop_files(files: DataFrame, chunks: DataFrame, edges: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, edges (at both ends) and manifest without ``files`` (file); paths are compared in their canonical spelling."""
    from corvane.operators.graph import delete_referencing

    return delete_files(chunks, files), delete_referencing(edges, files), delete_files(manifest, files, "file")


def index_gates(projects: DataFrame, model: str) -> DataFrame:
    """project, reason and served: a missing index or one of another model is refused, an incomplete one served with a warning.

    ``projects``: project, model_id, n_files, incomplete. Not being searchable is a row with its reason, not an empty result.
    """
    reason = (
        F.when(F.coalesce("n_files", F.lit(0)) == 0, "missing")
        .when(F.col("model_id").isNull(), "unknown model")
        .when(F.col("model_id") != model, "other model")
        .when(F.coalesce("incomplete", F.lit(False)), "incomplete")
        .otherwise("ok")
    )
    return projects.select("project", reason.alias("reason"), reason.isin("ok", "incomplete").alias("served"))


def coverage(requested: DataFrame, gates: DataFrame) -> DataFrame:
    """The requested projects that are completely searchable."""
    gapped = gates.where("reason <> 'ok'").select("project")
    return requested.select("project").distinct().join(gapped, "project", "left_anti")


def fallback_decision(results: DataFrame, complete: DataFrame, least: float = 0.4) -> DataFrame:
    """One row: whether to look elsewhere, because nothing or nothing good was found; never if no source was complete."""
    top = results.agg(F.count(F.lit(1)).alias("n_results"), F.max("score").alias("top_score"))
    n = complete.agg(F.count(F.lit(1)).alias("n_complete"))
    wanted = (F.col("n_results") == 0) | (F.col("top_score") < least)
    return top.join(F.broadcast(n)).select("n_results", "top_score", "n_complete", (wanted & (F.col("n_complete") > 0)).alias("fall_back"))


#: Changed files from which a project is indexed again as a whole.
FULL_SWEEP = 50


def sweep_actions(changes: DataFrame, projects: DataFrame, least: int = FULL_SWEEP) -> DataFrame:
    """project, n_changed and action of a sweep: ``full`` from ``least`` changed files on (``resume`` if the index is incomplete), ``files`` for fewer, ``none``.

    ``changes``: project, file, state as of :func:`diff`. ``projects``: project, incomplete.
    """
    n = changes.where("state IN ('new', 'changed', 'deleted')").groupBy("project").agg(F.count(F.lit(1)).alias("n_changed"))
    many = F.coalesce("n_changed", F.lit(0)) >= least
    action = F.when(many & F.coalesce("incomplete", F.lit(False)), "resume").when(many, "full").when(F.coalesce("n_changed", F.lit(0)) > 0, "files").otherwise("none")
    return projects.select("project", "incomplete").join(n, "project", "left").select("project", F.coalesce("n_changed", F.lit(0)).alias("n_changed"), action.alias("action"))


def sweep_plan(projects: DataFrame) -> DataFrame:
    """Order in which projects are refreshed: models by their total size, then projects by size and path.

    ``projects``: project, model_id, n_files. Equal models stand together, so that each is loaded once.
    """
    cost = F.sum("n_files").over(Window.partitionBy("model_id"))
    ranked = projects.withColumn("model_cost", cost)
    w = Window.orderBy("model_cost", "model_id", "n_files", "project")
    return ranked.withColumn("position", F.row_number().over(w).cast("bigint"))
