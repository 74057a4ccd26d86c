"""Aggregation through joins without skew: aggregate first, join compact states, roll up.

Per-key results over ``left JOIN right`` are skewed twice when a few keys hold most rows: the join
multiplies the rows of a hot key, and the aggregation gathers them in one task. Both inputs are
therefore reduced to one compact state per join key before anything is joined. The states form a
product: a pair count is the product of the counts, a sum over the pairs is one side's sum times the
other side's count, minima and maxima carry over. The join then meets at most one row per key and
side, so a hot key costs as much as a rare one.

The reduction itself has two levels. Level one groups by key *and* a finer column, whose partial
aggregation runs in the map tasks and spreads a hot key over all reducers; level two rolls the finer
groups up to the key and receives at most one row per map task and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path

#: The columns that identify an edge; rows equal in all of them (null equals null) are one edge.
EDGE_KEY = ("source_file", "source_symbol", "target_file", "target_symbol", "edge_type")


def join_states(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    count_left: str = "n_left",
    count_right: str = "n_right",
    sums_left: Sequence[str] = (),
    sums_right: Sequence[str] = (),
    how: str = "left",
) -> DataFrame:
    """Join two pre-aggregated inputs and combine their states algebraically.

    ``left`` and ``right`` hold one row per key with a row count and sums. The result has ``n_pairs``
    (rows of the join of the raw inputs) and every sum scaled to the pairs. A null key joins nothing:
    with ``how="left"`` it keeps its left state and has no pairs. Other columns of both sides pass
    through.
    """
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k) == F.col(f"__r_{k}") for k in keys]
    joined = left.join(r, on, how)
    n_right = F.coalesce(F.col(count_right), F.lit(0))
    joined = joined.withColumn(count_right, n_right).withColumn("n_pairs", F.col(count_left) * F.col(count_right))
    scaled = {s: F.col(s) * F.col(count_right) for s in sums_left} | {s: F.col(s) * F.col(count_left) for s in sums_right}
    return joined.withColumns(scaled).drop(*(f"__r_{k}" for k in keys)) if scaled else joined.drop(*(f"__r_{k}" for k in keys))


def preaggregate(df: DataFrame, keys: Sequence[str], spread: Sequence[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per ``keys``, built in two levels over ``keys + spread``.

    ``measures`` maps a column name to (``"sum"``/``"min"``/``"max"``/``"count"``, input column); all of these
    combine exactly over the levels. Null keys form a group of their own.
    """
    level = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    fine = df.groupBy(*keys, *spread).agg(*(level[kind](c).alias(name) for name, (kind, c) in measures.items()))
    return fine.groupBy(*keys).agg(*(again[kind](F.col(name)).alias(name) for name, (kind, _) in measures.items()))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with their number of rows; paths are compared in canonical spelling."""
    named = edges.select(
        canonical_path("source_file").alias("source_file"),
        "source_symbol",
        canonical_path("target_file").alias("target_file"),
        "target_symbol",
        "edge_type",
    )
    return named.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("n_rows"))


def edge_key_totals(edges: DataFrame, files: DataFrame, symbols: DataFrame, count_sources: bool = True) -> DataFrame:
    """Edges summed up per target_file and per target_symbol, with the records each value names.

    Result: ``field``, ``key_value``, ``n_rows`` (edge rows), ``n_edges`` (distinct edges), ``n_sources``
    (distinct source files, unless ``count_sources`` is off), ``n_records`` (records of that file, or symbols of
    that name) and ``n_pairs`` (rows of the join of the distinct edges with those records).

    ``files`` needs ``file``, ``symbols`` needs ``symbol``; further columns are ignored. Null and empty values are
    values of their own, a null joins no record. Repeated rows count in ``n_rows`` and ``n_records``. An empty
    ``edges`` gives no row.
    """
    fields = F.explode(
        F.array(
            F.struct(F.lit("target_file").alias("field"), F.col("target_file").alias("key_value")),
            F.struct(F.lit("target_symbol").alias("field"), F.col("target_symbol").alias("key_value")),
        )
    )
    per_source = (
        distinct_edges(edges)
        .select(fields.alias("k"), "source_file", "n_rows")
        .select("k.field", "k.key_value", "source_file", "n_rows")
    )
    sums = [F.sum("n_rows").alias("n_rows"), F.sum("n_edges").alias("n_edges")]
    if count_sources:
        # Level one is keyed by (value, source_file); its groups are at once the distinct sources of level two.
        fine = per_source.groupBy("field", "key_value", "source_file").agg(
            F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_edges")
        )
        left = fine.groupBy("field", "key_value").agg(*sums, F.count("source_file").alias("n_sources"))
    else:
        # The map-side partial aggregation is level one.
        left = per_source.withColumn("n_edges", F.lit(1)).groupBy("field", "key_value").agg(*sums)
    records = files.select(F.lit("target_file").alias("field"), canonical_path("file").alias("key_value")).unionByName(
        symbols.select(F.lit("target_symbol").alias("field"), F.col("symbol").alias("key_value"))
    )
    right = records.where("key_value IS NOT NULL").groupBy("field", "key_value").agg(F.count(F.lit(1)).alias("n_records"))
    states = join_states(left, right, ["field", "key_value"], count_left="n_edges", count_right="n_records")
    sources = ["n_sources"] if count_sources else []
    return states.select("field", "key_value", "n_rows", "n_edges", *sources, "n_records", "n_pairs")


def heavy_keys(totals: DataFrame, min_share_percent: int = 2) -> DataFrame:
    """The values of :func:`edge_key_totals` that hold at least ``min_share_percent`` % of all distinct edges.

    Every distinct edge has one target_file, null included, so the total is the sum over that field. Null and
    empty values count towards the total but are never reported. ``totals`` is read twice: hand over a written table.
    """
    total = totals.agg(F.sum(F.when(F.col("field") == "target_file", F.col("n_edges"))).alias("total"))
    return (
        totals.where((F.col("key_value") != "") & (F.col("n_edges") * 100 >= total.scalar() * min_share_percent))
        .select("field", "key_value")
    )
