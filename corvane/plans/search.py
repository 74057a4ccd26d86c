"""Search over chunks: vector, keyword and graph legs, fused by rank.

A search is one lazily built plan over small candidate lists; only graph traversal writes intermediate tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path
from corvane.operators import graph, ranking, vectors
from corvane.plans.indexing import search_topic
from corvane.session import discard, gathered, materialize

MODES = ("vector", "graph", "both")


def usable_chunks(chunks: DataFrame, dimensions: int = 64) -> DataFrame:
    """One row for each chunk id with a vector of the right width, the latest if it was indexed again.

    The latest rows are found on the two small columns and joined back, so contents and vectors aren't sorted.
    """
    ok = chunks.where(F.size("embedding") == dimensions)
    latest = ok.groupBy("chunk_id").agg(F.max(F.struct("indexed_at", "row_id")).alias("__l")).select(F.col("__l.row_id").alias("row_id"))
    return ok.join(latest, "row_id", "left_semi")


HIT = ("chunk_id", "source_file", "section", "line_start", "line_end", "content")


def best_rows(chunks: DataFrame, query: list[float], limit: int, min_score: float) -> DataFrame:
    """row_id, chunk_id, source_file and score of the best chunks for a query vector, of each id its latest row.

    Scores are computed in the scan; the rows of an id meet as small ones of id, time, path and score, and contents aren't read.
    """
    ok = chunks.where(F.size("embedding") == len(query))
    s = vectors.score_of(vectors.cosine_to(F.col("embedding"), query))
    latest = ok.groupBy("chunk_id").agg(F.max(F.struct("indexed_at", "row_id", s.alias("s"), "source_file")).alias("l"))
    good = latest.where((F.col("l.s") >= min_score) & ~F.isnan("l.s"))
    return good.select("l.row_id", "chunk_id", "l.source_file", F.round("l.s", 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def vector_leg(chunks: DataFrame, query: list[float], limit: int, min_score: float = 0.5) -> DataFrame:
    """Best chunks for a query vector: the fields of a hit, score and rank. The contents of the few best rows are fetched last."""
    best = best_rows(chunks, query, limit, min_score).select("row_id", "score")
    top = chunks.select("row_id", *HIT).join(F.broadcast(best), "row_id").drop("row_id")  # at most ``limit`` rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("bigint"))


def keyword_leg(candidates: DataFrame, query: str, limit: int) -> DataFrame:
    """The candidates that share a token with the query, by BM25: chunk_id, score, rank."""
    text = F.concat_ws(" ", F.coalesce("source_file", F.lit("")), F.coalesce("content", F.lit("")))
    scored = ranking.bm25(candidates, "chunk_id", text, query).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("bigint"))


@dataclass
class GraphIndex:
    """What searches read of the graph, made once with the index: links of files, the strongest relation of each, and PageRank."""

    links: DataFrame
    kinds: DataFrame
    ranks: DataFrame


def graph_index(edges: DataFrame, iterations: int = 20) -> GraphIndex:
    """The graph tables of an edge table, written to the shared folder. A run of :func:`index_files` has the ranks already."""
    canonical = materialize(graph.canonical_edges(edges), "canonical-edges")
    links = materialize(graph.links(canonical), "links")
    weight = ranking.edge_weight("edge_type")
    real = canonical.where(~F.col("source_file").isin("", graph.EXTERNAL) & ~F.col("target_file").isin("", graph.EXTERNAL))
    kinds = real.groupBy(F.col("source_file").alias("a"), F.col("target_file").alias("b")).agg(F.max_by("edge_type", F.struct(weight, F.col("edge_type"))).alias("edge_type"))
    kinds = materialize(kinds, "relations")
    discard(canonical)
    return GraphIndex(links, kinds, materialize(graph.pagerank(links, iterations), "ranks"))


#: Graph tables that are kept for searches to come.
CACHED_GRAPHS = 4


def cached_graph_index(edges: DataFrame, id_col: str) -> GraphIndex:
    """:func:`graph_index`, kept for the session by the signature of the edge table; the least recently used of more than ``CACHED_GRAPHS`` goes, with its tables."""
    s = graph.change_signature(edges, id_col, *graph.EDGE_KEY).first()  # one row
    sc = edges.sparkSession.sparkContext
    kept = getattr(sc, "_corvane_graphs", {})
    key = (s.n, s.max_id, s.checksum)
    found = kept.pop(key, None)
    if found is None or found.links._corvane_path not in getattr(sc, "_corvane_tables", []):
        found = graph_index(edges)
    kept[key] = found
    while len(kept) > CACHED_GRAPHS:
        old = kept.pop(next(iter(kept)))
        for t in (old.links, old.kinds, old.ranks):
            discard(t)
    sc._corvane_graphs = kept
    return found


#: Files that a hop goes on from, for each seed: the most central ones.
MAX_NODES = 200


def graph_leg(chunks: DataFrame, index: GraphIndex, seeds: DataFrame, depth: int, direction: str, limit: int, max_nodes: int = MAX_NODES) -> DataFrame:
    """First chunks of the files around the seeds, by structure fused with centrality.

    ``seeds``: source_file, score; a few. A hop keeps the ``max_nodes`` most central new files of a seed, so everything after it is small. The score of a
    neighbour stays the pure structural number; centrality only moves the order. It is the PageRank with restarts at the seeds, taken within the neighbourhood.
    """
    per_file = gathered(seeds.groupBy(F.col("source_file").alias("seed")).agg(F.max("score").alias("seed_score")), limit)
    reached = max_nodes * depth * limit
    near = gathered(graph.neighbours(index.links, per_file.select("seed"), depth, direction, max_nodes, index.ranks), reached)
    forward = near.join(index.kinds, (F.col("seed") == F.col("a")) & (F.col("file") == F.col("b")), "left").select("seed", "file", "hop", F.col("edge_type").alias("e1"))
    both = forward.join(index.kinds, (F.col("file") == F.col("a")) & (F.col("seed") == F.col("b")), "left").select(
        "seed", "file", "hop", F.coalesce("e1", "edge_type").alias("relation"), (F.col("e1").isNull() & F.col("edge_type").isNotNull()).alias("is_caller")
    )
    scored = both.join(per_file, "seed").withColumn("score", ranking.structural_score(F.col("seed_score"), F.col("relation"), F.col("hop")))
    best = scored.join(per_file.select(F.col("seed").alias("file")), "file", "left_anti").groupBy("file").agg(
        F.max_by(F.struct("seed", "relation", "is_caller", "hop", "score"), F.struct("score", F.col("seed"))).alias("r")
    )
    best = gathered(best.select("file", "r.*"), reached)
    # at most max_nodes files for each hop and seed, and the links among them
    files = F.broadcast(best.select("file").union(per_file.select("seed")).distinct())
    inner = index.links.join(files.select(F.col("file").alias("src")), "src", "left_semi").join(files.select(F.col("file").alias("dst")), "dst", "left_semi")
    central = graph.pagerank(inner.select("src", "dst"), seeds=per_file.select(F.col("seed").alias("file")), in_memory=True).select("file", F.round("score", 9).alias("pr"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "file"))
    ordered = best.join(central, "file", "left").withColumn("a", rank("score")).withColumn("b", rank("pr"))
    fused = F.round(1.0 / (ranking.RRF_K + F.col("a")) + ranking.CENTRALITY_WEIGHT / (ranking.RRF_K + F.col("b")), 6)
    most = max(3 * limit, 15)
    kept = gathered(ordered.withColumn("fused", fused).orderBy(F.desc("fused"), "file").limit(most), most)
    # of the few files kept the first chunk, found without contents, which are fetched last
    usable = chunks.where(F.size("embedding").isNotNull()).join(F.broadcast(kept.select("file")), canonical_path("source_file") == F.col("file"))
    latest = usable.groupBy("file", "chunk_id").agg(F.max(F.struct("indexed_at", "row_id", "chunk_index")).alias("l"))
    first = latest.groupBy("file").agg(F.min(F.struct("l.chunk_index", "chunk_id", "l.row_id")).alias("f"))
    rows = gathered(kept.join(first.select("file", "f.row_id"), "file"), most)
    got = chunks.select("row_id", *HIT).join(F.broadcast(rows), "row_id")
    return got.select("chunk_id", F.col("file").alias("source_file"), "section", "line_start", "line_end", "content", "score", "relation", "seed", "is_caller", "hop", "fused")


def search(
    chunks: DataFrame, query_vector: list[float], query: str, mode: str = "both", edges: DataFrame | GraphIndex | None = None, limit: int = 10, min_score: float = 0.5, depth: int = 1, direction: str = "both"
) -> DataFrame:
    """Results of a search: chunk_id, source_file, score, rrf_score, search_mode, in order, at most ``limit`` of them.

    ``edges`` is the :class:`GraphIndex` that was made with the index, or an edge table, from which it is made first. Bad arguments are refused before anything runs.
    """
    if mode not in MODES or (mode != "vector" and edges is None):
        raise ValueError(f"mode is one of {', '.join(MODES)}, and the graph needs edges")
    if not 1 <= depth <= 5 or direction not in ("both", "callers", "dependencies"):
        raise ValueError("depth is 1 to 5; direction is both, callers or dependencies")
    if mode == "vector":
        near = best_rows(chunks, query_vector, limit, min_score)
        return near.select("chunk_id", "source_file", "score", F.lit(None).cast("double").alias("rrf_score"), F.lit("vector").alias("search_mode"))
    index = edges if isinstance(edges, GraphIndex) else graph_index(edges)
    seeds = best_rows(chunks, query_vector, 3, 0.1).select(canonical_path("source_file").alias("source_file"), "score")
    around = graph_leg(chunks, index, seeds, depth, direction, limit)
    hits = ["chunk_id", "source_file", "content", "score"]
    if mode == "graph":
        top = around.orderBy(F.desc("fused"), "chunk_id").limit(limit)
        return top.select("chunk_id", "source_file", "score", F.col("fused").alias("rrf_score"), F.lit("graph").alias("search_mode"))
    near = gathered(vector_leg(chunks, query_vector, limit, min_score), limit)
    around = gathered(around, max(3 * limit, 15))
    graph_list = around.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "chunk_id")).cast("bigint"))
    pool = gathered(near.select(hits).unionByName(graph_list.select(hits)).dropDuplicates(["chunk_id"]), limit + max(3 * limit, 15))
    words = keyword_leg(pool, query, limit)
    lists = [
        df.select("chunk_id", F.lit(i).alias("list_id"), "rank", F.lit(1.0).alias("weight")) for i, df in enumerate((near, graph_list, words))
    ]
    fused = ranking.reciprocal_rank_fusion(lists[0].unionByName(lists[1]).unionByName(lists[2]), "chunk_id")
    out = fused.join(pool.select("chunk_id", "source_file", "score"), "chunk_id").withColumn("search_mode", F.lit("both"))
    return out.orderBy("fused_rank").limit(limit).select("chunk_id", "source_file", "score", "rrf_score", "search_mode")


@dataclass
class Sources:
    """What a search over several sources reads. ``chunks`` and the graph are those of all projects, told apart by ``project_column``."""

    chunks: DataFrame
    projects: DataFrame
    documents: DataFrame | None = None
    edges: DataFrame | GraphIndex | None = None
    project_column: str = "scope"


def search_sources(
    sources: list[str], tables: Sources, query: str, embedder_for: Callable[[str], Callable[[str], list[float]]], default_model: str, mode: str = "vector", limit: int = 10, min_score: float = 0.5, **graph_options
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Search several sources at once: the results in order, at most ``limit`` of them, and the sources that were left out with the reason.

    A source is ``project:NAME`` or ``docs:TOPIC``; others are ``unknown``. A project is queried with the model that its index records (``projects``:
    project, model_id, n_files, incomplete), the default one where that can't be loaded; then, like a missing index, it is left out, as vectors of two models don't compare. Lists with a fused
    score come before those without, then the score decides; the scores of different sources are not mixed with fused ones. No usable source gives None. Result: source, chunk_id, source_file, score, rrf_score, search_mode.
    """
    named = [s[len("project:") :] for s in sources if s.startswith("project:")]
    known = {r.project: r for r in tables.projects.where(F.col("project").isin(named)).collect()} if named else {}  # at most one row for each source
    lists, skipped = [], []
    for source in dict.fromkeys(sources):
        kind, _, name = source.partition(":")
        if kind == "docs" and tables.documents is not None:
            found = search_topic(tables.documents, name, embedder_for(default_model)(query), limit, min_score)
            lists.append(found.select(F.lit(source).alias("source"), "chunk_id", F.col("citation").alias("source_file"), "score", F.lit(None).cast("double").alias("rrf_score"), F.lit("docs").alias("search_mode")))
            continue
        if kind != "project" or not name:
            skipped.append((source, "unknown"))
            continue
        record = known.get(name)
        model, reason = default_model, None
        if record is None or not record.n_files:
            reason = "missing"
        elif record.model_id is None:
            reason = "unknown model"
        elif record.model_id != default_model:
            try:
                embedder_for(record.model_id)
                model = record.model_id
            except Exception:
                reason = "other model"
        if reason:
            skipped.append((source, reason))
            continue
        own = tables.chunks.where(F.col(tables.project_column) == name)
        found = search(own, embedder_for(model)(query), query, mode, tables.edges, limit, min_score, **graph_options)
        lists.append(found.select(F.lit(source).alias("source"), "chunk_id", "source_file", "score", "rrf_score", "search_mode"))
    if not lists:
        return None, skipped
    every = functools.reduce(DataFrame.unionByName, lists)
    return every.orderBy(*ranking.final_order(), "source", "chunk_id").limit(limit), skipped


def assemble_context(hits: DataFrame, top: int = 3, least: float = 0.4, width: int = 200) -> DataFrame:
    """One text of the best hits' first characters, in order: what is handed to a reader."""
    good = hits.where(F.col("score") >= least).orderBy(F.desc("score"), "chunk_id").limit(top)
    line = F.concat(F.col("source_file"), F.lit(": "), F.left(F.coalesce("content", F.lit("")), F.lit(width)))
    return good.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
