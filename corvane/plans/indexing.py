"""Indexing as one set-based plan: files and documents to chunks, edges, ranks and manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, codegraph, graph, index, vectors
from corvane.session import materialize


@dataclass
class Index:
    """The tables of an index."""

    chunks: DataFrame
    edges: DataFrame
    ranks: DataFrame
    manifest: DataFrame


def code_or_blocks(text: str, stem: str):
    """Definitions where the language is known, blocks else; the stem carries the suffix behind a NUL."""
    name, _, suffix = stem.partition("\x00")
    return chunking.python_chunks(text, name) if suffix == "py" else chunking.structure_chunks(text, name, suffix)


def chunk_files(files: DataFrame, embedder=tx.hashed_embedding) -> DataFrame:
    """Chunks of files (file, content, hash) with ids, metadata and vectors; degenerate ones are not stored."""
    marked = F.concat(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit("\x00"), F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)), F.lit("."))
    cut = chunking.chunk_texts(files.withColumn("__stem", marked), "file", "content", code_or_blocks, name="__stem")
    stored = chunking.not_degenerate(cut)
    return stored.select(tx.chunk_id("file", "chunk_index").alias("chunk_id"), "file", "chunk_index", "section", "line_start", "line_end", "content", "token_count", embedder("content").alias("embedding"))


def resolve_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with their target files: resolved, ``_external_`` or empty."""
    found = graph.resolve_symbols(edges, files).where("resolved IS NOT NULL")
    joined = graph.with_external(edges, files).join(found, ["target_symbol", "source_file"], "left")
    target = F.coalesce("resolved", F.when(F.col("external"), F.lit(graph.EXTERNAL)).otherwise(F.lit("")))
    return joined.withColumn("target_file", target).select(*graph.EDGE_KEY, "confidence").dropDuplicates(list(graph.EDGE_KEY))


def index_files(scan: DataFrame, old: Index | None = None, iterations: int = 20) -> Index:
    """The index after a scan (file, content, hash): only new and changed files are read again, deleted ones go.

    Unreadable files (null content) keep a manifest row and nothing else. Kept edges are resolved again with the new ones, as a file that came or went
    changes what their symbols name; so an update gives what a new index would.
    """
    if old is None:
        work, kept_chunks, kept_edges = scan, None, None
    else:
        state = materialize(index.diff(scan, old.manifest), "diff")
        touched = state.where("state IN ('new', 'changed', 'deleted')").select("file")
        work = scan.join(state.where("state IN ('new', 'changed')").select("file"), "file", "left_semi")
        kept_chunks = old.chunks.join(touched, "file", "left_anti")
        kept_edges = graph.delete_outgoing(old.edges, touched)
    readable = work.where("content IS NOT NULL")
    chunks, edges = chunk_files(readable), codegraph.extract_edges(readable).drop("target_file")
    files = scan.select("file")
    if old is not None:
        chunks = kept_chunks.unionByName(chunks)
        edges = kept_edges.select(edges.columns).unionByName(edges)
    edges = materialize(graph.delete_ghosts(resolve_edges(edges, files), files), "edges")
    ranks = graph.pagerank(graph.links(edges), iterations)
    return Index(chunks, edges, ranks, scan.select("file", "hash"))


def ingest_documents(sources: DataFrame, known: DataFrame, pattern: str, max_tokens: int = 500, embedder=tx.hashed_embedding) -> DataFrame:
    """Cited chunks of documents (source_id, topic, prefix, text) whose content isn't known (source_id, content_hash) yet.

    Chunks without a citation are dropped. Result: chunk_id, source_id, topic, citation, related, heading, content, token_count, content_hash, embedding.
    """
    hashed = sources.withColumn("content_hash", tx.short_hash("text"))
    fresh = hashed.join(known.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
    cut = chunking.chunk_texts(fresh, "source_id", "text", lambda t, _: chunking.document_chunks(t, pattern, max_tokens))
    full = cut.join(fresh.select("source_id", "topic", "prefix", "content_hash"), "source_id").withColumn("citation", tx.citation("section", "prefix"))
    return full.where("citation <> ''").select(
        tx.chunk_id("source_id", "chunk_index").alias("chunk_id"), "source_id", tx.topic_slug("topic").alias("topic"), "citation", tx.related_citations("content").alias("related"),
        F.col("section").alias("heading"), "content", "token_count", "content_hash", embedder("content").alias("embedding"),
    )


def update_documents(old: DataFrame, sources: DataFrame, pattern: str, max_tokens: int = 500, embedder=tx.hashed_embedding) -> DataFrame:
    """The chunk table after an ingestion: the old chunks of a source whose content changed go before its new ones come.

    ``old`` has the columns that :func:`ingest_documents` gives. Sources that aren't among ``sources``, or whose content is null, stay as they are.
    """
    known = materialize(old.select("source_id", "content_hash").distinct(), "known-sources")
    hashed = sources.where("text IS NOT NULL").select("source_id", tx.short_hash("text").alias("content_hash"))
    changed = hashed.join(known, ["source_id", "content_hash"], "left_anti").select("source_id").distinct()
    fresh = ingest_documents(sources, known, pattern, max_tokens, embedder)
    return old.join(changed, "source_id", "left_anti").unionByName(fresh)


def search_topic(documents: DataFrame, topic: str, query: list[float], limit: int = 5, min_score: float = 0.3) -> DataFrame:
    """The best chunks of one topic with their citations."""
    score: Column = vectors.score_of(vectors.cosine_to(F.col("embedding"), query))
    hits = documents.where(F.col("topic") == topic).withColumn("s", score).where(F.col("s") >= min_score)
    return hits.select("chunk_id", "citation", "related", "content", F.round("s", 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def search_log_row(results: DataFrame, search_id: str, query: str, mode: str) -> DataFrame:
    """The row that a search leaves in the log: how many results, the top score, and only a hash of the query."""
    return results.agg(F.count(F.lit(1)).alias("results_count"), F.max("score").alias("top_score")).select(
        F.lit(search_id).alias("search_id"), F.lit(mode).alias("mode"), tx.prefixed_hash(F.lit(query)).alias("query_hash"), "results_count", "top_score"
    )
