"""Queries of the operators for language-model corpora and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import docpairs, handwritten, neighbours, packing, spans, splitting, tokens
from corvane.session import materialize, table


def _capacity(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, "limits").where(F.col("limit_name") == name).first().capacity


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docpairs.documented_functions(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "raw_chunks"))
    return pairs.select("origin", "rec_id", "file", "lang", "container", "name", "signature", "doc_from", F.col("clean").alias("description"), "code")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions whose documentation stands with them in their own row: the exact check of the case definition on the resolved symbol table.

    The resolved table is written, as the check alone would let the optimizer leave the join of the declarations out.
    """
    pairs = docpairs.documented_functions(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "raw_chunks"), with_texts=False)
    pairs = materialize(pairs.select("origin", "rec_id", "name", "doc_from"), "resolved-symbols")
    return pairs.where("doc_from = 'own'").select("origin", "rec_id", F.col("name").alias("func_name")).distinct()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(*(table(spark, sf_dir, n) for n in ("raw_chunks", "doc_chunks", "limits")))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that were cut, each by its first piece."""
    return _pieces(spark, sf_dir).where("piece = 0 AND n_pieces > 1").select("origin", "rec_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "chunks"))


def p4_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.held_out_accuracy(table(spark, sf_dir, "chunks"))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by whether a fact labels them and whether the classifiers find them."""
    return handwritten.against_labels(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf_dir, "chunks"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "chunks"), "chunk_id", "embedding")


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours of the stated query set: chunk ids with a row whose row_id is divisible by 50."""
    return neighbours.exact_neighbours(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", "row_id % 50 = 0")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.recall(table(spark, sf_dir, "chunks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the bytes that the ids of each document decode to."""
    back = tokens.decode_corpus(tokens.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return back.select("doc_id", F.md5("raw").alias("digest"), F.octet_length("raw").cast("bigint").alias("n_bytes"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir, "pack"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, sf_dir), _capacity(spark, sf_dir, "pack"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are packed, and what a packing must not have: containers over capacity, gaps or overlaps in a container, pieces of what fits whole."""
    capacity = _capacity(spark, sf_dir, "pack")
    packed = materialize(p8_pack(spark, sf_dir), "packed")
    in_order = Window.partitionBy("container_id").orderBy("offset", "place")
    before = F.coalesce(F.sum("n_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = packed.withColumn("b", before).agg(F.count_if(F.col("b") != F.col("offset")).alias("gaps"))
    per_bin = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("over_capacity"))
    per_doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    docs = per_doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= capacity)).alias("needless_pieces"))
    return docs.join(F.broadcast(per_bin)).join(F.broadcast(gaps)).select("documents", "over_capacity", "gaps", "needless_pieces")  # one row each


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_classes(table(spark, sf_dir, "documents"))


def p9_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_paths(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_shares(table(spark, sf_dir, "documents"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p4_found": p4_found,
    "p4_accuracy": p4_accuracy,
    "p4_labels": p4_labels,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_exact": p5_exact,
    "p5_recall": p5_recall,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p7_ids": p7_ids,
    "p7_counts": p7_counts,
    "p7_round_trip": p7_round_trip,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_paths": p9_paths,
    "p9_shares": p9_shares,
    "p9_spans": p9_spans,
}

SQL = {
    "p5_exact": """WITH ok AS (SELECT chunk_id, min(embedding::DOUBLE[]) AS e, bool_or(row_id % 50 = 0) AS asked FROM chunks
          WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id)
        SELECT a.chunk_id, b.chunk_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM ok a JOIN ok b ON a.chunk_id <> b.chunk_id WHERE a.asked
        QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY cosine DESC, b.chunk_id) <= 5""",
    "p3_found": """
        SELECT 'raw_chunks' AS origin, raw_id AS rec_id FROM raw_chunks
        WHERE length(content) // 4 > (SELECT capacity FROM limits WHERE limit_name = 'raw_chunks')
        UNION SELECT 'doc_chunks', doc_chunk_id FROM doc_chunks
        WHERE length(content) // 4 > (SELECT capacity FROM limits WHERE limit_name = 'doc_chunks')""",
    "p9_found": """WITH w AS (SELECT DISTINCT doc_id, md5_number(substr(text, i, 200)) AS s FROM (
          SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN r USING (s) JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id""",
    "p9_classes": """WITH w AS (SELECT DISTINCT doc_id, md5_number(substr(text, i, 200)) AS s FROM (
          SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
        p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM w a JOIN r USING (s) JOIN w b ON a.s = b.s AND a.doc_id <> b.doc_id)
        SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS class_id, (SELECT count(*) FROM p WHERE x = doc_id) AS n_links FROM documents""",
    "p9_shares": """WITH w AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS s FROM (
          SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        r AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        c AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 200) AS nxt FROM w SEMI JOIN r ON w.s = r.s),
        n AS (SELECT doc_id, sum(least(200, nxt - i))::BIGINT AS n FROM c GROUP BY doc_id)
        SELECT doc_id, length(text) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) END AS share FROM documents LEFT JOIN n USING (doc_id)""",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0 AS over_capacity, 0 AS gaps, 0 AS needless_pieces FROM documents",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
