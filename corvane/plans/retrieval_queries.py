"""Queries on vectors, ranking and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import graph, ranking, vectors
from corvane.plans import search
from corvane.session import table

WORDS = "index pattern session queue retry"
KEYWORD_QUERY = "Why does the queue keep every locked batch after the rollback"


def _query(df: DataFrame, where: str = "vec_id IS NOT NULL", pick: str = "vec_id") -> list[float]:
    return df.where(where).orderBy(pick).select("embedding").first()[0]  # one vector


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.knn(e, _query(e), 10)


def vector_search_min_score(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.knn(e, _query(e), 1000, min_score=0.55)


def _queries(e: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def batch_knn(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.batch_knn(e, _queries(e), 5)


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """How well the neighbours of the query vectors, without themselves, have their label."""
    e = table(spark, sf, "embeddings")
    labels = e.select("vec_id", "label")
    top = vectors.batch_knn(e, _queries(e), 11).where("vec_id <> query_id").join(labels, "vec_id")
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = top.join(asked, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranking.retrieval_metrics(ranked.select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant")), asked)


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.collection_stats(table(spark, sf, "chunks"), "scope", "source_file")


def first_chunk_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.first_chunk_per_source(table(spark, sf, "chunks").select("row_id", "chunk_id", "source_file", "chunk_index")).select("source_file", "chunk_id", "chunk_index")


def dimension_states(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.dimension_check(table(spark, sf, "chunks"), "embedding", 64)


def _two_lists(e: DataFrame) -> DataFrame:
    a, b = _query(e), _query(e, "label = 1")
    w = Window.orderBy(F.desc("score"), "vec_id")
    lists = [vectors.knn(e, q, 20).select("vec_id", F.lit(i).alias("list_id"), F.row_number().over(w).alias("rank"), F.lit(x).alias("weight")) for i, (q, x) in enumerate(((a, 1.0), (b, 0.5)))]
    return lists[0].unionByName(lists[1])


def rrf_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = _two_lists(table(spark, sf, "embeddings")).withColumn("weight", F.lit(1.0))
    return ranking.reciprocal_rank_fusion(lists, "vec_id")


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(_two_lists(table(spark, sf, "embeddings")), "vec_id")


def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bm25(table(spark, sf, "documents"), "doc_id", F.coalesce("text", F.lit("")), WORDS)


def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "doc_chunks")
    base = (F.length("content") % 100) / 100
    return d.select("doc_chunk_id", F.round(ranking.boosted_score(base, F.col("source_id"), F.col("content")), 4).alias("score"))


def _ranked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as results of one search in each source and kind, the longest first."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("text").alias("content"))
    w = Window.partitionBy("source", "kind").orderBy(F.desc("n"), "doc_id")
    # ranked on the small columns, so contents aren't sorted
    ranks = docs.select("doc_id", "source", "kind", F.length("content").alias("n")).withColumn("rank", F.row_number().over(w)).select("doc_id", "rank")
    return docs.join(ranks, "doc_id")


def keyword_demotion(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.demote_by_keywords(_ranked_documents(spark, sf), KEYWORD_QUERY, ("source", "kind")).select("doc_id", "hits", "new_rank")


def keyword_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keyword_overlap_ratio(_ranked_documents(spark, sf), KEYWORD_QUERY, ("source", "kind"))


PREFERRED, DEMOTED = ("velvet-ledge-etl.example.net", "dev.example.org"), ("fe.example.com",)


def source_tiers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    host = F.concat(F.coalesce("source", F.lit("none")), F.when(F.col("lang") == "en", ".example.net").otherwise(".dev.example.org"))
    tier = ranking.source_tier(host, PREFERRED, DEMOTED).cast("bigint").alias("tier")
    return d.select("doc_id", tier)


def structural_scores(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "edges").select("edge_type").distinct()
    hops = kinds.select("edge_type", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("hop"))
    return hops.select("edge_type", "hop", ranking.structural_score(F.lit(0.8), F.col("edge_type"), F.col("hop")).alias("score"))


def _chunk_query(chunks: DataFrame) -> list[float]:
    """The vector of the first chunk that has one; a chunk that was indexed again has the same vector in both rows."""
    usable = chunks.where((F.size("embedding") == 64) & F.col("chunk_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    first = usable.orderBy("chunk_id", F.desc("indexed_at"), F.desc("row_id")).select("embedding").first()
    return list(first[0]) if first else [0.0] * 64


def chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.search(c, _chunk_query(c), WORDS, "vector").select("chunk_id", "source_file", "score")


def _graph(spark: SparkSession, sf: str) -> search.GraphIndex:
    """The graph tables of the dataset, made at the first search of the session as an index run would."""
    return search.cached_graph_index(table(spark, sf, "edges").select("edge_id", *graph.EDGE_KEY), "edge_id")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.search(c, _chunk_query(c), WORDS, "both", _graph(spark, sf))


def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.search(c, _chunk_query(c), WORDS, "graph", _graph(spark, sf))


def search_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return search.assemble_context(search.vector_leg(c, _chunk_query(c), 10))


QUERIES = {
    f.__name__: f
    for f in (
        vector_search, vector_search_min_score, batch_knn, retrieval_metrics, collection_stats, first_chunk_per_source, dimension_states, rrf_two_lists, rrf_weighted,
        bm25_rank, boosted_scores, keyword_demotion, keyword_overlap, source_tiers, structural_scores, chunk_search, hybrid_search, graph_search, search_context,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_SCORE = "1 - (1 - list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])) / 2"
_FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_ASKED = "lq AS (SELECT vec_id AS query_id, embedding AS q, label AS wanted FROM embeddings WHERE vec_id % 50 = 0)"
_KNN = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT query_id, vec_id, label, wanted, round({_SCORE.format('embedding', 'q')}, 4) AS score FROM embeddings, lq))"""


def _in_words(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _query_words() -> str:
    import re

    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(re.findall("[a-z]+", KEYWORD_QUERY.lower())) if len(w) > 3) + "]"


def tokens_sql(text: str) -> str:
    """Identifier tokens without look-ahead: capitals that begin a word are set apart first."""
    pieces = r"list_transform(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda p: lower(p))"
    return f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: list_concat([lower(w)], list_filter({pieces}, lambda p: p <> lower(w)))))"


def _lists(weight: str) -> str:
    def one(i: int, q: str, x: str) -> str:
        return f"""SELECT vec_id, {i} AS list_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, {x} AS weight FROM (
          SELECT vec_id, round({_SCORE.format('embedding', q)}, 4) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20)"""

    second = "(SELECT embedding FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 1)"
    return f"""WITH l AS ({one(0, _FIRST, '1.0::DOUBLE')} UNION ALL {one(1, second, weight)}),
      f AS (SELECT vec_id, round(sum(weight / (60 + rank)), 6) AS rrf_score, min(list_id * 1000 + rank) AS seen FROM l GROUP BY vec_id)
      SELECT vec_id, rrf_score, row_number() OVER (ORDER BY rrf_score DESC, seen, vec_id) AS fused_rank FROM f"""


_RANKED = "r AS (SELECT doc_id, text AS content, coalesce(source, '') AS source, coalesce(kind, '') AS kind, row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(kind, '') ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL)"
_HITS = f"len(list_filter({_query_words()}, lambda w: contains(lower(content), w)))"
_PATH = "lower(coalesce(source_id, ''))"
_BODY = "lower(coalesce(content, ''))"
_USABLE = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, row_id DESC) AS i FROM chunks WHERE len(embedding) = 64) WHERE i = 1)"

SQL = {
    "vector_search": f"SELECT vec_id, round({_SCORE.format('embedding', _FIRST)}, 4) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
    "vector_search_min_score": f"""SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, {_SCORE.format('embedding', _FIRST)} AS s FROM embeddings)
      WHERE s >= 0.55 ORDER BY score DESC, vec_id LIMIT 1000""",
    "batch_knn": f"WITH {_ASKED} SELECT query_id, vec_id, score, rank FROM {_KNN} WHERE rank <= 5",
    "retrieval_metrics": f"""WITH {_ASKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM {_KNN} WHERE rank <= 11 AND vec_id <> query_id),
      f AS (SELECT lq.query_id, min(r) FILTER (WHERE label = k.wanted) AS first FROM lq LEFT JOIN k ON k.query_id = lq.query_id GROUP BY lq.query_id)
      SELECT count(*) AS n_queries, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS r_at_1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS r_at_5,
        round(avg(coalesce((first <= 10)::INT, 0)), 6) AS r_at_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM f""",
    "collection_stats": "SELECT scope, count(*) AS n_chunks, count(DISTINCT source_file) AS n_sources FROM chunks GROUP BY scope",
    "first_chunk_per_source": """SELECT source_file, chunk_id, chunk_index FROM (
      SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, row_id) AS i FROM chunks) WHERE i = 1""",
    "dimension_states": "SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 64 THEN 'ok' ELSE 'other width' END AS state, count(*) AS n FROM chunks GROUP BY ALL",
    "rrf_two_lists": _lists("1.0::DOUBLE"),
    "rrf_weighted": _lists("0.5::DOUBLE"),
    "bm25_rank": f"""WITH d AS (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents),
      s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
      t AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS tok FROM d) GROUP BY ALL),
      df AS (SELECT tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM t, s GROUP BY tok, n),
      m AS (SELECT avg(idf) AS mean FROM df),
      q AS (SELECT tok, count(*) AS qf FROM (SELECT unnest({tokens_sql(repr(WORDS))}) AS tok) GROUP BY tok)
      SELECT t.doc_id, round(sum(qf * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 6) AS score
      FROM t JOIN q USING (tok) JOIN df USING (tok) JOIN d USING (doc_id), s, m GROUP BY t.doc_id""",
    "boosted_scores": f"""SELECT doc_chunk_id, round(least(greatest((length(content) % 100) / 100
        + {' + '.join(f'CASE WHEN {_in_words(_PATH, words)} THEN {by} ELSE 0 END' for by, words in ranking.PATH_BOOSTS)}
        + {' + '.join(f'CASE WHEN {_in_words(_BODY, words)} THEN {by} ELSE 0 END' for by, words in ranking.CONTENT_BOOSTS)}
        + least(0.15, 0.05 * ({' + '.join(f'{_in_words(_BODY, [w])}::INT' for w in ranking.PRESCRIPTIVE)})), 0), 1)::DOUBLE, 4) AS score FROM doc_chunks""",
    "keyword_demotion": f"WITH {_RANKED} SELECT doc_id, {_HITS} AS hits, row_number() OVER (PARTITION BY source, kind ORDER BY {_HITS} DESC, rank) AS new_rank FROM r",
    "keyword_overlap": f"""WITH {_RANKED}, c AS (SELECT source, kind, string_agg(content, ' ' ORDER BY rank) AS content FROM r WHERE rank <= 3 GROUP BY source, kind)
      SELECT source, kind, round({_HITS} / len({_query_words()}), 6) AS ratio FROM c""",
    "source_tiers": """SELECT doc_id, CASE WHEN h = 'velvet-ledge-etl.example.net' OR h LIKE '%.velvet-ledge-etl.example.net' OR h = 'dev.example.org' OR h LIKE '%.dev.example.org' THEN 0
      WHEN h = 'fe.example.com' OR h LIKE '%.fe.example.com' THEN 2 ELSE 1 END::BIGINT AS tier
      FROM (SELECT doc_id, lower(coalesce(source, 'none') || CASE WHEN lang = 'en' THEN '.example.net' ELSE '.dev.example.org' END) AS h FROM documents)""",
    "structural_scores": """SELECT edge_type, hop, round(0.8::DOUBLE * CASE edge_type WHEN 'imports' THEN 0.9::DOUBLE WHEN 'inherits' THEN 0.85 WHEN 'implements' THEN 0.85 WHEN 'calls' THEN 0.8 ELSE 0.7 END
      * pow(0.7::DOUBLE, hop - 1), 4) AS score FROM (SELECT DISTINCT edge_type FROM edges), (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS hop)""",
    "chunk_search": f"""WITH {_USABLE}, q AS (SELECT embedding FROM u WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 ORDER BY chunk_id LIMIT 1)
      SELECT chunk_id, source_file, round(s, 4) AS score FROM (
        SELECT chunk_id, source_file, {_SCORE.format('u.embedding', 'q.embedding')} AS s FROM u, q
        WHERE list_sum(list_transform(u.embedding, lambda x: x::DOUBLE * x)) > 0 AND NOT list_has_any(list_transform(u.embedding, lambda x: isfinite(x)), [false]))
      WHERE s >= 0.5 ORDER BY score DESC, chunk_id LIMIT 10""",
}
