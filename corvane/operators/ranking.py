"""Fusing and reordering ranked lists."""

from __future__ import annotations

import collections

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import lower_words, token_counts
from corvane.session import materialize

RRF_K = 60
# What a relation is worth, and what a hop costs.
EDGE_WEIGHTS = {"imports": 0.9, "inherits": 0.85, "implements": 0.85, "calls": 0.8}
DEFAULT_EDGE_WEIGHT, DEPTH_DECAY, CENTRALITY_WEIGHT = 0.7, 0.7, 0.1


def reciprocal_rank_fusion(lists: DataFrame, identity: str, k: int = RRF_K, record: Column | None = None, richness: Column | None = None) -> DataFrame:
    """Fuse ranked lists: sum of weight / (k + rank) for each identity, rounded to 6 decimals.

    ``lists``: list_id, rank (from 1), weight, ``identity``. An identity that stands twice in one list counts twice. Equal
    scores keep the order of their first appearance (list, then rank). With ``record``, the richest record
    survives, the earliest among equals. The result has ``fused_rank``.
    """
    aggs = [
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 6).alias("rrf_score"),
        F.min(F.struct("list_id", "rank")).alias("first_seen"),
    ]
    if record is not None:
        order = F.struct(richness if richness is not None else F.lit(0), -F.col("list_id"), -F.col("rank"))
        aggs.append(F.max_by(record, order).alias("record"))
    fused = lists.groupBy(identity).agg(*aggs)
    # an overall order of the fused candidates; lists are cut before they are fused, so this is small
    w = Window.orderBy(F.desc("rrf_score"), "first_seen", identity)
    return fused.withColumn("fused_rank", F.row_number().over(w).cast("bigint")).drop("first_seen")


def bm25(candidates: DataFrame, id_col: str, text: Column, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Rank candidates by BM25 over their own identifier tokens: ``id_col``, score (6 decimals).

    Statistics are those of the candidate set. The IDF of a token is ln(N - df + .5) - ln(df + .5), negative ones become epsilon
    times the mean IDF. A candidate stays if it shares a token with the query, whatever its score.
    """
    asked = token_counts(query)
    words = sorted(asked)
    kind = candidates.schema[id_col].dataType.simpleString()
    texts = candidates.select(F.col(id_col).alias("__id"), text.alias("__t"))

    def frequencies(batches):
        # summed up within a batch first, so a common token is one row of it
        for b in batches:
            df = collections.Counter()
            for t in b.column(0).to_pylist():
                df.update(token_counts(t or "").keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["tok", "df"])

    def measure(batches):
        for b in batches:
            counts = [token_counts(t or "") for t in b.column(1).to_pylist()]
            tf = pa.array([[c[w] for w in words] for c in counts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.total() for c in counts], pa.int64()), tf], names=[id_col, "dl", "tf"])

    # a document stays one row: its length and the counts of the query's tokens
    measured = materialize(texts.mapInArrow(measure, f"{id_col} {kind}, dl bigint, tf array<bigint>"), "measured")
    total = measured.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))  # one row
    df = texts.select("__t").mapInArrow(frequencies, "tok string, df bigint").groupBy("tok").agg(F.sum("df").alias("df"))
    idf = df.join(F.broadcast(total)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    known = F.map_from_entries(F.collect_list(F.when(F.col("tok").isin(*words), F.struct("tok", "idf"))))  # at most one entry for each token of the query
    stats = idf.agg(F.first("avgdl").alias("avgdl"), F.avg("idf").alias("mean_idf"), known.alias("idf"))
    parts = F.lit(0.0)
    for i, w in enumerate(words):
        tf, own = F.col("tf")[i], F.try_element_at("idf", F.lit(w))
        weight = F.when(own < 0, epsilon * F.col("mean_idf")).otherwise(own)
        parts = parts + F.when(tf > 0, asked[w] * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    hits = measured.where(F.exists("tf", lambda x: x > 0) if words else F.lit(False))
    return hits.join(F.broadcast(stats)).select(id_col, F.round(parts, 6).alias("score"))


def edge_weight(edge_type: Column | str) -> Column:
    edge_type = F.col(edge_type) if isinstance(edge_type, str) else edge_type
    weights = F.create_map(*(F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(weights, edge_type), F.lit(DEFAULT_EDGE_WEIGHT))


def structural_score(seed_score: Column, edge_type: Column, depth: Column) -> Column:
    """Worth of a neighbour: its seed's score times the relation's weight, decayed by each hop after the first."""
    return F.round(seed_score * edge_weight(edge_type) * F.pow(F.lit(DEPTH_DECAY), depth - 1), 4)


def final_order() -> list[Column]:
    """The order of results of several sources: fused ones first, by fused and then by raw score. Null scores come last."""
    return [F.desc_nulls_last("rrf_score"), F.desc_nulls_last("score")]


# Words in paths and contents that move a result, and by how much.
PATH_BOOSTS = ((0.15, ("official", "reference", "spec", "doc")), (0.10, ("example", "guide", "tutorial", "how-to")), (-0.10, ("discussion", "issue", "comment", "forum")))
CONTENT_BOOSTS = ((0.05, ("example", "code", "implementation", "usage")), (-0.02, ("theory", "concept", "explain", "describe")))
PRESCRIPTIVE = (
    "should be", "should not", "recommended", "best practice", "avoid", "must be", "always use", "never use", "prefer", "instead of",
    "anti-pattern", "pitfall", "common mistake", "keep separate", "don't", "do not", "make sure to",
)


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def boosted_score(score: Column, path: Column, content: Column) -> Column:
    """Score moved by what path and content say, kept within 0 and 1."""
    path, content = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    boost = F.lit(0.0)
    for by, words in PATH_BOOSTS:
        boost = boost + F.when(_any(path, words), by).otherwise(0.0)
    for by, words in CONTENT_BOOSTS:
        boost = boost + F.when(_any(content, words), by).otherwise(0.0)
    hits = F.lit(0)
    for w in PRESCRIPTIVE:
        hits = hits + F.contains(content, F.lit(w)).cast("int")
    return F.least(F.greatest(score + boost + F.least(F.lit(0.15), hits * 0.05), F.lit(0.0)), F.lit(1.0))


def query_words(query: str) -> Column:
    """Distinct words of more than three letters."""
    return F.filter(F.array_distinct(lower_words(F.lit(query))), lambda w: F.length(w) > 3)


def keyword_hits(content: Column, query: str) -> Column:
    """Number of the query's words that the content holds."""
    c = F.lower(F.coalesce(content, F.lit("")))
    return F.size(F.filter(query_words(query), lambda w: F.contains(c, w)))


def demote_by_keywords(ranked: DataFrame, query: str, lists: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """Stable reordering of each list by keyword hits: ``hits`` and ``new_rank``; results without any go to the end.

    ``lists`` are the columns that tell lists apart; only hits and ranks are sorted, and contents are read in the scan.
    """
    hit = ranked.withColumn("hits", keyword_hits(F.col("content"), query).cast("bigint")).drop("content")
    return hit.withColumn("new_rank", F.row_number().over(Window.partitionBy(*lists).orderBy(F.desc("hits"), rank)).cast("bigint"))


def keyword_overlap_ratio(ranked: DataFrame, query: str, lists: tuple[str, ...] = (), top: int = 3, rank: str = "rank") -> DataFrame:
    """Share of the query's words that stand in the top results of each list together; 1 if it has none."""
    joined = ranked.where(F.col(rank) <= top).groupBy(*lists).agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct(F.col(rank), F.lower("content").alias("c")))).getField("c")).alias("all"))
    words = query_words(query)
    found = F.size(F.filter(words, lambda w: F.contains(F.col("all"), w)))
    return joined.select(*lists, F.when(F.size(words) == 0, 1.0).otherwise(F.round(found / F.size(words), 6)).alias("ratio"))


def source_tier(host: Column, preferred, demoted) -> Column:
    """0 for preferred hosts and their sub-domains, 2 for demoted ones, else 1."""
    host = F.lower(host)
    within = lambda names: F.exists(F.array(*(F.lit(n) for n in names)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return F.when(within(preferred), 0).when(within(demoted), 2).otherwise(1)


def retrieval_metrics(hits: DataFrame, queries: DataFrame, query_col: str = "query_id") -> DataFrame:
    """recall@1, @5, @10 and MRR over the rank of the first relevant hit; queries without one count as missed.

    ``hits``: query, rank, relevant.
    """
    first = hits.where("relevant").groupBy(query_col).agg(F.min("rank").alias("first"))
    per = queries.select(query_col).distinct().join(first, query_col, "left")
    recall = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6)
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"),
        recall(1).alias("r_at_1"),
        recall(5).alias("r_at_5"),
        recall(10).alias("r_at_10"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
