"""Exact vector search and collection statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision, null where a vector is zero or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_to(a: Column, query: list[float]) -> Column:
    """:func:`cosine` with one literal vector, in a single pass over the elements; null for another width or a zero vector."""
    q = [float(x) for x in query]
    length = sum(x * x for x in q) ** 0.5
    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq"))

    def add(s, p):
        x = p["x"].cast("double")
        return F.struct((s["dot"] + x * p["q"]).alias("dot"), (s["sq"] + x * x).alias("sq"))

    pairs = F.zip_with(a, F.array(*(F.lit(x) for x in q)), lambda x, y: F.struct(x.alias("x"), y.alias("q")))
    done = F.aggregate(pairs, start, add, lambda s: F.when(s["sq"] > 0, s["dot"] / (F.sqrt(s["sq"]) * F.lit(length))))
    return F.when((F.size(a) == len(q)) & F.lit(length > 0), done)


def score_of(similarity: Column) -> Column:
    """1 for the same direction, 0 for the opposite one: 1 - distance / 2 with distance 1 - cosine."""
    return 1 - (1 - similarity) / 2


def knn(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", embedding: str = "embedding", min_score: float | None = None) -> DataFrame:
    """The ``limit`` best rows for one query vector: ``id_col`` and score, rounded to 4 decimals.

    The query is a literal, so this is one scan with a top-k. ``min_score`` is tested on the unrounded score. Equal rounded
    scores go to the smaller id.
    """
    scored = vectors.select(id_col, score_of(cosine_to(F.col(embedding), query)).alias("s")).where(F.col("s").isNotNull())
    if min_score is not None:
        scored = scored.where(F.col("s") >= min_score)
    return scored.select(id_col, F.round("s", 4).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


#: Queries and vectors of one block of a batch search.
BLOCK_QUERIES, BLOCK_VECTORS = 8_192, 16_384


def batch_knn(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``limit`` best rows for each row of ``queries`` (query_id, q): query_id, ``id_col``, score (4 decimals), rank.

    A stated query set against all rows, in blocks of a bounded number of both, so that neither side is broadcast; a block is one
    matrix product and keeps the best rows of each query. Only vectors of the width of the query that aren't zero have a score. Equal scores go to the smaller id.
    """
    wide = queries.where("q IS NOT NULL").select("query_id", "q")
    rows = vectors.where(F.col(embedding).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(embedding).alias("v"))
    n_queries, n_rows = wide.count(), rows.count()
    blocks, slices = max(1, -(-n_queries // BLOCK_QUERIES)), max(1, -(-n_rows // BLOCK_VECTORS))
    key = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    asked = wide.select(key("query_id", blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "query_id", "q")
    given = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), key("id", slices, 2).alias("slice"), "id", "v")
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((vectors, id_col), (queries, "query_id")))

    def matrix(column, width: int) -> np.ndarray:
        m = np.array([x if len(x) == width and None not in x else [np.nan] * width for x in column.to_pylist()], dtype=np.float64).reshape(-1, width)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.take(pc.sort_indices(two, sort_keys=[("id", "ascending")]))
        parts: list[tuple] = []
        width = pc.list_value_length(one.column("q")).to_numpy() if one.num_rows else np.zeros(0, dtype=int)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            q, m = matrix(one.column("q").take(pa.array(rows)), int(w)), matrix(two.column("v"), int(w))
            for a in range(0, len(rows), 256):
                score = np.round(1 - (1 - q[a : a + 256] @ m.T) / 2, 4)
                score = np.where(np.isfinite(score), score, -9)
                for r, s in zip(rows[a : a + 256], score):
                    least = np.partition(s, len(s) - limit)[len(s) - limit] if len(s) > limit else -9
                    at = np.flatnonzero((s >= least) & (s > -9))
                    best = at[np.lexsort((at, -s[at]))][:limit]  # rows stand in order of their ids
                    parts.append((np.full(len(best), r), best, s[best]))
        q, m, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"query_id": one.column("query_id").take(pa.array(q)), id_col: two.column("id").take(pa.array(m)), "score": pa.array(s, pa.float64())})

    pairs = asked.groupBy("block", "slice").cogroup(given.groupBy("block", "slice")).applyInArrow(compare, f"query_id {query_type}, {id_col} {id_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def pack_vector(embedding: Column | str) -> Column:
    """A vector as the bytes of its 32-bit floats, lowest byte first; null for null."""

    def pack(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, dtype="<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    return F.arrow_udf(pack, "binary")(embedding)


def unpack_vector(packed: Column | str) -> Column:
    """The vector of :func:`pack_vector`; bytes that aren't whole floats give null."""

    def unpack(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist() for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return F.arrow_udf(unpack, "array<float>")(packed)


def packed_dimension(packed: Column | str) -> Column:
    """Elements of a packed vector, by its bytes alone."""
    return (F.octet_length(packed) / 4).cast("int")


def collection_stats(chunks: DataFrame, collection: str, source: str) -> DataFrame:
    """Chunks and distinct sources of each collection."""
    return chunks.groupBy(collection).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(source).alias("n_sources"))


def first_chunk_per_source(chunks: DataFrame, source: str = "source_file", order: tuple[str, ...] = ("chunk_index", "row_id")) -> DataFrame:
    """The first chunk of each source; the limit per source is applied before the exchange too."""
    w = Window.partitionBy(source).orderBy(*order)
    return chunks.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def dimension_check(vectors: DataFrame, embedding: str, dimension: int) -> DataFrame:
    """Rows of vectors by whether they have the width of the table; null vectors are unusable."""
    kind = F.when(F.col(embedding).isNull(), "missing").when(F.size(embedding) == dimension, "ok").otherwise("other width")
    return vectors.groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("n"))
