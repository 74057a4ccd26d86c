"""Most similar vectors for every vector, by a permutation index.

A bounded sample of the vectors serves as pivots. Each vector is represented by its nearest pivots in order of
similarity, and is posted in the inverted files of the first few of them. All vectors are queries: a query reads
the files of the same pivots, ranks what it finds by the footrule distance of the two orders, and only the
best ranked are compared by their cosine in double precision.

Pivots have two levels. Leaders group them, and beyond ``EXACT_PIVOTS`` a vector looks for its nearest pivots among those of its nearest leaders, so the
work for a vector grows with the root of their number. The files of neighbouring pivots form a cell, which is one task's block: a vector
travels once to each cell, not to each file. A file of more than ``TILE`` vectors (a hot pivot) is a cell of its own and is cut into
chunks, and every pair of chunks is a block of its own, so nothing is left out. Vectors of equal direction, whatever their
length, are copies and indexed once: of a group of copies only the few smallest ids can be among anyone's neighbours, and
all copies get their result from the common one. Members that tie in the footrule distance at the end of the best ranked are all
compared, so no neighbour is an arbitrary one of several.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialize

DIMENSIONS = 64
#: Vectors for each pivot, and the bounds of the number of pivots; the largest sample has MAX_PIVOTS vectors (64 MB).
VECTORS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 50, 16, 262_144
#: Pivots in a vector's order, pivots under which it is posted, best ranked candidates of a file that are compared again.
ORDER, POSTINGS, RERANK = 16, 4, 150
#: Pivots up to which all are compared with each vector, and groups of pivots that are looked into beyond that.
EXACT_PIVOTS, PROBES = 8_192, 64
TILE = 2_000
#: Pivots of a cell, at most about this many, and the postings that they may have together.
CELL_PIVOTS, CELL_POSTINGS = 8, 4_000
#: Unit vectors that agree in all elements to this are copies. Float rounding of a rescaled copy moves an element by at most 6e-8 of itself,
#: so it seldom falls elsewhere (it is then indexed besides); the cosine of two copies rounds to 1.
SAME = 1e-6


def usable(embedding: str, dimensions: int = DIMENSIONS):
    """Whether a vector has the right length, finite elements only and one that isn't zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(embedding) == dimensions) & finite & F.exists(embedding, lambda x: x != 0)


def _matrix(column, dimensions: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    m /= np.abs(m).max(axis=1, keepdims=True)  # against overflow of the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@dataclass
class Pivots:
    """Pivots, their leaders, and the numbers of the pivots nearest to each leader."""

    vectors: np.ndarray
    leaders: np.ndarray
    groups: list[np.ndarray]
    exact: int = EXACT_PIVOTS
    probes: int = PROBES

    @classmethod
    def of(cls, vectors: np.ndarray, exact: int = EXACT_PIVOTS, probes: int = PROBES) -> Pivots:
        v = vectors.astype(np.float32)
        leaders = v[: max(1, round(len(v) ** 0.5))]  # the sample is in the order of a hash
        nearest = np.concatenate([(v[i : i + 8192] @ leaders.T).argmax(axis=1) for i in range(0, len(v), 8192)])
        groups = [np.flatnonzero(nearest == g) for g in range(len(leaders))]
        return cls(v, leaders, groups, exact, probes)


def _best(similarity: np.ndarray, length: int) -> np.ndarray:
    """Columns of the ``length`` highest values of each row, highest first, the smaller column first among equals."""
    if length < similarity.shape[1]:
        top = np.argpartition(-similarity, length - 1, axis=1)[:, :length]
    else:
        top = np.broadcast_to(np.arange(similarity.shape[1]), similarity.shape)
    values = np.take_along_axis(similarity, top, axis=1)
    return np.take_along_axis(top, np.lexsort((top, -values), axis=1), axis=1)


def pivot_orders(vectors: np.ndarray, pivots: Pivots, length: int) -> np.ndarray:
    """The numbers of the ``length`` nearest pivots of each vector, nearest first; beyond ``pivots.exact`` pivots nearly so."""
    p = pivots.vectors
    length = min(length, len(p))
    out = np.empty((len(vectors), length), dtype=np.int32)
    if len(p) <= pivots.exact:
        step = max(64, (1 << 22) // len(p))  # so that the similarities at hand stay at 16 MB
        for a in range(0, len(vectors), step):
            out[a : a + step] = _best(vectors[a : a + step].astype(np.float32) @ p.T, length)
        return out
    probes = min(pivots.probes, len(pivots.leaders))
    for a in range(0, len(vectors), 4096):
        v = vectors[a : a + 4096].astype(np.float32)
        near = _best(v @ pivots.leaders.T, probes)
        similarity = np.full((len(v), probes, length), -9, dtype=np.float32)
        names = np.zeros((len(v), probes, length), dtype=np.int32)
        order = np.argsort(near, axis=None, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(near.ravel()[order])) + 1):
            rows, slots = np.divmod(part, probes)
            group = pivots.groups[near[rows[0], slots[0]]]
            if len(group):
                s = v[rows] @ p[group].T
                best = _best(s, min(length, len(group)))
                similarity[rows, slots, : best.shape[1]] = np.take_along_axis(s, best, axis=1)
                names[rows, slots, : best.shape[1]] = group[best]
        flat = similarity.reshape(len(v), -1)
        out[a : a + len(v)] = np.take_along_axis(names.reshape(len(v), -1), _best(flat, length), axis=1)
    return out


def cells_of(pivots: Pivots, sizes: np.ndarray, tile: int) -> np.ndarray:
    """The cell of each pivot: neighbouring ones together, up to a number of pivots and of postings; those of more than ``tile`` alone."""
    cell, number = np.empty(len(sizes), dtype=np.int64), 0
    for group in pivots.groups:
        cold = group[sizes[group] <= tile]
        leaders = cold[::CELL_PIVOTS]
        near = (pivots.vectors[cold] @ pivots.vectors[leaders].T).argmax(axis=1) if len(cold) else np.zeros(0, dtype=int)
        for i in range(len(leaders)):
            held = count = 0
            for x in cold[near == i]:
                if count and (count >= 2 * CELL_PIVOTS or held + sizes[x] > CELL_POSTINGS):
                    number, held, count = number + 1, 0, 0
                cell[x], held, count = number, held + sizes[x], count + 1
            number += 1
        for x in group[sizes[group] > tile]:
            cell[x] = number
            number += 1
    return cell


def footrule_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows of pivot orders a constant minus half their footrule distance.

    A pivot that an order lacks counts as standing right behind its end. A pivot that stands at i and j in both then takes max(i, j) less than that
    from the distance: its weights are looked up in a table of the rows of ``a`` for one place of all rows of ``b`` after the other.
    """
    length = a.shape[1]
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    index = index.reshape(len(a) + len(b), length)
    weights = np.zeros((len(a), len(names)), dtype=np.uint8)
    weights[np.arange(len(a))[:, None], index[: len(a)]] = length - np.arange(length)
    common = np.zeros((len(a), len(b)), dtype=np.int16)
    for t in range(length):
        common += np.minimum(weights[:, index[len(a) :, t]], np.uint8(length - t))
    return common


def _directions(vectors: np.ndarray) -> list[bytes]:
    """A key of the direction of each unit vector, equal for copies (see ``SAME``)."""
    cells = np.rint(vectors / SAME).astype(np.int32)
    return [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in cells]


def _compare(vectors: np.ndarray, order: np.ndarray, q: np.ndarray, m: np.ndarray, k: int, rerank: int):
    """Query, member and cosine of the k best members for each query of a file: ranked by footrule, then the best ranked (with all that tie) by cosine.

    Members stand in order of their ids, so the smaller id wins among equals.
    """
    found = []
    for a in range(0, len(q), 256):
        rows = q[a : a + 256]
        rank = footrule_similarity(order[rows], order[m])
        rank[rows[:, None] == m[None, :]] = -1
        best = rank >= 0
        if len(m) > rerank:
            best &= rank >= np.partition(rank, len(m) - rerank, axis=1)[:, len(m) - rerank, None]
        if len(m) <= 4 * rerank:  # a product of matrices is cheaper than the pairs one by one
            cosine = np.where(best, np.round(vectors[rows] @ vectors[m].T, 6), -9)
        else:
            cosine = np.full(rank.shape, -9.0)
            row, column = np.nonzero(best)
            for i in range(0, len(row), 1 << 15):  # in steps of 32 MB
                x, y = row[i : i + (1 << 15)], column[i : i + (1 << 15)]
                cosine[x, y] = np.round(np.einsum("ij,ij->i", vectors[rows[x]], vectors[m[y]]), 6)
        value = np.rint(cosine * 1e6).astype(np.int64) * len(m) - np.arange(len(m))
        top = np.argpartition(-value, k - 1, axis=1)[:, :k] if len(m) > k else np.tile(np.arange(len(m)), (len(rows), 1))
        s = np.take_along_axis(cosine, top, axis=1)
        row, place = np.nonzero(s > -2)
        found.append((rows[row], m[top[row, place]], s[row, place]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]


def _block(table: pa.Table, k: int, dimensions: int, rerank: int) -> pa.Table:
    """The k best members of a cell for each of its queries, over the files that they share."""
    table = table.take(pc.sort_indices(table, sort_keys=[("rep", "ascending")]))
    rep = table.column("rep").combine_chunks()
    vectors = _matrix(table.column("e"), dimensions)
    order = np.stack(table.column("pivots").to_numpy()) if table.num_rows else np.zeros((0, 1), dtype=np.int32)
    is_query, is_member = (table.column(c).to_numpy(zero_copy_only=False) for c in ("is_query", "is_member"))
    files = table.column("files").combine_chunks()
    file, row = files.flatten().to_numpy(), pc.list_parent_indices(files).to_numpy()
    by = np.argsort(file, kind="stable")
    parts = []
    for rows in np.split(row[by], np.flatnonzero(np.diff(file[by])) + 1):
        if len(rows):
            parts.append(_compare(vectors, order, rows[is_query[rows]], rows[is_member[rows]], k, rerank))
    q, m, cosine = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    # a pair may stand in several files of the cell
    _, one = np.unique(q * len(vectors) + m, return_index=True)
    q, m, cosine = q[one], m[one], cosine[one]
    by = np.lexsort((m, -cosine, q))
    q, m, cosine = q[by], m[by], cosine[by]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.table({"q": rep.take(pa.array(q[kept])), "m": rep.take(pa.array(m[kept])), "cosine": pa.array(cosine[kept], pa.float64())})


def _first(df: DataFrame, partition: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the limit is also applied before the exchange."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__i") <= k).drop("__i")


def nearest(
    vectors: DataFrame,
    id_col: str,
    embedding: str,
    k: int = 5,
    *,
    dimensions: int = DIMENSIONS,
    vectors_per_pivot: int = VECTORS_PER_PIVOT,
    order: int = ORDER,
    postings: int = POSTINGS,
    rerank: int = RERANK,
    tile: int = TILE,
    exact_pivots: int = EXACT_PIVOTS,
    probes: int = PROBES,
) -> DataFrame:
    """``id_col``, ``neighbour``, ``cosine`` (rounded to 6 decimals): the k most similar others of every id, nearly always.

    Ids are strings. Rows whose id is null or whose vector isn't :func:`usable` are left out; an id with several
    rows counts once (with its smallest vector). Equal cosines go to the smaller id. Fewer than k + 1 ids have
    fewer neighbours; an empty table has none. Extra columns are ignored. Only the pivots are a sample (of at most
    MAX_PIVOTS vectors); all vectors are indexed and all are queries.
    """
    spark = vectors.sparkSession
    ok = vectors.where(F.col(id_col).isNotNull() & usable(embedding, dimensions))
    once = ok.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(embedding).alias("e"))

    def direct(batches):
        for b in batches:
            keys = _directions(_matrix(b.column("e"), dimensions)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), pa.array(keys, type=pa.binary())], names=["id", "e", "direction"])

    ids = materialize(once.mapInArrow(direct, "id string, e array<float>, direction binary"), "vectors")
    first = F.min(F.struct("id", "e"))
    groups = ids.groupBy("direction").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.select("direction", F.col("first.id").alias("rep"), F.col("first.e").alias("e"), "n"), "distinct-vectors")
    n = groups.count()
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, n // vectors_per_pivot), max(n, 1))
    sample = groups.select("e", F.xxhash64("rep").alias("x"), "rep").orderBy("x", "rep").limit(wanted).select("e").toArrow()
    pivots = Pivots.of(_matrix(sample.column("e"), dimensions) if sample.num_rows else np.zeros((1, dimensions)), exact_pivots, probes)
    shared = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS rows

    def count(batches):
        sizes = np.zeros(len(shared.value.vectors), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                o = pivot_orders(_matrix(b.column("e"), dimensions), shared.value, order)[:, :postings]
                sizes += np.bincount(o.ravel(), minlength=len(sizes))
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], names=["pivot", "n"])

    counts = groups.select("e").mapInArrow(count, "pivot bigint, n bigint").groupBy("pivot").agg(F.sum("n").alias("n"))
    sizes = np.zeros(len(pivots.vectors), dtype=np.int64)
    for r in counts.toLocalIterator():  # at most one row for each pivot
        sizes[r.pivot] = r.n
    split = spark.sparkContext.broadcast((cells_of(pivots, sizes, tile), np.maximum(1, -(-sizes // tile))))

    def post(batches):
        names = ["cell", "i", "j", "is_query", "is_member", "rep", "e", "pivots", "files"]
        cells, chunks = split.value
        for b in batches:
            if not b.num_rows:
                continue
            o = pivot_orders(_matrix(b.column("e"), dimensions), shared.value, order)
            files = o[:, :postings]
            row, file = np.repeat(np.arange(len(o)), files.shape[1]), files.ravel().astype(np.int64)
            by = np.lexsort((file, cells[file], row))
            row, file = row[by], file[by]
            # a vector goes once to each of its cells, with the files that it is posted in there
            start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cells[file[1:]] != cells[file[:-1]])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(file.astype(np.int32)))
            row, file = row[start], file[start]
            of = chunks[file]  # more than one only for a file that is a cell of its own
            own = row * 2654435761 % (1 << 31) % of
            at = np.arange(len(row))
            parts = [(at, own, own, True, True)]
            many = np.flatnonzero(of > 1)
            if len(many):
                other = np.concatenate([np.delete(np.arange(of[x]), own[x]) for x in many])
                back = np.repeat(many, of[many] - 1)
                parts.append((back, own[back], other, True, False))
                parts.append((back, other, own[back], False, True))
            for at, i, j, is_query, is_member in parts:
                r = row[at]
                flags = [pa.array(np.full(len(r), x)) for x in (is_query, is_member)]
                orders = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * o.shape[1]), pa.array(o[r].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[file[at]]), pa.array(i), pa.array(j), *flags, b.column("rep").take(pa.array(r)), b.column("e").take(pa.array(r)), orders, lists.take(pa.array(at))],
                    names=names,
                )

    posted = groups.select("rep", "e").mapInArrow(
        post, "cell bigint, i bigint, j bigint, is_query boolean, is_member boolean, rep string, e array<float>, pivots array<int>, files array<int>"
    )
    found = posted.groupBy("cell", "i", "j").applyInArrow(
        lambda t: _block(t, k, dimensions, rerank), "q string, m string, cosine double"
    )
    # a pair may be found in several cells; its copies have equal ranks and are dropped without another exchange
    ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "m"))).where(F.col("r") <= k)
    best = ranked.select("q", "m", "cosine").distinct()
    # copies: of each group the k + 1 smallest ids can be neighbours, one more than k because an id isn't its own
    copies = groups.where("n > 1").select("rep", "direction")
    members = ids.select("id", "direction").join(copies, "direction").select("rep", "id")
    few = _first(members, ["rep"], ["id"], k + 1)
    own = members.join(few.select(F.col("rep").alias("rep2"), F.col("id").alias("other")), F.col("rep") == F.col("rep2"))
    own = own.where("id <> other").select("id", F.col("other").alias("neighbour"), F.lit(1.0).alias("cosine"))
    target = best.join(few.select(F.col("rep").alias("m2"), "id"), F.col("m") == F.col("m2"), "left").select(
        "q", F.coalesce("id", "m").alias("neighbour"), "cosine"
    )
    reached = _first(target, ["q"], [F.desc("cosine"), "neighbour"], k)
    every = reached.join(members.select("rep", "id"), F.col("q") == F.col("rep"), "left").select(
        F.coalesce("id", "q").alias("id"), "neighbour", "cosine"
    )
    return _first(every.unionByName(own), ["id"], [F.desc("cosine"), "neighbour"], k).select(F.col("id").alias(id_col), "neighbour", "cosine")


def neighbour_pairs(chunks: DataFrame, k: int = 5, **parameters) -> DataFrame:
    """chunk_id_a < chunk_id_b of all pairs of which at least one is among the k neighbours of the other."""
    near = nearest(chunks, "chunk_id", "embedding", k, **parameters)
    return near.select(
        F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")
    ).distinct()


#: Queries and vectors of one block of the exact comparison.
EXACT_QUERIES, EXACT_VECTORS = 8_192, 16_384


def exact_neighbours(vectors: DataFrame, id_col: str, embedding: str, is_query: str, k: int = 5, *, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id_col``, ``neighbour``, ``cosine`` (rounded to 6 decimals) of every id that has a row where ``is_query`` holds, against all ids.

    The same rules as :func:`nearest`, but every query is compared with every vector, in blocks of a bounded number of both, so it is meant for a stated set of
    queries; with all rows as queries it is the exact form of the whole job, whose work is quadratic.
    """
    ok = vectors.where(F.col(id_col).isNotNull() & usable(embedding, dimensions))
    asked = F.max(F.coalesce(F.expr(is_query), F.lit(False)))
    once = materialize(ok.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(embedding).alias("e"), asked.alias("asked")), "all-vectors")
    n = once.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()  # one row
    blocks, slices = max(1, -(-n.q // EXACT_QUERIES)), max(1, -(-n.n // EXACT_VECTORS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    side = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    queries = once.where("asked").select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "id", "e", F.lit(True).alias("is_query"))
    members = once.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), side.alias("slice"), "id", "e", F.lit(False).alias("is_query"))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")]))
        ids, v, asks = t.column("id").combine_chunks(), _matrix(t.column("e"), dimensions), t.column("is_query").to_numpy(zero_copy_only=False)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        _, key = np.unique(np.array(ids.to_pylist(), dtype=object).astype(str), return_inverse=True) if len(ids) else (None, np.zeros(0, dtype=int))
        parts = []
        for a in range(0, len(q), 256):
            rows = q[a : a + 256]
            cosine = np.round(v[rows] @ v[m].T, 6)
            cosine[key[rows][:, None] == key[m][None, :]] = -9
            best = _best(cosine, min(k, len(m))) if len(m) else np.zeros((len(rows), 0), dtype=int)
            s = np.take_along_axis(cosine, best, axis=1)
            # ties at the end go to the smaller id, which argpartition doesn't know
            last = s[:, -1:] if s.size else np.zeros((len(rows), 1))
            row, column = np.nonzero(cosine >= last) if s.size else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
            value = cosine[row, column]
            by = np.lexsort((column, -value, row))
            row, column, value = row[by], column[by], value[by]
            kept = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (value > -2)
            parts.append((rows[row[kept]], m[column[kept]], value[kept]))
        q, m, cosine = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"id": ids.take(pa.array(q)), "neighbour": ids.take(pa.array(m)), "cosine": pa.array(cosine, pa.float64())})

    found = queries.unionByName(members).groupBy("block", "slice").applyInArrow(run, "id string, neighbour string, cosine double")
    return _first(found, ["id"], [F.desc("cosine"), "neighbour"], k).select(F.col("id").alias(id_col), "neighbour", "cosine")


def recall(chunks: DataFrame, k: int = 5, **parameters) -> DataFrame:
    """n_queries, n_true, n_found and recall of :func:`nearest` for the chunk ids with a row whose row_id is divisible by 50, against the exact neighbours."""
    truth = materialize(exact_neighbours(chunks, "chunk_id", "embedding", "row_id % 50 = 0", k, dimensions=parameters.get("dimensions", DIMENSIONS)), "true-neighbours").drop("cosine")
    near = nearest(chunks, "chunk_id", "embedding", k, **parameters).select("chunk_id", "neighbour", F.lit(1).alias("hit"))
    joined = truth.join(near, ["chunk_id", "neighbour"], "left")
    sums = joined.agg(F.countDistinct("chunk_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return sums.withColumn("recall", F.when(F.col("n_true") > 0, F.round(F.col("n_found") / F.col("n_true"), 4)))
