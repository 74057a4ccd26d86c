"""References to records that do not exist at the time of the reference.

Keys are partitioned into ranges of their hashed domain. The parents of a range become one sorted
array; batches of references of the same range are probed against it by binary search, all at once
in numpy. A range with many references, such as one with a hot key, is split into salts of a bounded
number of references, and its (small) parent array is sent to every salt. Batches are numbered, and the
number decides the partition, so tasks get equally many of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.paths import canonical_path
from corvane.session import materialize

PARENTS_PER_RANGE = 20_000
REFS_PER_BATCH = 150_000
#: The table of ranges (a few numbers each) is broadcast up to 2**16 rows, about 2 MB; beyond that it is joined.
BROADCAST_BITS = 16
#: The range of the references that are passed on; it has no parents.
PASSED_ON = -1
FOREVER = (1 << 62) - 1
BEFORE = -(1 << 62)


def _key_range(key: Column, bits: int) -> Column:
    """Number of the range of the hashed key domain, of 2**bits equal ones."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0).cast("long")


def _probe(refs, parents):
    """Judge one batch of references against the sorted array of its range."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = refs.num_rows
    no_time = refs.column("t").is_null().to_numpy(zero_copy_only=False)
    t = pc.fill_null(refs.column("t").cast(pa.int64()), FOREVER).to_numpy()
    h = refs.column("h").to_numpy()
    judged = refs.column("reason").is_null().to_numpy(zero_copy_only=False)
    found = np.zeros(n, dtype=bool)
    alive = np.zeros(n, dtype=bool)
    ended = np.zeros(n, dtype=bool)
    if parents.num_rows and n:
        begun = pc.fill_null(parents.column("start").cast(pa.int64()), BEFORE)  # before sorting: a null start is the earliest
        parents = parents.set_column(parents.schema.get_field_index("start"), "start", begun)
        parents = parents.take(pc.sort_indices(parents, sort_keys=[("h", "ascending"), ("key", "ascending"), ("start", "ascending")]))
        ph = parents.column("h").to_numpy()
        key = parents.column("key").combine_chunks()
        start = parents.column("start").to_numpy()
        end = pc.fill_null(parents.column("end").cast(pa.int64()), FOREVER).to_numpy()
        new = np.ones(len(ph), dtype=bool)
        new[1:] = (ph[1:] != ph[:-1]) | ~pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        uh, ukey = ph[first], key.take(pa.array(first))
        # binary search by hash, then equality of the keys themselves; equal hashes of unequal keys are walked
        at = np.searchsorted(uh, h, "left")
        open_ = np.arange(n)
        rkey = refs.column("key").combine_chunks()
        while len(open_):
            at_open = at[open_]
            open_ = open_[(at_open < len(uh)) & (uh[np.minimum(at_open, len(uh) - 1)] == h[open_])]
            same = pc.equal(ukey.take(pa.array(at[open_])), rkey.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            found[open_[same]] = True
            open_ = open_[~same]
            at[open_] += 1
        hit = np.flatnonzero(found)
        k = at[hit]
        # lives of a key in order of their start, with the latest end so far and the earliest end of all
        ends, place = np.unique(end, return_inverse=True)
        latest = ends[np.maximum.accumulate(rank * len(ends) + place) - rank * len(ends)]
        earliest = np.minimum.reduceat(end, first)
        starts = np.unique(start)
        width = len(starts) + 1
        lives = rank * width + np.searchsorted(starts, start) + 1
        i = np.searchsorted(lives, k * width + np.searchsorted(starts, t[hit], "right"), "right") - 1
        has_begun = (i >= first[k]) & (i >= 0)
        alive[hit] = has_begun & (latest[np.maximum(i, 0)] > t[hit])
        ended[hit] = earliest[k] <= t[hit]
    alive |= found & no_time
    reason = np.full(n, None, dtype=object)
    reason[judged & ~found] = "missing"
    reason[judged & found & ~alive & ended] = "deleted"
    reason[judged & found & ~alive & ~ended] = "late"
    old = refs.column("reason")
    out = pa.chunked_array([pa.array(reason, type=pa.string())])
    keep = pa.array(judged)
    return pa.table(
        {
            "edge_id": refs.column("edge_id"),
            "ref_field": refs.column("ref_field"),
            "reason": pc.if_else(keep, out, old),
            "key": refs.column("key"),
            "symbol": refs.column("symbol"),
            "t": refs.column("t"),
        }
    )


def _batches(n_rows: Column) -> Column:
    return F.ceil(n_rows / REFS_PER_BATCH).cast("int")


def probe_references(refs: DataFrame, parents: DataFrame, sizes: DataFrame | None = None, n_passed: int = 0) -> DataFrame:
    """Add to each reference the reason why its record is not alive, null if it is.

    ``refs``: edge_id, ref_field, key, symbol, t (timestamp), reason. A row whose reason is already set is passed
    on as it is. ``parents``: key, start, end; a null start has always been, a null end goes on, repeated rows
    and overlapping lives are allowed. Rows of ``parents`` with a null key name nothing. A reference whose t is
    null is only judged by whether its key exists. ``sizes`` holds ``key`` of the references to be judged if that
    is cheaper to get than ``refs`` itself; ``n_passed`` is then the most rows whose reason is set.
    """
    parents = parents.where("key IS NOT NULL")
    n_parents = parents.count()
    bits = max(0, math.ceil(math.log2(max(1, n_parents / PARENTS_PER_RANGE))))
    judge = F.col("reason").isNull()
    key_range, n_rows = _key_range(F.col("key"), bits), F.count(F.lit(1)).alias("n")
    if sizes is None:
        counts = refs.groupBy(F.when(judge, key_range).otherwise(PASSED_ON).alias("range")).agg(n_rows)
    else:
        counts = sizes.groupBy(key_range.alias("range")).agg(n_rows)
        counts = counts.unionByName(refs.sparkSession.range(1).select(F.lit(PASSED_ON).cast("long").alias("range"), F.lit(n_passed).cast("long").alias("n")))
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the table of ranges only
    numbered = counts.where("n > 0").select("range", "n", _batches(F.col("n")).alias("salts"))
    numbered = numbered.withColumn("first", (F.sum("salts").over(up_to) - F.col("salts")).cast("int"))
    if bits <= BROADCAST_BITS:
        ranges = F.broadcast(refs.sparkSession.createDataFrame(numbered.toArrow()))  # from Arrow it needs no Python workers
    else:
        ranges = materialize(numbered, "reference-ranges")
    n_judged, n_batches = ranges.agg(F.sum(F.when(F.col("range") != PASSED_ON, F.col("n"))), F.sum("salts")).first()
    # a batch a task, or several where they are small
    default = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(1, min(n_batches or 0, max(default, math.ceil((n_judged or 0) / REFS_PER_BATCH))))
    ranges = ranges.drop("n")
    located = refs.withColumns({"h": F.xxhash64("key"), "range": F.when(judge, key_range).otherwise(PASSED_ON)}).join(ranges, "range", "left")
    salt = F.pmod(F.xxhash64("edge_id", "ref_field"), F.col("salts").cast("long")).cast("int")
    arrays = parents.select("key", "start", "end", F.xxhash64("key").alias("h"), key_range.alias("range")).join(ranges, "range")
    left = located.select((F.col("first") + salt).alias("batch"), "edge_id", "ref_field", "key", "symbol", "t", "reason", "h")
    right = arrays.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)).alias("batch"), "h", "key", "start", "end")
    left, right = (d.repartitionById(n_tasks, "batch") for d in (left, right))
    schema = T.StructType([refs.schema[c] for c in ("edge_id", "ref_field", "reason", "key", "symbol", "t")])
    for f in schema:
        f.nullable = True
    return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_probe, schema)


def find_orphans(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference of ``edges`` whose record is not alive at extracted_at: edge_id, ref_field, reason, t.

    ``files``: file, start, end. ``symbols``: file, symbol, start, end. A null, empty or ``_external_`` file refers to
    nothing; a null symbol refers to nothing, an empty one is looked up like any other. target_symbol is
    judged only for edges that are not imports and whose target_file is alive. Each edge row counts by itself. Empty
    tables of records make every reference ``missing``; empty ``edges`` give no row.
    """
    path = {c: canonical_path(c) for c in ("source_file", "target_file")}
    ref = lambda field, symbol: F.struct(
        F.lit(field).alias("ref_field"), path[field].alias("key"), symbol.alias("symbol")
    )
    wants_symbol = F.when(~F.col("edge_type").eqNullSafe("imports"), F.col("target_symbol"))
    named = edges.select("edge_id", F.col("extracted_at").alias("t"), F.explode(F.array(
        ref("source_file", F.lit(None).cast("string")), ref("target_file", wants_symbol))).alias("r"))
    refs = named.select("edge_id", "r.ref_field", "r.key", "r.symbol", "t", F.lit(None).cast("string").alias("reason")).where(
        (F.col("key") != "") & (F.col("key") != "_external_")
    )
    file_lives = files.select(canonical_path("file").alias("key"), "start", "end")
    first = probe_references(refs, file_lives)

    pair = lambda f, s: F.concat_ws("\x00", f, s)
    symbol_lives = symbols.where("symbol IS NOT NULL AND file IS NOT NULL").select(
        pair(canonical_path("file"), F.col("symbol")).alias("key"), "start", "end"
    )
    alive_target = (F.col("ref_field") == "target_file") & F.col("symbol").isNotNull() & F.col("reason").isNull()
    second = first.where(F.col("reason").isNotNull() | alive_target).select(
        "edge_id",
        F.when(alive_target, F.lit("target_symbol")).otherwise(F.col("ref_field")).alias("ref_field"),
        F.when(alive_target, pair(F.col("key"), F.col("symbol"))).otherwise(F.col("key")).alias("key"),
        F.lit(None).cast("string").alias("symbol"),
        "t",
        "reason",
    )
    # an upper bound of the symbol references, so that the first probe need not run to size the second
    sizes = edges.where(F.col("target_file").isNotNull() & wants_symbol.isNotNull()).select(
        pair(path["target_file"], F.col("target_symbol")).alias("key")
    )
    return probe_references(second, symbol_lives, sizes, 2 * edges.count()).where("reason IS NOT NULL").select("edge_id", "ref_field", "reason", "t")


def record_lives(manifest: DataFrame, shared_files: DataFrame, symbols: DataFrame, shared_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lives of files and of symbols, own and shared ones together, as :func:`find_orphans` takes them."""
    file_life = lambda d: d.select("file", F.col("first_seen_at").alias("start"), F.col("deleted_at").alias("end"))
    symbol_life = lambda d: d.select("file", "symbol", F.col("defined_at").alias("start"), F.col("removed_at").alias("end"))
    return file_life(manifest).unionByName(file_life(shared_files)), symbol_life(symbols).unionByName(symbol_life(shared_symbols))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referring field, reason and month of extracted_at (null: no time)."""
    return orphans.groupBy("ref_field", "reason", F.date_format("t", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
