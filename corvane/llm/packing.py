"""Filling containers of a fixed capacity with texts: best-two-fit over the histogram of lengths.

Items are told apart only by their length, of which there are at most ``capacity`` different ones. The plan is
therefore made on the histogram, whose size does not depend on the data: a greedy filling is found
for one container, its smallest item is exchanged for two unpacked ones if they fit its widened gap more
tightly, and the filling is repeated as often as the remaining counts allow. Each step uses up at least one
length, so there are only about as many different fillings as lengths. Every item then takes the
slot that its rank among the items of its length names, which is computed without gathering a length in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.session import materialize

RANKED_AT_ONCE = 100_000


@dataclass
class Plan:
    """Slots of each length: for length n, entries ``first[n]:first[n + 1]`` of the arrays, by ascending rank."""

    first: np.ndarray  # where the entries of a length start
    rank: np.ndarray  # rank of the first item of the entry
    per_bin: np.ndarray  # items of this length in one container
    base: np.ndarray  # number of the first container of the filling
    place: np.ndarray  # place of the first item of this length
    offset: np.ndarray  # tokens before it
    containers: int
    bins: np.ndarray  # per filling: first container, used tokens, items


def _fill(available: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one container, longest first: greedy best fit, then the exchange of its smallest item.

    ``available`` holds the number of unpacked items by length. The largest one opens the container.
    """
    left = available.copy()
    chosen: list[int] = []
    gap = capacity
    # largest available length up to n, for all n; kept up to date as lengths run out
    upto = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    while gap > 0 and (n := int(upto[gap])) > 0:
        chosen.append(n)
        gap -= n
        left[n] -= 1
        if left[n] == 0:
            upto = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    if gap and len(chosen) > 1:
        smallest = chosen[-1]
        room = gap + smallest
        a = np.flatnonzero(left[: room + 1] > 0)
        a = a[a > 0]
        if len(a):
            b = upto[room - a]
            # the same length twice needs two items; else the next shorter one is taken
            twice = (b == a) & (left[b] < 2)
            b = np.where(twice, upto[np.maximum(np.minimum(a - 1, room - a), 0)], b)
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax())
            if total[best] > smallest:
                chosen[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
    return sorted(chosen, reverse=True)


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-two-fit over ``histogram`` (items by length, lengths in 1..capacity)."""
    available = np.zeros(capacity + 1, dtype=np.int64)
    for n, count in histogram.items():
        available[n] += count
    used = np.zeros(capacity + 1, dtype=np.int64)
    entries: list[tuple[int, int, int, int, int, int]] = []
    bins: list[tuple[int, int, int]] = []
    containers = 0
    while (available > 0).any():
        chosen = _fill(available, capacity)
        lengths, counts = np.unique(chosen, return_counts=True)
        times = int((available[lengths] // counts).min())
        place = offset = 0
        for n, c in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
            entries.append((n, int(used[n]), c, containers, place, offset))
            place += c
            offset += n * c
            used[n] += times * c
            available[n] -= times * c
        bins.append((containers, offset, place))
        containers += times
    entries.sort()
    e = np.array(entries, dtype=np.int64).reshape(-1, 6)
    first = np.searchsorted(e[:, 0], np.arange(capacity + 2))
    return Plan(first, e[:, 1], e[:, 2], e[:, 3], e[:, 4], e[:, 5], containers, np.array(bins, dtype=np.int64).reshape(-1, 3))


def _ranked(items: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add ``rank``, the 0-based position of an item among those of its length by (doc_id, piece) within salts.

    A length with many items is split into salts; the salts' counts give the rank at which each starts.
    """
    salts = histogram.select(F.col("n_tokens").alias("__n"), F.ceil(F.col("n") / RANKED_AT_ONCE).cast("bigint").alias("salts"))
    # bounded: one row per length up to the capacity
    salted = items.join(F.broadcast(salts), F.col("n_tokens") == F.col("__n")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))
    ).drop("__n", "salts")
    starts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c")).select(
        F.col("n_tokens").alias("__n"),
        F.col("salt").alias("__s"),
        (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("c")).alias("start"),
    )
    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    return (
        salted.withColumn("within", within)
        .join(starts, (F.col("n_tokens") == F.col("__n")) & (F.col("salt") == F.col("__s")))
        .select("doc_id", "piece", "n_tokens", "start_token", (F.col("within") + F.col("start")).alias("rank"))
    )


def pack_sizes(sizes: DataFrame, capacity: int) -> DataFrame:
    """Place every document of ``sizes`` (doc_id, n_tokens) in containers of ``capacity`` tokens.

    Result, one row per document or piece: doc_id, piece (0-based), start_token (of the piece in its document),
    n_tokens, container_id, place (0-based position in the container), offset (tokens before it there).

    A document is divided only if it exceeds the capacity: into pieces of exactly the capacity and one remainder.
    Documents without tokens fill nothing; they are spread evenly over the containers, behind their items (if
    there is no other container, all of them are in container 0). Null sizes count as 0. Repeated rows are items
    of their own. No rows give no rows.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    whole = F.floor(n / capacity).cast("bigint")
    pieces = F.greatest(whole + F.when(n % capacity > 0, 1).otherwise(0), F.lit(1))
    items = sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start_token"),
        F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"),
    )
    histogram = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.n_tokens: r.n for r in histogram.collect()}  # at most capacity + 1 rows
    plan = plan_containers({k: v for k, v in counts.items() if k > 0}, capacity)
    known = sizes.sparkSession.createDataFrame(list(counts.items()) or [(0, 0)], "n_tokens bigint, n bigint")

    def place(batches):
        for b in batches:
            size, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            # entries are sorted by (length, rank): one search finds the entry of each item
            width = int(max(plan.rank.max(initial=0), rank.max(initial=0))) + 1
            length_of = np.repeat(np.arange(len(plan.first) - 1), np.diff(plan.first))
            i = np.searchsorted(length_of * width + plan.rank, size * width + rank, "right") - 1
            empty = size == 0
            i = np.where(empty, 0, i)
            if len(plan.rank):
                k = rank - plan.rank[i]
                container = plan.base[i] + k // plan.per_bin[i]
                spot = plan.place[i] + k % plan.per_bin[i]
                offset = plan.offset[i] + (k % plan.per_bin[i]) * size
            else:
                container = spot = offset = np.zeros(len(size), dtype=np.int64)
            if empty.any():
                c = rank % max(plan.containers, 1)
                j = np.searchsorted(plan.bins[:, 0], c, "right") - 1 if len(plan.bins) else None
                container = np.where(empty, c, container)
                behind = plan.bins[j] if j is not None else np.zeros((len(c), 3), dtype=np.int64)
                offset = np.where(empty, behind[:, 1], offset)
                spot = np.where(empty, behind[:, 2] + rank // max(plan.containers, 1), spot)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("start_token"), b.column("n_tokens")]
                + [pa.array(x, type=pa.int64()) for x in (container, spot, offset)],
                names=["doc_id", "piece", "start_token", "n_tokens", "container_id", "place", "offset"],
            )

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return _ranked(items, known).mapInArrow(
        place, f"doc_id {kind}, piece bigint, start_token bigint, n_tokens bigint, container_id bigint, place bigint, offset bigint"
    )


def pack_documents(documents: DataFrame, capacity: int, rank_file: str = tokens.RANK_FILE) -> DataFrame:
    """:func:`pack_sizes` of the token counts of ``documents`` (doc_id, text)."""
    return pack_sizes(materialize(tokens.token_counts(documents, rank_file=rank_file), "token-counts"), capacity)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, free tokens in all containers and the share of the capacity that is used."""
    per_bin = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    return per_bin.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("items"),
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(capacity - F.col("t")), F.lit(0)).alias("free_tokens"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 6).alias("fill_share"),
    )
