"""Long spans that stand verbatim in more than one document.

The texts are seen as paths of a de Bruijn graph over a sparse set of k-mers. A k-mer of characters is selected
where its hash is the least of ``WINDOW`` consecutive ones, so that any two copies of a span of ``MIN_SPAN``
characters select the same k-mer at the same place in it (k + window - 1 = span). The text from one selected k-mer
to the end of the next one is an edge.

A k-mer that selects in one document only is dropped. Where all occurrences of a k-mer leave by the same edge and
all occurrences of the next one enter by it, the two lie on a nonbranching path: the later one has the same
occurrences and shares the same spans, and only the head of each path is kept. This compaction is one join of
incoming with outgoing edges. The surviving occurrences are cut out of the texts with so much context that
the longest common span through the k-mer can be measured up to ``MIN_SPAN`` characters, and compared character for
character, so no pair is given for an equal hash; no occurrence is capped. What is left out, an occurrence of equal context within its
text and a k-mer behind its path's head, is left out by 64-bit hashes of what it would be compared by. Characters take the part of tokens, as
spans are measured in characters. :func:`repeated_paths` gives the compacted paths themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import discard, materialize

MIN_SPAN = 200
#: Characters of a k-mer; the window over k-mers is MIN_SPAN - K + 1.
K = 96
#: Characters handled at once in a task; longer texts are taken in overlapping stretches.
BATCH_CHARS = 1 << 19
#: Occurrences of one k-mer that are compared within one group; more are compared block by block.
BLOCK = 256
#: Hashes of repeated k-mers that are broadcast (8 bytes each); more are joined.
BROADCAST_HASHES = 1_000_000

_INDEX_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64, at least n + 1 of each."""
    size = max(n + 1, BATCH_CHARS + 4096)
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, dtype=np.uint64)
        _POWERS[size] = tuple(np.cumprod(np.concatenate([one, np.full(size, x, dtype=np.uint64)])) for x in (_BASE, inverse))
    return _POWERS[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks."""
    n = len(v)
    if n < w:
        return v[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def select_kmers(codes: np.ndarray, lengths: np.ndarray, k: int, span: int):
    """Selected k-mers of texts laid end to end.

    Returns positions, the number of the text, hash, hash of the edge that enters (0: none), of the one that
    leaves, a hash of the context, and how far the selected k-mer before it is away. Windows that reach into the next text only select more than needed.
    """
    n, w = len(codes), span - k + 1
    power, inverse = _powers(n)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=s[1:])
    ends = np.cumsum(lengths)
    end_of = np.repeat(ends, lengths)
    kmers = max(n - k + 1, 0)
    at = np.arange(kmers, dtype=np.int64)
    fits = at + k <= end_of[:kmers]
    h = _mix((s[k:] - s[:-k]) * inverse[:kmers]) if kmers else np.zeros(0, dtype=np.uint64)
    low = np.uint64((1 << _INDEX_BITS) - 1)
    v = (h & ~low) | (low - at.astype(np.uint64))
    v[~fits] = np.iinfo(np.uint64).max
    least = _sliding_min(v, w)
    chosen = np.zeros(kmers, dtype=bool)
    chosen[np.minimum((low - (least & low)).astype(np.int64), max(kmers - 1, 0))] = True
    p = np.flatnonzero(chosen & fits)
    text = np.searchsorted(ends, p, "right")
    stop, start = ends[text], ends[text] - lengths[text]

    def hashed(b, e):
        return _mix(((s[e] - s[b]) * inverse[b]) ^ (e - b).astype(np.uint64))

    enter = np.zeros(len(p), dtype=np.uint64)
    leave = np.zeros(len(p), dtype=np.uint64)
    gap = np.zeros(len(p), dtype=np.int64)
    if len(p) > 1:
        same = text[1:] == text[:-1]
        edge = hashed(p[:-1], p[1:] + k) | np.uint64(1)
        leave[:-1] = np.where(same, edge, 0)
        enter[1:] = np.where(same, edge, 0)
        gap[1:] = np.where(same, p[1:] - p[:-1], 0)
    around = span - k
    b, e = np.maximum(p - around, start), np.minimum(p + k + around, stop)
    context = _mix(hashed(b, e) + (p - b).astype(np.uint64))
    return p - start, text, h[p], enter, leave, context, gap


def _stretches(length: int, margin: int):
    """(start, end, from, to) of overlapping stretches of a text and the positions that each of them answers for."""
    if length <= BATCH_CHARS:
        yield 0, length, 0, length
        return
    step = BATCH_CHARS - 2 * margin
    for a in range(0, length, step):
        lo, hi = max(0, a - margin), min(length, a + step + margin)
        yield lo, hi, (a if a else 0), min(a + step, length)
        if hi == length and a + step >= length:
            return


def _emit(group, k: int, span: int, every: bool):
    """Arrays of the selected k-mers of a group of (doc_id, stretch, codes); unless ``every``, one for each context in a text."""
    lengths = np.array([len(c) for _, _, c in group], dtype=np.int64)
    pos, text, h, enter, leave, context, gap = select_kmers(np.concatenate([c for _, _, c in group]), lengths, k, span)
    lo = np.array([s[0] for _, s, _ in group], dtype=np.int64)[text]
    mine = (pos + lo >= np.array([s[2] for _, s, _ in group])[text]) & (pos + lo < np.array([s[3] for _, s, _ in group])[text])
    ids = np.array([d for d, _, _ in group], dtype=np.int64)[text]
    arrays = (h, ids, pos + lo, enter, leave, gap)
    if every:
        return [a[mine].view(np.int64) if a.dtype == np.uint64 else a[mine] for a in arrays]
    # an occurrence with the same context in the same text shares nothing with other documents that the first one does not
    order = np.lexsort((np.arange(len(h)), context, h, text))
    first = np.ones(len(order), dtype=bool)
    o = order
    first[1:] = (text[o[1:]] != text[o[:-1]]) | (h[o[1:]] != h[o[:-1]]) | (context[o[1:]] != context[o[:-1]])
    keep = np.zeros(len(h), dtype=bool)
    keep[o[first]] = True
    keep &= mine
    return [a[keep].view(np.int64) if a.dtype == np.uint64 else a[keep] for a in arrays]


def kmer_occurrences(documents: DataFrame, k: int = K, span: int = MIN_SPAN, every: bool = False) -> DataFrame:
    """h, doc_id, pos, enter, leave, gap of the selected k-mers; texts shorter than ``span`` have none.

    Without ``every`` a k-mer comes once for each context that it has in a text, which is enough to find pairs of documents.
    """
    margin = 2 * span

    def run(batches):
        names = ["h", "doc_id", "pos", "enter", "leave", "gap"]

        def table(group):
            arrays = _emit(group, k, span, every)
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

        for batch in batches:
            group, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text) < span:
                    continue
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                for s in _stretches(len(codes), margin):
                    if group and size + s[1] - s[0] > BATCH_CHARS:
                        yield table(group)
                        group, size = [], 0
                    group.append((doc, s, codes[s[0] : s[1]]))
                    size += s[1] - s[0]
            if group:
                yield table(group)

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(run, "h bigint, doc_id bigint, pos bigint, enter bigint, leave bigint, gap bigint")


def _repeated(documents: DataFrame, k: int, span: int, every: bool, *columns: str) -> DataFrame:
    """h, doc_id, pos and ``columns`` of the occurrences (see :func:`kmer_occurrences`) of k-mers that select in more than one document, as a written table.

    The k-mers are counted first, by partial aggregation of nothing but hash and document, so one that stands in a third
    of all documents costs one row for each map task. Selecting is cheap, so it runs again for the occurrences of the
    repeated k-mers, which meet their (unique) hashes by broadcast up to a checked size and by a join beyond it.
    """
    once = kmer_occurrences(documents, k, span).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    hashes = materialize(once.where("lo <> hi").select("h"), "repeated-hashes")
    few = hashes.count() <= BROADCAST_HASHES
    rows = kmer_occurrences(documents, k, span, every).select("h", "doc_id", "pos", *columns).join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    return materialize(rows, "repeated-kmers")


def repeated_occurrences(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """The occurrences of k-mers that select in more than one document, as a written table.

    ``n`` counts the occurrences of the k-mer; ``in_edge`` and ``out_edge`` are set where all of them agree in it.
    """
    rows = _repeated(documents, k, span, False, "enter", "leave")
    agreed = lambda c, name: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(name)
    facts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), agreed("enter", "in_edge"), agreed("leave", "out_edge"))
    return materialize(rows.select("h", "doc_id", "pos").join(facts, "h"), "repeated-occurrences")


def path_heads(occurrences: DataFrame) -> DataFrame:
    """Compact nonbranching paths: drop every k-mer that is entered by one edge which is its source's only way out."""
    out = occurrences.where("out_edge IS NOT NULL").select(F.col("out_edge").alias("in_edge")).distinct()
    return occurrences.join(out, "in_edge", "left_anti").select("h", "doc_id", "pos", "n")


def compact_paths(nodes: DataFrame) -> DataFrame:
    """h, head, offset: the nonbranching path of every node, named by its first k-mer, and how far behind that the node stands.

    ``nodes``: h, in_edge, out_edge, gap. A node whose only entering edge is the only way out of another one follows it. The chains are
    compacted by joining the links with themselves, which doubles what a link spans, so there are as many rounds as the logarithm of the longest chain. Every
    round is written and the one before deleted. A chain can't be a ring, as the first occurrence in a text isn't entered like the others.
    """
    before = nodes.where("out_edge IS NOT NULL").select(F.col("out_edge").alias("in_edge"), F.col("h").alias("up"))
    links = materialize(nodes.select("h", "in_edge", "gap").join(before, "in_edge", "left").select("h", "up", F.when(F.col("up").isNotNull(), F.col("gap")).otherwise(0).alias("offset")), "links")
    while links.alias("a").join(links.where("up IS NOT NULL").select(F.col("h").alias("up")), "up", "left_semi").limit(1).count():
        above = links.select(F.col("h").alias("up"), F.col("up").alias("__up"), F.col("offset").alias("__offset"))
        farther = links.join(above, "up", "left").select("h", F.coalesce("__up", "up").alias("up"), (F.col("offset") + F.coalesce("__offset", F.lit(0))).alias("offset"))
        old, links = links, materialize(farther, "links")
        discard(old)
    return links.select("h", F.coalesce("up", "h").alias("head"), "offset")


def repeated_paths(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """doc_id, start (from 0), length, n_documents and n_places of the compacted paths of at least ``span`` characters that stand in more than one document.

    doc_id and start are the first place. Each place of a path's first k-mer is cut out of its text for the whole length of the path and
    digested (SHA-256), so the places of a row are verbatim copies. Where copies part and meet again, they are several paths.
    Null ids and texts, and texts shorter than ``span``, have none.
    """
    rows = _repeated(documents, k, span, True, "enter", "leave", "gap")
    agreed = lambda c, name: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(name)
    nodes = materialize(rows.groupBy("h").agg(agreed("enter", "in_edge"), agreed("leave", "out_edge"), F.max("gap").alias("gap")), "nodes")
    paths = compact_paths(nodes).groupBy("head").agg((F.max("offset") + k).alias("length")).where(F.col("length") >= span)
    places = rows.select(F.col("h").alias("head"), "doc_id", "pos").join(paths, "head")

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for d, text, found in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("places")):
                text = text.as_py()
                for p in found.as_py():
                    cut = text[p["pos"] : p["pos"] + p["length"]]
                    if len(cut) == p["length"]:
                        out.append((p["head"], d, p["pos"], p["length"], hashlib.sha256(cut.encode("utf-8", "surrogatepass")).digest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["head", "doc_id", "start", "length", "digest"])

    # bounded by the length of one text
    by_text = places.groupBy(F.col("doc_id").alias("at_doc")).agg(F.collect_list(F.struct("head", "pos", "length")).alias("places"))
    texts = documents.where(F.length("text") >= span).select(F.col("doc_id").cast("bigint"), "text")
    cut = texts.join(by_text, F.col("doc_id") == F.col("at_doc")).select("doc_id", "text", "places").mapInArrow(run, "head bigint, doc_id bigint, start bigint, length bigint, digest binary")
    # documents are counted by the partial groups of path and document, so a path in a third of them has one row for each
    per_doc = cut.distinct().groupBy("head", "length", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    whole = per_doc.groupBy("head", "length", "digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_places"))
    return whole.where("n_documents > 1").select("first.doc_id", "first.start", "length", "n_documents", "n_places")


def with_context(occurrences: DataFrame, documents: DataFrame, k: int, span: int) -> DataFrame:
    """Add the text before (``before``, up to span - k characters) and from the k-mer on (``after``, up to span)."""

    def run(batches):
        for b in batches:
            h, doc, pos, n, before, after = [], [], [], [], [], []
            for d, text, places in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("places").to_pylist()):
                text = text.as_py()
                for p in places:
                    at = p["pos"]
                    h.append(p["h"])
                    doc.append(d)
                    pos.append(at)
                    n.append(p["n"])
                    before.append(text[max(0, at - (span - k)) : at])
                    after.append(text[at : at + span])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=pa.int64()) for x in (h, doc, pos, n)] + [pa.array(x, type=pa.string()) for x in (before, after)],
                names=["h", "doc_id", "pos", "n", "before", "after"],
            )

    # bounded by the length of one text
    places = occurrences.groupBy(F.col("doc_id").alias("at_doc")).agg(F.collect_list(F.struct("h", "pos", "n")).alias("places"))
    texts = documents.where(F.length("text") >= span).select(F.col("doc_id").cast("bigint"), "text")
    joined = texts.join(places, F.col("doc_id") == F.col("at_doc")).select("doc_id", "text", "places")
    return joined.mapInArrow(run, "h bigint, doc_id bigint, pos bigint, n bigint, before string, after string")


def _runs(places: list[int], most: int):
    """(first, step, times) of runs of places that are equally far apart, by ``most`` at the most."""
    i = 0
    while i < len(places):
        j, step = i, 0
        if i + 1 < len(places) and places[i + 1] - places[i] <= most:
            step = places[i + 1] - places[i]
            while j + 1 < len(places) and places[j + 1] - places[j] == step:
                j += 1
        yield places[i], step, j - i + 1
        i = j + 1


def context_runs(documents: DataFrame, k: int, span: int) -> DataFrame:
    """All occurrences of the repeated k-mers with their contexts, as a written table: h, doc_id, before, after, pos, step, times.

    A row is a run of ``times`` places of equal context in one text, ``step`` (at most ``span``) apart, so the places of periodic
    text take one row, and extents of at least ``span`` characters around neighbouring places of a run touch.
    """

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["h", "doc_id", "before", "after", "pos", "step", "times"]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=names)

        rows = []
        for b in batches:
            for d, text, places in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("places")):
                text, by = text.as_py(), {}
                for h, at in sorted({(p["h"], p["pos"]) for p in places.as_py()}):
                    by.setdefault((h, text[max(0, at - (span - k)) : at], text[at : at + span]), []).append(at)
                rows += ((h, d, before, after, *r) for (h, before, after), at in by.items() for r in _runs(at, span))
                if len(rows) >= 10_000:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    # bounded by the length of one text
    found = _repeated(documents, k, span, True)
    places = found.groupBy(F.col("doc_id").alias("at_doc")).agg(F.collect_list(F.struct("h", "pos")).alias("places"))
    texts = documents.where(F.length("text") >= span).select(F.col("doc_id").cast("bigint"), "text")
    joined = texts.join(places, F.col("doc_id") == F.col("at_doc")).select("doc_id", "text", "places")
    rows = joined.mapInArrow(run, "h bigint, doc_id bigint, before string, after string, pos bigint, step bigint, times bigint")
    return materialize(rows, "contexts")


def _blocked_pairs(rows: DataFrame, salt: list[str], left: list[str], right: list[str]) -> DataFrame:
    """Pairs of rows with equal ``h``, each unordered pair once, in groups of at most about ``BLOCK`` by ``BLOCK`` rows.

    Columns of ``left`` get the suffix _a, of ``right`` the suffix _b. ``n`` is the size of the group.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    b = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(*salt), F.col("blocks")).cast("int"))
    one = b.select("h", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), *(F.col(c).alias(f"{c}_a") for c in left))
    two = b.select(
        F.col("h").alias("h2"), F.explode(F.sequence(F.lit(0), "block")).alias("x2"), F.col("block").alias("y2"), *(F.col(c).alias(f"{c}_b") for c in right)
    )
    return one.join(two, (F.col("h") == F.col("h2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))


def _characters(values: list[str], width: int) -> np.ndarray:
    """Rows of code points of fixed width; what is missing is 0."""
    return np.array(values, dtype=f"<U{width}").view(np.uint32).reshape(len(values), width)


def _common(x: list[str], y: list[str], width: int) -> np.ndarray:
    """Length of the common prefix of each pair, up to ``width``."""
    n = len(x)
    if not n or not width:
        return np.zeros(n, dtype=np.int64)
    shorter = np.fromiter((min(len(p), len(q)) for p, q in zip(x, y)), dtype=np.int64, count=n)
    same = np.zeros((n, width + 1), dtype=bool)
    same[:, :width] = (_characters(x, width) == _characters(y, width)) & (np.arange(width) < shorter[:, None])
    return same.argmin(axis=1)


def _extents(b, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Common characters before the k-mer and from it on, of the pairs of a batch; -1 where the k-mers differ."""
    back = [[v[::-1] for v in b.column(c).to_pylist()] for c in ("before_a", "before_b")]
    before = _common(*back, span - k)
    after = _common(b.column("after_a").to_pylist(), b.column("after_b").to_pylist(), span)
    return np.where(after >= k, before, -1), np.where(after >= k, after, -1)


def shared_pairs(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """doc_id_a < doc_id_b of all documents that have ``span`` consecutive characters in common.

    Null texts, texts shorter than ``span`` and null ids share nothing. Repeated rows of one doc_id are one document.
    White space, case and U+0000 count like any character. Extra columns are ignored.
    """
    occurrences = repeated_occurrences(documents, k, span)
    rows = with_context(path_heads(occurrences), documents, k, span)
    cols = ["doc_id", "before", "after"]
    pairs = _blocked_pairs(rows, ["doc_id", "pos"], cols, cols).where(
        F.when(F.col("x") == F.col("y"), F.col("doc_id_a") < F.col("doc_id_b")).otherwise(F.col("doc_id_a") != F.col("doc_id_b"))
    )

    def run(batches):
        for b in batches:
            before, after = _extents(b, k, span)
            ok = before + after >= span
            x, y = b.column("doc_id_a").to_numpy()[ok], b.column("doc_id_b").to_numpy()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["doc_id_a", "doc_id_b"])

    compared = pairs.select("doc_id_a", "doc_id_b", "before_a", "after_a", "before_b", "after_b")
    return compared.mapInArrow(run, "doc_id_a bigint, doc_id_b bigint").distinct()


def shared_classes(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """doc_id, class_id and n_links of every document: exact copies have one class, named by their smallest doc_id.

    ``n_links`` counts the other documents that share ``span`` consecutive characters with it, as :func:`shared_pairs` would pair them. Only one
    document of each class is compared, and its links are weighed by the sizes of the classes, so many copies never become pairs. A null text is a class
    of its own without links; of several texts of one doc_id one counts.
    """
    digest = F.sha2("text", 256)
    ids = documents.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.struct(digest.alias("d"), F.length("text").alias("n"))).alias("t"))
    ids = materialize(ids.select("doc_id", F.col("t.d").alias("digest"), F.col("t.n").alias("n_chars")), "digests")
    classes = ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.first("n_chars").alias("n_chars"))
    classes = materialize(classes, "text-classes")
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("digest", digest)
    one = named.join(classes.select(F.col("class_id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "text")
    pairs = materialize(shared_pairs(one, k, span), "class-pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("doc_id_a").alias("x"), F.col("doc_id_b").alias("y")), F.struct(F.col("doc_id_b").alias("x"), F.col("doc_id_a").alias("y")))).alias("p")).select("p.*")
    links = ends.join(classes.select(F.col("class_id").alias("y"), "members"), "y").groupBy(F.col("x").alias("class_id")).agg(F.sum("members").alias("others"))
    copies = F.when(F.col("n_chars") >= span, F.col("members") - 1).otherwise(0)
    total = classes.join(links, "class_id", "left").select("digest", "class_id", (copies + F.coalesce("others", F.lit(0))).alias("n_links"))
    return ids.join(total, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def shared_shares(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """doc_id, n_chars, shared_chars and share of every document.

    A character is shared if it lies in ``span`` consecutive characters that also stand in another document. Every such
    span holds a selected k-mer of both, so the extents around all repeated occurrences cover exactly these.
    All occurrences count, also those that repeat within a document. Those with equal context are one class, and only
    different classes of a k-mer are compared. Null texts have
    null n_chars, no shared characters and a null share, empty ones a null share.
    """
    rows = context_runs(documents, k, span)
    classes = materialize(rows.groupBy("h", "before", "after").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "context-classes")
    counts = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    cols = ["before", "after", "lo", "hi"]
    pairs = _blocked_pairs(classes.join(counts, "h"), ["before", "after"], cols, cols).where(
        ~((F.col("before_a") == F.col("before_b")) & (F.col("after_a") == F.col("after_b")))
        & ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
        & ((F.col("x") != F.col("y")) | (F.struct("before_a", "after_a") < F.struct("before_b", "after_b")))
    )

    def run(batches):
        for b in batches:
            before, after = _extents(b, k, span)
            ok = before + after >= span
            h = b.column("h").to_numpy()[ok]
            sides = [(b.column(f"before_{s}").filter(pa.array(ok)), b.column(f"after_{s}").filter(pa.array(ok))) for s in "ab"]
            for bs, af in sides:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), bs, af, pa.array(before[ok]), pa.array(after[ok])], names=["h", "before", "after", "l", "r"]
                )

    compared = pairs.select("h", "before_a", "after_a", "before_b", "after_b").mapInArrow(
        run, "h bigint, before string, after string, l bigint, r bigint"
    )
    whole = classes.where((F.col("lo") != F.col("hi")) & (F.length("before") + F.length("after") >= span)).select(
        "h", "before", "after", F.length("before").cast("bigint").alias("l"), F.length("after").cast("bigint").alias("r")
    )
    extents = compared.unionByName(whole).groupBy("h", "before", "after").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    covers = rows.join(extents, ["h", "before", "after"]).select(
        "doc_id", (F.col("pos") - F.col("l")).alias("b"), (F.col("pos") + F.col("step") * (F.col("times") - 1) + F.col("r")).alias("e")
    )
    by_start = Window.partitionBy("doc_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("e") - F.greatest(F.col("b"), F.coalesce(F.max("e").over(by_start), F.col("b"))), F.lit(0))
    shared = covers.select("doc_id", fresh.alias("c")).groupBy("doc_id").agg(F.sum("c").alias("shared_chars"))
    sizes = documents.select(F.col("doc_id").cast("bigint"), F.length("text").cast("bigint").alias("n_chars")).distinct()
    chars = F.coalesce(F.col("shared_chars"), F.lit(0).cast("bigint"))
    return sizes.join(shared, "doc_id", "left").select(
        "doc_id", "n_chars", chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(chars / F.col("n_chars"), 6)).alias("share")
    )


def _matches(p: int, step: int, times: int, q: int, step2: int, times2: int):
    """Diagonals of all pairs of a place of one run and a place of another, with the first and last place of the one on each.

    Runs of one step meet on ``times + times2 - 1`` diagonals; only different steps need every pair of places.
    """
    step, step2 = (step2 if times == 1 else step), (step if times2 == 1 else step2)
    if step == step2:
        t = np.arange(1 - times, times2)
        return q - p + step * t, p + step * np.maximum(0, -t), p + step * np.minimum(times - 1, times2 - 1 - t)
    one = np.repeat(p + step * np.arange(times), times2)
    return np.tile(q + step2 * np.arange(times2), times) - one, one, one


def shared_spans(documents: DataFrame, k: int = K, span: int = MIN_SPAN) -> DataFrame:
    """doc_id, start (from 0) and length of every maximal stretch of a document that also stands in another one.

    A stretch has at least ``span`` characters, stands as a whole in some other document, and lies in no longer one of
    its document that does. Stretches found in different documents may overlap and aren't merged, as their union need not stand
    anywhere; together they cover the ``shared_chars`` of :func:`shared_shares`. The extents around all occurrences are
    put together along the diagonals of each pair of documents, so that no length is capped.
    """
    rows = context_runs(documents, k, span)
    cols = ["doc_id", "pos", "step", "times", "before", "after"]
    pairs = _blocked_pairs(rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"), ["doc_id", "pos"], cols, cols).where(
        F.when(F.col("x") == F.col("y"), F.col("doc_id_a") < F.col("doc_id_b")).otherwise(F.col("doc_id_a") != F.col("doc_id_b"))
    )

    def run(batches):
        names = ["a", "b", "diagonal", "s", "e"]
        for batch in batches:
            before, after = _extents(batch, k, span)
            ok = np.flatnonzero(before + after >= span)
            v = {c: batch.column(c).to_numpy()[ok] for c in (f"{c}_{x}" for c in cols[:4] for x in "ab")}
            turn = v["doc_id_a"] > v["doc_id_b"]
            x, y = ([np.where(turn, v[f"{c}_{t}"], v[f"{c}_{o}"]) for c in cols[:4]] for t, o in ("ba", "ab"))
            left, right = before[ok], after[ok]
            single = (x[3] == 1) & (y[3] == 1)
            p = x[1][single]
            parts = [(x[0][single], y[0][single], y[1][single] - p, p - left[single], p + right[single])]
            for i in np.flatnonzero(~single):
                diagonal, first, last = _matches(*(int(c[i]) for c in (*x[1:], *y[1:])))
                parts.append((np.full(len(diagonal), x[0][i]), np.full(len(diagonal), y[0][i]), diagonal, first - left[i], last + right[i]))
                if sum(len(part[0]) for part in parts) >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

    compared = pairs.select(*(f"{c}_{x}" for c in cols for x in "ab")).mapInArrow(run, "a bigint, b bigint, diagonal bigint, s bigint, e bigint")
    line = Window.partitionBy("a", "b", "diagonal").orderBy("s", "e")
    apart = F.coalesce(F.col("s") > F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = compared.withColumn("new", apart.cast("int"))
    numbered = marked.withColumn("g", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("a", "b", "diagonal", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    d = F.col("diagonal")
    sides = [F.struct(F.col(x).alias("doc_id"), (F.col("s") + y).alias("s"), (F.col("e") + y).alias("e")) for x, y in (("a", F.lit(0)), ("b", d))]
    stretches = whole.select(F.explode(F.array(*sides)).alias("x")).select("x.*").distinct()
    by_start = Window.partitionBy("doc_id").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    longest = stretches.withColumn("past", F.max("e").over(by_start)).where("past IS NULL OR e > past")
    return longest.select("doc_id", F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("length"))
