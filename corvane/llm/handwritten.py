"""Files that nobody wrote by hand here: generated, minified, third-party or data kept as code.

Three linear support-vector classifiers judge a chunk of a file: one its path (components and the parts of the file name),
one the comment at its head and one its body (hashed character n-grams both). Each is fitted on a bounded
sample of chunks of the collection itself.

There are no labels in the data, so weak ones come from facts (:func:`facts`): conventions of paths,
the shape of a body (packed lines, unbroken runs, shares of digits and numbers), the standard markers of generators, and what a banner refers to (a versioned name, a
date stamp, an interface definition, a command line, a licence notice that doesn't name the project). A banner of a file whose path or body is
labelled counts as labelled too. Apart from the standard markers no wording is listed: that of banners is what the head view has to learn.

What a banner refers to is masked from the features of a head, in fitting and in scoring. The standard markers are masked in
a second copy of each head that is fitted, so that the model must also do without them. The body is seen without its head. Labels of heads are incomplete
(a banner need not state any fact), so thresholds are set for positive and unlabelled rows: they maximise
recall ** 2 / share found. Repositories are split: some fit, some set the thresholds, and the rest, seen by neither, measure the very
classifiers that are used. A file is found if any of its chunks is found by any view.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path
from corvane.session import materialize

#: Chunks that are labelled, at most about this many; all of a smaller table. Everything is scored.
LABELLED_CHUNKS = 120_000
VIEWS = ("path", "head", "body")
#: Most rows without and with a label that a view is fitted and measured on.
SAMPLE = {"path": (6_000, 2_500), "head": (9_000, 3_000), "body": (2_500, 1_000)}
#: Of so many parts of the repositories one measures and one sets the thresholds; the others are fitted on.
PARTS = 8
BITS = 17
GRAMS_HEAD, GRAMS_BODY = (3, 4, 5), (3, 4)
#: The cost of an error; heads are labelled less surely, so their margin is softer.
COST = {"path": 4.0, "head": 0.5, "body": 4.0}

# Conventions of paths.
_PATH_FACT = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|pods|carthage|godeps|vendor|extern|externals?|deps|upstream)/[^/]+/"
    r"|\.min\.\w+$|\.bundle\.\w+$|(?:^|/)(?:chunk-|app\.|main\.|vendors?[.~-]|runtime\.)[0-9a-f]{2,}\.js$"
    r"|\.pb(?:-c)?\.\w+$|_pb2?(?:_grpc)?\.\w+$|\.g\.\w+$|\.generated\.\w+$|\.designer\.\w+$|(?:_gen|_generated)\.\w+$|(?:^|/)zz_generated\.|(?:^|/)lex\.|\.tab\.[ch]$"
    r"|(?:outerclass|grpc)\.java$",
    re.I,
)
# What a banner refers to: the groups are its facts, and what they match is masked from the features.
_HEAD_FACTS = re.compile(
    r"(?P<command>`[^`\n]*\s-{1,2}\w[^`\n]*`)"
    r"|(?P<definition>\b[\w-]+\.(?:proto|thrift|idl|xsd|wsdl|avsc|fbs|asn1?|g4|graphqls?|capnp)\b)"
    r"|(?P<date>\b(?:19|20)\d\d-\d\d-\d\d\b)"
    r"|(?P<licence>\bSPDX-License-Identifier:\s*[\w.+-]+|\(c\)|©|\bcopyright\b|\b(?:MIT|BSD|GPL|LGPL|MPL|ISC|Apache)\b(?:[ -][\d.]+)?)"
    r"|(?P<versioned>\b(?!(?:version|release|section|chapter|since|from|than|to|in|at|of|by|and|or)\b)[A-Za-z][\w-]*[ ,]+v?\d+\.\d+(?:\.\d+)*\b(?!\s*(?:%|[munk]?s\b|[kmg]i?b\b)))",
    re.I,
)
#: A banner begins a file and is followed by an empty line. Those longer than this are prose, whose numbers and names are no facts.
BANNER = 400
#: Numbers from which a table isn't a small one.
LARGE_TABLE = 80
# The standard markers of Go, .NET and others at the start of a statement (a quoted marker is spoken of, not made), and all that is masked
# in the second copy of a head that is fitted.
_MARKER = re.compile(r"^[ \t/*#;-]*(?:@generated\b|<auto-?generated\b|auto-?generated (?:file|code)\b|code generated\b[^\n]*\bdo not (?:edit|modify)\b)", re.I | re.M)
_GIVEAWAY = re.compile(r"@generated|</?auto-?generated\s*/?>|\bauto-?generated\b|\bcode generated\b|\bgenerated by\b|\bautomatically generated\b|\bdo not (?:edit|modify)\b", re.I)

_COMMENT = re.compile(r"(?:[ \t]*(?://|#(?!include|define|if|\[|pragma)|--|/\*|\*|<!--)[^\n]*(?:\n|\Z)|[ \t]*\n)*")
_LAST_COMMENT = re.compile(r"(?:^|\n)[ \t]*(?://|#|/\*|--)[^\n]*\s*\Z")
_DETACHED = re.compile(r"\s*(?:[ \t]*(?://|#|--|/\*|\*|<!--)[^\n]*\n)+[ \t]*\n")
_TOKEN = re.compile(r"\w+")
_UNBROKEN = re.compile(r"[A-Za-z0-9+/=]{200}")


def _hash(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint32) >> np.uint32(32 - BITS)


def _gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(len(b) - n + 1, 0), n, dtype=np.uint32)
    for i in range(n):
        h ^= b[i : len(b) - n + 1 + i]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def grams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashed n-grams of the bytes of a text, as feature numbers."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    return np.concatenate([_gram_hashes(b, n) for n in sizes if len(b) >= n] or [np.zeros(0, dtype=np.uint32)])


def split_chunk(content: str) -> tuple[str, str]:
    """The comments at the head (and a comment in the last line) of a chunk, and its body without them."""
    head = _COMMENT.match(content).end()
    last = _LAST_COMMENT.search(content, head)
    end = last.start() if last else len(content)
    return content[:head] + content[end:], content[head:end]


def path_features(path: str) -> np.ndarray:
    *folders, name = path.lower().split("/")
    raw = path.rsplit("/", 1)[-1]
    words = []
    for i, f in enumerate(folders[1:], 1):
        after = folders[i + 1] if i + 1 < len(folders) else ""
        # folders and endings say more than the words of a name: four times over they weigh twice as much
        words += [f"d {f}", f"d {f} {'file' if not after else 'package' if '-' in after else 'folder'}"] * 4
    masked = re.sub(r"(?<![a-z])[0-9a-f]*\d[0-9a-f]*(?![a-z])", "0", name)
    stem, _, ending = masked.partition(".")
    words += [f"e .{ending}"] * 4
    parts = [p for p in re.split(r"[._\-]+", masked) if p]
    words += [f"p {p}" for p in parts] + [f"p2 {a} {b}" for a, b in zip(parts, parts[1:])] + [f"first {parts[0] if parts else ''}"]
    camel = re.findall(r"[A-Z][a-z]+|[a-z]+", raw.split(".")[0])
    words += [f"c {' '.join(camel[-2:])}", f"c1 {camel[-1] if camel else ''}", f"stem0 {re.sub('[a-z]+', 'w', stem)} .{ending}"]
    return _hash(words)


def masked_head(head: str, project: str, without_giveaways: bool = False) -> str:
    """A head in lower case as the classifier sees it: without the facts that label it, the project's name and numbers."""
    text = _HEAD_FACTS.sub(lambda m: {"command": " c ", "definition": " f ", "date": "0", "licence": " l ", "versioned": " n 0"}[m.lastgroup], head)
    if project:
        text = text.replace(project, " p ")
    if without_giveaways:
        text = _GIVEAWAY.sub(" ", text)
    return re.sub(r"\d+(?:[.\-:]\d+)*", "0", text).lower()


def head_features(masked: str) -> np.ndarray:
    words = re.findall(r"[^\W\d_]+|@|<", masked)
    return np.concatenate([grams(masked, GRAMS_HEAD), _hash([f"w {w}" for w in words] + [f"b {a} {b}" for a, b in zip(words, words[1:])])])


def _vector(features: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: the root of the counts at unit length, or plain counts over the root of their sum.

    The latter makes a score the sum of the weights of all n-grams in order, which needs no counting.
    """
    f, c = np.unique(features, return_counts=True)
    if counted:
        return f.astype(np.int64), c / np.sqrt(len(features))
    v = np.sqrt(c)
    return f.astype(np.int64), v / np.sqrt(v @ v)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0
    counted: bool = False

    def score(self, features: np.ndarray) -> float:
        """Signed distance to the threshold; a view without features says nothing."""
        if not len(features):
            return -1.0
        f, v = _vector(features, self.counted)
        return float(self.weights[f] @ v) + self.bias - self.threshold

    def score_texts(self, texts: list[str], sizes: tuple[int, ...]) -> np.ndarray:
        """:meth:`score` of the n-grams of many texts at once, for plain counts."""
        out = np.full(len(texts), -1.0)
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        a = 0
        while a < len(data):
            z, size = a, 0
            while z < len(data) and (z == a or size + len(data[z]) <= 1 << 20):
                size += len(data[z])
                z += 1
            lengths = np.array([len(x) for x in data[a:z]])
            ends = np.cumsum(lengths)
            b = np.frombuffer(b"".join(data[a:z]), dtype=np.uint8).astype(np.uint32)
            total, n = np.zeros(z - a), np.zeros(z - a)
            for k in sizes:
                w = np.concatenate([[0.0], np.cumsum(self.weights[_gram_hashes(b, k)], dtype=np.float64)])
                lo, hi = np.minimum(ends - lengths, len(w) - 1), np.clip(ends - k + 1, 0, len(w) - 1)
                own = np.maximum(lengths - k + 1, 0)
                total += np.where(own > 0, w[hi] - w[lo], 0)
                n += own
            some = n > 0
            out[a:z][some] = total[some] / np.sqrt(n[some]) + self.bias - self.threshold
            a = z
        return out


def fit_svm(rows: list[np.ndarray], labels: np.ndarray, counted: bool = False, c: float = 4.0, passes: int = 12) -> Classifier:
    """L2-regularised squared-hinge SVM by dual coordinate descent; both classes weigh the same."""
    w = np.zeros((1 << BITS) + 1, dtype=np.float64)
    positive = max(int(labels.sum()), 1)
    cost = np.where(labels, c * max(len(labels) - positive, 1) / positive, c) if positive * 2 < len(labels) else np.full(len(labels), c)
    y = np.where(labels, 1.0, -1.0)
    data = []
    for r in rows:
        f, v = _vector(r, counted)
        data.append((np.append(f, 1 << BITS), np.append(v, 1.0)))
    length = [float(v @ v) for _, v in data]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    active = np.arange(len(rows))
    for turn in range(passes):
        moved = np.zeros(len(rows), dtype=bool)
        for i in rng.permutation(active):
            f, v = data[i]
            diagonal = 0.5 / cost[i]
            g = y[i] * (w[f] @ v) - 1 + diagonal * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / (length[i] + diagonal), 0.0)
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                moved[i] = abs(new - alpha[i]) > 1e-3
                alpha[i] = new
        active = np.flatnonzero(moved | (alpha > 0)) if turn % 3 else np.arange(len(rows))
        if not moved.any():
            break
    return Classifier(w[:-1].astype(np.float32), float(w[-1]), counted=counted)


def _set_threshold(model: Classifier, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """Put the threshold where recall ** 2 / share found is highest on rows that are labelled or unlabelled, near 0 and amid its gap.

    With incomplete labels precision can't be measured, but this is in proportion to the squared F1 of the unknown truth.
    """
    if not labels.any() or labels.all():
        return
    s = np.array([model.score(r) for r in rows])
    order = np.unique(np.clip(s, -1, 1))
    cuts = np.concatenate([[0.0], (order[1:] + order[:-1]) / 2])
    cuts = cuts[np.abs(cuts) <= 0.5]
    positive, every = np.sort(s[labels]), np.sort(s)
    recall = 1 - np.searchsorted(positive, cuts, "right") / len(positive)
    share = 1 - np.searchsorted(every, cuts, "right") / len(every)
    value = recall**2 / np.maximum(share, 1 / len(every))
    best = cuts[value >= value.max() - 1e-12]
    model.threshold = float(best[np.abs(best).argmin()])


def body_fact(body: str) -> bool:
    """Whether a body has the shape of packed code or data: hardly any white space in long lines, an unbroken run, or mostly numbers."""
    longest = max((len(x) for x in body.split("\n")), default=0)
    if longest >= 300 and sum(body.count(c) for c in " \n\t") < len(body) * 0.12 or _UNBROKEN.search(body):
        return True
    tokens = _TOKEN.findall(body)
    numbered = sum(any(c.isdigit() for c in t) for t in tokens)
    return numbered >= LARGE_TABLE and numbered >= 0.45 * len(tokens)


def head_fact(head: str, project: str) -> bool:
    """Whether a banner refers to what made it or where it came from; a licence notice that names the project is its own."""
    return any(m.lastgroup != "licence" or not project or project not in head for m in _HEAD_FACTS.finditer(head))


def facts(path: str, content: str, first: bool = True) -> tuple[bool, bool, bool]:
    """The weak labels of path, head and body of a chunk; ``first`` says that it begins its file."""
    head, body = split_chunk(content)
    by_path, by_body = bool(_PATH_FACT.search(path)), body_fact(body)
    marked = _MARKER.search(head) is not None
    banner = first and len(head) <= BANNER and _DETACHED.match(head) is not None
    return by_path, marked or banner and (by_path or by_body or head_fact(head, path.split("/", 1)[0])), by_body


def features(view: str, path: str, text: str, without_giveaways: bool = False) -> np.ndarray:
    """Feature numbers of one view: of the path, or of the head or body that ``text`` is."""
    if view == "path":
        return path_features(path)
    if view == "body":
        return grams(text, GRAMS_BODY)
    return head_features(masked_head(text, path.split("/", 1)[0], without_giveaways))


def train(sample: pa.Table) -> tuple[list[Classifier], list[dict]]:
    """The classifiers of the three views from labelled rows (view, label, path, text), and their counts on repositories kept for measuring.

    A view whose rows all have one label, or that has none, says nothing. The head is measured twice, as it is and without giveaways.
    """
    by_view: dict[str, list] = {v: [] for v in VIEWS}
    for view, label, path, text in zip(*(sample.column(c).to_pylist() for c in ("view", "label", "path", "text"))):
        by_view[view].append((label, zlib.crc32(path.split("/", 1)[0].encode()) % PARTS, path, text))
    models, counts = [], []
    for view, rows in by_view.items():
        y, part = np.array([r[0] for r in rows], dtype=bool), np.array([r[1] for r in rows], dtype=np.int64)
        if not y[part > 1].any() or y[part > 1].all():  # too few repositories to keep any apart
            part = np.full(len(rows), 2)
        model = Classifier(np.zeros(1 << BITS, dtype=np.float32), -1.0)
        if y[part > 1].any() and not y[part > 1].all():
            x = [features(view, r[2], r[3]) for r in rows]
            used = np.flatnonzero(part > 1)
            fitted, labels = [x[i] for i in used], [y[i] for i in used]
            if view == "head":
                hidden = [i for i in used if _GIVEAWAY.search(rows[i][3])]
                fitted += [features(view, rows[i][2], rows[i][3], True) for i in hidden]
                labels += [y[i] for i in hidden]
            full = [i for i, f in enumerate(fitted) if len(f)]
            model = fit_svm([fitted[i] for i in full], np.array(labels, dtype=bool)[full], counted=view == "body", c=COST[view])
            _set_threshold(model, [x[i] for i in np.flatnonzero(part == 1)], y[part == 1])
        models.append(model)
        kept = [r for r, p in zip(rows, part) if p == 0]
        for name, hide in ((view, False), (f"{view} without giveaways", True))[: 2 if view == "head" else 1]:
            hit = np.array([model.score(features(view, r[2], r[3], hide)) > 0 for r in kept], dtype=bool)
            truth = np.array([r[0] for r in kept], dtype=bool)
            counts.append({"view": name, "n": len(kept), "positive": int(truth.sum()), "found": int(hit.sum()), "right": int((hit & truth).sum())})
    return models, counts


def _prepared(chunks: DataFrame) -> DataFrame:
    index = F.col("chunk_index") if "chunk_index" in chunks.columns else F.lit(0)
    return chunks.where(F.col("source_file").isNotNull()).select(
        canonical_path("source_file").alias("path"),
        F.col("source_file").alias("file"),
        F.coalesce("content", F.lit("")).alias("content"),
        (F.coalesce(index, F.lit(0)) == 0).alias("first"),
    )


def labelled_sample(prepared: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> DataFrame:
    """view, label, path, text: rows to fit on, at most ``SAMPLE`` of each view and label, chosen by a hash, the same in every run."""
    n = max(prepared.count(), 1)
    cut = int(min(1.0, labelled_chunks / n) * (1 << 30))
    place = F.pmod(F.xxhash64("path", "content"), F.lit(1 << 30))
    # of the many unlabelled heads and bodies three times as many as wanted are passed on
    enough = {view: cut * min(1.0, 3 * sizes[0] / min(n, labelled_chunks)) for view, sizes in SAMPLE.items()}

    def run(batches):
        kinds = {"view": pa.string(), "label": pa.bool_(), "path": pa.string(), "text": pa.string(), "place": pa.int64()}
        for b in batches:
            rows = []
            for path, content, first, at in zip(*(b.column(c).to_pylist() for c in ("path", "content", "first", "place"))):
                head, body = split_chunk(content)
                by_path, by_head, by_body = facts(path, content, first)
                rows.append(("path", by_path, path, "", zlib.crc32(path.encode())))
                if head.strip() and (by_head or at < enough["head"]):
                    rows.append(("head", by_head, path, head, at))
                if body.strip() and (by_body or at < enough["body"]):
                    rows.append(("body", by_body, path, body, at))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds.values())], names=list(kinds))

    rows = prepared.where(place < cut).select("path", "content", "first", place.alias("place")).mapInArrow(
        run, "view string, label boolean, path string, text string, place bigint"
    )
    most = F.lit(0)
    for view, sizes in SAMPLE.items():
        most = F.when(F.col("view") == view, F.when(F.col("label"), sizes[1]).otherwise(sizes[0])).otherwise(most)
    w = Window.partitionBy("view", "label").orderBy("place", "path", "text")
    largest = max(max(s) for s in SAMPLE.values())
    # dense ranks take the repeated rows of one path as one; the constant limit is also applied before the exchange
    ranked = rows.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= largest)
    return ranked.where(F.col("r") <= most).select("view", "label", "path", "text").distinct().orderBy("view", "label", "path", "text")


def fit(chunks: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> tuple[list[Classifier], list[dict]]:
    """:func:`train` on a bounded sample of the table itself."""
    return train(labelled_sample(_prepared(chunks), labelled_chunks).toArrow())


def held_out_accuracy(chunks: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> DataFrame:
    """Per view: rows of the repositories kept for measuring, labelled, found and rightly found ones, precision and recall.

    Precision is against the weak labels: a right find that no fact labels counts against it.
    """
    _, counts = fit(chunks, labelled_chunks)
    rows = [(c["view"], c["n"], c["positive"], c["found"], c["right"]) for c in counts]
    got = chunks.sparkSession.createDataFrame(rows, "view string, n bigint, positive bigint, found bigint, right bigint")
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return got.withColumns({"precision": share("right", "found"), "recall": share("right", "positive")})


def scored_files(chunks: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> DataFrame:
    """source_file and the highest score of its chunks by view (positive: not hand-written), for every file.

    Null files are left out; null and empty contents are judged by their path alone. Repeated rows change nothing.
    The classifiers are fitted on a bounded sample, but every chunk is scored in full.
    """
    models, _ = fit(chunks, labelled_chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(models)  # three arrays of 2**BITS numbers

    def run(batches):
        path_model, head_model, body_model = shared.value
        by_path: dict[str, float] = {}
        for b in batches:
            scores = np.full((b.num_rows, 3), -1.0)
            bodies = []
            for i, (path, content) in enumerate(zip(b.column("path").to_pylist(), b.column("content").to_pylist())):
                if path not in by_path:
                    if len(by_path) > 50_000:
                        by_path.clear()
                    by_path[path] = path_model.score(path_features(path))
                scores[i, 0] = by_path[path]
                head, body = split_chunk(content)
                if head.strip():
                    scores[i, 1] = head_model.score(features("head", path, head))
                bodies.append(body)
            scores[:, 2] = body_model.score_texts(bodies, GRAMS_BODY)
            yield pa.RecordBatch.from_arrays([b.column("file"), *(pa.array(scores[:, j]) for j in range(3))], names=["source_file", *VIEWS])

    scored = _prepared(chunks).select("file", "path", "content").mapInArrow(run, "source_file string, path double, head double, body double")
    return scored.groupBy("source_file").agg(*(F.max(v).alias(v) for v in VIEWS))


def not_handwritten(chunks: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> DataFrame:
    """source_file of every file that any view finds."""
    return scored_files(chunks, labelled_chunks).where(F.greatest(*VIEWS) > 0).select("source_file")


def against_labels(chunks: DataFrame, labelled_chunks: int = LABELLED_CHUNKS) -> DataFrame:
    """labelled, found, n: files by whether a fact labels any of their chunks and whether the classifiers find them."""

    def run(batches):
        for b in batches:
            hit = [any(facts(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("path", "content", "first")))]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(hit, type=pa.bool_())], names=["source_file", "labelled"])

    labelled = _prepared(chunks).select("file", "path", "content", "first").mapInArrow(run, "source_file string, labelled boolean")
    files = labelled.groupBy("source_file").agg(F.max("labelled").alias("labelled"))
    found = materialize(scored_files(chunks, labelled_chunks), "scored-files").select("source_file", (F.greatest(*VIEWS) > 0).alias("found"))
    return files.join(found, "source_file").groupBy("labelled", "found").agg(F.count(F.lit(1)).alias("n"))
