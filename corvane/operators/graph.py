"""The typed dependency graph: neighbours by hops, PageRank, symbol resolution and edge maintenance.

Loops cut their lineage at tables in the shared folder, so the loss of an executor costs one step at most.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path, parent_dir
from corvane.session import discard, materialize

EXTERNAL = "_external_"
EDGE_KEY = ("source_file", "source_symbol", "target_file", "target_symbol", "edge_type")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with canonical paths: insert-or-ignore by the five identifying columns."""
    return edges.select(
        canonical_path("source_file").alias("source_file"),
        "source_symbol",
        canonical_path("target_file").alias("target_file"),
        "target_symbol",
        "edge_type",
    ).distinct()


def links(edges: DataFrame) -> DataFrame:
    """src, dst of the simple directed graph of files; unresolved and external ends give no link."""
    real = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", EXTERNAL)
    return edges.where(real("source_file") & real("target_file")).select(F.col("source_file").alias("src"), F.col("target_file").alias("dst")).distinct()


def edge_counters(edges: DataFrame) -> DataFrame:
    """Edges, resolved, external and unresolved ones, in one pass."""
    t = F.col("target_file")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return edges.agg(
        F.count(F.lit(1)).alias("n_edges"),
        n(t.isNotNull() & ~t.isin("", EXTERNAL)).alias("n_resolved"),
        n(t == EXTERNAL).alias("n_external"),
        n(t.isNull() | (t == "")).alias("n_unresolved"),
    )


def change_signature(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Rows, highest id and an order-free checksum: it changes whenever the table does."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("max_id"), F.bit_xor(F.xxhash64(id_col, *columns)).alias("checksum"))


def neighbours(edge_links: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", max_nodes: int | None = None, centrality: DataFrame | None = None) -> DataFrame:
    """Files within ``depth`` hops (1 to 5) of each seed: seed, file, hop (the shortest).

    ``direction``: ``callers`` go from target to source, ``dependencies`` from source to target, ``both`` either way.
    Either-way steps are a union of two equi-joins. ``max_nodes`` keeps the frontier of a hop to the most central
    files (``centrality``: file, score), then by name.
    """
    if direction not in ("both", "callers", "dependencies") or not 1 <= depth <= 5:
        raise ValueError("direction is both, callers or dependencies; depth is 1 to 5")
    steps = []
    if direction in ("both", "dependencies"):
        steps.append(edge_links.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    if direction in ("both", "callers"):
        steps.append(edge_links.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    step = steps[0].unionByName(steps[1]).distinct() if len(steps) > 1 else steps[0]
    seen = seeds.select("seed", F.col("seed").alias("file"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.select("seed", F.col("file").alias("at")).join(step, "at").select("seed", F.col("to").alias("file")).distinct()
        fresh = found.join(seen.select("seed", "file"), ["seed", "file"], "left_anti").withColumn("hop", F.lit(hop))
        if max_nodes is not None:
            ranked = fresh.join(centrality.select("file", "score"), "file", "left") if centrality is not None else fresh.withColumn("score", F.lit(0.0))
            w = Window.partitionBy("seed").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "file")
            fresh = ranked.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max_nodes).select("seed", "file", "hop")
        if hop < depth:
            fresh = materialize(fresh, f"hop-{hop}")
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen.where("hop > 0")


def callers_of(edge_links: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Sorted distinct callers of each seed within ``depth`` hops."""
    return neighbours(edge_links, seeds, depth, "callers").groupBy("seed").agg(F.sort_array(F.collect_set("file")).alias("callers"))


def _pagerank_in_memory(edge_links: DataFrame, iterations: int, alpha: float, seeds: DataFrame | None, tolerance: float | None, check_every: int) -> DataFrame:
    """The same iteration as :func:`pagerank`, by numpy in one task."""
    given = edge_links.select("src", "dst")
    seeded = seeds is not None
    if seeded:
        given = given.unionByName(seeds.select(F.lit(None).cast("string").alias("src"), F.col("file").alias("dst")))

    def run(table: pa.Table) -> pa.Table:
        src, dst = (np.asarray(table.column(c).to_pylist(), dtype=object) for c in ("src", "dst"))
        link = np.array([x is not None for x in src], dtype=bool)
        names, codes = np.unique(np.concatenate([src[link], dst[link]]).astype(str), return_inverse=True) if link.any() else (np.zeros(0, str), np.zeros(0, int))
        n, m = len(names), int(link.sum())
        a, b = codes[:m], codes[m:]
        if not seeded:
            tele = np.full(n, 1.0 / max(n, 1))
        else:
            tele = np.isin(names, dst[~link].astype(str)).astype(float)
            tele = tele / tele.sum() if tele.any() else tele
        if not n or not tele.any():
            return pa.table({"file": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        degree = np.bincount(a, minlength=n)
        rank = tele.copy()
        for i in range(1, iterations + 1):
            flow = np.bincount(b, weights=(rank / np.maximum(degree, 1))[a], minlength=n)
            new = alpha * (flow + rank[degree == 0].sum() * tele) + (1 - alpha) * tele
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance is not None and i % check_every == 0 and moved < n * tolerance:
                break
        return pa.table({"file": pa.array(names.tolist(), pa.string()), "score": pa.array(rank)})

    return given.groupBy(F.lit(1).alias("one")).applyInArrow(run, "file string, score double")


def pagerank(
    edge_links: DataFrame, iterations: int = 20, alpha: float = 0.85, seeds: DataFrame | None = None, tolerance: float | None = None, check_every: int = 5, in_memory: bool = False
) -> DataFrame:
    """PageRank of all files: file, score. With ``seeds`` (file), restarts and dangling mass go to the seeds in the graph.

    Power iteration by joins; stops after ``iterations`` or once, at every ``check_every``-th step, the L1 change is below ``tolerance`` times the number of
    nodes. No seed in the graph gives no rows. The out-degree travels with the ranks. Every step is written to the shared folder and the one before it
    deleted, so a step reads one table and the loss of an executor costs one step. ``in_memory`` iterates in one task instead, with the
    same results; it is the caller's choice for graphs that are known to be small and never taken by itself.
    """
    if in_memory:
        return _pagerank_in_memory(edge_links, iterations, alpha, seeds, tolerance, check_every)
    nodes = edge_links.select(F.col("src").alias("file")).union(edge_links.select("dst")).distinct()
    degree = edge_links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    base = nodes.join(degree.withColumnRenamed("src", "file"), "file", "left")
    if seeds is None:
        base = base.withColumn("own", F.lit(1))
    else:
        base = base.join(seeds.select("file").distinct().withColumn("own", F.lit(1)), "file", "left")
    base = materialize(base, "nodes")
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s")).first()  # one row
    if not counts.n or not counts.s:
        return base.select("file", F.lit(0.0).alias("score")).limit(0)
    base = base.withColumn("tele", F.coalesce(F.col("own"), F.lit(0)) / F.lit(float(counts.s))).drop("own")
    ranks = base.withColumn("score", F.col("tele"))
    for i in range(1, iterations + 1):
        shares = ranks.where("deg IS NOT NULL").select(F.col("file").alias("src"), (F.col("score") / F.col("deg")).alias("x"))
        inflow = edge_links.join(shares, "src").groupBy(F.col("dst").alias("file")).agg(F.sum("x").alias("x"))
        dangling = ranks.where("deg IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("d"))
        new = base.join(inflow, "file", "left").join(F.broadcast(dangling)).select(
            "file", "deg", "tele", (alpha * (F.coalesce("x", F.lit(0.0)) + F.col("d") * F.col("tele")) + (1 - alpha) * F.col("tele")).alias("score")
        )
        old, ranks = ranks, materialize(new, f"ranks-{i}")
        moved = None
        if tolerance is not None and i % check_every == 0:
            moved = ranks.join(old.select("file", F.col("score").alias("was")), "file").agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        discard(old)
        if moved is not None and moved < counts.n * tolerance:
            break
    return ranks.select("file", "score")


# --- symbol resolution ----------------------------------------------------------------------------

_JS = (".js", ".jsx", ".ts", ".tsx", ".mjs")
_JS_SOURCES = (*_JS, ".cjs")
# Namespaces of libraries.
CSHARP_EXTERNAL = (
    "System", "Microsoft", "Newtonsoft", "AutoMapper", "Serilog", "FluentValidation", "MediatR", "Dapper", "NUnit", "Xunit", "Moq",
    "FluentAssertions", "Bogus", "Azure", "Amazon", "Google", "Twilio", "SendGrid", "Polly", "Hangfire", "Quartz", "MassTransit", "RabbitMQ",
    "StackExchange", "MongoDB", "Npgsql", "MySql", "Oracle", "JWT", "IdentityModel", "Humanizer", "CsvHelper", "Kendo", "Org",
)
JAVA_EXTERNAL = (
    "java", "javax", "jakarta", "sun", "com.sun", "jdk", "org.junit", "org.testng", "org.apache", "org.slf4j", "org.springframework",
    "com.google", "com.fasterxml", "android", "kotlin",
)


def file_variants(files: DataFrame) -> DataFrame:
    """Names under which a file may be imported: key, path. A path itself always wins, then the first file in path order.

    ``files``: file. Variants are the path, its stem, the path without suffix, that with dots, and the folder of an index file.
    """
    f = F.col("file")
    bare = F.regexp_replace(f, r"(?<=[^/])\.[^./]*$", "")
    stem = F.regexp_extract(bare, r"([^/]*)$", 1)
    parent = parent_dir(f)
    keys = F.array(
        F.struct(f.alias("key"), F.lit(0).alias("p")),
        F.struct(stem.alias("key"), F.lit(1).alias("p")),
        F.struct(bare.alias("key"), F.lit(1).alias("p")),
        F.struct(F.translate(bare, "/", ".").alias("key"), F.lit(1).alias("p")),
        F.struct(F.when((stem == "index") & (parent != ""), parent).alias("key"), F.lit(1).alias("p")),
    )
    named = files.select(canonical_path("file").alias("file")).where("file IS NOT NULL AND file <> ''").distinct().select("file", F.explode(keys).alias("k"))
    return named.where("k.key IS NOT NULL").groupBy("k.key").agg(F.min_by("file", F.struct("k.p", "file")).alias("path"))


def _ends(c: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(c, F.lit(s))
    return out


def candidate_keys(symbol: Column, source: Column) -> Column:
    """Names to look a symbol up by, in order of priority."""
    s = F.trim(F.split(symbol, " as ").getItem(0))
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(s, r"^\.+", ""), "^/+", "")
    rest = F.when(F.contains(rest, F.lit("/")), rest).otherwise(F.translate(rest, ".", "/"))
    folders = F.filter(F.split(parent_dir(source), "/"), lambda x: x != "")
    up = F.slice(folders, 1, F.greatest(F.size(folders) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    relative = F.array_join(F.concat(up, F.filter(F.array(rest), lambda x: x != "")), "/")
    alias = F.substring(s, 3, 1 << 20)
    js, ts = _ends(source, _JS_SOURCES), _ends(source, (".ts", ".tsx"))
    extended = lambda base: [F.concat(base, F.lit(x)) for e in _JS for x in (e, f"/index{e}")]
    is_rel, is_alias = F.startswith(s, F.lit(".")), F.startswith(s, F.lit("@/")) & js
    as_ts = F.regexp_replace(relative, r"\.js$", "")
    keys = [s, F.translate(s, ".", "/"), F.translate(s, "/", ".")]
    keys += [F.when(is_rel, relative), F.when(is_rel, F.translate(relative, "/", "."))]
    keys += [F.when(is_rel & ts & F.endswith(relative, F.lit(".js")), F.concat(as_ts, F.lit(e))) for e in (".ts", ".tsx")]
    keys += [F.when(is_rel & js, k) for k in extended(relative)]
    keys += [F.when(is_alias, alias)] + [F.when(is_alias, k) for k in extended(alias)]
    return F.array(*keys)


def resolve_symbols(edges: DataFrame, files: DataFrame) -> DataFrame:
    """target_symbol, source_file and the file that the symbol names, for each distinct pair of unresolved edges.

    A left join of the candidate names with all variants; of several matches the candidate of the highest priority wins.
    """
    asked = edges.select("target_symbol", canonical_path("source_file").alias("source_file")).where("target_symbol <> '' AND source_file IS NOT NULL").distinct()
    exploded = asked.select("*", F.posexplode(candidate_keys(F.col("target_symbol"), F.col("source_file"))).alias("priority", "key")).where("key <> ''")
    matched = exploded.join(file_variants(files), "key")
    best = matched.groupBy("target_symbol", "source_file").agg(F.min_by("path", "priority").alias("resolved"))
    return asked.join(best, ["target_symbol", "source_file"], "left")


def is_external(symbol: Column, source: Column, own_go_modules: tuple[str, ...] = ()) -> Column:
    """Whether a symbol that names no file of the project is from a library, by the rules of the source's language."""
    first = F.split(symbol, r"\.").getItem(0)
    two = F.array_join(F.slice(F.split(symbol, r"\."), 1, 2), ".")
    plain = ~F.contains(symbol, F.lit("/")) & ~F.contains(symbol, F.lit("."))
    go_host = F.contains(F.split(symbol, "/").getItem(0), F.lit("."))
    own_go = F.lit(False)
    for m in own_go_modules:
        own_go = own_go | (symbol == m) | F.startswith(symbol, F.lit(m + "/"))
    standard = sorted(sys.stdlib_module_names)
    out = (
        F.when(symbol.isNull() | (symbol == "") | F.startswith(symbol, F.lit(".")), False)
        .when(_ends(source, _JS_SOURCES), ~F.startswith(symbol, F.lit("@/")))
        .when(_ends(source, (".py",)), plain | first.isin(*standard))
        .when(_ends(source, (".cs", ".cshtml")), first.isin(*CSHARP_EXTERNAL))
        .when(_ends(source, (".java",)), first.isin(*JAVA_EXTERNAL) | two.isin(*JAVA_EXTERNAL))
        .when(_ends(source, (".go",)), ~go_host | ~own_go)
    )
    return F.coalesce(out, F.lit(False))


def namespaces(files: DataFrame) -> DataFrame:
    """segment and ``plain``: the parts of all paths of a project, and (``plain`` is false) the dotted pieces of its folders."""
    path = files.select(F.split(canonical_path("file"), "/").alias("p")).where("p IS NOT NULL")
    plain = path.select(F.explode("p").alias("segment"), F.lit(True).alias("plain"))
    dotted = path.select(F.explode(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0)))).alias("folder")).where(F.contains("folder", F.lit(".")))
    pieces = dotted.select(F.explode(F.split("folder", r"\.")).alias("segment"), F.lit(False).alias("plain"))
    return plain.unionByName(pieces).where("segment <> ''").groupBy("segment").agg(F.max("plain").alias("plain"))


def with_external(edges: DataFrame, files: DataFrame, own_go_modules: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` with ``external``: whether the symbol that named no file of the project is from a library.

    Besides :func:`is_external`, a Python symbol, and one that a C# file imports, is from a library if its first segment is none of the project's
    own ``namespaces``; for C# those of dotted folders (``Acme.Api/``) count too. ``edges`` have source_file, target_symbol and edge_type.
    """
    symbol, source = F.col("target_symbol"), F.col("source_file")
    python, csharp = _ends(source, (".py",)), _ends(source, (".cs", ".cshtml")) & (F.col("edge_type") == "imports")
    named = F.when(python, F.trim(F.split(symbol, " as ").getItem(0))).when(csharp, symbol)
    first = F.split(named, r"\.").getItem(0)
    own = namespaces(files).select(F.col("segment").alias("__segment"), F.col("plain").alias("__plain"))
    joined = edges.withColumn("__first", first).join(own, F.col("__first") == F.col("__segment"), "left")
    foreign = (F.col("__first") != "") & F.when(python, ~F.coalesce("__plain", F.lit(False))).otherwise(F.col("__segment").isNull())
    external = is_external(symbol, source, own_go_modules) | F.coalesce(foreign, F.lit(False))
    return joined.withColumn("external", external).drop("__first", "__segment", "__plain")


# --- maintenance ----------------------------------------------------------------------------------


def delete_outgoing(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without those that start in ``files`` (file), in whatever spelling."""
    return edges.join(files.select(canonical_path("file").alias("__f")).distinct(), canonical_path("source_file") == F.col("__f"), "left_anti")


def delete_referencing(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without those that start or end in ``files``, in whatever spelling; the placeholders for unresolved and external ends are refused."""
    gone = files.select(canonical_path("file").alias("file")).where(~F.col("file").isin("", EXTERNAL)).distinct()
    return delete_outgoing(edges, gone).join(gone.withColumnRenamed("file", "__f"), canonical_path("target_file") == F.col("__f"), "left_anti")


def delete_ghosts(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Edges whose source, and target if it is resolved, are files of ``current`` (file)."""
    files = current.select(canonical_path("file").alias("__f")).distinct()
    own = edges.join(files, canonical_path("source_file") == F.col("__f"), "left_semi")
    t = canonical_path("target_file")
    kept = own.join(files, t == F.col("__f"), "left")
    return kept.where(F.col("__f").isNotNull() | F.col("target_file").isNull() | F.col("target_file").isin("", EXTERNAL)).drop("__f")
