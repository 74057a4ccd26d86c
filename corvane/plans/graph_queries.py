"""Queries on the dependency graph and on index maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.paths import canonical_path
from corvane.operators import graph, index, store
from corvane.plans import indexing
from corvane.sources import scan
from corvane.session import materialize, table

#: Steps of the queries that SQL unrolls; the converged ones have no SQL.
ITERATIONS = 5
#: The reference's bound of the steps, and the mean change of a score at which they end; its own 1e-6 hardly takes a step on large graphs.
CONVERGED = {"iterations": 100, "tolerance": 1e-12, "in_memory": True}
SEEDS = 3


def _links(s: SparkSession, d: str) -> DataFrame:
    return materialize(graph.links(graph.canonical_edges(table(s, d, "edges"))), "links")


def _seeds(links: DataFrame) -> DataFrame:
    """The query's seed files: the ones with the most dependencies."""
    return links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(SEEDS).select(F.col("src").alias("seed"))


def edge_counters(s: SparkSession, d: str) -> DataFrame:
    return graph.edge_counters(table(s, d, "edges"))


def change_signature(s: SparkSession, d: str) -> DataFrame:
    """Two tables with the same rows in another order have one signature; without one row it's another."""
    e = table(s, d, "edges")
    sign = lambda t, name: graph.change_signature(t, "edge_id", "source_file", "target_file").select(F.lit(name).alias("state"), "n", "max_id", "checksum")
    first = e.agg(F.min("edge_id").alias("least"))
    fewer = e.join(F.broadcast(first), F.col("edge_id") > F.col("least")).drop("least")
    states = sign(e, "whole").unionByName(sign(e.repartition("target_symbol"), "moved")).unionByName(sign(fewer, "fewer"))
    whole = sign(e, "whole").select(F.col("checksum").alias("before"))
    return states.join(F.broadcast(whole)).select("state", "n", "max_id", (F.col("checksum") == F.col("before")).alias("unchanged"))


def neighbours_dependencies(s: SparkSession, d: str) -> DataFrame:
    links = _links(s, d)
    return graph.neighbours(links, _seeds(links), 3, "dependencies")


def neighbours_both(s: SparkSession, d: str) -> DataFrame:
    links = _links(s, d)
    return graph.neighbours(links, _seeds(links), 2, "both")


def callers(s: SparkSession, d: str) -> DataFrame:
    links = _links(s, d)
    hubs = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(SEEDS).select(F.col("dst").alias("seed"))
    return graph.callers_of(links, hubs, 2).select("seed", F.size("callers").cast("bigint").alias("n_callers"), F.element_at("callers", 1).alias("first"))


def pagerank(s: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_links(s, d), ITERATIONS).select("file", F.round("score", 8).alias("score"))


def personalized_pagerank(s: SparkSession, d: str) -> DataFrame:
    links = _links(s, d)
    return graph.pagerank(links, ITERATIONS, seeds=_seeds(links).select(F.col("seed").alias("file"))).select("file", F.round("score", 8).alias("score"))


def pagerank_in_memory(s: SparkSession, d: str) -> DataFrame:
    """:func:`pagerank` by the choice for small graphs."""
    return graph.pagerank(_links(s, d), ITERATIONS, in_memory=True).select("file", F.round("score", 8).alias("score"))


def pagerank_converged(s: SparkSession, d: str) -> DataFrame:
    """The scores that the power iteration tends to, of which :func:`pagerank` gives the first steps."""
    return graph.pagerank(_links(s, d), **CONVERGED).select("file", F.round("score", 8).alias("score"))


def personalized_pagerank_converged(s: SparkSession, d: str) -> DataFrame:
    links = _links(s, d)
    return graph.pagerank(links, seeds=_seeds(links).select(F.col("seed").alias("file")), **CONVERGED).select("file", F.round("score", 8).alias("score"))


def ghost_edges(s: SparkSession, d: str) -> DataFrame:
    current = table(s, d, "manifest").where("deleted_at IS NULL").select("file").unionByName(table(s, d, "shared_files").where("deleted_at IS NULL").select("file"))
    return graph.delete_ghosts(table(s, d, "edges"), current).groupBy("edge_type").agg(F.count(F.lit(1)).alias("kept"))


def delete_referencing(s: SparkSession, d: str) -> DataFrame:
    gone = index.ended_files(table(s, d, "manifest"))
    return graph.delete_referencing(graph.canonical_edges(table(s, d, "edges")), gone).groupBy("edge_type").agg(F.count(F.lit(1)).alias("kept"))


def resolved_symbols(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "manifest").select("file").unionByName(table(s, d, "shared_files").select("file"))
    imports = table(s, d, "edges").where("edge_type = 'imports'")
    return graph.resolve_symbols(imports, files).select("target_symbol", "source_file", "resolved")


def external_symbols(s: SparkSession, d: str) -> DataFrame:
    """Distinct references by file, symbol and kind: whether the symbol is a library's."""
    e = table(s, d, "edges").select(canonical_path("source_file").alias("source_file"), "target_symbol", "edge_type").where("source_file IS NOT NULL").distinct()
    files = table(s, d, "manifest").select("file").unionByName(table(s, d, "shared_files").select("file"))
    return graph.with_external(e, files).groupBy("external", "edge_type").agg(F.count(F.lit(1)).alias("n"))


# --- index ----------------------------------------------------------------------------------------


def _scan(s: SparkSession, d: str) -> DataFrame:
    """A later scan of the manifest's files: some changed, some gone."""
    m = table(s, d, "manifest").groupBy("file").agg(F.min("file_hash").alias("hash"))
    n = F.length("file")
    return m.where(n % 13 != 0).select("file", F.when(n % 7 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))


def manifest_diff(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "manifest").groupBy("file").agg(F.min("file_hash").alias("hash")).where(F.length("file") % 11 != 0)
    return index.diff(_scan(s, d), old)


def upsert_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunk table after its re-indexed rows replaced the first ones."""
    c = table(s, d, "chunks").select("chunk_id", "row_id", "indexed_at", "token_count")
    first = index.last_by(c, ["chunk_id"], [F.col("indexed_at"), F.col("row_id")])
    return index.upsert(first, c, "chunk_id", [F.desc("indexed_at"), F.desc("row_id")]).select("chunk_id", "row_id", "token_count")


def delete_by_source(s: SparkSession, d: str) -> DataFrame:
    gone = index.ended_files(table(s, d, "manifest"))
    return index.delete_files(table(s, d, "chunks"), gone).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def dropped_files(s: SparkSession, d: str) -> DataFrame:
    gone = index.ended_files(table(s, d, "manifest"))
    parts = index.drop_files(gone, table(s, d, "chunks"), table(s, d, "edges"), table(s, d, "manifest"))
    counted = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, p in zip(("chunks", "edges", "manifest"), parts)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def registry_update(s: SparkSession, d: str) -> DataFrame:
    measured = table(s, d, "chunks").groupBy(F.col("scope").alias("project")).agg(F.count(F.lit(1)).alias("n_chunks"), F.lit(None).cast("bigint").alias("n_files"))
    m = table(s, d, "manifest").groupBy(F.regexp_extract("file", "^([^/]*)", 1).alias("project"))
    return index.carry_over(measured, m.agg(F.countDistinct("file").alias("n_files"), F.lit(0).cast("bigint").alias("n_chunks")), ["project"]).select("project", "n_files", "n_chunks")


def _projects(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "chunks").groupBy(F.col("scope").alias("project")).agg(F.countDistinct("source_file").alias("n_files"), F.max("indexed_at").alias("at"))
    model = F.when(F.col("n_files") % 5 == 0, None).when(F.col("n_files") % 3 == 0, "model-b").otherwise("model-a")
    return p.select("project", "n_files", model.alias("model_id"), (F.col("n_files") % 2 == 0).alias("incomplete"))


def index_gates(s: SparkSession, d: str) -> DataFrame:
    return index.index_gates(_projects(s, d), "model-a")


def project_coverage(s: SparkSession, d: str) -> DataFrame:
    p = _projects(s, d)
    return index.coverage(p, index.index_gates(p, "model-a"))


def fallback_decision(s: SparkSession, d: str) -> DataFrame:
    p = _projects(s, d)
    results = table(s, d, "events").select((F.col("value") / 1000).alias("score"))
    return index.fallback_decision(results, index.coverage(p, index.index_gates(p, "model-a"))).select("n_results", F.round("top_score", 6).alias("top_score"), "n_complete", "fall_back")


def sweep_plan(s: SparkSession, d: str) -> DataFrame:
    return index.sweep_plan(_projects(s, d).where("model_id IS NOT NULL")).select("project", "model_cost", "position")


def _code_files(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("kind = 'code' AND path IS NOT NULL")
    file = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), canonical_path("path"))
    return docs.select(file.alias("file"), F.col("text").alias("content"), F.coalesce(tx.short_hash("text"), F.lit(index.UNREADABLE)).alias("hash"))


def full_index(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the tables of an index that was built, and then brought up to date after some files changed or went."""
    files = _code_files(s, d)
    built = indexing.index_files(files, iterations=5)
    later = files.where(F.length("file") % 13 != 0).select("file", F.when(F.length("file") % 7 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))
    later = later.withColumn("hash", F.coalesce(tx.short_hash("content"), F.lit(index.UNREADABLE)))
    parts = []
    for name, i in (("built", built), ("updated", indexing.index_files(later, built, 5))):
        for part in ("chunks", "edges", "ranks", "manifest"):
            parts.append(getattr(i, part).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("state"), F.lit(part).alias("part"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ingested(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("kind = 'statute' AND text IS NOT NULL")
    sources = t.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("Statutes").alias("topic"), F.coalesce("source", F.lit("")).alias("prefix"), "text")
    known = sources.where(F.length("text") % 5 == 0).select("source_id", tx.short_hash("text").alias("content_hash"))
    return indexing.ingest_documents(sources, known, r"(?:§|Article|Sec\.|\d+(?:\.\d+)+)\s?")


def ingested_documents(s: SparkSession, d: str) -> DataFrame:
    return _ingested(s, d).select("chunk_id", "source_id", "topic", "citation", "token_count")


def topic_search(s: SparkSession, d: str) -> DataFrame:
    docs = materialize(_ingested(s, d), "ingested")
    return indexing.search_topic(docs, "statutes", docs.orderBy("chunk_id").select("embedding").first()[0]).select("chunk_id", "citation", "score")


def usable_hits(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("row_id", canonical_path("source_file").alias("source_file"), "content")
    return store.usable_hits(c, "row_id").select("row_id", "source_file")


QUERIES = {
    f.__name__: f
    for f in (
        full_index, ingested_documents, topic_search, usable_hits, edge_counters, change_signature, neighbours_dependencies, neighbours_both, callers, pagerank, personalized_pagerank, pagerank_in_memory, pagerank_converged, personalized_pagerank_converged, ghost_edges, delete_referencing, resolved_symbols,
        external_symbols, manifest_diff, upsert_chunks, delete_by_source, dropped_files, registry_update, index_gates, project_coverage, fallback_decision, sweep_plan,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_P = r"regexp_replace(translate({0}, '\', '/'), '^\./', '')"
_CANON = f"c AS (SELECT DISTINCT {_P.format('source_file')} AS sf, source_symbol, {_P.format('target_file')} AS tf, target_symbol, edge_type FROM edges)"
_LINKS = f"{_CANON}, l AS (SELECT DISTINCT sf AS src, tf AS dst FROM c WHERE sf NOT IN ('', '_external_') AND tf NOT IN ('', '_external_'))"
_SEED = f"q AS (SELECT src AS seed FROM l GROUP BY src ORDER BY count(*) DESC, src LIMIT {SEEDS})"


def _hops(step: str, depth: int) -> str:
    out = ["h0 AS (SELECT seed, seed AS file, 0 AS hop FROM q)"]
    for i in range(1, depth + 1):
        out.append(f"h{i} AS (SELECT seed, file, min(hop) AS hop FROM (SELECT * FROM h{i - 1} UNION ALL SELECT seed, t, {i} FROM h{i - 1} JOIN {step} ON f = file) GROUP BY seed, file)")
    return ", ".join(out)


_DEP = "(SELECT src AS f, dst AS t FROM l)"
_CALL = "(SELECT dst AS f, src AS t FROM l)"
_BOTH = "(SELECT src AS f, dst AS t FROM l UNION SELECT dst, src FROM l)"


def _ranks(personal: bool) -> str:
    tele = "CASE WHEN file IN (SELECT seed FROM q) THEN 1.0::DOUBLE / (SELECT count(*) FROM q) ELSE 0 END" if personal else "1.0::DOUBLE / (SELECT count(*) FROM nodes)"
    out = [
        "nodes AS (SELECT src AS file FROM l UNION SELECT dst FROM l)",
        "deg AS (SELECT src AS file, count(*) AS deg FROM l GROUP BY src)",
        f"base AS (SELECT file, deg, {tele} AS tele FROM nodes LEFT JOIN deg USING (file))",
        "r0 AS (SELECT file, tele AS score FROM base)",
    ]
    for i in range(1, ITERATIONS + 1):
        out.append(
            f"i{i} AS (SELECT dst AS file, sum(score / deg) AS x FROM l JOIN r{i - 1} ON file = src JOIN deg USING (file) GROUP BY dst), "
            f"d{i} AS (SELECT coalesce(sum(score), 0) AS d FROM r{i - 1} JOIN base USING (file) WHERE deg IS NULL), "
            f"r{i} AS (SELECT file, 0.85 * (coalesce(x, 0) + d * tele) + 0.15 * tele AS score FROM base LEFT JOIN i{i} USING (file), d{i})"
        )
    return f"WITH {_LINKS}, {_SEED + ', ' if personal else ''}{', '.join(out)} SELECT file, round(score, 8) AS score FROM r{ITERATIONS}"


_PROJECTS = """p AS (SELECT project, n_files, CASE WHEN n_files % 5 = 0 THEN NULL WHEN n_files % 3 = 0 THEN 'model-b' ELSE 'model-a' END AS model_id, n_files % 2 = 0 AS incomplete
  FROM (SELECT scope AS project, count(DISTINCT source_file) AS n_files FROM chunks GROUP BY scope)),
  g AS (SELECT project, CASE WHEN model_id IS NULL THEN 'unknown model' WHEN model_id <> 'model-a' THEN 'other model' WHEN incomplete THEN 'incomplete' ELSE 'ok' END AS reason FROM p)"""
_GONE = f"""alive AS (SELECT {_P.format('file')} AS f FROM manifest WHERE deleted_at IS NULL), gone AS (SELECT {_P.format('file')} AS file FROM manifest WHERE file IS NOT NULL EXCEPT SELECT f FROM alive)"""
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_suffix = lambda c, xs: "(" + " OR ".join(f"ends_with({c}, '{x}')" for x in xs) + ")"


def _std() -> str:
    import sys

    return _in(sorted(sys.stdlib_module_names))


_CODE = "(" + ", ".join(f"'{e}'" for e in scan.CODE_EXTENSIONS) + ")"
SQL = {
    "usable_hits": rf"""SELECT row_id, f AS source_file FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(content, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') ORDER BY row_id) AS i
      FROM (SELECT row_id, content, {_P.format('source_file')} AS f FROM chunks WHERE content IS NOT NULL) WHERE lower(regexp_extract(f, '(\.[^./]+)$', 1)) IN {_CODE} AND regexp_matches(content, '[^\s\x0b]')) WHERE i = 1""",
    "edge_counters": """SELECT count(*) AS n_edges, count(*) FILTER (WHERE target_file NOT IN ('', '_external_')) AS n_resolved,
      count(*) FILTER (WHERE target_file = '_external_') AS n_external, count(*) FILTER (WHERE target_file IS NULL OR target_file = '') AS n_unresolved FROM edges""",
    "change_signature": """SELECT unnest(['whole', 'moved']) AS state, count(*) AS n, max(edge_id) AS max_id, true AS unchanged FROM edges
      UNION ALL SELECT 'fewer', count(*) - 1, max(edge_id), false FROM edges""",
    "neighbours_dependencies": f"WITH {_LINKS}, {_SEED}, {_hops(_DEP, 3)} SELECT seed, file, hop::INT AS hop FROM h3 WHERE hop > 0",
    "neighbours_both": f"WITH {_LINKS}, {_SEED}, {_hops(_BOTH, 2)} SELECT seed, file, hop::INT AS hop FROM h2 WHERE hop > 0",
    "callers": f"""WITH {_LINKS}, q AS (SELECT dst AS seed FROM l GROUP BY dst ORDER BY count(*) DESC, dst LIMIT {SEEDS}), {_hops(_CALL, 2)}
      SELECT seed, count(*) AS n_callers, min(file) AS first FROM h2 WHERE hop > 0 GROUP BY seed""",
    "pagerank": _ranks(False),
    "pagerank_in_memory": _ranks(False),
    "personalized_pagerank": _ranks(True),
    "ghost_edges": f"""WITH cur AS (SELECT {_P.format('file')} AS f FROM manifest WHERE deleted_at IS NULL UNION SELECT {_P.format('file')} FROM shared_files WHERE deleted_at IS NULL)
      SELECT edge_type, count(*) AS kept FROM edges WHERE {_P.format('source_file')} IN (SELECT f FROM cur)
        AND (target_file IS NULL OR target_file IN ('', '_external_') OR {_P.format('target_file')} IN (SELECT f FROM cur)) GROUP BY edge_type""",
    "delete_referencing": f"""WITH {_CANON}, {_GONE} SELECT edge_type, count(*) AS kept FROM c
      WHERE NOT EXISTS (SELECT 1 FROM gone WHERE file = sf) AND NOT EXISTS (SELECT 1 FROM gone WHERE file = tf) GROUP BY edge_type""",
    "external_symbols": f"""WITH e AS (SELECT DISTINCT {_P.format('source_file')} AS f, target_symbol AS y, edge_type FROM edges WHERE source_file IS NOT NULL),
      parts AS (SELECT string_split({_P.format('file')}, '/') AS p FROM (SELECT file FROM manifest UNION SELECT file FROM shared_files) WHERE file IS NOT NULL),
      segments AS (SELECT DISTINCT unnest(p) AS g FROM parts), dotted AS (SELECT DISTINCT unnest(string_split(g, '.')) AS g FROM (SELECT unnest(p[1:len(p) - 1]) AS g FROM parts) WHERE contains(g, '.')),
      own AS (SELECT g FROM segments WHERE g <> ''), wide AS (SELECT g FROM own UNION SELECT g FROM dotted WHERE g <> ''),
      r AS (SELECT f, y, edge_type, coalesce(CASE WHEN y IS NULL OR y = '' OR starts_with(y, '.') THEN false
        WHEN {_suffix('f', graph._JS_SOURCES)} THEN NOT starts_with(y, '@/')
        WHEN ends_with(f, '.py') THEN (NOT contains(y, '/') AND NOT contains(y, '.')) OR split_part(y, '.', 1) IN {_std()}
        WHEN {_suffix('f', ('.cs', '.cshtml'))} THEN split_part(y, '.', 1) IN {_in(graph.CSHARP_EXTERNAL)}
        WHEN ends_with(f, '.java') THEN split_part(y, '.', 1) IN {_in(graph.JAVA_EXTERNAL)} OR array_to_string(string_split(y, '.')[1:2], '.') IN {_in(graph.JAVA_EXTERNAL)}
        WHEN ends_with(f, '.go') THEN true END, false) AS listed FROM e)
      SELECT listed OR coalesce(CASE WHEN ends_with(f, '.py') THEN split_part(trim(split_part(y, ' as ', 1)), '.', 1) NOT IN (SELECT g FROM own UNION ALL SELECT '')
          WHEN edge_type = 'imports' AND {_suffix('f', ('.cs', '.cshtml'))} THEN split_part(y, '.', 1) NOT IN (SELECT g FROM wide UNION ALL SELECT '') END, false) AS external,
        edge_type, count(*) AS n FROM r GROUP BY ALL""",
    "manifest_diff": """WITH m AS (SELECT file, min(file_hash) AS h FROM manifest GROUP BY file),
      s AS (SELECT file, CASE WHEN length(file) % 7 = 0 THEN reverse(h) ELSE h END AS h FROM m WHERE length(file) % 13 <> 0),
      o AS (SELECT file, h FROM m WHERE length(file) % 11 <> 0)
      SELECT coalesce(s.file, o.file) AS file, CASE WHEN o.h IS NULL THEN 'new' WHEN s.h IS NULL THEN 'deleted' WHEN s.h <> o.h THEN 'changed' ELSE 'unchanged' END AS state
      FROM s FULL JOIN o ON s.file = o.file""",
    "upsert_chunks": """SELECT chunk_id, row_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, row_id DESC) AS i FROM chunks) WHERE i = 1""",
    "delete_by_source": f"WITH {_GONE} SELECT scope, count(*) AS n FROM chunks WHERE source_file IS NULL OR {_P.format('source_file')} NOT IN (SELECT file FROM gone) GROUP BY scope",
    "dropped_files": f"""WITH {_GONE} SELECT 'chunks' AS part, count(*) AS n FROM chunks WHERE coalesce({_P.format('source_file')}, '') NOT IN (SELECT file FROM gone)
      UNION ALL SELECT 'edges', count(*) FROM edges WHERE coalesce({_P.format('source_file')}, '') NOT IN (SELECT file FROM gone) AND coalesce({_P.format('target_file')}, '') NOT IN (SELECT file FROM gone)
      UNION ALL SELECT 'manifest', count(*) FROM manifest WHERE coalesce({_P.format('file')}, '') NOT IN (SELECT file FROM gone)""",
    "registry_update": """WITH n AS (SELECT scope AS project, count(*) AS n_chunks FROM chunks GROUP BY scope),
      o AS (SELECT regexp_extract(file, '^([^/]*)', 1) AS project, count(DISTINCT file) AS n_files FROM manifest GROUP BY ALL)
      SELECT coalesce(n.project, o.project) AS project, n_files, coalesce(n_chunks, CASE WHEN o.project IS NOT NULL THEN 0 END)::BIGINT AS n_chunks FROM n FULL JOIN o ON n.project = o.project""",
    "index_gates": f"WITH {_PROJECTS} SELECT project, reason, reason IN ('ok', 'incomplete') AS served FROM g",
    "project_coverage": f"WITH {_PROJECTS} SELECT project FROM g WHERE reason = 'ok'",
    "fallback_decision": f"""WITH {_PROJECTS}, r AS (SELECT count(*) AS n_results, round(max(value / 1000), 6) AS top_score FROM events), n AS (SELECT count(*) AS n_complete FROM g WHERE reason = 'ok')
      SELECT n_results, top_score, n_complete, (n_results = 0 OR top_score < 0.4) AND n_complete > 0 AS fall_back FROM r, n""",
    "sweep_plan": f"""WITH {_PROJECTS}, c AS (SELECT project, model_id, n_files, (sum(n_files) OVER (PARTITION BY model_id))::BIGINT AS model_cost FROM p WHERE model_id IS NOT NULL)
      SELECT project, model_cost, row_number() OVER (ORDER BY model_cost, model_id, n_files, project) AS position FROM c""",
}
