"""Queries on sources, logs, stored tables and small text functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import metadata
from corvane.functions import text as tx
from corvane.functions.paths import canonical_path
from corvane.operators import chunking, graph, index, prose, ranking, store, vectors
from corvane.plans import graph_queries, indexing, retrieval_queries, search
from corvane.session import materialize, shared_dir, table
from corvane.sources import logs, markup, scan
from corvane.streaming import index_stream, runs

EVENT = "event_id bigint, user_id bigint, event_type string, value double"
HEADING = r"(?:Sec\. |Article |#{1,3} |\d+\. )"
NOW = "2026-01-01 00:00:00"
PRUNED, CRAWLED = 5, 60


def _folder(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"


def _logged(s: SparkSession, d: str) -> str:
    """A log of the events, with lines that are no JSON in it."""
    folder = _folder(s, "log")
    events = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    logs.append_jsonl(events.where("event_id % 2 = 0"), folder)
    logs.append_jsonl(events.where("event_id % 2 = 1"), folder)
    s.createDataFrame([('{"event_id": 1, "user',), ("no json",)], "value string").write.mode("append").text(folder)
    return folder


def _by_type(events: DataFrame) -> DataFrame:
    return events.where("event_id IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def logged_events(s: SparkSession, d: str) -> DataFrame:
    """Events that were appended to a log of JSON lines and read again."""
    return _by_type(logs.read_jsonl(s, _logged(s, d), EVENT))


def tailed_events(s: SparkSession, d: str) -> DataFrame:
    """The same log followed as a stream."""
    lines = index_stream.tail_logs(s, _logged(s, d), EVENT)
    return index_stream.run_available(_by_type(lines), f"tail_{uuid.uuid4().hex}", _folder(s, "tail"))


def binary_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents by whether their bytes look binary; every seventh is given a zero byte at its end."""
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", scan.looks_binary(F.encode(t, "UTF-8")).alias("binary"))


def scanned_files(s: SparkSession, d: str) -> DataFrame:
    """What a scan of the code documents keeps; every fifth isn't valid text and is kept without content."""
    docs = table(s, d, "documents").where("kind = 'code' AND path IS NOT NULL AND text IS NOT NULL")
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.to_binary(F.lit("FF"), F.lit("hex")))
    files = docs.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), canonical_path("path")).alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.when(F.col("doc_id") % 5 == 0, broken).otherwise(raw).alias("content")
    )
    return scan.scan(files).select("path", F.length("content").cast("bigint").alias("n_chars"), (F.col("hash") == index.UNREADABLE).alias("unreadable"))


def registered_projects(s: SparkSession, d: str) -> DataFrame:
    """A registry written as one JSON object and read as rows."""
    p = table(s, d, "chunks").groupBy("scope").agg(F.countDistinct("source_file").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"))
    entry = F.struct(F.concat(F.lit("/code/"), F.col("scope")).alias("path"), "n_files", "n_chunks", F.lit("model-a").alias("model_id"), (F.col("n_files") % 2 == 0).alias("incomplete"))
    # a registry has one entry for each project
    whole = p.where("scope IS NOT NULL").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("scope", entry)))).alias("value"))
    folder = _folder(s, "registry")
    whole.coalesce(1).write.text(folder)
    return logs.read_registry(s, folder).select("project", "path", "n_files", "n_chunks", "incomplete")


def regulation_sections(s: SparkSession, d: str) -> DataFrame:
    """Numbers of the sections, and lines of the prose, of XML made of the document chunks."""
    body = F.translate(F.coalesce("content", F.lit("")), "<>&", "   ")
    number = F.col("doc_chunk_id").cast("string")
    part = lambda n: F.concat(F.lit('<DIV8 N="'), n, F.lit('" TYPE="SECTION"><HEAD>Sec. '), n, F.lit("</HEAD><P>"), body, F.lit("</P><CITA>[62 FR 1]</CITA></DIV8>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><DIV5 N="1" TYPE="PART">'), part(number), part(F.concat(number, F.lit(".1"))), F.lit("</DIV5>"))
    c = table(s, d, "doc_chunks").select("doc_chunk_id", xml.alias("xml"))
    prose = markup.regulation_to_text("xml")
    return c.select("doc_chunk_id", F.array_join(markup.section_numbers("xml"), ",").alias("numbers"), F.size(F.filter(F.split(prose, "\n"), lambda x: F.startswith(x, F.lit("Sec. ")))).cast("bigint").alias("heads"), F.contains(prose, F.lit("62 FR 1")).alias("cited"))


def crawled_files(s: SparkSession, d: str) -> DataFrame:
    """The links of files as a site: pages by depth from the file with the most links, within a budget."""
    links = graph_queries._links(s, d)
    start = graph_queries._seeds(links).orderBy("seed").limit(1)
    return markup.crawl(links.select(F.col("src").alias("url"), F.col("dst").alias("link")), start.select(F.col("seed").alias("url")), 2, CRAWLED).select(F.col("url").alias("file"), "depth")


def pruned_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Two hops either way, each going on from the files with the most links only."""
    links = graph_queries._links(s, d)
    degree = links.groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return graph.neighbours(links, graph_queries._seeds(links), 2, "both", PRUNED, degree)


def graph_state(s: SparkSession, d: str) -> DataFrame:
    links = graph_queries._links(s, d)
    near = graph.neighbours(links, graph_queries._seeds(links), 1, "both")
    callers = links.select(F.col("src").alias("file"), F.col("dst").alias("seed"), F.lit(True).alias("is_caller"))
    return store.graph_status(links, near.join(callers, ["file", "seed"], "left"))


def graph_tables(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the graph tables that searches read, and the sum of the stored ranks."""
    g = retrieval_queries._graph(s, d)
    part = lambda df, name, value: df.agg(F.count(F.lit(1)).alias("n"), value.alias("total")).select(F.lit(name).alias("part"), "n", "total")
    none = F.lit(None).cast("double")
    return part(g.links, "links", none).unionByName(part(g.kinds, "relations", none)).unionByName(part(g.ranks, "ranks", F.round(F.sum("score"), 6)))


def fused_before_single(s: SparkSession, d: str) -> DataFrame:
    """Places in the order of results of several sources, of which a third have no fused score; one list for each user."""
    e = table(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 1000, 6)).alias("rrf_score"), F.col("value").alias("score"))
    w = Window.partitionBy("user_id").orderBy(*ranking.final_order(), "event_id")
    return e.withColumn("place", F.row_number().over(w).cast("bigint")).select("event_id", "place")


def source_search(s: SparkSession, d: str) -> DataFrame:
    """A search over all projects, an unknown source and a missing project, each project with the model of its index."""
    projects = materialize(graph_queries._projects(s, d), "projects")
    c = table(s, d, "chunks")
    q = retrieval_queries._chunk_query(c)
    names = [f"project:{r.project}" for r in projects.where("project IS NOT NULL").select("project").orderBy("project").collect()]  # one for each project
    found, _ = search.search_sources([*names, "project:none", "web:x"], search.Sources(c, projects), retrieval_queries.WORDS, lambda model: lambda text: q, "model-a")
    return found.select("source", "chunk_id", "score")


def updated_documents(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the document table before and after a third of the statutes changed."""
    t = table(s, d, "documents").where("kind = 'statute' AND text IS NOT NULL")
    sources = t.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("Statutes").alias("topic"), F.coalesce("source", F.lit("")).alias("prefix"), "text")
    none = s.createDataFrame([], "source_id string, content_hash string")
    old = materialize(indexing.ingest_documents(sources, none, HEADING), "documents")
    later = sources.withColumn("text", F.when(F.col("source_id").cast("bigint") % 3 == 0, F.concat("text", F.lit("\nArticle 99 Added later on, at the very end of it."))).otherwise(F.col("text")))
    new = indexing.update_documents(old, later, HEADING)
    count = lambda df, state: df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("content_hash").alias("n_versions")).select(F.lit(state).alias("state"), "*")
    return count(old, "before").unionByName(count(new, "after"))


def sweep_actions(s: SparkSession, d: str) -> DataFrame:
    states = index.diff(graph_queries._scan(s, d), table(s, d, "manifest").groupBy("file").agg(F.min("file_hash").alias("hash")))
    changes = states.withColumn("project", F.regexp_extract(canonical_path("file"), "^([^/]*)", 1))
    return index.sweep_actions(changes, graph_queries._projects(s, d).where("project IS NOT NULL"), 5)


def heading_checks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", chunking.heading_matches("text", HEADING).alias("matches"))


def covered(s: SparkSession, d: str) -> DataFrame:
    """Files that a plan says it covers, out of texts made of the manifest."""
    t = F.concat(F.lit("# Plan\n- COVERS: \""), F.col("file"), F.lit("\", [`"), F.col("file_hash"), F.lit("`], ,\nCovers: other.py"))
    return table(s, d, "manifest").where("file IS NOT NULL AND file_hash IS NOT NULL").select("file", F.array_join(tx.covered_files(t), "|").alias("covers")).distinct()


def ages(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").where("file IS NOT NULL").select("file", F.col("first_seen_at").cast("timestamp").alias("t"))
    steps = F.explode(F.array(F.lit(30), F.lit(300), F.lit(9000), F.lit(400_000))).alias("seconds")
    at = m.select("file", "t", steps).select("file", "seconds", tx.relative_age("t", F.timestamp_add("SECOND", F.col("seconds"), F.col("t"))).alias("age"), tx.ellipsis("file", 12).alias("short"))
    return at.distinct()


def instants(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    return e.select("event_id", F.unix_timestamp(tx.parse_instant(F.concat("t", zone))).alias("seconds"))


def search_log(s: SparkSession, d: str) -> DataFrame:
    results = table(s, d, "events").select((F.col("value") / 1000).alias("score"))
    return indexing.search_log_row(results, "s-1", "open rows", "vector").select("search_id", "mode", "query_hash", "results_count", F.round("top_score", 6).alias("top_score"))


def project_names(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "chunks").where("scope IS NOT NULL").select("scope").distinct()
    return p.select("scope", tx.project_slug(F.concat(F.lit("/home/src/"), F.col("scope"))).alias("plain"), F.regexp_extract(tx.project_slug(F.concat(F.lit("C:\\Team A\\"), F.col("scope"), F.lit("/"))), "^(.*)-[0-9a-f]{8}$", 1).alias("parented"))


def collection_rows(s: SparkSession, d: str) -> DataFrame:
    """Chunks written as collections, one of them replaced afterwards and all compacted."""
    c = table(s, d, "chunks").where("scope IS NOT NULL").select("row_id", "scope", F.when(F.size("embedding") == 64, F.col("embedding")).alias("embedding"))
    a, b = _folder(s, "collections"), _folder(s, "compacted")
    store.write_collection(c, a, "scope", 64)
    first = c.agg(F.min("scope").alias("first")).first().first  # one row
    if first is not None:
        store.write_collection(c.where(F.col("scope") == first).where("row_id % 2 = 0"), a, "scope", 64)
    compacted = store.compact_if_needed(s, a, b, "scope", 1)
    return s.read.parquet(b if compacted else a).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def frame_findings(s: SparkSession, d: str) -> DataFrame:
    return prose.frame_findings(table(s, d, "documents"), "doc_id", "text")


def participle_runs(s: SparkSession, d: str) -> DataFrame:
    return prose.participle_runs(table(s, d, "documents"), "doc_id", "text")


def plain_comments(s: SparkSession, d: str) -> DataFrame:
    """Words that have plainer ones, planted into the sections of the raw chunks."""
    t = F.concat(F.lit("Utilizes a robust "), F.coalesce("section", F.lit("")), F.lit(" to leverage it, robustly"))
    return table(s, d, "raw_chunks").select("raw_id", prose.plain_words(t).alias("comment"))


def title_case(s: SparkSession, d: str) -> DataFrame:
    """Headings in title case, planted for every third document."""
    t = F.concat(F.lit("# The Main Title Of It\n"), F.when(F.col("doc_id") % 3 == 0, "## Some Of The Big Words\n### API and the rest of it\n").otherwise("## Some of the big words\n"))
    return table(s, d, "documents").select("doc_id", prose.title_case_headings(t).cast("bigint").alias("n"))


def metadata_texts(s: SparkSession, d: str) -> DataFrame:
    """The typed metadata of chunks after a round trip over JSON text."""
    fields = "source_file string, scope string, section string, tree_path string, line_start int, line_end int, chunk_index int, token_count int"
    names = [f.split()[0] for f in fields.split(", ")]
    return table(s, d, "chunks").select("row_id", metadata.from_text(metadata.to_text(*names), fields).alias("m")).select("row_id", "m.*")


def packed_vectors(s: SparkSession, d: str) -> DataFrame:
    """Chunks by the width of their packed vectors, and how many are the same when unpacked."""
    p = table(s, d, "chunks").select("embedding", vectors.pack_vector("embedding").alias("p"))
    same = F.count_if(F.coalesce(F.hex(vectors.pack_vector(vectors.unpack_vector("p"))) == F.hex("p"), F.lit(False)))
    return p.groupBy(vectors.packed_dimension("p").cast("bigint").alias("width")).agg(F.count(F.lit(1)).alias("n"), same.alias("same"))


def session_states(s: SparkSession, d: str) -> DataFrame:
    """Sessions of users whose sign-ups start, purchases resume and errors end them."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "resume").when(F.col("event_type") == "error", "end").otherwise(F.col("event_type"))
    e = table(s, d, "events").select("user_id", kind.alias("kind"), F.col("event_id").alias("at"))
    return runs.session_records(e, "user_id", "kind", "at")


def task_changes(s: SparkSession, d: str) -> DataFrame:
    """Files of the manifest as tasks, before and after a while."""
    m = table(s, d, "manifest").where("file IS NOT NULL").groupBy(F.col("file").alias("id")).agg(F.max("first_seen_at").alias("modified_at"))
    n = F.length("id")
    later = m.where(n % 5 != 0).withColumn("modified_at", F.when(n % 3 == 0, F.timestamp_add("DAY", F.lit(1), F.col("modified_at"))).otherwise(F.col("modified_at")))
    return runs.task_changes(m.where(n % 7 != 0), later)


QUERIES = {
    f.__name__: f
    for f in (
        frame_findings, participle_runs, plain_comments, title_case, metadata_texts, packed_vectors, session_states, task_changes,
        logged_events, tailed_events, binary_documents, scanned_files, registered_projects, regulation_sections, crawled_files, pruned_neighbours, graph_state, graph_tables, fused_before_single,
        source_search, updated_documents, sweep_actions, heading_checks, covered, ages, instants, search_log, project_names, collection_rows,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_g = graph_queries
_EVENTS = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"
_BOTH = "b AS (SELECT src AS f, dst AS t FROM l UNION SELECT dst, src FROM l)"
SQL = {
    "logged_events": _EVENTS,
    "plain_comments": """SELECT raw_id, 'Uses a solid ' || coalesce(section, '') || ' to use it, robustly' AS comment FROM raw_chunks""",
    "title_case": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents",
    "metadata_texts": "SELECT row_id, source_file, scope, section, tree_path, line_start, line_end, chunk_index, token_count FROM chunks",
    "packed_vectors": "SELECT len(embedding) AS width, count(*) AS n, count(embedding) AS same FROM chunks GROUP BY ALL",
    "session_states": """WITH g AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS started_at, count(*) FILTER (event_type = 'purchase') + greatest(count(*) FILTER (event_type = 'signup') - 1, 0) AS resumes,
        max(event_id) FILTER (event_type IN ('signup', 'purchase')) AS b, max(event_id) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type NOT IN ('signup', 'purchase', 'error')) AS n_events
        FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
      SELECT user_id, started_at, resumes, CASE WHEN b IS NULL OR e >= b THEN e END AS ended_at, n_events FROM g""",
    "task_changes": """WITH m AS (SELECT DISTINCT file AS id, length(file) AS n FROM manifest WHERE file IS NOT NULL)
      SELECT id, CASE WHEN n % 7 = 0 THEN 'added' WHEN n % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM m
      WHERE (n % 7 = 0 AND n % 5 <> 0) OR (n % 7 <> 0 AND (n % 5 = 0 OR n % 3 = 0))""",
    "tailed_events": _EVENTS,
    "binary_documents": "SELECT doc_id, regexp_matches(left(hex(encode(CASE WHEN doc_id % 7 = 0 THEN text || chr(0) ELSE text END)), 16384), '^(?:..)*?00') AS binary FROM documents WHERE text IS NOT NULL",
    "registered_projects": """SELECT scope AS project, '/code/' || scope AS path, count(DISTINCT source_file) AS n_files, count(*) AS n_chunks, count(DISTINCT source_file) % 2 = 0 AS incomplete
      FROM chunks WHERE scope IS NOT NULL GROUP BY scope""",
    "regulation_sections": r"""SELECT doc_chunk_id, doc_chunk_id || ',' || doc_chunk_id || '.1' AS numbers,
      2 + 2 * (len(list_filter(string_split(translate(coalesce(content, ''), '<>&', '   '), chr(10)), lambda x: starts_with(trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' '), 'Sec. ')))) AS heads, false AS cited FROM doc_chunks""",
    "crawled_files": f"""WITH {_g._LINKS}, {_g._SEED}, s AS (SELECT min(seed) AS file FROM q),
      d1 AS (SELECT DISTINCT dst AS file FROM l, s WHERE src = s.file AND dst <> s.file ORDER BY dst LIMIT {CRAWLED - 1}),
      d2 AS (SELECT DISTINCT dst AS file FROM l WHERE src IN (SELECT file FROM d1) AND dst NOT IN (SELECT file FROM d1 UNION SELECT file FROM s) ORDER BY dst LIMIT (SELECT {CRAWLED - 1} - count(*) FROM d1))
      SELECT file, 0 AS depth FROM s UNION ALL SELECT file, 1 FROM d1 UNION ALL SELECT file, 2 FROM d2""",
    "pruned_neighbours": f"""WITH {_g._LINKS}, {_g._SEED}, {_BOTH}, deg AS (SELECT dst AS file, count(*) AS n FROM l GROUP BY dst),
      h1 AS (SELECT seed, t AS file FROM (SELECT DISTINCT seed, t FROM q JOIN b ON f = seed WHERE t <> seed) LEFT JOIN deg ON file = t QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coalesce(n, 0) DESC, t) <= {PRUNED}),
      h2 AS (SELECT seed, t AS file FROM (SELECT DISTINCT seed, t FROM h1 JOIN b ON f = h1.file WHERE t <> seed AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.seed = h1.seed AND o.file = t)) LEFT JOIN deg ON file = t
        QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coalesce(n, 0) DESC, t) <= {PRUNED})
      SELECT seed, file, 1 AS hop FROM h1 UNION ALL SELECT seed, file, 2 FROM h2""",
    "graph_state": f"""WITH {_g._LINKS}, {_g._SEED}, {_BOTH}, n AS (SELECT DISTINCT seed, t FROM q JOIN b ON f = seed WHERE t <> seed)
      SELECT CASE WHEN (SELECT count(*) FROM l) = 0 THEN 'absent' WHEN count(*) = 0 THEN 'empty' ELSE 'hit' END AS status, count(*) AS hits, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE src = t AND dst = seed)) AS callers FROM n""",
    "graph_tables": f"""WITH {_g._LINKS} SELECT 'links' AS part, count(*) AS n, NULL::DOUBLE AS total FROM l UNION ALL SELECT 'relations', count(*), NULL FROM l
      UNION ALL SELECT 'ranks', count(*), CASE WHEN count(*) > 0 THEN 1.0 END FROM (SELECT src FROM l UNION SELECT dst FROM l)""",
    "fused_before_single": """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY r IS NULL, r DESC, value DESC, event_id) AS place
      FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN round(value / 1000, 6) END AS r FROM events)""",
    "sweep_actions": f"""WITH {_g._PROJECTS}, m AS (SELECT file, min(file_hash) AS h FROM manifest GROUP BY file),
      c AS (SELECT split_part({_g._P.format('file')}, '/', 1) AS project, count(*) AS n FROM m
        WHERE length(file) % 13 = 0 OR (length(file) % 7 = 0 AND reverse(h) <> h) GROUP BY 1)
      SELECT project, coalesce(n, 0) AS n_changed, CASE WHEN n >= 5 AND incomplete THEN 'resume' WHEN n >= 5 THEN 'full' WHEN n > 0 THEN 'files' ELSE 'none' END AS action FROM p LEFT JOIN c USING (project) WHERE project IS NOT NULL""",
    "heading_checks": rf"SELECT doc_id, regexp_matches(text, '(?m)^{HEADING}') AS matches FROM documents WHERE text IS NOT NULL",
    "covered": "SELECT DISTINCT file, file || '|' || file_hash AS covers FROM manifest WHERE file IS NOT NULL AND file_hash IS NOT NULL",
    "ages": """SELECT DISTINCT file, s AS seconds, a AS age, CASE WHEN length(file) > 12 THEN left(file, 11) || '…' ELSE file END AS short
      FROM manifest, (VALUES (30, 'just now'), (300, '5m ago'), (9000, '2h ago'), (400000, '4d ago')) v(s, a) WHERE file IS NOT NULL""",
    "instants": "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END AS seconds FROM events",
    "search_log": "SELECT 's-1' AS search_id, 'vector' AS mode, 'sha256:' || sha256('open rows') AS query_hash, count(*) AS results_count, round(max(value / 1000), 6) AS top_score FROM events",
    "collection_rows": "SELECT scope, count(*) AS n FROM chunks WHERE scope IS NOT NULL AND (scope <> (SELECT min(scope) FROM chunks) OR row_id % 2 = 0) GROUP BY scope",
    "source_search": f"""WITH {_g._PROJECTS}, {retrieval_queries._USABLE}, q AS (SELECT embedding FROM u WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 ORDER BY chunk_id LIMIT 1)
      SELECT 'project:' || scope AS source, chunk_id, round(s, 4) AS score FROM (
        SELECT chunk_id, scope, {retrieval_queries._SCORE.format('u.embedding', 'q.embedding')} AS s FROM u, q
        WHERE scope IN (SELECT project FROM p WHERE model_id IS NOT NULL) AND list_sum(list_transform(u.embedding, lambda x: x::DOUBLE * x)) > 0 AND NOT list_has_any(list_transform(u.embedding, lambda x: isfinite(x)), [false]))
      WHERE s >= 0.5 ORDER BY score DESC, source, chunk_id LIMIT 10""",
}
