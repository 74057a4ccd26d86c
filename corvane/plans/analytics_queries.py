"""Queries of logs, findings and audits, relational breadth and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path
from corvane.operators import analytics as an
from corvane.session import shared_dir, table
from corvane.streaming import index_stream

_events = lambda s, d: table(s, d, "events")


def language_vote(s: SparkSession, d: str) -> DataFrame:
    return an.language_vote(table(s, d, "documents").where("source IS NOT NULL"), ["source"])


def event_stats(s: SparkSession, d: str) -> DataFrame:
    return an.event_stats(_events(s, d), "event_type", "value")


def top_users(s: SparkSession, d: str) -> DataFrame:
    return an.top_values(_events(s, d), "user_id")


def pass_rate(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "view", "exempt").otherwise("pass")
    return an.pass_rate(_events(s, d), kind)


def events_in_window(s: SparkSession, d: str) -> DataFrame:
    return an.in_window(_events(s, d), "ts", "2024-01-05 00:00:00", "2024-01-12 12:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def last_events(s: SparkSession, d: str) -> DataFrame:
    return an.tail(_events(s, d).select("event_id", "ts", "event_type"), 25, "ts", "event_id")


def severity_summary(s: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "A", "critical").when(F.col("l_returnflag") == "N", "HIGH").when(F.col("l_quantity") > 25, "medium").when(F.col("l_quantity") > 5, "low").otherwise("info")
    return an.severity_summary(table(s, d, "lineitem").withColumn("severity", severity), ["l_linestatus"])


def mutation_scores(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "killed").when(F.col("o_orderstatus") == "O", "survived").when(F.col("o_orderpriority") == "1-URGENT", None).otherwise("timeout")
    return an.mutation_score(table(s, d, "orders").withColumn("status", status), ["o_orderpriority"])


def language_difference(s: SparkSession, d: str) -> DataFrame:
    return an.multiset_difference(table(s, d, "manifest").select("lang"), table(s, d, "documents").select("lang"), ["lang"])


def fact_tokens(s: SparkSession, d: str) -> DataFrame:
    return an.fact_tokens(table(s, d, "documents"), "doc_id", "text").groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))


def freshness(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    started = e.groupBy("user_id").agg(F.min("ts").alias("started_at"))
    return an.freshness(started, e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at")), "user_id", "2024-01-30 00:00:00", 86_400)


def changed_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return an.hunk_counts(docs.select(F.col("kind").alias("file"), F.regexp_replace("text", "(?m)^- ", "+").alias("code")))


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return an.sessions(_events(s, d), "user_id", "ts", "30 minutes").select("user_id", "start", "n_events")


def _chain(s: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(":", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"))
    return an.build_chain(_events(s, d), "user_id", ["ts", "event_id"], body)


def chain_heads(s: SparkSession, d: str) -> DataFrame:
    return _chain(s, d).groupBy("user_id").agg(F.max("line").alias("n"), F.count_if(F.col("line") == 1).alias("roots"))


def chain_faults(s: SparkSession, d: str) -> DataFrame:
    """Faults of a chain in which the bodies of some entries were altered afterwards."""
    altered = _chain(s, d).withColumn("body", F.when(F.split("body", ":").getItem(0).cast("bigint") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return an.verify_chain(altered, "user_id")


def event_runs(s: SparkSession, d: str) -> DataFrame:
    return an.runs(_events(s, d), "user_id", ["ts", "event_id"], "event_type", 3)


def hazard_lines(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "chunks").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.select(F.explode(an.hazard_categories("line")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def hazard_evidence(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "chunks").select("row_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return an.hazard_evidence(lines, "row_id", ["row_id", "at"], "line")


def hazard_paths(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").select(F.explode(an.path_hazards("file")).alias("category"))
    return m.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def files_in_scope(s: SparkSession, d: str) -> DataFrame:
    patterns = s.createDataFrame([("lib/**",), ("*_gen.py",), ("src/*.ts",)], "pattern string")
    files = table(s, d, "manifest").select(canonical_path("file").alias("file")).distinct()
    return an.in_scope(files, patterns)


# --- relational breadth ---------------------------------------------------------------------------


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


def revenue_by_region(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def customers_without_orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def order_rollup(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r


def order_cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def top_parts_per_brand(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(s, d, "part").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("p_brand", "p_partkey", "rank")


def running_totals(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(s, d).select("event_id", F.round(F.sum("value").over(w), 4).alias("running"))


def last_click_before(s: SparkSession, d: str) -> DataFrame:
    """As-of join: the last click of the same user before each purchase, by one window over both."""
    e = _events(s, d).where("event_type IN ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w)).where("event_type = 'purchase'").select("event_id", "click_id")


def status_pivot(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def shared_languages(s: SparkSession, d: str) -> DataFrame:
    m, c = table(s, d, "manifest").select("lang"), table(s, d, "documents").select("lang")
    both = m.intersect(c).withColumn("side", F.lit("both"))
    return both.unionByName(m.exceptAll(c).distinct().withColumn("side", F.lit("more in manifest")))


# --- streams --------------------------------------------------------------------------------------


def daily_counts(s: SparkSession, d: str) -> DataFrame:
    return index_stream.windowed_counts(_events(s, d), "ts", "event_type", "value").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def _scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def streamed_daily_counts(s: SparkSession, d: str) -> DataFrame:
    """The same over a stream of the table's file, run until it is exhausted."""
    batch = _events(s, d)
    stream = s.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = index_stream.windowed_counts(stream, "ts", "event_type", "value")
    name = f"daily_{uuid.uuid4().hex}"
    return index_stream.run_available(counted, name, _scratch(s)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def streamed_sessions(s: SparkSession, d: str) -> DataFrame:
    stream = s.readStream.schema(_events(s, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = index_stream.session_counts(stream, "user_id", "ts")
    return index_stream.run_available(counted, f"sessions_{uuid.uuid4().hex}", _scratch(s)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_events")


def streamed_index(s: SparkSession, d: str) -> DataFrame:
    """Chunks per file of an index that was kept by a stream of its files."""
    base = _scratch(s)
    docs = table(s, d, "documents").where("text IS NOT NULL").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"), F.lit(1).cast("bigint").alias("version"))
    docs.write.parquet(f"{base}/files")
    index_stream.index_stream(s, f"{base}/files", f"{base}/index", f"{base}/state").awaitTermination()
    return index_stream.current_chunks(s, f"{base}/index").groupBy("file").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        language_vote, event_stats, top_users, pass_rate, events_in_window, last_events, severity_summary, mutation_scores, language_difference, fact_tokens, freshness,
        changed_lines, user_sessions, chain_heads, chain_faults, event_runs, hazard_lines, hazard_evidence, hazard_paths, files_in_scope, pricing_summary,
        revenue_by_region, customers_without_orders, order_rollup, order_cube, top_parts_per_brand, running_totals, last_click_before, status_pivot, shared_languages,
        daily_counts, streamed_daily_counts, streamed_sessions, streamed_index,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_quote = lambda w: w.replace("'", "''")
_has = lambda text, words: "(" + " OR ".join(f"contains({text}, '{_quote(w)}')" for w in words) + ")"
_COMMENT = r"""regexp_matches(line, '^\s*(?:#|//|\*|\"\"\"|''''''|/\*)')"""
_HAZ = "list_filter([" + ", ".join(
    f"CASE WHEN {_has('lower(line)', words)}{'' if c == 'test-weakening' else f' AND NOT {_COMMENT}'} THEN '{c}' END" for c, words in an.HAZARD_WORDS.items()
) + "], lambda x: x IS NOT NULL)"
_DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n_events FROM n GROUP BY user_id, k"""
_SECONDARY = "(" + ", ".join(f"'{x}'" for x in an.SECONDARY_LANGUAGES) + ")"
# without look-around: the character before a token is matched too, and the token is the group
_BEFORE = r"(?:^|[^\pL\pM\pN_])"
_PLAIN_KINDS = {k: f"({p})" for k, p in an.TOKEN_KINDS.items()} | {"numbers": _BEFORE + r"(\d[\d,]*(?:\.\d+)?%?)", "tickets": _BEFORE + r"([A-Z]{2,6}-\d{2,6})\b"}
_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(body, '{p}', 1)) AS token FROM b" for k, p in _PLAIN_KINDS.items())

SQL = {
    "language_vote": f"""WITH c AS (SELECT source, lower(lang) AS lang, CASE WHEN lang IS NULL OR lower(lang) = 'unknown' THEN 0 WHEN lower(lang) IN {_SECONDARY} THEN 1 ELSE 2 END AS tier, count(*) AS n
      FROM documents WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier DESC, n DESC, lang NULLS FIRST) AS i FROM c)
      SELECT source, CASE WHEN tier > 0 THEN lang END AS dominant, CASE WHEN tier > 0 THEN n END AS n_files FROM r WHERE i = 1""",
    "event_stats": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
      round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type""",
    "top_users": "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "pass_rate": """WITH k AS (SELECT CASE event_type WHEN 'error' THEN 'block' WHEN 'view' THEN 'exempt' ELSE 'pass' END AS k FROM events),
      c AS (SELECT count(*) FILTER (WHERE k = 'pass') AS passes, count(*) FILTER (WHERE k = 'block') AS blocks, count(*) FILTER (WHERE k = 'exempt') AS exempts FROM k)
      SELECT *, round(100 * passes / (passes + blocks), 4) AS pass_rate FROM c""",
    "events_in_window": "SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-12 12:00:00' GROUP BY event_type",
    "last_events": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "severity_summary": """WITH s AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'A' THEN 'critical' WHEN l_returnflag = 'N' THEN 'high' WHEN l_quantity > 25 THEN 'medium' WHEN l_quantity > 5 THEN 'low' ELSE 'info' END AS v FROM lineitem)
      SELECT l_linestatus, count(*) FILTER (WHERE v = 'critical') AS critical, count(*) FILTER (WHERE v = 'high') AS high, count(*) FILTER (WHERE v = 'medium') AS medium, count(*) FILTER (WHERE v = 'low') AS low FROM s GROUP BY ALL""",
    "mutation_scores": """WITH s AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'killed' WHEN o_orderstatus = 'O' THEN 'survived' WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'timeout' END AS v FROM orders),
      c AS (SELECT o_orderpriority, count(*) FILTER (WHERE v = 'killed') AS killed, count(*) FILTER (WHERE v = 'survived') AS survived, count(*) FILTER (WHERE v = 'timeout') AS timed_out, count(*) FILTER (WHERE v IS NULL) AS unmeasured FROM s GROUP BY ALL)
      SELECT *, CASE WHEN unmeasured = 0 THEN round(100 * (killed + timed_out) / (killed + timed_out + survived), 4) END AS score FROM c""",
    "language_difference": """WITH a AS (SELECT lang, count(*) AS a FROM manifest GROUP BY lang), b AS (SELECT lang, count(*) AS b FROM documents GROUP BY lang),
      j AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.lang = b.lang)
      SELECT lang, greatest(a - b, 0) AS lost, greatest(b - a, 0) AS gained FROM j WHERE a <> b""",
    "fact_tokens": f"""WITH b AS (SELECT regexp_replace(text, '(?s)```.*?```', ' ', 'g') AS body FROM documents), t AS ({_KINDS})
      SELECT kind, token, count(*) AS n FROM t WHERE NOT (kind = 'tickets' AND regexp_matches(token, '{an.NOT_TICKETS}')) GROUP BY ALL""",
    "freshness": """WITH s AS (SELECT user_id, min(ts) AS a FROM events GROUP BY user_id), c AS (SELECT user_id, max(ts) AS b FROM events WHERE event_type = 'click' GROUP BY user_id),
      l AS (SELECT s.user_id, greatest(a, b) AS latest FROM s LEFT JOIN c USING (user_id))
      SELECT user_id, latest, TIMESTAMP '2024-01-30 00:00:00' - latest <= INTERVAL 1 DAY AS fresh FROM l""",
    "changed_lines": r"""WITH l AS (SELECT kind AS file, unnest(string_split(regexp_replace(text, '(?m)^- ', '+', 'g'), chr(10))) AS l FROM documents WHERE text IS NOT NULL)
      SELECT file, count(*) FILTER (WHERE starts_with(l, '+') AND NOT starts_with(l, '+++')) AS added, count(*) FILTER (WHERE starts_with(l, '-') AND NOT starts_with(l, '---')) AS removed FROM l GROUP BY file""",
    "user_sessions": _SESSIONS,
    "chain_heads": "SELECT user_id, count(*) AS n, 1::BIGINT AS roots FROM events GROUP BY user_id",
    "chain_faults": """SELECT user_id, line, 'body differs' AS fault FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events) WHERE event_id % 97 = 0""",
    "event_runs": """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS j FROM events)
      SELECT user_id, event_type, min(i) AS start, count(*) AS length FROM p GROUP BY user_id, event_type, i - j HAVING count(*) >= 3""",
    "hazard_lines": f"""WITH l AS (SELECT unnest(string_split(content, chr(10))) AS line FROM chunks), c AS (SELECT unnest({_HAZ}) AS category FROM l)
      SELECT category, count(*) AS n FROM c GROUP BY category""",
    "hazard_evidence": rf"""WITH l AS (SELECT row_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM chunks),
      c AS (SELECT unnest({_HAZ}) AS category, left(trim(regexp_replace(line, '^\s+|\s+$', '', 'g')), 200) AS evidence, row_id, pos FROM l),
      f AS (SELECT category, evidence, min((row_id, pos)) AS first FROM c GROUP BY ALL)
      SELECT category, rank, evidence FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY first, evidence) AS rank FROM f) WHERE rank <= 5""",
    "hazard_paths": "WITH c AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {_has('lower(file)', w)} THEN '{c}' END" for c, w in an.HAZARD_PATHS.items()) + """], lambda x: x IS NOT NULL)) AS category FROM manifest)
      SELECT category, count(*) AS n FROM c GROUP BY category""",
    "files_in_scope": r"""SELECT DISTINCT f AS file FROM (SELECT regexp_replace(translate(file, '\', '/'), '^\./', '') AS f FROM manifest)
      WHERE regexp_matches(f, '^(?:.*/)?lib/.*$|^(?:.*/)?[^/]*_gen\.py$|^(?:.*/)?src/[^/]*\.ts$')""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""",
    "revenue_by_region": """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "order_rollup": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "order_cube": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)",
    "top_parts_per_brand": "SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "running_totals": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events",
    "last_click_before": """SELECT event_id, click_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id
      FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'""",
    "status_pivot": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority""",
    "shared_languages": """SELECT lang, 'both' AS side FROM (SELECT lang FROM manifest INTERSECT SELECT lang FROM documents)
      UNION ALL SELECT DISTINCT lang, 'more in manifest' FROM (SELECT lang FROM manifest EXCEPT ALL SELECT lang FROM documents)""",
    "daily_counts": _DAILY,
    "streamed_daily_counts": _DAILY,
    "streamed_sessions": _SESSIONS,
}
