"""Queries on texts, chunks and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.paths import canonical_path, extension, parent_dir
from corvane.operators import analytics, chunking, codegraph, graph, prose
from corvane.plans.retrieval_queries import tokens_sql
from corvane.plans.indexing import code_or_blocks
from corvane.session import table
from corvane.sources import markup, scan

_docs = lambda s, d: table(s, d, "documents")


def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.estimate_tokens("text").alias("tokens"))


def token_totals(s: SparkSession, d: str) -> DataFrame:
    return chunking.token_totals(_docs(s, d), ["kind"], "text")


def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks")
    return c.select("row_id", tx.chunk_id(canonical_path("source_file"), "chunk_index").alias("id"), tx.short_hash("content").alias("content_hash"))


def query_hashes(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.prefixed_hash("text").alias("hash"))


def identifier_tokens(s: SparkSession, d: str) -> DataFrame:
    toks = table(s, d, "raw_chunks").select(F.explode(tx.identifier_tokens("content")).alias("tok"))
    return toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def content_words(s: SparkSession, d: str) -> DataFrame:
    words = _docs(s, d).select(F.explode(tx.content_words("text")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def redacted(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.redact(F.concat(F.lit("token="), F.coalesce("text", F.lit("x")))).alias("summary"))


def hashed_buckets(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "doc_chunks").select(F.posexplode(tx.hashed_embedding("content")).alias("bucket", "n"))
    return v.groupBy("bucket").agg(F.sum(F.col("n").cast("bigint")).alias("n"))


def languages(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").select(tx.language_of("file").alias("language"))
    return m.select("language", tx.model_of(F.coalesce("language", F.lit("?"))).alias("model")).groupBy("language", "model").agg(F.count(F.lit(1)).alias("n"))


def citations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_chunks").select("doc_chunk_id", tx.citation("heading", "source_id").alias("citation"))


def related_citations(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).select("doc_id", F.explode(tx.related_citations("text")).alias("citation"))
    return c.groupBy("citation").agg(F.count(F.lit(1)).alias("n"))


def plain_markdown(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_chunks").select("doc_chunk_id", tx.prefixed_hash(tx.strip_markdown("content")).alias("hash"))


def clean_snippets(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.clean_snippet("text").alias("snippet"), F.length(tx.clean_code("text")).alias("n_code"))


def topic_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_chunks").select(tx.topic_slug("source_id").alias("slug")).distinct()


def fixed_windows(s: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(_docs(s, d), "doc_id", "text", 2000)


def line_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.line_sections(_docs(s, d).where("text IS NOT NULL"), "doc_id", "text", r"^#{1,3}\s+", "Introduction").select("doc_id", "section", "n_lines", "n_chars")


def forced_pieces(s: SparkSession, d: str) -> DataFrame:
    how = lambda t, _: [["", x, 0, 0] for x in chunking.force_split(t, 500)]
    return chunking.chunk_texts(_docs(s, d), "doc_id", "text", how).select("doc_id", "chunk_index", "content", "token_count")


def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.not_degenerate(chunking.chunk_texts(_docs(s, d).where("kind IN ('guide', 'summary', 'changelog')"), "doc_id", "text", lambda t, _: chunking.markdown_chunks(t)))


def document_chunks(s: SparkSession, d: str) -> DataFrame:
    how = lambda t, _: chunking.document_chunks(t, r"(?:§|Article|Sec\.|\d+(?:\.\d+)+)\s?")
    return chunking.chunk_texts(_docs(s, d).where("kind = 'statute'"), "doc_id", "text", how)


def code_chunks(s: SparkSession, d: str) -> DataFrame:
    suffix = F.coalesce(F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1), F.lit(""))
    named = _docs(s, d).where("kind = 'code'").withColumn("name", F.concat(F.regexp_replace(F.coalesce("path", F.lit("")), r"\.[^./]*$", ""), F.lit("\x00"), suffix, F.lit(".")))
    return chunking.chunk_texts(named, "doc_id", "text", code_or_blocks, name="name")


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    """The stored form of the chunks that aren't degenerate: id and all fields of the metadata."""
    c = table(s, d, "chunks").withColumn("source_file", canonical_path("source_file"))
    return chunking.with_metadata(chunking.not_degenerate(c), "source_file", "scope", F.col("indexed_at")).select("chunk_id", "metadata.*")


def file_variants(s: SparkSession, d: str) -> DataFrame:
    return graph.file_variants(table(s, d, "manifest"))


def exclusions(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).where("path IS NOT NULL")
    path = canonical_path("path")
    content = F.coalesce("text", F.lit(""))
    reason = scan.exclusion_reason(path, F.octet_length(content), scan.looks_binary(F.encode(content, "UTF-8")), scan.looks_secret(content))
    return docs.select("doc_id", reason.alias("reason"), scan.in_skipped_folder(path).alias("skipped"))


def secrets(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select(scan.looks_secret(F.coalesce("text", F.lit(""))).alias("secret"))
    return docs.groupBy("secret").agg(F.count(F.lit(1)).alias("n"))


def source_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_chunks").where("content IS NOT NULL").select("raw_id", codegraph.loc("content").alias("loc"), codegraph.keyword_complexity("content").alias("complexity"))


def extracted_edges(s: SparkSession, d: str) -> DataFrame:
    return codegraph.extract_edges(table(s, d, "raw_chunks"), "source_file", "content")


def python_metrics(s: SparkSession, d: str) -> DataFrame:
    return codegraph.code_metrics(table(s, d, "raw_chunks").select("source_file", "content"), "source_file", "content")


def text_statistics(s: SparkSession, d: str) -> DataFrame:
    return prose.text_stats(_docs(s, d), ["kind"], "text")


def plain_text_statistics(s: SparkSession, d: str) -> DataFrame:
    """The same with sentences by terminal punctuation alone."""
    return prose.text_stats(_docs(s, d), ["kind"], "text", prose.plain_sentences)


def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", F.size(prose.sentences("text")).alias("n_sentences"))


def prose_findings(s: SparkSession, d: str) -> DataFrame:
    return prose.rule_findings(_docs(s, d), "doc_id", "text")


def comment_findings(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "raw_chunks").select("raw_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?://|#)[ \t]*(.*)$"), F.lit(1))).alias("line", "t"))
    found = prose.comment_checks(c.where("t IS NOT NULL"), "raw_id", "line", "t")
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def comment_stops(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "raw_chunks").select("raw_id", F.explode(F.split("content", "\n")).alias("t")).where(F.ltrim("t").startswith("//"))
    return prose.stop_share(c, "raw_id", "t")


def uniform_comments(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "raw_chunks").select("raw_id", F.posexplode(F.split("content", "\n")).alias("line", "t")).where(F.ltrim("t").startswith("//"))
    return prose.uniform_lengths(c, "raw_id", "line", "t")


def first_word_share(s: SparkSession, d: str) -> DataFrame:
    o = _docs(s, d).where("source IS NOT NULL").select("source", F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1)).alias("opener")).where("opener <> ''")
    return analytics.opener_share(o, "source", "opener", 3, 0.2)


def page_texts(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), F.coalesce("heading", F.lit("")), F.lit("</h1><p>A &amp; B</p><script>x()</script><p>"), F.col("source_id"), F.lit("</p></body></html>"))
    return table(s, d, "doc_chunks").select("doc_chunk_id", markup.html_to_text(page).alias("text"))


def page_links(s: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://docs.example.org/"), F.col("source_id"), F.lit("/index.html"))
    page = F.concat(F.lit('<a href="/x/'), F.col("doc_chunk_id").cast("string"), F.lit('/">one</a> <a class="b" href="next.html#top">two</a> <a href="https://other.example.net/y">three</a>'))
    pages = table(s, d, "doc_chunks").select(url.alias("url"), page.alias("html"))
    return markup.extract_links(pages).select("url", "link", markup.worth_crawling("link", F.lit("docs.example.org")).alias("follow")).distinct()


def regulation_texts(s: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit('<?xml version="1.0"?><DIV8 N="'), F.col("doc_chunk_id").cast("string"), F.lit('.1" TYPE="SECTION"><HEAD>'), F.col("source_id"), F.lit("</HEAD><P>one  &lt;two&gt;</P><CITA>drop</CITA></DIV8>"))
    return table(s, d, "doc_chunks").select("doc_chunk_id", markup.regulation_to_text(xml).alias("text"), F.element_at(markup.section_numbers(xml), 1).alias("section"))


QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, token_totals, chunk_ids, query_hashes, identifier_tokens, content_words, redacted, hashed_buckets, languages, citations, related_citations,
        plain_markdown, clean_snippets, topic_slugs, fixed_windows, line_sections, forced_pieces, markdown_chunks, document_chunks, code_chunks, chunk_metadata,
        file_variants, exclusions, secrets, source_lines, extracted_edges, python_metrics, text_statistics, plain_text_statistics, sentence_counts, prose_findings, comment_findings,
        comment_stops, uniform_comments, first_word_share, page_texts, page_links, regulation_texts,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_PATH = r"regexp_replace(translate({0}, '\', '/'), '^\./', '')"
_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _case(key: str, table_: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


_MODELS = {lang: m for m, langs in tx.MODEL_FAMILIES.items() for lang in langs}
_EXT = r"lower(regexp_extract({0}, '(\.[^./\\]+)$', 1))"
_NAME = f"regexp_extract({_PATH.format('path')}, '([^/]*)$', 1)"
_STEPS = (("(?s)```.*?```", " "), ("`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s+[^\n\r]*", ""), ("[*_>]", ""))


SQL = {
    "token_estimate": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "token_totals": "SELECT kind, count(*) AS n, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY kind",
    "chunk_ids": f"SELECT row_id, substr(sha256({_PATH.format('source_file')} || '::' || chunk_index), 1, 16) AS id, substr(sha256(content), 1, 16) AS content_hash FROM chunks",
    "query_hashes": "SELECT doc_id, CASE WHEN length(text) > 0 THEN 'sha256:' || sha256(text) END AS hash FROM documents",
    "identifier_tokens": f"SELECT tok, count(*) AS n FROM (SELECT unnest({tokens_sql('content')}) AS tok FROM raw_chunks) GROUP BY tok",
    "content_words": f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
      WHERE length(word) > 2 AND word NOT IN {_list(tx.STOP_WORDS)} GROUP BY word""",
    "redacted": r"""SELECT doc_id, left(regexp_replace('token=' || coalesce(text, 'x'), '(?i)(password|passwd|pwd|secret|token|api[_-]?key|authorization)(\s*[=:]\s*)\S+', '\1\2***REDACTED***', 'g'), 200) AS summary FROM documents""",
    "hashed_buckets": f"""WITH t AS (SELECT unnest({tokens_sql('content')}) AS tok FROM doc_chunks),
      b AS (SELECT (('0x' || substr(md5(tok), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM t GROUP BY ALL)
      SELECT i::INT AS bucket, coalesce(n, 0)::BIGINT AS n FROM range(64) r(i) LEFT JOIN b ON bucket = i""",
    "languages": f"""SELECT language, coalesce({_case('language', _MODELS)}, '{tx.FALLBACK_MODEL}') AS model, count(*) AS n
      FROM (SELECT {_case(_EXT.format('file'), tx.SUFFIX_LANGUAGE)} AS language FROM manifest) GROUP BY ALL""",
    "citations": """SELECT doc_chunk_id, CASE WHEN coalesce(heading, '') IN ('', 'Preamble') THEN trim(coalesce(source_id, '')) ELSE trim(coalesce(source_id, '') || ' ' || heading) END AS citation FROM doc_chunks""",
    "related_citations": r"""SELECT citation, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(left(text, 2000), '<[^>]+>', ' ', 'g'),
      '\b\d+ C\.?F\.?R\.? (?:§+ ?)?\d[\d.]*\d|\b\d+ U\.?S\.?C\.? (?:§+ ?)?\d+|Pub\. ?L\. (?:No\. )?\d+-\d+|\b\d+ Fed\. Reg\. \d+|\b\d+ FR \d+')[1:5]) AS citation FROM documents) GROUP BY citation""",
    "topic_slugs": "SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(source_id)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM doc_chunks",
    "fixed_windows": """SELECT doc_id, piece::INT AS piece, substr(text, piece * 2000 + 1, 2000) AS content
      FROM (SELECT doc_id, text, unnest(range((length(text) + 1999) // 2000)) AS piece FROM documents WHERE length(text) > 0)""",
    "line_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
      n AS (SELECT *, sum(regexp_matches(t, '^#{1,3}\s+')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
      SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars FROM n GROUP BY ALL""",
    "chunk_metadata": f"""SELECT substr(sha256(f || '::' || chunk_index), 1, 16) AS chunk_id, f AS source_file, scope, section, regexp_replace(f, '/?[^/]*$', '') AS tree_path, line_start, line_end, indexed_at, chunk_index, token_count
      FROM (SELECT *, {_PATH.format('source_file')} AS f FROM chunks WHERE token_count >= 10)""",
    "file_variants": rf"""WITH f AS (SELECT DISTINCT {_PATH.format('file')} AS file FROM manifest WHERE file <> ''),
      b AS (SELECT file, regexp_replace(file, '([^/])\.[^./]*$', '\1') AS bare FROM f),
      k AS (SELECT file, file AS key, 0 AS p FROM b UNION ALL SELECT file, regexp_extract(bare, '([^/]*)$', 1), 1 FROM b UNION ALL SELECT file, bare, 1 FROM b
        UNION ALL SELECT file, replace(bare, '/', '.'), 1 FROM b
        UNION ALL SELECT file, regexp_replace(file, '/?[^/]*$', ''), 1 FROM b WHERE regexp_extract(bare, '([^/]*)$', 1) = 'index' AND contains(file, '/'))
      SELECT key, arg_min(file, (p, file)) AS path FROM k GROUP BY key""",
    "exclusions": rf"""SELECT doc_id, CASE WHEN {_NAME} IN {_list(scan.SKIP_FILES)} THEN 'generated file'
      WHEN {' OR '.join(f"ends_with({_NAME}, '{x}')" for x in scan.SKIP_SUFFIXES)} THEN 'generated suffix'
      WHEN {' OR '.join(f"lower({_NAME}) GLOB '{g}'" for g in scan.CREDENTIAL_NAMES)} THEN 'credential config'
      WHEN lower(regexp_extract({_PATH.format('path')}, '(\.[^./]+)$', 1)) NOT IN {_list(scan.CODE_EXTENSIONS)} THEN 'extension'
      WHEN strlen(coalesce(text, '')) > 500000 THEN 'too large' END AS reason,
      list_has_any(string_split(regexp_replace({_PATH.format('path')}, '[^/]*$', ''), '/'), [{', '.join(f"'{x}'" for x in scan.SKIP_DIRS)}]) AS skipped
      FROM documents WHERE path IS NOT NULL""",
    "source_lines": r"""SELECT raw_id, len(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$|^\s*(?:#|//|--|\*|/\*)')))::INT AS loc,
      (1 + len(regexp_extract_all(content, '\b(?:if|for|while|case|catch|elif|elsif|except|when)\b|&&|\|\|')))::INT AS complexity FROM raw_chunks WHERE content IS NOT NULL""",
    "plain_text_statistics": """WITH s AS (SELECT kind, trim(unnest(regexp_extract_all(text, '[^.!?]+'))) AS s FROM documents),
      w AS (SELECT kind, len(regexp_extract_all(s, '[A-Za-z0-9]+')) AS w FROM s WHERE s <> '')
      SELECT kind, count(*) AS sentences, sum(w)::BIGINT AS words, round(avg(w), 4) AS mean_words, round(stddev_pop(w), 4) AS sd_words,
        round(count(*) FILTER (WHERE w BETWEEN 14 AND 21) / count(*), 4) AS band_share FROM w GROUP BY kind""",
    "comment_stops": """WITH c AS (SELECT raw_id, unnest(string_split(content, chr(10))) AS t FROM raw_chunks)
      SELECT raw_id, count(*) AS n, count(*) FILTER (WHERE ends_with(rtrim(t, ' '), '.')) AS stops, count(*) FILTER (WHERE ends_with(rtrim(t, ' '), '.')) >= 0.7 * count(*) AS formal
      FROM c WHERE starts_with(ltrim(t, ' '), '//') GROUP BY raw_id""",
    "uniform_comments": """WITH c AS (SELECT raw_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM raw_chunks),
      w AS (SELECT raw_id, line::INT AS line, count(*) OVER r AS n, max(length(t)) OVER r - min(length(t)) OVER r AS d FROM c WHERE starts_with(ltrim(t, ' '), '//')
        WINDOW r AS (PARTITION BY raw_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
      SELECT raw_id, line FROM w WHERE n = 4 AND d <= 5""",
    "first_word_share": """WITH o AS (SELECT source, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS opener FROM documents WHERE source IS NOT NULL),
      n AS (SELECT source, opener, count(*) AS n FROM o WHERE opener <> '' GROUP BY ALL),
      r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, opener) AS i FROM n)
      SELECT source, opener, n, round(n / total, 6) AS share FROM r WHERE i = 1 AND n >= 3 AND n >= 0.2 * total""",
    "page_links": """SELECT DISTINCT 'https://docs.example.org/' || source_id || '/index.html' AS url, link, starts_with(link, 'https://docs.example.org') AS follow FROM doc_chunks,
      LATERAL (SELECT unnest(['https://docs.example.org/x/' || doc_chunk_id, 'https://docs.example.org/' || source_id || '/next.html', 'https://other.example.net/y']) AS link)
      WHERE source_id IS NOT NULL""",
    "regulation_texts": """SELECT doc_chunk_id, source_id || chr(10) || 'one <two>' AS text, doc_chunk_id || '.1' AS section FROM doc_chunks""",
}
for _pattern, _by in _STEPS:
    _done = f"regexp_replace({_done}, '{_pattern}', '{_by}', 'g')" if _pattern != _STEPS[0][0] else f"regexp_replace(content, '{_pattern}', '{_by}', 'g')"
SQL["plain_markdown"] = f"SELECT doc_chunk_id, CASE WHEN length(x) > 0 THEN 'sha256:' || sha256(x) END AS hash FROM (SELECT doc_chunk_id, {_done} AS x FROM doc_chunks)"
