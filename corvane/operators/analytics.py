"""Summaries over logs, findings and audit chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import SECONDARY_LANGUAGES

GENESIS = "0" * 64


def language_vote(files: DataFrame, group: list[str], lang: str = "lang") -> DataFrame:
    """The dominant language of each group: application languages first, supporting ones only among themselves.

    ``unknown`` and null never win; ties go to the first name. A group with neither has a null language.
    """
    name = F.lower(lang)
    tier = F.when(name.isNull() | (name == "unknown"), 0).when(name.isin(*SECONDARY_LANGUAGES), 1).otherwise(2)
    counts = files.groupBy(*group, name.alias("lang"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("tier"), F.desc("n"), "lang")
    first = counts.withColumn("i", F.row_number().over(w)).where("i = 1")
    return first.select(*group, F.when(F.col("tier") > 0, F.col("lang")).alias("dominant"), F.when(F.col("tier") > 0, F.col("n")).alias("n_files"))


def event_stats(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Events of each kind with mean, least and greatest value and their share of all events."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return events.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 6).alias("avg_value"),
        F.round(F.min(value), 6).alias("min_value"),
        F.round(F.max(value), 6).alias("max_value"),
        F.round(F.count(F.lit(1)) / total, 6).alias("share"),
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their counts; ties go to the smaller value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def pass_rate(events: DataFrame, kind: Column) -> DataFrame:
    """One row: passes, blocks, exemptions and the percentage of passes among the first two."""
    n = lambda k: F.count_if(kind == k)
    return events.agg(n("pass").alias("passes"), n("block").alias("blocks"), n("exempt").alias("exempts")).withColumn(
        "pass_rate", F.when(F.col("passes") + F.col("blocks") > 0, F.round(100 * F.col("passes") / (F.col("passes") + F.col("blocks")), 4))
    )


def in_window(df: DataFrame, ts: str, since: str, until: str) -> DataFrame:
    """Rows whose time lies between two moments, both included."""
    return df.where(F.col(ts).between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows of an order, in that order."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def severity_summary(findings: DataFrame, group: list[str], severity: str = "severity") -> DataFrame:
    """critical, high, medium and low findings of each group; other severities are ignored."""
    s = F.lower(severity)
    return findings.groupBy(*group).agg(*(F.count_if(F.coalesce(s == k, F.lit(False))).alias(k) for k in ("critical", "high", "medium", "low")))


def mutation_score(results: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """killed, survived, timed_out and unmeasured mutants; the score is withheld (null) while any is unmeasured."""
    n = lambda *k: F.count_if(F.coalesce(F.col(status).isin(*k), F.lit(False)))
    counted = results.groupBy(*group).agg(
        n("killed").alias("killed"), n("survived").alias("survived"), n("timeout").alias("timed_out"),
        F.count_if(~F.coalesce(F.col(status).isin("killed", "survived", "timeout"), F.lit(False))).alias("unmeasured"),
    )
    caught, all_ = F.col("killed") + F.col("timed_out"), F.col("killed") + F.col("timed_out") + F.col("survived")
    return counted.withColumn("score", F.when((F.col("unmeasured") == 0) & (all_ > 0), F.round(100 * caught / all_, 4)))


def multiset_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``key`` with the number of rows that one side has more than the other: lost, gained."""
    l = left.groupBy(*key).agg(F.count(F.lit(1)).alias("a"))  # noqa: E741
    r = right.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
    both = l.join(r, key, "full_outer").select(*key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.where("a <> b").select(*key, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("gained"))


# What prose keeps when it is rewritten.
TOKEN_KINDS = {
    "numbers": r"(?<![\p{L}\p{M}\p{N}_])\d[\d,]*(?:\.\d+)?%?",
    "sections": r"[§#]\s?\d+(?:\.\d+)*",
    "citations": r"`[^`\n]+?:[\d,\-]+`",
    "tickets": r"(?<![\p{L}\p{M}\p{N}_])[A-Z]{2,6}-\d{2,6}(?![\p{L}\p{N}_])",
    "filenames": r"`[^`\n]*?\.[A-Za-z][A-Za-z0-9]{0,5}`",
}
NOT_TICKETS = r"^(?:SHA|MD|RFC|ISO|AES|RSA|UTF|GPT|HS|RS|ES|PS|CVE|ANSI|IEEE|EN|BS)-"


def fact_tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, kind, token of the numbers, sections, citations, tickets and file names of a text, code blocks left out."""
    body = F.regexp_replace(text, r"(?s)```.*?```", " ")

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    kinds = [of(k, p) for k, p in TOKEN_KINDS.items()]
    rows = df.select(id_col, F.explode(F.concat(*kinds)).alias("t")).select(id_col, "t.kind", "t.token")
    return rows.where(~((F.col("kind") == "tickets") & F.col("token").rlike(NOT_TICKETS)))


def freshness(sessions: DataFrame, stamps: DataFrame, key: str, now: str, ttl_seconds: int) -> DataFrame:
    """Latest activity of each session (its start or any stamp) and whether it is within the time to live."""
    last = stamps.groupBy(key).agg(F.max("at").alias("last_stamp"))
    joined = sessions.join(last, key, "left").withColumn("latest", F.greatest("started_at", "last_stamp"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))
    return joined.select(key, "latest", (age <= ttl_seconds * 1_000_000).alias("fresh"))


def hunk_counts(hunks: DataFrame, file: str = "file", code: str = "code") -> DataFrame:
    """Added and removed lines of each file, from the text of its diff hunks."""
    line = F.explode(F.split(code, "\n"))
    lines = hunks.select(file, line.alias("l"))
    plus = F.startswith("l", F.lit("+")) & ~F.startswith("l", F.lit("+++"))
    minus = F.startswith("l", F.lit("-")) & ~F.startswith("l", F.lit("---"))
    return lines.groupBy(file).agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))


def hunk_header(c: Column | str) -> Column:
    """old_start, old_lines, new_start, new_lines of a hunk header; a missing count is 1."""
    p = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("int")
    return F.struct(part(1).alias("old_start"), F.coalesce(part(2), F.lit(1)).alias("old_lines"), part(3).alias("new_start"), F.coalesce(part(4), F.lit(1)).alias("new_lines"))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``; start, end and number of events."""
    w = F.session_window(ts, gap)
    return events.groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


# --- audit chain ----------------------------------------------------------------------------------


def entry_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, body), 256)


def build_chain(entries: DataFrame, key: str, order: list[str], body: Column) -> DataFrame:
    """Chain the entries of each key: line, body, prev_hash, entry_hash.

    A chain is sequential within its key, so the sorted entries of a partition stream through one task, which holds nothing but the last hash;
    no key is ever collected. Null keys are one key; a null body is hashed as nothing.
    """
    kind = entries.schema[key].dataType.simpleString()

    def run(batches):
        at, line, last = object(), 0, GENESIS
        for b in batches:
            lines, before, hashes = [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != at:
                    at, line, last = k, 0, GENESIS
                line += 1
                lines.append(line)
                before.append(last)
                last = hashlib.sha256((last if text is None else f"{last}|{text}").encode("utf-8", "surrogatepass")).hexdigest()
                hashes.append(last)
            columns = [b.column(0), pa.array(lines, pa.int64()), b.column(1), pa.array(before, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "line", "body", "prev_hash", "entry_hash"])

    placed = entries.select(F.col(key).alias("__k"), body.cast("string").alias("__b"), *order)
    ordered = placed.repartition("__k").sortWithinPartitions("__k", *order).select("__k", "__b")
    return ordered.mapInArrow(run, f"{key} {kind}, line bigint, body string, prev_hash string, entry_hash string")


def verify_chain(chain: DataFrame, key: str) -> DataFrame:
    """Broken lines with what is wrong; verification is parallel, each entry only needs the one before."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy("line")), F.lit(GENESIS))
    state = F.when(F.col("prev_hash") != before, "parent differs").when(F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("body")), "body differs")
    return chain.select(key, "line", state.alias("fault")).where("fault IS NOT NULL")


def runs(df: DataFrame, key: str, order: list[str], value: str, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive rows with equal value: key, value, start (0-based position), length."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = df.withColumn("i", F.row_number().over(w) - 1).withColumn("j", F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) - 1)
    found = placed.groupBy(key, value, (F.col("i") - F.col("j")).alias("island")).agg(F.min("i").cast("bigint").alias("start"), F.count(F.lit(1)).alias("length"))
    return found.where(F.col("length") >= least).drop("island")


def opener_share(df: DataFrame, key: str, opener: str, least: int = 3, share: float = 0.4) -> DataFrame:
    """Keys whose most frequent opener occurs at least ``least`` times and in at least ``share`` of the rows."""
    n = df.groupBy(key, opener).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), opener))
    top = n.withColumn("total", total).withColumn("i", first).where("i = 1")
    return top.where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select(key, opener, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# Words that name a hazard in added lines and in paths.
HAZARD_WORDS = {
    "sql": ("execute(", "executemany(", "cursor.", ".query(", "text(", "select ", "insert into", "update ", "delete from", " where "),
    "auth": ("password", "passwd", "token", "secret", "api_key", "apikey", "session", "jwt", "oauth", "login", "authenticate", "authorize", "permission", "role", "is_admin", "verify_signature", "hmac"),
    "subprocess": ("subprocess", "os.system", "os.popen", "eval(", "exec(", "shell=true", "pty.spawn", "child_process"),
    "concurrency": ("threading.", "thread(", "multiprocessing", "semaphore(", "lock(", ".acquire(", "shared_state", "race"),
    "money": ("balance", "payment", "charge(", "refund", "transfer(", "transaction", "invoice", "wallet", "stripe", "paypal"),
    "test-weakening": (
        "mark.skip", "mark.xfail", "xfail", "unittest.skip", "@skip", "type: ignore", "# noqa", "eslint-disable", "@ts-ignore", "@ts-expect-error",
        "pylint: disable", "suppresswarnings", "assert true", "@ignore", "#[ignore]", "skip_reason", "as any;", "as any)", "as any,", "as any]",
        "as unknown as", "<any>",
    ),
}
HAZARD_PATHS = {
    "sql": ("migration", "schema"),
    "auth": ("auth", "login", "session", "permission", "security"),
    "subprocess": ("shell", "command_runner"),
    "concurrency": ("worker", "scheduler"),
    "money": ("payment", "billing", "checkout", "wallet", "invoice", "ledger"),
}


def hazard_categories(line: Column | str) -> Column:
    """Categories that an added line touches; a line that is only a comment counts for test-weakening alone."""
    line = F.col(line) if isinstance(line, str) else line
    low, comment = F.lower(line), F.trim(line).rlike(r"""^\s*(?:#|//|\*|\"\"\"|'''|/\*)""")
    found = []
    for category, words in HAZARD_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found.append(F.when(hit if category == "test-weakening" else hit & ~comment, F.lit(category)))
    return F.array_compact(F.array(*found))


def path_hazards(path: Column | str) -> Column:
    low = F.lower(path)
    found = []
    for category, words in HAZARD_PATHS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found.append(F.when(hit, F.lit(category)))
    return F.array_compact(F.array(*found))


def hazard_evidence(lines: DataFrame, file: str, order: list[str], line: str, cap: int = 5) -> DataFrame:
    """Per category the first ``cap`` different evidence lines in order: category, rank, evidence."""
    hits = lines.select(*dict.fromkeys([file, *order, line])).withColumn("category", F.explode(hazard_categories(line)))
    evidence = F.left(F.trim(F.regexp_replace(F.col(line), r"^\s+|\s+$", "")), F.lit(200))
    first = hits.groupBy("category", evidence.alias("evidence")).agg(F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy("category").orderBy("at", "evidence")
    return first.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= cap).select("category", "rank", "evidence")


def glob_regex(glob: Column) -> Column:
    """A path glob as a regular expression: ``*`` within a folder, ``**`` across folders; a bare name matches as a suffix."""
    g = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    g = F.regexp_replace(g, r"\*\*/?", "\x01")
    g = F.regexp_replace(F.regexp_replace(g, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^(?:.*/)?"), F.regexp_replace(g, "\x01", "(?:.*)?"), F.lit("$"))


#: Patterns of a scope; they are written by hand, one for a folder or kind of file.
MAX_PATTERNS = 1_000


def in_scope(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that match any of ``patterns`` (pattern): at most ``MAX_PATTERNS`` distinct ones, which become one expression; more are refused."""
    p = [r.re for r in patterns.select(glob_regex(F.col("pattern")).alias("re")).where("re IS NOT NULL").distinct().orderBy("re").limit(MAX_PATTERNS + 1).collect()]
    if len(p) > MAX_PATTERNS:
        raise ValueError(f"a scope has at most {MAX_PATTERNS} patterns")
    return files.where(F.col("file").rlike("|".join(f"(?:{x})" for x in p)) if p else F.lit(False))
