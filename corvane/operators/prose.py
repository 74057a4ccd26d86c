"""Statistics and rule checks of prose and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import content_words, strip_markdown
from corvane.operators.analytics import runs

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "cf", "fig", "no", "vol", "inc", "ltd", "co", "approx", "dept", "est", "al")
# Openings and phrases that the rules watch.
SUMMARY_OPENERS = ("in conclusion", "in summary", "to summarise", "to summarize", "to sum up", "ultimately", "at the end of the day", "all in all", "in short", "the bottom line", "overall,")
PARTICIPLE_TAIL = r"(?i)(?<!ing),\s+(?:ensuring|allowing|helping|enabling|making|providing|creating|offering|delivering|improving|reducing|increasing|giving|leading|resulting|driving|streamlining|empowering)\b(?!\s+and\s+\w+ing\b)"
CONTRASTS = (
    r"(?i)\bnot\s+(?:just\s+|merely\s+|simply\s+)?[\w\s]{2,30},\s*but\s+",
    r"(?i)\bisn't\s+[\w\s]{2,30}[.,]\s*(?:it's|it is)\s+",
    r"(?i)\bis not\s+[\w\s]{2,30}[.,]\s*(?:it's|it is)\s+",
    r"(?i)\bless about\s+[\w\s]{2,30}\s+(?:and\s+)?more about\b",
    r"(?i)\bnot\s+because\s+[\w\s]{2,40},\s*but\s+because\b",
)
# Words and phrases of the vocabulary rules; those of a figure of speech count only with what they are said of.
BANNED_WORDS = ("delve", "deep dive", "unpack", "robust", "holistic", "synergy", "comprehensive")
FIGURATIVE = (
    r"\bnavigat(?:e|ing|es|ed)\s+(?:the\s+)?(?:complexit|challeng|landscape|nuance|world|maze|terrain)",
    r"\b(?:the\s+)?(?:competitive|regulatory|market|industry|business|digital|media|evolving|shifting|changing)\s+landscape\b",
    r"\bleverag(?:e|ing|es|ed)\s+(?:the\s+|our\s+|your\s+|their\s+|its\s+)?\w+",
)
CAPPED_WORDS = {"crucial": 1, "vital": 1, "essential": 1}
BANNED_PHRASES = (
    "it is worth noting that", "it's worth noting that", "it is important to understand", "it is important to note", "it's important to note", "it's important to understand",
    "it is crucial to", "it's crucial to", "in conclusion", "in summary", "to summarise", "to summarize", "to sum up", "not only", "but also", "on the one hand", "on the other hand",
)
STACKED = r"\b(?:\w+ly\s+)?\w+,\s*\w+,\s*and\s+\w+\s+(?:approach|solution|strategy|framework|guide|process|method|system|tool)\b"
RHETORICAL = r"(?i)(?:^|\n)\s*(?:so\s+)?(?:what|why|how)\s+(?:does|do|is|are|can|should)\b[^?]{5,80}\?"
GENERIC_OPENING = r"(?i)^\s*(?:in today's|in the world of|in an era|as technology|when it comes to|whether you|the world of|there's no denying|in recent years)"
PARTICIPLE_OPEN = r"(?i)^\s*\w+(?:ing|ed)\b"
TITLE_CASE_SKIP = (
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "if", "in", "into", "nor", "of", "off", "on", "or", "out", "over", "per", "the", "to", "up", "via", "vs", "with", "without",
)
# Words that comments do without, and what takes their place.
REPLACEMENTS = {
    "facilitates": "handles", "seamless": "smooth", "leverage": "use", "leverages": "uses", "leveraging": "using", "utilize": "use", "utilizes": "uses", "utilizing": "using",
    "robust": "solid", "comprehensive": "full", "pivotal": "key", "nuanced": "subtle", "harness": "use", "bolster": "improve", "intricate": "complex", "transformative": "impactful",
    "paradigm": "pattern", "holistic": "overall", "empower": "let", "empowers": "lets",
}
# Words of a comment that explains something, whose length is then no fault.
EXPLAINS = r"(?i)\b(?:because|so that|in order to|avoids?|prevents?|workaround|important|why|only|unless|until|race|bug|issue|security|compat|compatibility|must|cannot|can't|should|otherwise|note that|caveat|gotcha|todo|fixme|hack|deliberate|deliberately|on purpose)\b"
HEDGE = r"(?i)\bwhile\s+[\w\s,]{5,60}\s+(?:it is|it's)\s+(?:also\s+)?(?:important|worth|crucial|vital)\b"


def sentences(text: Column | str) -> Column:
    """Sentences of at least two words: cut behind ``.``, ``!`` or ``?`` before a capital, quote or bracket.

    A full stop after an abbreviation or a lone initial doesn't end one: such parts are joined to the next by a fold.
    """
    text = F.col(text) if isinstance(text, str) else text
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    short = r"(?i)(?:^|[^A-Za-z.])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"|[A-Za-z])\.\s*$"

    def of(block):
        parts = F.split(block, r"(?<=[.!?])\s+(?=[A-Z\"'“(])")
        return F.aggregate(
            parts,
            F.expr("cast(array() as array<string>)"),
            lambda acc, p: F.when(
                (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")).rlike(short),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), p))),
            ).otherwise(F.concat(acc, F.array(p))),
        )

    return F.filter(F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), of)), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 2)


def plain_sentences(text: Column | str) -> Column:
    """Sentences by terminal punctuation alone, in one pass."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def text_stats(df: DataFrame, group: list[str], text: str, splitter=sentences) -> DataFrame:
    """Sentences (by ``splitter``), words, mean and population deviation of the words of a sentence, and the share of 14 to 21 words."""
    s = df.select(*group, F.explode(splitter(text)).alias("s")).withColumn("w", F.size(F.regexp_extract_all("s", F.lit(r"[A-Za-z0-9]+"), F.lit(0))))
    return s.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum("w").cast("bigint").alias("words"),
        F.round(F.avg("w"), 4).alias("mean_words"),
        F.round(F.stddev_pop("w"), 4).alias("sd_words"),
        F.round(F.count_if(F.col("w").between(14, 21)) / F.count(F.lit(1)), 4).alias("band_share"),
    )


def title_case_headings(text: Column) -> Column:
    """Headings below the first level whose words, besides the first and the small ones, begin with capitals: at least two of them and three quarters."""
    plain = lambda h: F.regexp_replace(F.regexp_replace(h, r"[`*_\[\]()]|\{[^}]*\}", ""), r"^\d+[.)]\s*", "")
    headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^ {0,3}#{2,6}[ \t]+(.*)$"), F.lit(1)), lambda h: F.regexp_extract_all(plain(h), F.lit(r"[A-Za-z][\w'-]*"), F.lit(0)))

    def wrong(words):
        major = F.filter(F.slice(words, 2, 10_000), lambda w: ~F.lower(w).isin(*TITLE_CASE_SKIP))
        capped = F.size(F.filter(major, lambda w: w.rlike("^[A-Z]") & (w != F.upper(w))))
        return (F.size(major) >= 2) & (capped >= 2) & (capped >= 0.75 * F.size(major))

    return F.size(F.filter(headings, wrong))


def frame_findings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id and finding of how a text begins and ends: an opening that only repeats the title or sets a general scene, a closing that says nothing new or begins as a summary, and paragraphs that open alike.

    Null and empty texts give nothing.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = strip_markdown(raw)
    d = df.select(
        id_col, F.regexp_extract(raw, r"(?m)^#[ \t]+(.+)$", 1).alias("title"), sentences(plain).alias("s"),
        F.filter(F.split(plain, r"\n\s*\n"), lambda p: F.trim(p) != "").alias("p"),
    )
    first, last = F.coalesce(F.try_element_at("s", F.lit(1)), F.lit("")), F.coalesce(F.try_element_at("p", F.lit(-1)), F.lit(""))
    t, f = F.array_distinct(content_words(F.col("title"))), F.array_distinct(content_words(first))
    restates = (F.size("s") > 0) & (F.size(t) > 0) & (F.size(F.array_intersect(t, f)) >= 0.6 * F.size(t)) & (F.size(F.array_except(f, t)) <= 3)
    long = (F.size("p") >= 2) & (F.size("s") >= 8)
    body = content_words(F.array_join(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), " "))
    words = content_words(last)
    closing = long & (F.size(words) > 6) & (F.size(F.filter(words, lambda w: F.array_contains(body, w))) > 0.85 * F.size(words))
    summary = F.lit(False)
    for o in SUMMARY_OPENERS:
        summary = summary | F.startswith(F.ltrim(F.lower(last)), F.lit(o))
    opens = F.filter(F.transform("p", lambda p: F.lower(F.regexp_extract(p, r"([A-Za-z']+)", 1))), lambda w: w != "")
    alike = F.exists(F.array_distinct(opens), lambda w: (F.size(F.filter(opens, lambda x: x == w)) >= 3) & (F.size(F.filter(opens, lambda x: x == w)) >= 0.4 * F.size(opens)))
    found = F.array_compact(
        F.array(
            F.when(restates, "opening restates title"), F.when(F.col("s")[0].rlike(GENERIC_OPENING), "generic opening"), F.when(closing, "closing restates body"),
            F.when(long & summary, "summary closing"), F.when((F.size(opens) >= 4) & alike, "paragraphs open alike"),
        )
    )
    return d.where(F.size("s") > 0).select(id_col, F.explode(found).alias("finding"))


def participle_runs(df: DataFrame, id_col: str, text: str, least: int = 3) -> DataFrame:
    """id, start (from 0) and length of runs of at least ``least`` consecutive sentences that open with a participle."""
    each = df.where(F.col(text).isNotNull()).select(id_col, F.posexplode(sentences(strip_markdown(F.col(text)))).alias("i", "s")).withColumn("opens", F.col("s").rlike(PARTICIPLE_OPEN))
    return runs(each, id_col, ["i"], "opens", least).where("opens").drop("opens")


def plain_words(text: Column | str) -> Column:
    """A comment with the words of ``REPLACEMENTS`` replaced; a capital at the beginning is kept."""
    out = F.col(text) if isinstance(text, str) else text
    for word, better in sorted(REPLACEMENTS.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"\b{word}\b", better)
        out = F.regexp_replace(out, rf"\b{word.capitalize()}\b", better.capitalize())
    return out


def uniform_spacing(lines: DataFrame, id_col: str, text: str, least: int = 5) -> DataFrame:
    """Ids of which all comments, at least ``least``, have exactly one space behind ``//``."""
    one = F.count_if(F.coalesce(F.col(text).rlike(r"^//[ \t]\S"), F.lit(False)))
    return lines.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), one.alias("one")).where((F.col("n") >= least) & (F.col("n") == F.col("one"))).select(id_col, "n")


def rule_findings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One long table of rule, id and number of violations, for each rule that a text breaks."""
    t = strip_markdown(F.coalesce(F.col(text), F.lit("")))
    contrast = sum((F.regexp_count(t, F.lit(p)) for p in CONTRASTS[1:]), F.regexp_count(t, F.lit(CONTRASTS[0])))
    opener = F.lit(0)
    for o in SUMMARY_OPENERS:
        opener = opener + F.regexp_count(F.lower(t), F.lit(r"(?m)^\s*" + o)).cast("int")
    rules = {
        "em dash": F.regexp_count(t, F.lit("—")),
        "contrast": contrast,
        "hedge": F.regexp_count(t, F.lit(HEDGE)),
        "summary opener": opener,
        "participle tail": F.greatest(F.regexp_count(t, F.lit(PARTICIPLE_TAIL)) - 1, F.lit(0)),
        "banned word": F.regexp_count(F.lower(t), F.lit(r"\b(?:" + "|".join(BANNED_WORDS) + r")\w*")),
        "figurative word": sum((F.regexp_count(F.lower(t), F.lit(p)) for p in FIGURATIVE[1:]), F.regexp_count(F.lower(t), F.lit(FIGURATIVE[0]))),
        "capped word": sum((F.when(F.regexp_count(F.lower(t), F.lit(rf"\b{w}\b")) > n, 1).otherwise(0) for w, n in CAPPED_WORDS.items()), F.lit(0)),
        "banned phrase": sum((F.contains(F.lower(t), F.lit(p)).cast("int") for p in BANNED_PHRASES), F.lit(0)),
        "stacked adjectives": F.regexp_count(F.lower(t), F.lit(STACKED)),
        "rhetorical opener": F.regexp_count(t, F.lit(RHETORICAL)),
        "title case": title_case_headings(F.coalesce(F.col(text), F.lit(""))),
        "all caps": F.regexp_count(t, F.lit(r"\b[A-Z]{2,}(?:\s+[A-Z]{2,}){3,}\b")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.cast("bigint").alias("n")) for k, v in rules.items())))
    return df.select(id_col, each.alias("r")).select(id_col, "r.rule", "r.n").where("n > 0")


def heading_overlap(title: Column, first: Column) -> Column:
    """Share of a title's content words that the first sentence repeats; null for a title without any."""
    a, b = F.array_distinct(content_words(title)), F.array_distinct(content_words(first))
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6))


def comment_checks(lines: DataFrame, id_col: str, line_col: str, text: str) -> DataFrame:
    """Checks of comment lines: id, line, check. ``lines`` holds one comment text each.

    Too long (over 20 words that explain nothing), a dash or a hyphen in its place, a word that has a plainer one, a formal opener, or narration of the next step.
    """
    t = F.col(text)
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    checks = F.array_compact(
        F.array(
            F.when((words > 20) & ~t.rlike(EXPLAINS), F.lit("too long")),
            F.when(F.regexp_replace(t, r"`[^`]*`", "").rlike("[\u2012\u2013\u2014]"), F.lit("dash")),
            F.when(F.regexp_replace(t, r"`[^`]*`", "").rlike(r" - (?![->\d])"), F.lit("spaced hyphen")),
            F.when(plain_words(t) != t, F.lit("banned word")),
            F.when(t.rlike(r"(?i)^\s*(?:this (?:function|method|class|module)|the following|in order to|note that)\b"), F.lit("formal opener")),
            F.when(t.rlike(r"(?i)^\s*(?:now|next|then|first|finally),? (?:we|let's|i)\b"), F.lit("narration")),
        )
    )
    return lines.select(id_col, line_col, F.explode(checks).alias("check"))


def stop_share(lines: DataFrame, id_col: str, text: str) -> DataFrame:
    """Comment lines of each id, how many end with a full stop, and whether that is at least 70 %."""
    ends = F.count_if(F.rtrim(F.col(text)).endswith("."))
    return lines.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), ends.alias("stops")).withColumn("formal", F.col("stops") >= 0.7 * F.col("n"))


def uniform_lengths(lines: DataFrame, id_col: str, order: str, text: str, run: int = 4, spread: int = 5) -> DataFrame:
    """Starts of ``run`` consecutive comments whose lengths differ by at most ``spread`` characters."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(0, run - 1)
    n = F.length(text)
    seen = lines.select(id_col, order, F.count(F.lit(1)).over(w).alias("n"), (F.max(n).over(w) - F.min(n).over(w)).alias("d"))
    return seen.where((F.col("n") == run) & (F.col("d") <= spread)).select(id_col, order)
