"""Column functions on text: tokens, hashes, cleaning, citations, languages."""

from __future__ import annotations

import collections
import functools
import hashlib
import html as html_module
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_col = lambda c: F.col(c) if isinstance(c, str) else c


# --- sizes and identities -------------------------------------------------------------------------


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the code points, rounded down; null stays null."""
    return F.floor(F.length(_col(text)) / 4).cast("bigint")


def short_hash(text: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def chunk_id(file: Column | str, index: Column | str) -> Column:
    """Id of the chunk at a position of a file."""
    return short_hash(F.concat_ws("::", _col(file), _col(index).cast("string")))


def prefixed_hash(text: Column | str) -> Column:
    """``sha256:`` and the full digest, null for null or empty texts."""
    text = _col(text)
    return F.when(F.length(text) > 0, F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def topic_slug(topic: Column | str) -> Column:
    """Lower-case name of a topic in ``[a-z0-9_-]``; a topic of which nothing remains is an error."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(topic))), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(slug) > 0, slug).otherwise(F.raise_error(F.lit("a topic needs a name")).cast("string"))


def project_slug(path: Column | str) -> Column:
    """``parent-leaf-hash8`` of a project path; parents that say nothing are left out."""
    path = F.regexp_replace(F.translate(_col(path), "\\", "/"), r"/+$", "")
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    leaf = clean(F.regexp_extract(path, r"([^/]*)$", 1))
    parent = clean(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1))
    digest = F.substring(F.sha2(path, 256), 1, 8)
    # Folders that hold projects of any kind.
    generic = parent.isin("", "home", "users", "projects", "repos", "src", "code", "dev", "work", "documents", "desktop", "tmp")
    return F.when(generic, F.concat_ws("-", leaf, digest)).otherwise(F.concat_ws("-", parent, leaf, digest))


# --- tokens ---------------------------------------------------------------------------------------


def identifier_tokens(text: Column | str) -> Column:
    """ASCII identifiers in lower case, each followed by its camelCase and snake_case pieces unless it is one piece."""
    words = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    piece = F.lit(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+")
    pieces = lambda w: F.transform(F.regexp_extract_all(w, piece, F.lit(0)), F.lower)

    def of(w):
        # most words are lower case without underscores, and then their only piece is the word itself
        split = F.concat(F.array(F.lower(w)), F.filter(pieces(w), lambda p: p != F.lower(w)))
        return F.when((F.lower(w) == w) & ~F.contains(w, F.lit("_")), F.array(w)).otherwise(split)

    return F.flatten(F.transform(words, of))


def lower_words(text: Column | str) -> Column:
    """All runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z]+"), F.lit(0))


# Words that carry no content.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "its",
    "this", "that", "as", "at", "by", "from", "you", "your", "i", "we", "our", "they", "their", "not", "can", "will", "has", "have", "had",
    "do", "does", "if", "so", "than", "then", "there", "what", "which", "when",
)


def content_words(text: Column | str) -> Column:
    """Lower-case words of more than two letters that aren't stop words, in order and with repeats."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z']+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+")


@functools.lru_cache(maxsize=1 << 16)
def word_tokens(word: str) -> tuple[str, ...]:
    """The tokens of one identifier: the same as :func:`identifier_tokens`, for workers that walk whole texts."""
    low = word.lower()
    return (low, *(x for x in map(str.lower, _PIECE.findall(word)) if x != low))


def token_counts(text: str) -> collections.Counter:
    """The identifier tokens of a text with their counts; each distinct word is taken apart once."""
    counts: collections.Counter = collections.Counter()
    for word, n in collections.Counter(_WORD.findall(text)).items():
        for t in word_tokens(word):
            counts[t] += n
    return counts


@functools.lru_cache(maxsize=1 << 16)
def _bucket(token: str, dimensions: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions


def hashed_embedding(text: Column | str, dimensions: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of tokens by their MD5 bucket, as array of float.

    Null and empty texts give zeros. Any ``str -> array<float>`` function may take its place. Arrow batches; one pass over the tokens.
    """

    def embed(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, t in enumerate(texts.to_pylist()):
            if t:
                for token, n in token_counts(t).items():
                    out[row, _bucket(token, dimensions)] += n
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dimensions), pa.array(out.ravel()))

    return F.arrow_udf(embed, "array<float>")(_col(text))


# --- citations ------------------------------------------------------------------------------------


def citation(heading: Column | str, prefix: Column | str) -> Column:
    """The checkable citation of a section: the prefix alone for text before the first heading."""
    heading, prefix = F.coalesce(_col(heading), F.lit("")), F.coalesce(_col(prefix), F.lit(""))
    return F.when(heading.isin("Preamble", ""), F.trim(prefix)).otherwise(F.trim(F.concat_ws(" ", prefix, heading)))


def regulation_citation(title: Column | str, section: Column | str) -> Column:
    return F.trim(F.concat(_col(title).cast("string"), F.lit(" CFR "), _col(section)))


def related_citations(text: Column | str, limit: int = 5) -> Column:
    """Other citations named in the first 2000 characters, markup removed: a subset of the usual legal forms."""
    plain = F.regexp_replace(F.left(_col(text), F.lit(2000)), r"<[^>]+>", " ")
    form = r"\b\d+ C\.?F\.?R\.? (?:§+ ?)?\d[\d.]*\d|\b\d+ U\.?S\.?C\.? (?:§+ ?)?\d+|Pub\. ?L\. (?:No\. )?\d+-\d+|\b\d+ Fed\. Reg\. \d+|\b\d+ FR \d+"
    return F.slice(F.regexp_extract_all(plain, F.lit(form), F.lit(0)), 1, limit)


# --- cleaning -------------------------------------------------------------------------------------


def redact(text: Column | str, limit: int = 200) -> Column:
    """Values assigned to credential-like names become ``***REDACTED***``; cut to ``limit`` characters."""
    name = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|authorization)(\s*[=:]\s*)\S+"
    return F.left(F.regexp_replace(_col(text), name, "$1$2***REDACTED***"), F.lit(limit))


_INVISIBLE = "[​-‏‪-‮⁠-⁤﻿]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-normalised text; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _no_controls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _INVISIBLE, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def clean_snippet(text: Column | str) -> Column:
    """A search snippet on one line of at most 200 characters, without markup, entities and invisible characters."""
    t = F.coalesce(_col(text), F.lit(""))
    for entity, character in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(character))
    t = _no_controls(nfkc(F.regexp_replace(t, r"<[^>]+>", "")))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(F.length(t) > 200, F.concat(F.left(t, F.lit(197)), F.lit("..."))).otherwise(t)


def clean_code(text: Column | str, limit: int = 40_000) -> Column:
    """A source text whose layout stays: only invisible characters go, and the excess is cut with a note."""
    t = _no_controls(nfkc(F.coalesce(_col(text), F.lit(""))))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("\n... [truncated]"))).otherwise(t)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities replaced by their characters."""
    return text.map(lambda t: None if t is None else html_module.unescape(t))


def unicode_trim(text: Column | str) -> Column:
    """Trim white space of any script, not only blanks."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def strip_markdown(text: Column | str) -> Column:
    """Prose of a markdown text: without code, images, headings and emphasis; links keep their words."""
    steps = (
        (r"(?s)```.*?```", " "),
        (r"`[^`]*`", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?dm)^\s{0,3}#{1,6}\s+[^\n\r]*", ""),
        (r"[*_>]", ""),
    )
    t = _col(text)
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return t


@F.pandas_udf(T.StringType())
def mask_exempt(text: pd.Series) -> pd.Series:
    """Code and quoted spans blanked out by as many spaces, so that all positions stay."""
    spans = re.compile(r"```.*?```|`[^`\n]*`|\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”", re.S)
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    return text.map(lambda t: None if t is None else spans.sub(blank, t))


def parse_instant(text: Column | str) -> Column:
    """An ISO 8601 time as an instant: ``Z`` and offsets count, a time without zone is UTC; null if it is none."""
    t = F.trim(_col(text))
    return F.try_to_timestamp(F.when(t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))))


def covered_files(text: Column | str) -> Column:
    """Files of the first ``COVERS:`` line: comma-separated, without wrapping quotes, brackets and backticks."""
    line = F.regexp_extract(_col(text), r"(?im)^\s*(?:[-*]\s*)?covers:\s*(.*)$", 1)
    parts = F.transform(F.split(line, ","), lambda p: F.regexp_replace(p, r"^[\s`'\"\[\](){}<>]+|[\s`'\"\[\](){}<>]+$", ""))
    return F.filter(parts, lambda p: p != "")


def relative_age(then: Column | str, now: Column | str) -> Column:
    """``just now``, minutes, hours or days between two times."""
    s = F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(then))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def ellipsis(text: Column | str, width: int) -> Column:
    text = _col(text)
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


# --- languages ------------------------------------------------------------------------------------

# Languages by file suffix.
SUFFIX_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".scala": "scala", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp",
    ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".lua": "lua", ".r": "r", ".jl": "julia", ".dart": "dart",
    ".sh": "bash", ".bash": "bash", ".ps1": "powershell", ".sql": "sql", ".graphql": "graphql", ".proto": "proto", ".html": "html", ".css": "css",
    ".scss": "scss", ".less": "less", ".vue": "vue", ".svelte": "svelte", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json",
    ".xml": "xml", ".md": "markdown", ".rst": "rst", ".txt": "text",
}
# Languages that support an application without being what it is written in.
SECONDARY_LANGUAGES = (
    "markdown", "text", "rst", "pdf", "org", "asciidoc", "json", "yaml", "toml", "xml", "ini", "properties", "csv", "tsv", "psv", "jsonnet",
    "po", "gettext", "html", "css", "scss", "sass", "less", "cshtml", "vue", "svelte", "handlebars", "jinja2", "twig", "erb", "haml", "pug",
    "liquid", "mustache", "sql", "graphql", "proto", "thrift", "capnp", "starlark", "bazel", "cmake", "make", "makefile", "meson", "ninja",
    "dockerfile", "gomod", "gosum", "requirements", "gitignore", "gitattributes", "hcl", "terraform", "unknown",
)
# Embedding models by family of languages.
MODEL_FAMILIES = {
    "nomic-ai/CodeRankEmbed": ("python", "javascript", "typescript", "java", "go", "php", "ruby"),
    "Salesforce/SFR-Embedding-Code-400M_R": ("csharp", "rust", "kotlin", "swift", "c", "cpp"),
    "jinaai/jina-embeddings-v2-base-code": (
        "scala", "haskell", "lua", "bash", "shell", "sql", "r", "dart", "elixir", "erlang", "perl", "powershell", "groovy", "objective-c",
        "clojure", "fortran", "matlab", "coffeescript", "verilog", "vhdl", "prolog", "ocaml", "fsharp", "scheme", "racket", "crystal", "nim",
        "zig", "asm", "assembly",
    ),
}
FALLBACK_MODEL = "nomic-ai/CodeRankEmbed"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def language_of(path: Column | str) -> Column:
    """Language by the suffix of a path, null if it is unknown."""
    return _lookup(F.lower(F.regexp_extract(_col(path), r"(\.[^./\\]+)$", 1)), SUFFIX_LANGUAGE)


def model_of(language: Column | str) -> Column:
    """Embedding model for a language, in any case; the fallback for others."""
    table = {lang: model for model, langs in MODEL_FAMILIES.items() for lang in langs}
    return F.coalesce(_lookup(F.lower(_col(language)), table), F.lit(FALLBACK_MODEL))
