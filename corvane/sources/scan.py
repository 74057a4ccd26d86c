"""Scanning a project: which files are indexable, and why the others are not."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is source code, and what is not worth reading.
CODE_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".go", ".rs", ".java", ".kt", ".scala", ".cs", ".fs", ".vb", ".c", ".cpp", ".cc", ".h", ".hpp",
    ".rb", ".php", ".swift", ".m", ".lua", ".r", ".jl", ".dart", ".zig", ".sh", ".bash", ".zsh", ".ps1", ".sql", ".graphql", ".proto", ".html",
    ".cshtml", ".razor", ".css", ".scss", ".less", ".vue", ".svelte", ".yaml", ".yml", ".toml", ".json", ".xml", ".md", ".mdx", ".rst", ".txt",
)
SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", "vendor", ".tox", ".mypy_cache",
    ".pytest_cache", "coverage", ".coverage", "bin", "obj", "workspace", ".rag-index", "knowledge", "databases", "site-packages", ".eggs", "env",
    ".conda", ".idea", ".vscode", "htmlcov", ".ruff_cache", ".ipynb_checkpoints", ".gradle", "out", ".terraform", ".serverless", ".turbo",
    ".parcel-cache", ".svelte-kit", ".angular", "Pods", "Carthage", "DerivedData", ".playwright-mcp",
)
SKIP_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Packages.lock.json", "packages.lock.json", "npm-shrinkwrap.json", "Cargo.lock",
    "Gemfile.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "mix.lock", "go.sum", "coverage.xml", "coverage.json", "lcov.info",
)
SKIP_SUFFIXES = (
    ".min.js", ".min.css", ".bundle.js", ".d.ts", ".generated.cs", ".Designer.cs", ".g.cs", ".AssemblyInfo.cs", "_pb2.py", "_pb2_grpc.py",
    ".pb.go", ".g.dart", ".freezed.dart",
)
CREDENTIAL_NAMES = ("appsettings*.json", "local.settings.json", "secrets.json", "*.secrets.json", "*.secrets.yaml", "*.secrets.yml")
MAX_BYTES = 500_000
UNREADABLE = "__unreadable__"

# Credentials that identify themselves, names that introduce one, and values that are only stand-ins.
ISSUED_SECRETS = (
    r"(?:A3T[A-Z0-9]|ABIA|ACCA|AKIA|ASIA)[0-9A-Z]{16}",
    r"-----BEGIN\s+(?:[A-Z]+\s+)?PRIVATE KEY(?:\s+BLOCK)?-----",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bsk-[A-Za-z0-9]{32,}",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
)
SECRET_NAME = r"(?i)password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?key|auth[_-]?token|client[_-]?secret|private[_-]?key|connection[_-]?string"
ABOUT_SECRETS = r"(?i)(?:name|message|label|policy|error|hint|prompt|title|description|regex|pattern|length|enabled|required|placeholder|visible)$"
QUOTED = r"""([A-Za-z_][A-Za-z0-9_.\-]*)[]"']{0,2}\s*[:=]\s*(["'])([^"'\n]+)\2"""
ENVIRONMENT = r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_.\-]*)=([^\s#]+)[ \t]*$"
STAND_INS = (
    "example", "placeholder", "your", "yours", "changeme", "change_me", "todo", "tbd", "dummy", "sample", "test", "fake", "redacted", "xxxx",
    "insert", "replace", "notreal", "n/a", "none", "null", "empty",
)
LEAST_SECRET = 12


def read_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, length and content (binary) of all files below a folder, by Spark's binary source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "content")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def indexable(path: Column | str) -> Column:
    """Whether the suffix is that of source code."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*CODE_EXTENSIONS)


def in_skipped_folder(path: Column | str, more: tuple[str, ...] = ()) -> Column:
    """Whether any folder of the path is one that is never scanned."""
    path = F.col(path) if isinstance(path, str) else path
    folders = F.split(F.regexp_replace(path, r"[^/]*$", ""), "/")
    return F.exists(folders, lambda f: f.isin(*SKIP_DIRS, *more))


def _glob(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")


def looks_secret(text: Column) -> Column:
    """Whether a text carries a live credential.

    A credential of an issuer's format decides alone. Otherwise a literal must be assigned to a credential-like name, be at
    least twelve characters long without trailing punctuation, and be neither a stand-in nor prose.
    """
    issued = F.lit(False)
    for p in ISSUED_SECRETS:
        issued = issued | text.rlike(p)

    def live(name: Column, value: Column) -> Column:
        v = F.regexp_replace(F.trim(value), r"""[.,;:!?)\]`]+$""", "")
        templated = v.rlike(r"^\{.*\}$|^<.*>$|^\$\{.*\}$|^%.*%$")
        stand_in = F.exists(F.array(*(F.lit(s) for s in STAND_INS)), lambda s: F.contains(F.lower(v), s))
        prose = F.contains(v, F.lit(" ")) & ~(F.contains(v, F.lit(";")) & F.contains(v, F.lit("=")))
        return name.rlike(SECRET_NAME) & ~name.rlike(ABOUT_SECRETS) & (F.length(v) >= LEAST_SECRET) & ~templated & ~stand_in & ~prose

    def assigned(pattern: str, value_group: int) -> Column:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        return F.exists(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: live(p["n"], p["v"]))

    return F.coalesce(issued | assigned(QUOTED, 3) | assigned(ENVIRONMENT, 2), F.lit(False))


def exclusion_reason(path: Column, size: Column, binary: Column, secret: Column) -> Column:
    """The first reason why a file isn't indexed, cheapest first; null if it is."""
    name = name_of(path)
    generated = F.lit(False)
    for s in SKIP_SUFFIXES:
        generated = generated | F.endswith(name, F.lit(s))
    credentials = F.lower(name).rlike("|".join(_glob(g) for g in CREDENTIAL_NAMES))
    return (
        F.when(name.isin(*SKIP_FILES), "generated file")
        .when(generated, "generated suffix")
        .when(credentials, "credential config")
        .when(~indexable(path), "extension")
        .when(size > MAX_BYTES, "too large")
        .when(binary, "binary")
        .when(secret, "secret")
    )


def outside_virtualenvs(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that lie in no virtual environment: in no folder, at whatever depth, that holds a ``pyvenv.cfg``, whatever its name.

    An equi-join of every file's folders with the marked ones.
    """
    marked = files.where(F.col(path).rlike(r"(?:^|/)pyvenv\.cfg$")).select(F.regexp_replace(path, r"/?pyvenv\.cfg$", "").alias("__root")).where("__root <> ''").distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = files.select(F.col(path).alias("__path"), F.explode(above).alias("__root")).join(marked, "__root").select("__path").distinct()
    return files.join(inside, F.col(path) == F.col("__path"), "left_anti")


def scan(files: DataFrame, more_skipped: tuple[str, ...] = ()) -> DataFrame:
    """path, content (text) and hash of the indexable files of ``files`` (path, length, content as bytes).

    Those of virtual environments and skipped folders are left out. Files that aren't UTF-8 keep their row with a null text and the hash ``__unreadable__``.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    kept = outside_virtualenvs(files).where(~in_skipped_folder("path", more_skipped)).withColumn("text", text)
    reason = exclusion_reason(F.col("path"), F.col("length"), looks_binary(F.col("content")), looks_secret(F.coalesce("text", F.lit(""))))
    digest = F.when(F.col("text").isNotNull(), F.substring(F.sha2("text", 256), 1, 16)).otherwise(F.lit(UNREADABLE))
    return kept.where(reason.isNull()).select("path", F.col("text").alias("content"), digest.alias("hash"))


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A rule of an ignore file as (regular expression on project-relative paths, whether it includes again)."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    again = rule.startswith("!")
    rule = rule[1:] if again else rule
    folder = rule.endswith("/")
    body = rule.strip("/")
    anchored = rule.startswith("/") or "/" in body
    out = ""
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), again


def drop_ignored(files: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    """Files that no rule ignores; the last matching rule decides. The rules are a short list and become one expression."""
    ignored = F.lit(False)
    for rule in rules:
        if parsed := ignore_regex(rule):
            ignored = F.when(F.col(path).rlike(parsed[0]), F.lit(not parsed[1])).otherwise(ignored)
    return files.where(~ignored)
