"""Edges and metrics of source files.

Python is read by its syntax tree; other languages by the heads of their imports, types and calls, which is
approximate and says so in ``confidence``.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import chunking

from corvane.functions.text import SUFFIX_LANGUAGE

EDGE_SCHEMA = "source_file string, source_symbol string, target_file string, target_symbol string, edge_type string, confidence string"

# How languages import, derive and implement.
_IMPORTS = {
    "javascript": [r"""(?m)^\s*(?:import|export)\s+(?:[^'"\n;]*?\sfrom\s+)?["']([^"'\n]+)["']""", r"""\brequire\(\s*["']([^"'\n]+)["']\s*\)"""],
    "go": [r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'(?m)^\s+(?:[\w.]+\s+)?"([^"\n]+)"\s*$'],
    "rust": [r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"],
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "kotlin": [r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)"],
    "csharp": [r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
    "ruby": [r"""(?m)^\s*require(?:_relative)?\s*\(?\s*["']([^"'\n]+)["']"""],
    "php": [r"(?m)^\s*use\s+([\w\\]+)"],
    "swift": [r"(?m)^\s*import\s+(\w+)"],
    "c": [r'(?m)^\s*#\s*include\s+[<"]([^>"\n]+)[>"]'],
    "lua": [r"""\brequire\s*\(?\s*["']([^"'\n]+)["']"""],
}
_BASES = {
    "javascript": r"\bclass\s+(\w+)\s+extends\s+([\w.]+)",
    "java": r"\b(?:class|interface)\s+(\w+)(?:<[^>\n]*>)?\s+extends\s+([\w., ]+?)\s*(?:implements|\{)",
    "csharp": r"\b(?:class|struct|record|interface)\s+(\w+)(?:<[^>\n]*>)?\s*:\s*([\w.,<> ]+?)\s*(?:where|\{)",
    "kotlin": r"\b(?:class|object|interface)\s+(\w+)(?:<[^>\n]*>)?(?:\([^)]*\))?\s*:\s*([\w.,()<> ]+?)\s*\{",
    "ruby": r"(?m)^\s*class\s+(\w+)\s*<\s*([\w:]+)",
    "swift": r"\b(?:class|struct|protocol|extension)\s+(\w+)\s*:\s*([\w, ]+?)\s*\{",
    "php": r"\bclass\s+(\w+)\s+extends\s+(\w+)",
}
_IMPLEMENTS = {
    "java": r"\bclass\s+(\w+)[^{\n]*?\bimplements\s+([\w., ]+?)\s*\{",
    "typescript": r"\bclass\s+(\w+)[^{\n]*?\bimplements\s+([\w., ]+?)\s*\{",
    "php": r"\bclass\s+(\w+)[^{\n]*?\bimplements\s+([\w, \\]+?)\s*\{",
    "rust": r"\bimpl(?:<[^>\n]*>)?\s+([\w:]+)(?:<[^>\n]*>)?\s+for\s+(\w+)",
}
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn def class new sizeof typeof await elif match when using lock foreach print super require import".split())
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?m:^\s*(?:#(?!\s*include)|--)[^\n]*)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")


def _python_edges(text: str, file: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    alias: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for n in node.names:
                alias[n.asname or n.name.split(".")[0]] = n.name
                yield "", n.name, "imports", "EXTRACTED"
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for n in node.names:
                alias[n.asname or n.name] = f"{module}.{n.name}" if module.strip(".") else module + n.name
            yield "", module, "imports", "EXTRACTED"

    def dotted(node) -> str:
        if isinstance(node, ast.Name):
            return alias.get(node.id, node.id)
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else ""
        return ""

    def walk(node, owner: str):
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                if isinstance(child, ast.ClassDef):
                    for b in child.bases:
                        if name := dotted(b):
                            yield inner, name, "inherits", "EXTRACTED"
            elif isinstance(child, ast.Call) and (name := dotted(child.func)):
                yield owner, name, "calls", "INFERRED"
            yield from walk(child, inner)

    yield from walk(tree, "")


def _other_edges(text: str, lang: str):
    family = "javascript" if lang == "typescript" else "c" if lang == "cpp" else lang
    for p in _IMPORTS.get(family, ()):
        for m in re.finditer(p, text):
            yield "", m.group(1), "imports", "EXTRACTED"
    if p := _BASES.get(family):
        for m in re.finditer(p, text):
            for base in re.split(r",", m.group(2)):
                base = re.sub(r"[<(].*", "", base).strip()
                if base:
                    interface = family == "csharp" and re.match(r"I[A-Z]", base.split(".")[-1])
                    yield m.group(1), base, "implements" if interface else "inherits", "EXTRACTED"
    if p := _IMPLEMENTS.get(lang):
        for m in re.finditer(p, text):
            pairs = [(m.group(2), m.group(1))] if lang == "rust" else [(m.group(1), b.strip()) for b in m.group(2).split(",")]
            for name, base in pairs:
                if base:
                    yield name, base, "implements", "EXTRACTED"
    aliases = _js_aliases(text) if family == "javascript" else {}
    code = _COMMENT.sub(lambda m: "\n" * m.group().count("\n") or " ", text)
    owners, heads = chunking.owners_of_lines(code, lang)
    line = at = 0
    for m in _CALL.finditer(code):
        name = m.group(1)
        line += code.count("\n", at, m.start())
        at = m.start()
        if name in _NOT_CALLS or heads.get(line) == name:
            continue
        first, dot, rest = name.partition(".")
        if first in aliases:
            name = aliases[first] + dot + rest
        if lang == "csharp" and "." in name and not looks_like_type(name.split(".")[0]):
            name = name.split(".")[-1]  # a qualifier counts only if it names a type
        yield owners[line], name, "calls", "INFERRED"


_JS_FROM = re.compile(r"\bimport\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]")
_JS_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")


def _js_aliases(text: str) -> dict[str, str]:
    """Local names of imports: a default or namespace name stands for its module, a named one for the module's member."""
    out: dict[str, str] = {}
    for names, module in [m.groups() for m in _JS_FROM.finditer(text)] + [m.groups() for m in _JS_REQUIRE.finditer(text)]:
        braces = re.search(r"\{([^}]*)\}", names)
        for part in braces.group(1).split(",") if braces else ():
            member, _, local = re.sub(r"^\s*type\s+", "", part).replace(" as ", ":").partition(":")
            if member.strip():
                out[(local or member).strip()] = f"{module}.{member.strip()}"
        for part in re.sub(r"\{[^}]*\}", "", names).split(","):
            local = part.replace("* as", "").strip()
            if re.fullmatch(r"[\w$]+", local):
                out[local] = module
    return out


def looks_like_type(name: str) -> bool:
    """Whether a C# qualifier is written like a type: it begins with an upper-case letter."""
    return name[:1].isupper()


def extract(text: str, lang: str, file: str):
    """Distinct (symbol, target symbol, type, confidence) edges of a source text."""
    return list(dict.fromkeys(_python_edges(text, file) if lang == "python" else _other_edges(text, lang)))


def extract_edges(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Edges of every source file; their targets are unresolved. Unknown languages and null contents give none."""
    names = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lang = SUFFIX_LANGUAGE.get("." + f.rsplit(".", 1)[-1].lower()) if f else None
                if lang and text:
                    rows += [(f, s, "", t, kind, sure) for s, t, kind, sure in extract(text, lang, f)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()) for c in (zip(*rows) if rows else [()] * 6)], names=names)

    return files.select(file, content).mapInArrow(run, EDGE_SCHEMA)


METRIC_SCHEMA = "loc int, functions int, classes int, complexity int, rank string, imports array<string>, calls array<string>, definitions array<string>"


def python_metrics(text: str):
    """Lines of code, counts, highest complexity of a block with its rank, and the first ten names of each kind; null if unparsable."""
    loc = sum(1 for x in text.split("\n") if x.strip() and not x.strip().startswith("#"))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return loc, None, None, None, None, None, None, None
    branching = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)

    def complexity(node) -> int:
        n = 1
        for x in ast.walk(node):
            n += isinstance(x, branching) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) + (len(x.cases) if isinstance(x, ast.Match) else 0)
        return n

    functions = [x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [x for x in ast.walk(tree) if isinstance(x, ast.ClassDef)]
    worst = max((complexity(f) for f in functions), default=0)
    rank = next(r for limit, r in ((5, "A"), (10, "B"), (20, "C"), (30, "D"), (40, "E"), (1 << 30, "F")) if worst <= limit)
    edges = extract(text, "python", "")
    first = lambda kind: list(dict.fromkeys(t for _, t, k, _ in edges if k == kind))[:10]
    return loc, len(functions), len(classes), worst, rank, first("imports"), first("calls"), [x.name for x in functions + classes][:10]


def code_metrics(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """:func:`python_metrics` of every Python file; a null content has null metrics."""
    names = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.string()] + [pa.list_(pa.string())] * 3

    def run(batches):
        for b in batches:
            rows = [python_metrics(t) if t is not None else (None,) * 8 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), type=k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds))], names=[file, *names])

    return files.where(F.lower(file).endswith(".py")).select(file, content).mapInArrow(run, f"{file} string, {METRIC_SCHEMA}")


def loc(text: Column | str) -> Column:
    """Lines that are neither blank nor only a comment, of any language, in columns alone."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*$|^\s*(?:#|//|--|\*|/\*)")))


def keyword_complexity(text: Column | str) -> Column:
    """1 and the number of branching keywords: an estimate for languages without a parser here."""
    return 1 + F.regexp_count(text, F.lit(r"\b(?:if|for|while|case|catch|elif|elsif|except|when)\b|&&|\|\|"))
