"""Functions and methods paired with their documentation.

Every source text gives rows of a symbol table: definitions and bodiless declarations with their qualified name (namespaces, outer classes, class),
normalised signature and the documentation that stands with them. A definition that has none of its own takes
the one of a documented declaration of the same qualified name and signature, which may lie in another file (a
header, an overload list, a stub file), or of the same method of an interface or base that its class names; that is a join of the table with itself.
Which documentation a definition gets is chosen after the join, and trivial documentation is filtered last, so that a
stub above a definition doesn't hide the text above its declaration.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import canonical_path
from corvane.session import materialize

# Languages by file suffix, and what a head of a function looks like in each of them.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js",
    ".go": "go", ".rs": "rust", ".java": "java", ".cs": "java", ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby",
    ".lua": "lua", ".sh": "shell", ".bash": "shell", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c",
}
_PARAMS = r"\((?P<params>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
_GENERIC = r"(?:<[^<>\n;]*(?:<[^<>\n;]*>[^<>\n;]*)*>)?"
_PY_TOKEN = re.compile(
    r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*"
    r"|^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=[(\[])|^(?P<cindent>[ \t]*)class[ \t]+(?P<cname>\w+)[ \t]*(?:\((?P<bases>[^()\n]*)\))?",
    re.M,
)
_PY_STRING = re.compile(
    r"(?:[rRuU]?)(?:\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)'''|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)')[ \t]*(?:;|#[^\n]*)?(?=\r?\n|\r|\Z)"
)
_HEADS = {
    "js": [
        rf"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[A-Za-z_$][\w$]*)[ \t]*{_GENERIC}[ \t]*{_PARAMS}(?P<rest>[ \t]*(?::[^{{;\n]*(?:\{{[^{{}}\n]*\}}[^{{;\n]*)?)?(?P<end>[{{;]|$))",
        rf"(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?(?:function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*{_GENERIC}[ \t]*{_PARAMS}|{_GENERIC}{_PARAMS.replace('params', 'params2')}[ \t]*(?::[^=\n]+)?=>|(?P<params3>[A-Za-z_$][\w$]*)[ \t]*=>)(?P<end>)",
        rf"(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)[ \t]+)*\*?(?P<name>[#A-Za-z_$][\w$]*)[ \t]*{_GENERIC}{_PARAMS}[ \t]*(?::[^{{;\n]+)?(?P<end>\{{)",
        # a method of an interface or an abstract one: counts right within the braces of its container only
        rf"(?:(?:public|private|protected|static|async|override|readonly|abstract)[ \t]+)*(?P<name>[A-Za-z_$][\w$]*)[ \t]*\??{_GENERIC}{_PARAMS}[ \t]*:[^{{;\n]+(?P<end>;|$)",
    ],
    "go": [rf"func[ \t]+(?:\((?P<owner>[^()\n]*)\)[ \t]*)?(?P<name>[A-Za-z_]\w*)[ \t]*(?:\[[^\]\n]*\])?{_PARAMS}(?P<end>)"],
    "rust": [
        rf"(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:default[ \t]+)?(?:const[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?(?:extern[ \t]+(?:\"[^\"\n]*\"[ \t]+)?)?fn[ \t]+(?P<name>\w+)[ \t]*{_GENERIC}[ \t]*{_PARAMS}[^{{;]*(?P<end>[{{;])"
    ],
    "java": [
        rf"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|sealed|unsafe|native|default|new|extern|partial|strictfp|readonly)[ \t]+)*(?:<[^<>\n]+>[ \t]+)?(?P<type>[A-Za-z_][\w.]*{_GENERIC}(?:[ \t]*\[[ \t,]*\])*\??)[ \t]+(?P<name>[A-Za-z_]\w*)[ \t]*{_GENERIC}{_PARAMS}[ \t]*(?:throws[^{{;]+|where[^{{;]+)?\s*(?P<end>[{{;]|=>)"
    ],
    "kotlin": [
        rf"(?:(?:public|private|protected|internal|suspend|inline|override|open|abstract|operator|infix|tailrec|final|external|actual|expect|noinline|crossinline)[ \t]+)*fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w<>?, ]+\.)?(?P<name>\w+|`[^`\n]+`)[ \t]*{_PARAMS}(?P<rest>[ \t]*(?::[ \t]*[^{{=\n]+)?)(?P<end>[{{=]|$)"
    ],
    "ruby": [r"(?:(?:private|public|protected|module_function|memoize|private_class_method)[ \t]+)?def[ \t]+(?:[A-Za-z_]\w*\.)?(?P<name>[A-Za-z_]\w*[?!=]?|\[\]=?|[-+*/%<>=!~^&|]+)(?:[ \t]*\((?P<params>[^()\n]*(?:\([^()\n]*\)[^()\n]*)*)\))?(?P<end>)"],
    "lua": [
        rf"(?:local[ \t]+)?function[ \t]+(?P<name>[A-Za-z_][\w.:]*)[ \t]*{_PARAMS}(?P<end>)",
        rf"(?:local[ \t]+)?(?P<name>[A-Za-z_][\w.]*)[ \t]*=[ \t]*function[ \t]*{_PARAMS}(?P<end>)",
    ],
    "shell": [r"(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<name2>[A-Za-z_][\w:.-]*)[ \t]*\([ \t]*\))\s*(?P<end>[{(])"],
    "c": [
        rf"(?:template[ \t]*<[^>\n]*>[ \t]*)?(?P<type>(?:[A-Za-z_][\w:]*{_GENERIC}[ \t*&]+)+)(?P<owner>(?:[A-Za-z_]\w*::)*)(?P<name>~?[A-Za-z_]\w*)[ \t]*{_PARAMS}[ \t]*(?:const[ \t]*)?(?:noexcept[ \t]*)?(?:override[ \t]*)?\s*(?P<end>[{{;])"
    ],
}
_HEADS = {lang: [re.compile(r"^(?P<indent>[ \t]*)" + h, re.M) for h in heads] for lang, heads in _HEADS.items()}
_KEYWORDS = frozenset(
    "if else for foreach while switch case catch return new throw do try finally using lock synchronized sizeof typeof await yield "
    "delete in of function elif until select defer go goto fixed checked unchecked assert when with super this import package with "
    "constructor".split()
) - {"constructor"}
_CONTAINER = {
    "js": re.compile(r"^(?P<indent>[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:class|interface|namespace|module)[ \t]+(?P<name>[\w$.]+)", re.M),
    "java": re.compile(r"^(?P<indent>[ \t]*)(?:\w+[ \t]+)*?(?:class|interface|enum|record|struct|namespace)[ \t]+(?P<name>[\w.]+)", re.M),
    "kotlin": re.compile(r"^(?P<indent>[ \t]*)(?:\w+[ \t]+)*?(?:class|interface|object)[ \t]+(?P<name>\w+)", re.M),
    "rust": re.compile(r"^(?P<indent>[ \t]*)(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:unsafe[ \t]+)?(?:impl(?:<[^>\n]*>)?[ \t]+(?:(?P<trait>[\w:]+)(?:<[^>\n]*>)?[ \t]+for[ \t]+)?|trait[ \t]+|mod[ \t]+)(?P<name>\w+)", re.M),
    "ruby": re.compile(r"^(?P<indent>[ \t]*)(?:class|module)[ \t]+(?P<name>[\w:]+)", re.M),
    "c": re.compile(r"^(?P<indent>[ \t]*)(?:class|struct|union|namespace)[ \t]+(?P<name>[\w:]+)(?=[^;{}()=\n]*\s*\{)", re.M),
}
# Strings, comments and braces; what looks like a string in one language is a lifetime or a quote in another.
_BRACES = {
    "js": re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[{}]"),
    "": re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^'\n]*|[^'\\\n])'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[{}]"),
}
_BASE = re.compile(r"(?:\bextends|\bimplements|:|,)\s*(?:(?:public|private|protected|virtual)\s+)*(?:[A-Za-z_]\w*(?:\.|::))*([A-Za-z_]\w*)")
# Words of parameters that are no names, and those that are no types.
_TYPE_WORDS = frozenset("int long short char unsigned signed float double void bool boolean byte size_t string object".split())
_MODIFIERS = frozenset("final const out ref in params readonly register volatile struct enum union class mut vararg crossinline noinline".split())

_LINE_SIGN = {
    "js": ("//",), "go": ("//",), "rust": ("//",), "java": ("//",), "kotlin": ("//",), "c": ("//",),
    "ruby": ("#",), "shell": ("#",), "python": ("#",), "lua": ("--",),
}
_BLOCKS = {"ruby": ("=begin", "=end"), "lua": ("--[[", "]]"), "shell": None, "python": None}
_BETWEEN = {
    "js": re.compile(r"@[\w$.]+"),
    "python": re.compile(r"@[\w.]+"),
    "java": re.compile(r"@[\w.]+|\[[\w(]"),
    "kotlin": re.compile(r"@[\w.:]+"),
    "rust": re.compile(r"#!?\["),
    "c": re.compile(r"__attribute__|\[\[|__declspec|template[ \t]*<"),
    "ruby": re.compile(r"\bsig[ \t]*\{"),
    "go": None, "lua": None, "shell": None,
}

# Comments that speak to tools.
_DIRECTIVE = re.compile(
    r"^(?:!|no-?lint\b|nolint|go:\w+|\+build\b|lint:|export \w+$|line \S+:\d|@ts-|ts-(?:ignore|nocheck|expect)|eslint|tslint|jshint|jslint|jscs|"
    r"prettier-|istanbul|c8 |v8 |webpack|@flow|flow(?:lint)?:|(?-i:globals?\s+[\w$]+(?:\s*[,:]\s*[\w$]+)*\s*$)|pylint[: ]|noqa|(?-i:type:)|mypy[: ]|pyright[: ]|flake8[: ]|ruff[: ]|"
    r"isort[: ]|fmt:|yapf[: ]|pragma\b|nosec|bandit|coverage:|-\*-|vim?:|ex:|rubocop|frozen_string_literal|encoding:|steep:|sorbet|typed:|:nodoc:|:nocov:|"
    r"shellcheck|luacheck|@diagnostic|selene|stylua|clang-format|clang-tidy|NOLINT|NOSONAR|noinspection|@?formatter:|checkstyle|"
    r"@?suppress(?:warnings|lint|message)?\s*[(:]|ktlint|detekt|resharper|#?(?:end)?region\b[^.]*$|clippy|rustfmt|cspell|codespell|spell-?checker|sourcery|"
    r"IWYU|GCOVR?_|LCOV_|cppcheck|@codeCoverageIgnore|phpcs|biome-ignore|deno-(?:lint|fmt)|@jsx|@vitest|@jest)",
    re.I,
)
# Lines about parameters and results, and sections of them.
_TAG = re.compile(
    r"^(?:[@\\](?:params?|arg(?:ument)?s?|tparam|typeparam|template|returns?|retval|result|yields?|type|rtype|throws?|exception|raises?|see|since|author|"
    r"version|deprecated|property|prop|field|option|example|private|public|protected|static|async|override|inheritdoc|memberof|class|constructor|generic|treturn|"
    r"function|fn|method|name|brief(?=\s*$)|callback|overload|api|yieldparam|yieldreturn|receiver|sample|suppress|this|todo)\b"
    r"|:(?:params?|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|except|exception|yields?|ytype|var|ivar|cvar|meta)\b[^:]*:"
    r"|(?:params?|parameters?|args?|arguments?|returns?|return values?|yields?|raises|throws|inputs?|outputs?)\s*:(?!:)"
    r"|-\s*parameters?\b|-\s*returns?\b)",
    re.I,
)
_XML_TAG_LINE = re.compile(r"<(param|typeparam|returns|exception|value|paramref|response)\b[^>]*?(?:/>|>[\s\S]*?(?:</\1>|\Z))", re.I)
_SECTION = re.compile(
    r"^(?:#+\s*|\*\*)?(?:args|arguments|params|parameters|other parameters|keyword args|keyword arguments|returns?|yields?|raises|throws|attributes|errors|panics|safety)"
    r"(?:\*\*)?\s*:?(?:\*\*)?\s*$",
    re.I,
)
_XML = re.compile(r"</?[A-Za-z][\w:.-]*(?:\s[^<>\n]*)?/?>")
_INLINE = re.compile(r"\{@\w+\s*([^{}]*)\}")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
_UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
_UNSPACED_CHAR = re.compile(f"[{_UNSPACED}]")
_NAME_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_TODO = re.compile(r"^\W*(?:@?todo|to-do|to do\s*[:\-–(]|fixme|xxx+|tbd|tbc|tba|hack\s*:|wip|pending\s*:|needs? doc)", re.I)
_STUB = re.compile(
    r"auto-?\s?generated\s+(?:\w+\s+)?(?:stub|method|function|constructor|doc|comment)|\bgoes here\b|\b(?:add|insert|write|put|fill in|fill out|provide|enter)\s+"
    r"(?:an?\s+|the\s+|some\s+|your\s+|more\s+|missing\s+|proper\s+|better\s+)*(?:doc(?:string|umentation|s)?|descriptions?|comments?|summary|text|explanation|details?)\b|"
    r"\b(?:description|documentation|docstring|summary|docs?|comment|text)\s+(?:(?:is|are|was|to be|to)\s+)*(?:missing|pending|needed|required|follows?|come|added|written|filled|tbd|todo|placeholder|here)\b|"
    r"\b(?:missing|no|placeholder)\s+(?:for\s+)?(?:the\s+)?(?:doc(?:string|umentation|s)?|descriptions?|summary|comments?)\b|\b(?:not|un)\s?-?documented(?: yet)?\b|"
    r"\bto be (?:documented|written|filled|completed|described|done|added)\b|\blorem ipsum\b|\bplaceholder\b|_summary_|_description_|"
    r"^\s*[\[<{(](?:short |brief |long |insert |add |your )?(?:description|summary|documentation|docs?|text|todo|explanation)\b[^\n]*[\]>})]\s*$|\bdocument (?:this|me)\b|\[(?:description|summary|type|todo)\]|\bfill (?:me|this) in\b|\bdescribe (?:this|what|the (?:function|method|purpose))\b[^.]*here|\byour (?:description|comment|documentation) here\b",
    re.I,
)
_CODE_LINE = re.compile(
    r"^(?:[A-Za-z_$@][\w$.:>\-]*(?:<[^<>]*>)?\([^。]*\)\s*[;{]?\s*$"
    r"|[A-Za-z_$@*&][\w$.\[\]>\-]*(?:\s+[A-Za-z_$*&][\w$.\[\]]*)?\s*(?::=|[+\-*/|&^%]?=)(?!=)\s*\S.*"
    r"|.*[;{]\s*$|[}\])]+[;,]?\s*$|return\s+(?:\S+\s*$|-?\d+\b.*)"
    r"|(?:return|const|let|var|local|import|from|def|fn|func|function|fun|if|elif|elsif|else|for|while|switch|case|end|defer|print|echo|export|await|yield|throw|raise|del|pass|break|continue|require|include|use|using|unless|do|done|fi|then)\b(?:\s*$|(?=.*(?:\w\(|[{}\[\]=;$]))[^.]*$)"
    r"|(?:if|elif|for|while|with|try|except|else|def|class)\b[^.]*:\s*$"
    r"|[a-z_][\w-]*\s+(?:-{1,2}\w[\w-]*|\"?\$[\w{(]).*|.*(?:>\s*/dev/null|\|\||&&|2>&1).*)$"
)
_ARTICLES = frozenset(("a", "an", "the"))
_ENDINGS = ("", "s", "es", "ed", "d", "ing", "er", "ers", "r", "rs", "or", "ors", "ion", "ions", "ation", "ations", "ment", "ments", "ings", "n", "al", "able", "ted", "ting", "ly")


def _is_form(word: str, piece: str) -> bool:
    """Whether ``word`` is an inflected form of ``piece``."""
    stems = {piece, piece + piece[-1:]}
    if piece[-1:] in "ey":
        stems.add(piece[:-1])
    if piece[-1:] == "y":
        stems.add(piece[:-1] + "i")
    return any(word.startswith(s) and word[len(s) :] in _ENDINGS for s in stems if len(s) > 1 or s == word)


def clean_documentation(doc: str) -> str:
    """The text of a documentation without comment signs, markup, directives, lines about parameters and
    results and commented-out code."""
    text = _XML_TAG_LINE.sub("", doc)
    text = _INLINE.sub(r"\1", text)
    kept: list[str] = []
    section: int | None = None
    underlined = in_tag = False
    for raw in text.splitlines():
        line = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if not line:
            in_tag = False
            continue
        if section is not None and not _SECTION.match(line):
            if set(line) <= set("-=~"):
                underlined = True
            if indent > section or underlined:
                continue
            section = None
        if _SECTION.match(line):
            section, underlined, in_tag = indent, False, False
            continue
        if _TAG.match(line):
            in_tag = True
            continue
        if in_tag and indent > 1 and raw[:1] in " \t" and not _WORD.match(raw[:1]):
            continue  # a tag's text goes on
        in_tag = False
        line = _XML.sub(" ", line).strip()
        if not line or _DIRECTIVE.match(line) or _CODE_LINE.match(line):
            continue
        kept.append(line)
    return "\n".join(kept)


def is_trivial(clean: str, name: str) -> bool:
    """Whether a cleaned documentation says nothing about the function ``name``."""
    unspaced = len(_UNSPACED_CHAR.findall(clean))
    words = [w.lower() for w in _WORD.findall(_UNSPACED_CHAR.sub(" ", clean) if unspaced else clean)]
    if len(words) < 4 and unspaced < 8:
        return True
    if _TODO.match(clean) or _STUB.search(clean):
        rest = "\n".join(x for x in re.split(r"\n|(?<=[.!?])\s+", clean) if not (_TODO.match(x) or _STUB.search(x)))
        if rest == clean or len(_WORD.findall(rest)) < 4 and len(_UNSPACED_CHAR.findall(rest)) < 8:
            return True
    if unspaced:
        return False
    pieces = {p.lower() for p in _NAME_PIECE.findall(name)} | {name.lower()}
    said = [p for w in words for p in ([w] if w in pieces else re.split(r"[.\-'’]", w)) if p and p not in _ARTICLES]
    return all(any(_is_form(w, p) for p in pieces) for w in said)


def _parameters(params: str) -> list[str]:
    """The parameters of a list, without their defaults and annotations."""
    depth, part, parts = 0, "", []
    for c in params:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += c
    parts.append(part)
    cut = (re.sub(r"@[\w.]+(?:\([^()]*\))?", " ", re.split(r"(?<![<>!=])=(?![=>])", p)[0]).strip() for p in parts)
    return [p for p in cut if p]


def _type_first(p: str) -> str:
    """The type of a parameter that is written before its name, or without one."""
    words = [w for w in re.sub(r"([*&\[\]]|\.\.\.)", r" \1 ", p).split() if w not in _MODIFIERS]
    names = [i for i, w in enumerate(words) if re.fullmatch(r"\w+", w) and w not in _TYPE_WORDS]
    plain = [w for w in words if re.match(r"\w", w)]
    if len(plain) > 1 and names and names[-1] == max(i for i, w in enumerate(words) if re.match(r"\w", w)):
        del words[names[-1]]
    return " ".join(words)


def normal_signature(params: str | None, lang: str = "") -> str:
    """The types of the parameters, without names, defaults, modifiers and white space; their number where no types are given."""
    parts = [p for p in _parameters(params or "") if p.lstrip("&").split(":")[0].strip() not in ("self", "cls", "mut self", "this", "/", "*")]
    if parts == ["void"] and lang == "c":
        parts = []
    if lang == "go":
        pairs = [p.split(None, 1) for p in parts]
        named, types, last = any(len(p) > 1 for p in pairs), [], ""
        for p in reversed(pairs):  # a name without a type has the one that follows
            last = p[1] if len(p) > 1 else last if named else p[0]
            types.insert(0, re.sub(r"\s+", "", last))
    elif any(":" in re.sub("::", "", p) for p in parts):
        types = [re.sub(r"\s+", "", p.split(":", 1)[1]) if ":" in p else "" for p in parts]
    elif lang in ("", "java", "c"):
        types = [_type_first(p) if lang or re.search(r"\w[\s*&]+\w", p) else "" for p in parts]
    else:
        types = []
    return f"{len(parts)}:{','.join(types)}" if any(types) else str(len(parts))


def _lines(text: str) -> tuple[list[str], list[int]]:
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    return lines, starts


def _python(text: str):
    containers: list[tuple[int, str, list[str]]] = []
    lines = starts = None
    for m in _PY_TOKEN.finditer(text):
        name = m.group("name")
        if m.group("cname"):
            depth = len(m.group("cindent").expandtabs())
            containers = [c for c in containers if c[0] < depth] + [(depth, m.group("cname"), re.findall(r"(\w+)\s*(?:,|$)", m.group("bases") or ""))]
            continue
        if name is None:
            continue
        indent = len(m.group("indent").expandtabs())
        at, depth, n = m.end(), 0, len(text)
        # to the colon that ends the signature
        for t in _PY_SIGNATURE.finditer(text, at):
            c = t.group()
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and depth == 0:
                at = t.end()
                break
            elif c == "\n" and depth == 0:
                break
        else:
            at = n
        if at == m.end():
            continue
        params = text[m.end() : at]
        params = params[params.find("(") + 1 : params.rfind(")")] if "(" in params else ""
        body = _PY_GAP.match(text, at)
        string = _PY_STRING.match(text, body.end())
        doc = next((g for g in string.groups() if g is not None), None) if string else None
        containers = [c for c in containers if c[0] < indent]
        if doc is None or is_trivial(clean_documentation(doc), name):
            if lines is None:
                lines, starts = _lines(text)
            above = _comment_above(lines, bisect.bisect_right(starts, m.start()) - 1, "python")
            if above is not None and (doc is None or not is_trivial(clean_documentation(above), name)):
                doc = above
        yield m.start(), at, indent, name, ".".join(c[1] for c in containers), containers[-1][2] if containers else [], params, True, doc


_PY_SIGNATURE = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|[()\[\]{}:\n]")
_PY_GAP = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*")


def _strip_sign(line: str, lang: str) -> str:
    """A comment line without its sign, keeping its indentation behind the sign."""
    s = line.strip()
    for sign in _LINE_SIGN[lang]:
        if s.startswith(sign):
            s = s[len(sign) :]
            while s[:1] and (s[0] == sign[-1] or (sign == "//" and s[0] == "!")):
                s = s[1:]
            return s
    return s


def _block_text(lines: list[str]) -> list[str]:
    """The lines of a /* */ comment without its signs."""
    out = []
    for i, line in enumerate(lines):
        s = line.strip() if i == 0 else line.rstrip()
        if i == 0:
            s = re.sub(r"^/\*+!?", "", s)
        if i == len(lines) - 1:
            s = re.sub(r"\**\*/\s*$", "", s)
        if i:
            s = re.sub(r"^\s*\*(?!/)", "", s)
        out.append(s)
    return out


def _comment_above(lines: list[str], at: int, lang: str) -> str | None:
    """The unbroken block of comment lines that ends right above line ``at``; annotations may stand between."""
    i = at - 1
    between = _BETWEEN[lang]
    while between is not None and i >= 0:
        s = lines[i].strip()
        if between.match(s):
            i -= 1
            continue
        if s[-1:] in ")]," and not s.startswith(("//", "*", "/*", "#", "--")):
            j = i - 1
            while j >= 0 and i - j < 8 and lines[j].strip() and not between.match(lines[j].strip()):
                j -= 1
            if j >= 0 and i - j < 8 and between.match(lines[j].strip()) and lines[j].rstrip()[-1:] in "([{,":
                i = j - 1
                continue
        break
    signs = _LINE_SIGN[lang]
    found: list[list[str]] = []
    while i >= 0:
        s = lines[i].strip()
        if not s:
            break
        block = _BLOCKS.get(lang, ("/*", "*/"))
        if block and s.endswith(block[1]) and not (lang == "ruby" and s != "=end"):
            j = i
            while j >= 0 and block[0] not in lines[j]:
                j -= 1
            if j < 0 or not lines[j].strip().startswith(block[0]):
                break
            if block[0] == "/*":
                found.append(_block_text(lines[j : i + 1]))
            else:
                inner = "\n".join(lines[j : i + 1]).strip()
                found.append(inner[len(block[0]) : -len(block[1])].splitlines())
            i = j - 1
        elif s.startswith(signs):
            found.append([_strip_sign(lines[i], lang)])
            i -= 1
        else:
            break
    return "\n".join(x for part in reversed(found) for x in part) if found else None


_OPENS = re.compile(r"\s*[{=]")
_BLOCK_COMMENT = re.compile(r"^[ \t]*/\*[\s\S]*?(?:\*/|\Z)", re.M)


class _Nesting:
    """What encloses a place of a text: the chain of its containers with their bases, by braces or else by indentation."""

    def __init__(self, text: str, lang: str):
        self.by_braces = lang in ("js", "java", "kotlin", "rust", "c")
        heads = list(_CONTAINER[lang].finditer(text)) if lang in _CONTAINER else []
        self.opens: list[int] = []
        self.closes: list[int] = []
        self.parents: list[int] = []
        self.named: dict[int, tuple[str, list[str]]] = {}
        self.heads = [(m.start(), len(m.group("indent").expandtabs()), m.group("name").replace("::", ".")) for m in heads]
        if not self.by_braces or (not heads and lang != "c"):
            return
        stack: list[int] = []
        for t in _BRACES.get(lang, _BRACES[""]).finditer(text):
            if t.group() == "{":
                self.parents.append(stack[-1] if stack else -1)
                stack.append(len(self.opens))
                self.opens.append(t.start())
                self.closes.append(len(text))
            elif t.group() == "}" and stack:
                self.closes[stack.pop()] = t.start()
        for m in heads:
            i = bisect.bisect_left(self.opens, m.end())
            if i == len(self.opens) or i in self.named:
                continue
            between = text[m.end() : self.opens[i]]
            if ";" in between or "\n\n" in between:
                continue  # a container without a body
            bases = _BASE.findall(re.sub(r"<[^<>]*>|\([^()]*\)", "", between))
            trait = m.groupdict().get("trait")
            self.named[i] = (m.group("name").replace("::", "."), bases + ([trait.split("::")[-1]] if trait else []))

    def block(self, at: int) -> int:
        """The innermost block around ``at``, -1 outside of all."""
        i = bisect.bisect_left(self.opens, at) - 1
        while i >= 0 and self.closes[i] < at:
            i = self.parents[i]
        return i

    def of(self, at: int, indent: int) -> tuple[list[str], list[str], bool]:
        """The names of the containers from the outside in, the bases of the innermost, and whether nothing else lies between."""
        if not self.by_braces:
            chain: list[tuple[int, str]] = []
            for start, depth, name in self.heads:
                if start >= at:
                    break
                chain = [c for c in chain if c[0] < depth] + [(depth, name)]
            return [name for depth, name in chain if depth < indent], [], True
        i = self.block(at)
        direct, names, bases = i < 0 or i in self.named, [], None
        while i >= 0:
            if i in self.named:
                names.insert(0, self.named[i][0])
                bases = self.named[i][1] if bases is None else bases
            i = self.parents[i]
        return names, bases or [], direct


def _others(text: str, lang: str):
    lines = starts = nesting = None
    hidden: list[tuple[int, int]] | None = None
    seen: set[int] = set()
    for number, head in enumerate(_HEADS[lang]):
        for m in head.finditer(text):
            g = m.groupdict()
            name = g.get("name") or g.get("name2")
            if name in _KEYWORDS or m.start() in seen:
                continue
            if "type" in g and g["type"].split(None, 1)[0] in _KEYWORDS | {"typedef", "extern"}:
                continue
            end = g.get("end")
            if lang in ("java", "c") and end == ";" and "=" in (g.get("type") or ""):
                continue
            if lines is None:
                lines, starts = _lines(text)
                hidden = [x.span() for x in _BLOCK_COMMENT.finditer(text)] if lang not in ("ruby", "lua", "shell") and "/*" in text else []
                nesting = _Nesting(text, lang)
            if hidden:
                k = bisect.bisect_right(hidden, (m.start(), len(text))) - 1
                if k >= 0 and hidden[k][0] <= m.start() < hidden[k][1]:
                    continue
            indent = len(m.group("indent").expandtabs())
            names, bases, direct = nesting.of(m.start() + len(m.group("indent")), indent)
            bodiless_method = lang == "js" and number == 3
            if bodiless_method and not (direct and names):
                continue  # a call or the arm of a conditional, not a method
            if lang == "c" and end == ";" and not (direct and (names or not m.group("indent"))):
                continue  # a call or a variable within a function
            if lang == "c" and end == ";" and not names and not re.search(r"[A-Za-z_]\w*[ \t*&]+\**\w+|^\s*(?:void)?\s*$|^[\w\s*&,]*\b(?:int|char|long|short|float|double|unsigned|bool)\b", g["params"] or ""):
                continue  # a call, not a prototype
            seen.add(m.start())
            line = bisect.bisect_right(starts, m.start() + len(m.group("indent"))) - 1
            params = next((g[p] for p in ("params", "params2", "params3") if g.get(p)), "")
            if lang == "go":
                names = re.sub(r"\[[^\]]*\]", "", g.get("owner") or "").replace("*", " ").split()[-1:]
            elif g.get("owner"):
                names = names + [x for x in g["owner"].split("::") if x]
            bare = re.split(r"[.:]", name)[-1] if lang == "lua" else name.strip("`#")
            if lang == "lua" and name != bare:
                names = [name[: -len(bare) - 1]]
            # a head that ends with its line has a body if that begins on the next one
            open_ended = end == "" and g.get("rest") is not None
            defined = end != ";" and not bodiless_method and (not open_ended or _OPENS.match(text, m.end()) is not None)
            yield m.start(), m.end(), indent, bare, ".".join(names), bases, params, defined, _comment_above(lines, line, lang)


_INDENT = re.compile(r"[ \t]*")


def _code(text: str, start: int, head_end: int, indent: int, lang: str) -> str:
    """The definition from its head to its end, by indentation."""
    at = text.find("\n", head_end)
    while at >= 0:
        stop = text.find("\n", at + 1)
        line = text[at + 1 : stop if stop >= 0 else len(text)]
        s = line.strip()
        if s and len(_INDENT.match(line).group().expandtabs()) <= indent:
            if lang == "python":
                return text[start:at].rstrip()
            if s[0] in "})" or s.startswith("end"):
                return text[start : at + 1 + len(line)].rstrip()
            if s[0] != "{":
                return text[start:at].rstrip()
        at = stop
    return text[start:].rstrip()


def symbols_of(text: str, lang: str, with_code: bool = True):
    """(name, container, bases, signature, is_definition, doc, code, start) of every function in a source text."""
    found = _python(text) if lang == "python" else _others(text, lang)
    for start, end, indent, name, container, bases, params, defined, doc in found:
        code = _code(text, start, end, indent, lang) if with_code and defined else None
        yield name, container, bases, normal_signature(params, lang), defined, doc, code, start


SYMBOL_SCHEMA = (
    "origin string, rec_id string, scope string, file string, lang string, name string, container string, bases array<string>, signature string, "
    "defined boolean, doc string, clean string, trivial boolean, code string, start bigint"
)


def symbol_table(sources: DataFrame, with_code: bool = True) -> DataFrame:
    """One row per function definition or declaration in ``sources`` (origin, rec_id, project, file, content).

    The language goes by the suffix of the file; files of other languages, null files and null or empty contents
    give no rows. ``scope`` is the project, or the first folder of the path where that is null; functions of stub files (.pyi)
    are declarations. ``start`` is the place in the text. ``trivial`` is null where there is no documentation.
    """
    names = [c.split()[0] for c in SYMBOL_SCHEMA.split(", ")]
    kinds = {"defined": pa.bool_(), "trivial": pa.bool_(), "bases": pa.list_(pa.string()), "start": pa.int64()}

    def run(batches):
        for b in batches:
            rows = []
            cols = (b.column(c).to_pylist() for c in ("origin", "rec_id", "project", "file", "content"))
            for origin, rec, project, file, text in zip(*cols):
                dot = file.rfind(".")
                suffix = file[dot:].lower() if dot >= 0 else ""
                lang = LANGUAGES.get(suffix)
                if lang is None or not text:
                    continue
                scope = project if project is not None else file.split("/", 1)[0]
                if "\r" in text:
                    text = text.replace("\r\n", "\n").replace("\r", "\n")
                for name, container, bases, signature, defined, doc, code, start in symbols_of(text, lang, with_code):
                    clean = clean_documentation(doc) if doc is not None else None
                    trivial = is_trivial(clean, name) if clean is not None else None
                    rows.append((origin, rec, scope, file, lang, name, container, bases, signature, defined and suffix != ".pyi", doc, clean, trivial, code, start))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=kinds.get(n, pa.string())) for c, n in zip(columns, names)], names=names)

    named = sources.where("file IS NOT NULL AND content IS NOT NULL").select("origin", "rec_id", "project", canonical_path("file").alias("file"), "content")
    return named.mapInArrow(run, SYMBOL_SCHEMA)


def resolve(symbols: DataFrame, texts: tuple[str, ...] = ("doc", "clean")) -> DataFrame:
    """Every definition of a symbol table with the documentation of its own or, failing that, of a declaration; those that have neither or only trivial ones are left out.

    A declaration counts if scope, language, name and normalised signature are equal and its container is that of the definition or one of
    the bases of its class, which may be named without namespaces. The own container goes first, then the bases in order; of several declarations the
    one with the smallest (file, ``texts``). The choice is made after the join: own documentation if it isn't trivial, else the declaration's. ``doc_from`` is ``own`` or ``declaration``.
    """
    key = ["scope", "lang", "name", "signature"]
    one = ["origin", "rec_id", "file", "start"]
    simple = F.regexp_extract("container", r"([^.]*)$", 1)
    declared = symbols.where("NOT defined AND NOT trivial").select(*key, F.explode(F.array_distinct(F.array("container", simple))).alias("at"), "file", *texts)
    declared = declared.groupBy(*key, "at").agg(F.min(F.struct("file", *texts)).alias("d"))
    defined = symbols.where("defined")
    asked = defined.where("trivial IS NULL OR trivial").select(*key, *one, F.posexplode(F.concat(F.array("container"), "bases")).alias("place", "at"))
    taken = asked.join(declared, [*key, "at"]).groupBy(*one).agg(F.min(F.struct("place", *(F.col(f"d.{t}").alias(t) for t in texts))).alias("taken"))
    chosen = defined.join(taken, one, "left")
    own = ~F.coalesce("trivial", F.lit(True))
    source = F.when(own, "own").when(F.col("taken").isNotNull(), "declaration")
    columns = ["origin", "rec_id", "file", "lang", "container", "name", "signature"]
    described = [F.when(own, F.col(t)).otherwise(F.col(f"taken.{t}")).alias(t) for t in texts]
    return chosen.select(*columns, *described, "code", source.alias("doc_from")).where("doc_from IS NOT NULL")


def code_sources(chunks: DataFrame, raw_chunks: DataFrame) -> DataFrame:
    """The contents of both tables as :func:`symbol_table` takes them; a chunk that was indexed again counts once.

    The project is that of the chunk; raw chunks have none of their own.
    """
    project = F.col("scope") if "scope" in chunks.columns else F.lit(None).cast("string")
    named = chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.col("source_file").alias("file"), "content", project.alias("project"))
    once = named.groupBy("chunk_id", "file", "content").agg(F.min("project").alias("project"))
    return once.select(F.lit("chunks").alias("origin"), F.col("chunk_id").alias("rec_id"), "project", "file", "content").unionByName(
        raw_chunks.select(
            F.lit("raw_chunks").alias("origin"), F.col("raw_id").cast("string").alias("rec_id"), F.lit(None).cast("string").alias("project"), F.col("source_file").alias("file"), "content"
        )
    )


def documented_functions(chunks: DataFrame, raw_chunks: DataFrame, with_texts: bool = True) -> DataFrame:
    """Code and description of every function of both tables that has non-trivial documentation.

    Rows with null content, file or id give nothing. Repeated definitions stay; nothing is sampled or capped. The symbol table is written once,
    without descriptions and code unless ``with_texts``, and joined with itself.
    """
    symbols = symbol_table(code_sources(chunks, raw_chunks), with_texts)
    if not with_texts:
        symbols = symbols.drop("doc", "clean")
    return resolve(materialize(symbols, "symbols"), ("doc", "clean") if with_texts else ())
