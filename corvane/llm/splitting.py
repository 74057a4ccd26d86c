r"""Splitting oversized items at natural boundaries, with overlap.

One regular expression cuts an item: its alternatives are ordered by the strength of the boundary, and each
is a bounded quantifier that consumes as much as the limit allows before such a boundary. They are
tried first in the second half of the limit and then in the rest of it; a plain run of characters is the
fallback. ``regexp_extract_all`` thus yields consecutive cores whose concatenation is the item. The overlap is a
lookback of fixed length from the start of a core, and line numbers are running sums over the array of cores:
everything stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One token is reckoned as four characters, here and in the table of limits.
CHARS_PER_TOKEN = 4

EOL = r"(?:\r\n|\n|\r(?!\n))"

# What the first line of a definition looks like in the languages at hand.
_MODIFIER = (
    r"(?:export|default|public|private|protected|internal|static|async|abstract|final|open|override|suspend|"
    r"pub(?:\([a-z]+\))?|unsafe|local|inline|virtual|sealed|partial)"
)
_HEAD = (
    rf"(?:{_MODIFIER}[ \t]+)*(?:def|class|func|fn|fun|function|interface|struct|enum|impl|trait|module|type|object|namespace)\b"
    rf"|{_MODIFIER}[ \t][^\n;=]*\("
    r"|(?:export[ \t]+)?const[ \t]+\w+[ \t]*=[ \t]*(?:async[ \t]*)?\("
    r"|[A-Za-z_]\w*[ \t]*\(\)[ \t]*\{"
    r"|[A-Za-z_][\w*<>]*[ \t]+\**[A-Za-z_]\w*[ \t]*\([^;\n]*\)[ \t]*\{"
)
_NOTE = r"(?:[ \t]*(?:#|//|/\*|\*|--|@|\[)[^\n]*\n){0,20}"

# Boundaries are positions: what stands before (bounded look-behind) and after. The look at a single character comes
# first, as nearly all positions fail it.
_AFTER_LINE = r"(?<=[\r\n])(?<!\r(?=\n))"
_AFTER_BLANK = r"(?<=[\r\n])(?<=(?:\n|\r(?!\n))[ \t]{0,40}(?:\r\n|\n|\r))(?<!\r(?=\n))"
_AFTER_SENTENCE = r"(?:(?<=\s)(?<=[.!?;:…][\"')\]]?\s)|(?<=[。！？；।؟]))(?<!\r(?=\n))"
_AFTER_WORD = r"(?<=\s)(?<!\r(?=\n))"

#: Boundaries of code, strongest first: a blank line before a definition and what is noted above it, the line of a
#: definition, a blank line, a line end, a sentence, white space.
CODE_BOUNDARIES = (
    rf"{_AFTER_BLANK}(?={_NOTE}[ \t]*(?:{_HEAD}))",
    rf"{_AFTER_LINE}(?=[ \t]*(?:{_HEAD}))",
    rf"{_AFTER_BLANK}(?=[^\r\n])",
    _AFTER_LINE,
    _AFTER_SENTENCE,
    _AFTER_WORD,
)
#: Boundaries of prose: a line before a heading, a blank line, a sentence, a line end, white space.
PROSE_BOUNDARIES = (
    rf"{_AFTER_LINE}(?=#{{1,6}}[ \t]|§+[ \t]*\d|(?:Article|Section|Sec\.|Chapter|Part)[ \t]+\d|\d+(?:\.\d+)+\.?[ \t]+\S)",
    rf"{_AFTER_BLANK}(?=[^\r\n])",
    _AFTER_SENTENCE,
    _AFTER_LINE,
    _AFTER_WORD,
)


def cut_pattern(limit: int, overlap: int, boundaries: tuple[str, ...]) -> str:
    """The expression whose successive matches are the cores of an item.

    A core has at most ``limit - overlap`` characters and, unless it is the last one, more than ``overlap``.
    """
    most, least = limit - overlap, overlap + 1
    if overlap < 0 or most <= overlap:
        raise ValueError("the limit must be more than twice the overlap")
    half = max(least, most // 2)
    ranges = [(half, most)] + ([(least, half - 1)] if half > least else [])
    cuts = [rf".{{{lo},{hi}}}{b}" for lo, hi in ranges for b in boundaries]
    # neither inside a CRLF nor between a character and what combines with it, if that can be helped
    whole = rf".{{{least},{most}}}(?<!\r(?=\n))(?![\p{{M}}\x{{200d}}\x{{fe0f}}])"
    return "(?s)" + "|".join([rf".{{1,{most}}}\z", *cuts, whole, rf".{{{least},{most}}}"])


def split_items(
    df: DataFrame,
    id_col: str,
    content: str,
    capacity: int,
    overlap: int,
    boundaries: tuple[str, ...],
    line_start: str = "line_start",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The pieces of every row whose content exceeds ``capacity`` tokens; other rows and null contents give none.

    Result: ``id_col``, ``keep``, piece (0-based), n_pieces, piece_content, piece_line_start, piece_line_end, piece_tokens.
    A piece has at most ``capacity`` tokens of four characters and begins with the last ``4 * overlap`` characters of
    the one before. Lines count on from ``line_start`` (null: from 1) and end with LF, CRLF or CR; a piece that
    ends with a line end ends on that line. Without its overlaps, the pieces of a row concatenate to its content.
    """
    limit, back = CHARS_PER_TOKEN * capacity, CHARS_PER_TOKEN * overlap
    pattern = cut_pattern(limit, back, boundaries)
    over = df.where(F.floor(F.length(content) / CHARS_PER_TOKEN) > capacity)
    cores = over.select(
        F.col(id_col),
        *keep,
        F.coalesce(F.col(line_start).cast("bigint"), F.lit(1).cast("bigint")).alias("__first"),
        F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("__cores"),
    )
    # lines before each core: a running sum over the array
    lines = F.aggregate(
        "__cores",
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.regexp_count(x, F.lit(EOL)))),
    )
    text = lambda i, core: F.when(i == 0, core).otherwise(
        F.concat(F.right(F.element_at("__cores", F.greatest(i, F.lit(1))), F.lit(back)), core)
    )
    pieces = F.transform("__cores", lambda core, i: F.struct(text(i, core).alias("c"), F.get("__lines", i).alias("l"), F.length(core).alias("n")))
    out = cores.withColumn("__lines", lines).select(
        id_col, *keep, "__first", F.size("__cores").cast("bigint").alias("n_pieces"), F.posexplode(pieces).alias("piece", "p")
    )
    total, c = F.regexp_count("p.c", F.lit(EOL)), F.col("p.c")
    first = F.col("__first") + F.col("p.l") - F.regexp_count(F.left(c, F.length(c) - F.col("p.n")), F.lit(EOL))
    last = first + total - F.when(c.rlike(r"[\r\n]\z"), 1).otherwise(0)
    return out.select(
        id_col,
        *keep,
        F.col("piece").cast("bigint").alias("piece"),
        "n_pieces",
        c.alias("piece_content"),
        first.alias("piece_line_start"),
        last.alias("piece_line_end"),
        F.floor(F.length(c) / CHARS_PER_TOKEN).cast("bigint").alias("piece_tokens"),
    )


def split_chunks(raw_chunks: DataFrame, doc_chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of oversized code and document chunks under the capacities and overlaps of ``limits``.

    Result: origin, rec_id, title (section or heading), piece, n_pieces, content, line_start, line_end, token_count.
    An origin without a row in ``limits``, or with a null capacity there, has no limit and gives no pieces; a null
    overlap is 0. ``limits`` is a table of a few rows.
    """
    known = {r.limit_name: r for r in limits.select("limit_name", "capacity", "overlap").collect()}  # fixed, a few rows
    parts = []
    for name, df, key, title, bounds in (
        ("raw_chunks", raw_chunks, "raw_id", "section", CODE_BOUNDARIES),
        ("doc_chunks", doc_chunks, "doc_chunk_id", "heading", PROSE_BOUNDARIES),
    ):
        row = known.get(name)
        capacity = row.capacity if row is not None and row.capacity is not None else (1 << 31) // 8
        overlap = (row.overlap or 0) if row is not None else 0
        named = df.select(F.col(key).cast("bigint").alias("rec_id"), F.col(title).alias("title"), "content", "line_start")
        pieces = split_items(named, "rec_id", "content", capacity, overlap, bounds, keep=("title",))
        parts.append(pieces.withColumn("origin", F.lit(name)))
    return parts[0].unionByName(parts[1]).select(
        "origin",
        "rec_id",
        "title",
        "piece",
        "n_pieces",
        F.col("piece_content").alias("content"),
        F.col("piece_line_start").alias("line_start"),
        F.col("piece_line_end").alias("line_end"),
        F.col("piece_tokens").alias("token_count"),
    )
