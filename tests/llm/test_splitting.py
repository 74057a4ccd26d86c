"""Pieces of oversized items: concatenation, limits, lines and boundaries."""

import re

import pytest

from corvane.llm import splitting

SCHEMA = "id long, text string, line_start int, piece int, n_pieces string, section string"
LINE = re.compile(r"\r\n|\n|\r(?!\n)")


def pieces(spark, texts, capacity=20, overlap=2, bounds=splitting.CODE_BOUNDARIES, start=None):
    df = spark.createDataFrame([(i, t, start, 9, "clash", f"s{i}") for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in splitting.split_items(df, "id", "text", capacity, overlap, bounds, keep=("section",)).collect():
        out.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece) for k, v in out.items()}


TEXTS = [
    "def a():\n    x = 1\n    y = 2\n\n\ndef b():\n    return 1\n\n# note\n@deco\ndef c():\n    return 2\n" * 4,
    "x" * 500,
    "first line\r\nsecond line\r\n" * 30,
    "old mac\rline\r" * 40,
    "日本語の文。次の文です。" * 40,
    "🙂" * 200,
    "e\u0301" * 150,
    "one two three four five six seven eight. " * 20,
    "short",
    "",
    None,
    "\n" * 400,
]


@pytest.mark.parametrize("bounds", [splitting.CODE_BOUNDARIES, splitting.PROSE_BOUNDARIES])
def test_pieces_are_whole_bounded_and_overlap(spark, bounds):
    got = pieces(spark, TEXTS, bounds=bounds)
    assert set(got) == {i for i, t in enumerate(TEXTS) if t and len(t) // 4 > 20}
    for i, parts in got.items():
        text, whole = TEXTS[i], parts[0].piece_content
        assert len(parts) == parts[0].n_pieces and parts[0].section == f"s{i}"
        for p in parts[1:]:
            assert whole.endswith(p.piece_content[:8])
            whole += p.piece_content[8:]
        assert whole == text
        at = 0
        for k, p in enumerate(parts):
            c = p.piece_content
            assert p.piece_tokens == len(c) // 4 <= 20
            begin = at - (8 if k else 0)
            before = text[:begin]
            if before.endswith("\r") and text[begin : begin + 1] == "\n":
                before = before[:-1]
            assert p.piece_line_start == 1 + len(LINE.findall(before))
            assert p.piece_line_end == p.piece_line_start + len(LINE.findall(c)) - (c[-1] in "\r\n")
            at = begin + len(c)


def test_natural_boundaries_are_preferred(spark):
    code = pieces(spark, [TEXTS[0]])[0]
    assert all(p.piece_content.endswith("\n") for p in code[:-1])
    assert any(p.piece_content[8:].startswith(("def ", "# note")) for p in code[1:])
    prose = pieces(spark, [TEXTS[7]], bounds=splitting.PROSE_BOUNDARIES)[0]
    assert all(p.piece_content.endswith(". ") for p in prose[:-1])
    crlf = pieces(spark, [TEXTS[2]])[2 - 2]
    assert all(p.piece_content.endswith("\r\n") for p in crlf[:-1])


def test_lines_count_on(spark):
    parts = pieces(spark, ["a line of text\n" * 20], start=100)[0]
    assert parts[0].piece_line_start == 100 and parts[-1].piece_line_end == 119


def test_limits_table(spark):
    raw = spark.createDataFrame([(1, "s", "x" * 3000, 1), (2, None, None, None)], "raw_id long, section string, content string, line_start int")
    doc = spark.createDataFrame([(1, "h", "y " * 1500, None)], "doc_chunk_id long, heading string, content string, line_start int")
    limits = spark.createDataFrame([("raw_chunks", 500, 50), ("doc_chunks", None, None)], "limit_name string, capacity int, overlap int")
    got = splitting.split_chunks(raw, doc, limits).collect()
    assert {(r.origin, r.rec_id) for r in got} == {("raw_chunks", 1)} and len(got) == 2
    assert splitting.split_chunks(raw.limit(0), doc.limit(0), limits).count() == 0
    assert splitting.split_chunks(raw, doc, limits.limit(0)).count() == 0


def test_bad_parameters():
    with pytest.raises(ValueError):
        splitting.cut_pattern(100, 50, splitting.CODE_BOUNDARIES)
