"""Encoding and packing: exact round trips and the laws of a packing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import packing, tokens

ODD = ["", " ", "\n" * 3000, " " * 5000 + "x", "a" * 30_000, "^" * 25_000, "<|endoftext|> hi", "naïve café 東京\u3000テスト 🙂👩‍👩‍👧 e\u0301", "x\x00y", "tab\tline\r\nend  ", ("word " * 6000) + " " * 2000 + "end", "\u2003" * 1500 + "y" + " \n" * 12_000]


def test_long_texts_encode_like_short_ones():
    enc = tokens.encoding()
    for t in ODD:
        ids = tokens.encode(t, enc)
        assert tokens.decode_bytes(ids, enc).decode() == t
        if len(t) < 100_000 and not tokens._LONG_RUN.search(t):
            assert ids == enc.encode_ordinary(t)
    assert max(tokens.encode("<|endoftext|>", enc)) < 50_256


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "\n\n", "x1", "'s", "é", "\u3000", "."]), max_size=80))
def test_safe_boundaries_change_nothing(parts):
    enc, text = tokens.encoding(), "".join(parts)
    whole = enc.encode_ordinary(text)
    keep = tokens.LONG_TEXT
    try:
        tokens.LONG_TEXT = 5
        assert tokens.encode(text, enc) == whole
    finally:
        tokens.LONG_TEXT = keep


def test_long_runs_equal_the_plain_encoding():
    enc = tokens.encoding()
    for t in ("ab" + " " * 1500 + "cd" * 15_000, "ab" * 12_000 + "\n" * 1200 + "cd", "ab" * 12_000 + "\t" * 1300):
        assert tokens.encode(t, enc) == enc.encode_ordinary(t)


def test_corpus_nulls_empties_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "hi there", 5), (2, "", 6), (3, None, 7), (3, None, 7), (None, "x", 8)], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df).collect()
    assert [(r.doc_id, len(r.ids)) for r in got] == [(1, 2), (2, 0), (3, 0), (3, 0), (None, 1)]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    back = {r.doc_id: (bytes(r.raw), r.text) for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back[1] == (b"hi there", "hi there") and back[2] == (b"", "")


def check(rows, sizes, capacity):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r.container_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for items in by_bin.values():
        at = 0
        for i, r in enumerate(sorted(items, key=lambda r: r.place)):
            assert r.place == i and r.offset == at
            at += r.n_tokens
        assert at <= capacity
    assert set(by_doc) == set(sizes)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        n = sizes[doc] or 0
        assert sum(r.n_tokens for r in parts) == n and len(parts) == max(1, -(-n // capacity))
        assert [r.start_token for r in parts] == [i * capacity for i in range(len(parts))]
    return len(by_bin)


@pytest.mark.parametrize("sizes", [[5] * 50, [0, 0, None, 3], [0, 0], [10] * 3, [25, 31, 7, 10, 1], [6, 6, 6, 4, 4, 4, 3, 3, 7, 7, 2, 5, 5]])
def test_packing_is_valid(spark, sizes):
    named = dict(enumerate(sizes))
    df = spark.createDataFrame(list(named.items()), "doc_id long, n_tokens long")
    n = check(packing.pack_sizes(df, 10).collect(), named, 10)
    total = sum(s or 0 for s in sizes)
    assert n <= max(1, -(-total // 10) * 2)


def test_hot_length_is_split_into_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 7)
    named = {i: 4 for i in range(100)} | {1000 + i: i % 11 for i in range(40)}
    df = spark.createDataFrame(list(named.items()), "doc_id long, n_tokens long")
    check(packing.pack_sizes(df, 10).collect(), named, 10)


def test_empty_packing(spark):
    df = spark.createDataFrame([(1, 1)], "doc_id long, n_tokens long").limit(0)
    assert packing.pack_sizes(df, 10).count() == 0
    r = packing.packing_report(packing.pack_sizes(df, 10), 10).first()
    assert (r["items"], r.containers, r.tokens) == (0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_plan_fills_at_least_as_well_as_first_fit_within_one_percent(sizes):
    histogram = {}
    for s in sizes:
        histogram[s] = histogram.get(s, 0) + 1
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, free in enumerate(bins):
            if free >= s:
                bins[i] -= s
                break
        else:
            bins.append(40 - s)
    plan = packing.plan_containers(histogram, 40)
    assert plan.containers <= len(bins) + 1


def test_exchange_prefers_two_that_fit_more_tightly():
    import numpy as np

    available = np.zeros(11, dtype=np.int64)
    for n in (6, 3, 2, 2):
        available[n] += 1
    assert packing._fill(available, 10) == [6, 2, 2]
