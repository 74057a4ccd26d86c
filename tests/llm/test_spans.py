"""Long spans shared between documents, against brute force."""

import random
from collections import defaultdict

import pytest

from corvane.llm import spans


def brute(docs, span):
    where = defaultdict(set)
    for i, t in docs:
        if i is not None and t:
            for j in range(len(t) - span + 1):
                where[t[j : j + span]].add(i)
    pairs, shared = set(), {}
    for ids in where.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    for i, t in docs:
        if i is None:
            continue
        mark = [False] * len(t or "")
        for j in range(len(t or "") - span + 1):
            if len(where[t[j : j + span]]) > 1:
                mark[j : j + span] = [True] * span
        shared[i] = sum(mark)
    return pairs, shared


def corpus(seed, n=40, alphabet="abcdefgh \n"):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    blocks = [text(rng.randrange(15, 90)) for _ in range(12)] + ["-" * 70, "ab" * 40, "\x00" * 50 + text(10), "é🙂" * 30]
    docs = [(i, "".join(rng.choice([text(rng.randrange(30)), rng.choice(blocks), rng.choice(blocks)]) for _ in range(rng.randrange(6)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, docs[3][1]), (None, docs[3][1])]
    return docs


@pytest.mark.parametrize("span,k,broadcast", [(40, 20, 1_000_000), (30, 10, 0)])
def test_pairs_and_shares(spark, monkeypatch, span, k, broadcast):
    monkeypatch.setattr(spans, "BROADCAST_HASHES", broadcast)
    docs = corpus(span)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, h string, pos int")
    pairs, shared = brute(docs, span)
    got = [tuple(r) for r in spans.shared_pairs(df, k, span).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    classes = {r.doc_id: (r.class_id, r.n_links) for r in spans.shared_classes(df, k, span).collect()}
    first = {}
    for i, t in docs:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    assert classes == {i: (i if t is None else first[t], sum(i in p for p in pairs)) for i, t in docs if i is not None}
    rows = spans.shared_shares(df.where("doc_id IS NOT NULL"), k, span).collect()
    assert {r.doc_id: r.shared_chars for r in rows} == shared
    assert {r.doc_id: r.n_chars for r in rows} == {i: None if t is None else len(t) for i, t in docs if i is not None}


@pytest.mark.parametrize("seed", [3, 40])
def test_paths_are_verbatim_copies_and_as_long_as_they_can_be(spark, seed):
    docs = corpus(seed) + [(200 + i, t) for i, t in enumerate(["x" * 7 + "Long shared tail, " * 9 + "a%d" % i for i in range(3)])]
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs += [(300, "before " + passage + " after"), (301, passage), (302, "other " + passage[:500]), (303, passage + passage)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, h string, head int")
    text = {i: t for i, t in docs if i is not None and t}
    rows = spans.repeated_paths(df, 20, 40).collect()
    for r in rows:
        cut = text[r.doc_id][r.start : r.start + r.length]
        assert len(cut) == r.length >= 40 and 2 <= r.n_documents <= sum(cut in t for t in text.values()) and r.n_places >= r.n_documents
    # the copies of the passage part at its 500th character only, so two long paths cover it
    long = sorted(r.length for r in rows if r.doc_id in (300, 301))
    assert long and long[-1] >= 350 and sum(long[-2:]) >= 700
    assert spans.repeated_paths(df.limit(0), 20, 40).count() == 0


def test_chains_are_compacted(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 60)
    rows, want = [], {}
    for a, b in ((0, 1), (1, 30), (30, 60)):
        for i in range(a, b):
            rows.append((names[i], None if i == a else names[i] * 7, None if i == b - 1 else names[i + 1] * 7, i))
            want[names[i]] = (names[a], sum(range(a + 1, i + 1)))
    nodes = spark.createDataFrame(rows, "h long, in_edge long, out_edge long, gap long")
    assert {r.h: (r.head, r.offset) for r in spans.compact_paths(nodes).collect()} == want


def repeated_passages():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage, run = text(170), "ab" * 150
    docs = [(1, text(50) + passage + text(31) + passage + text(20)), (2, text(9) + passage + text(5)), (3, passage * 3 + run), (4, text(60) + run[:211] + text(7))]
    return docs + [(5, "-" * 400 + text(30)), (6, text(3) + "-" * 130), (7, passage[:100] + passage[60:])]


def test_shares_count_every_copy_of_a_passage(spark):
    docs = repeated_passages()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, shared = brute(docs, 40)
    assert shared[1] >= 340
    assert {r.doc_id: r.shared_chars for r in spans.shared_shares(df, 20, 40).collect()} == shared


def brute_stretches(docs, span):
    texts = {i: t for i, t in docs if i is not None and t}
    found = set()
    for i, t in texts.items():
        past = 0
        for b in range(len(t) - span + 1):
            e = max(past, b + span - 1)
            others = [u for j, u in texts.items() if j != i and t[b:e] in u]
            while e < len(t) and any(t[b : e + 1] in u for u in others):
                e += 1
            if e > past and e - b >= span and any(t[b:e] in u for u in others):
                found.add((i, b, e - b))
                past = e
    return found


@pytest.mark.parametrize("block", [256, 4])
def test_maximal_stretches(spark, monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    for docs in (repeated_passages(), corpus(13, 25)):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = [tuple(r) for r in spans.shared_spans(df, 20, 40).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_stretches(docs, 40)
        _, shared = brute(docs, 40)
        covered = {i: set() for i in shared}
        for i, b, n in got:
            covered[i] |= set(range(b, b + n))
        assert {i: len(c) for i, c in covered.items()} == shared


def test_overlapping_stretches_of_different_documents_stay_apart(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, t), (2, t[:200]), (3, t[150:])], "doc_id long, text string")
    got = {tuple(r) for r in spans.shared_spans(df, 20, 40).collect()}
    assert got == {(1, 0, 200), (1, 150, 150), (2, 0, 200), (3, 0, 150)}
    assert spans.shared_spans(df.limit(0), 20, 40).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 4)
    docs = corpus(7, 25)
    docs += [(200 + i, f"{i:03d}" * i + "shared boilerplate of a certain length, the same everywhere") for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, _ = brute(docs, 40)
    assert {tuple(r) for r in spans.shared_pairs(df, 20, 40).collect()} == pairs


def test_long_texts_are_taken_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(spans, "BATCH_CHARS", 700)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij") for _ in range(5000))
    docs = [(1, long), (2, "x" * 30 + long[1234:1290] + "y" * 30), (3, long[100:4000] + "z" * 900), (4, "q" * 3000), (5, "w" + "q" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, _ = brute(docs, 40)
    # the workers read the constant of the shipped module, so the stretches are cut on the driver here
    import numpy as np

    for _, t in docs:
        covered = np.zeros(len(t), dtype=int)
        for lo, hi, a, z in spans._stretches(len(t), 80):
            assert lo <= a and z <= hi and (lo == 0 or a - lo >= 80) and (hi == len(t) or hi - z >= 80)
            covered[a:z] += 1
        assert (covered == 1).all()
    assert {tuple(r) for r in spans.shared_pairs(df, 20, 40).collect()} == pairs


def test_empty(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert spans.shared_pairs(df.limit(0)).count() == 0 and spans.shared_shares(df.limit(0)).count() == 0
    assert spans.shared_pairs(df).count() == 0
