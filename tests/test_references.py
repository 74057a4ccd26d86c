"""Orphan references, against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from corvane.operators import references

T0 = datetime(2024, 1, 1)
EDGES = "edge_id long, source_file string, target_file string, target_symbol string, edge_type string, extracted_at timestamp_ntz, key string, salt int, h long"
FILES = "file string, start timestamp_ntz, end timestamp_ntz"
SYMBOLS = "file string, symbol string, start timestamp_ntz, end timestamp_ntz"


def norm(p):
    p = p.replace("\\", "/")
    return p[2:] if p.startswith("./") else p


def judge(lives, t):
    if not lives:
        return "missing"
    if t is None or any((s is None or s <= t) and (e is None or t < e) for s, e in lives):
        return None
    return "deleted" if any(e is not None and e <= t for _, e in lives) else "late"


def brute(edges, files, symbols):
    fl, sl = {}, {}
    for f, s, e in files:
        if f is not None:
            fl.setdefault(norm(f), []).append((s, e))
    for f, y, s, e in symbols:
        if f is not None and y is not None:
            sl.setdefault((norm(f), y), []).append((s, e))
    out = set()
    for i, sf, tf, y, kind, t, *_ in edges:
        alive = False
        for field, p in (("source_file", sf), ("target_file", tf)):
            if p is None or norm(p) in ("", "_external_"):
                continue
            reason = judge(fl.get(norm(p)), t)
            if reason:
                out.add((i, field, reason))
            elif field == "target_file":
                alive = True
        if alive and y is not None and kind != "imports" and (reason := judge(sl.get((norm(tf), y)), t)):
            out.add((i, "target_symbol", reason))
    return out


def case(n, seed, hot=0.4):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(days=rng.randrange(60))
    life = lambda: (lambda a, b: (rng.choice([a, a, a, None]), rng.choice([b, None])))(*sorted([day(), day()]))
    name = lambda: "p/hot.py" if rng.random() < hot else f"p/f{rng.randrange(30)}.py"
    spell = lambda p: rng.choice([p, p.replace("/", "\\"), "./" + p])
    files = [(spell(name()), *life()) for _ in range(25)] + [(None, *life())]
    symbols = [(spell(name()), rng.choice(["a", "b", "", None]), *life()) for _ in range(60)]
    edges = [
        (i, rng.choice([spell(name()), None, "", "_external_"]), rng.choice([spell(name()), spell(name()), None, "", "_external_"]), rng.choice(["a", "b", "c", "", None]),
         rng.choice(["calls", "imports", None]), rng.choice([day(), day(), day(), None]), "clash", 9, 9)
        for i in range(n)
    ]
    return edges, files, symbols


@pytest.mark.parametrize("ranges,batch", [(20_000, 150_000), (5, 40)])
def test_orphans_match_brute_force(spark, monkeypatch, ranges, batch):
    monkeypatch.setattr(references, "PARENTS_PER_RANGE", ranges)
    monkeypatch.setattr(references, "REFS_PER_BATCH", batch)
    edges, files, symbols = case(600, 3)
    df = references.find_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    got = [tuple(r) for r in df.select("edge_id", "ref_field", "reason").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges, files, symbols)


def test_ranges_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(references, "PARENTS_PER_RANGE", 5)
    monkeypatch.setattr(references, "BROADCAST_BITS", 0)
    edges, files, symbols = case(200, 5)
    df = references.find_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    assert {tuple(r)[:3] for r in df.collect()} == brute(edges, files, symbols)


def test_empty_tables(spark):
    edges, files, symbols = case(80, 4)
    e, f, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS)
    assert {tuple(r)[:3] for r in references.find_orphans(e, f.limit(0), s.limit(0)).collect()} == brute(edges, [], [])
    assert references.find_orphans(e.limit(0), f, s).count() == 0


def test_report_counts_by_month(spark):
    edges, files, symbols = case(200, 6)
    df = references.find_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    assert sum(r.n for r in references.orphan_report(df).collect()) == len(brute(edges, files, symbols))


@pytest.mark.parametrize("n_symbols", [0, 400])
def test_batches_stay_bounded_where_all_references_are_passed_on(spark, monkeypatch, n_symbols):
    probe, most = references._probe, 80
    monkeypatch.setattr(references, "REFS_PER_BATCH", most // 2)

    def bounded(refs, parents):
        assert refs.num_rows <= most, f"{refs.num_rows} references in a batch"
        return probe(refs, parents)

    monkeypatch.setattr(references, "_probe", bounded)
    gone = [(i, f"p/a{i}.py", f"p/b{i}.py", None, "imports", T0, "clash", 9, 9) for i in range(1000)]
    alive = [(1000 + i, "p/hot.py", "p/hot.py", "a", "calls", T0, "clash", 9, 9) for i in range(n_symbols)]
    files, symbols = [("p/hot.py", None, None)], [("p/hot.py", "a", None, None)]
    df = references.find_orphans(spark.createDataFrame(gone + alive, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    got = [tuple(r)[:3] for r in df.collect()]
    assert len(got) == 2000 and set(got) == brute(gone + alive, files, symbols)
