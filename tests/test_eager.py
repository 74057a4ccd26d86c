"""Values that hold most of the edges, against brute force."""

import random
from collections import Counter

from corvane.operators import eager
from corvane.session import materialize

SCHEMA = "edge_id long, source_file string, source_symbol string, target_file string, target_symbol string, edge_type string, key_value string, field string, n_rows long"


def norm(p):
    if p is None:
        return None
    p = p.replace("\\", "/")
    return p[2:] if p.startswith("./") else p


def edges(spark, n, seed=1):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        f = "lib/hot.py" if hot else f"src/f{rng.randrange(60)}.py"
        target = pick([f, f, f.replace("/", "\\"), "./" + f, None, "", "_external_"])
        rows.append((i, pick(["a.py", "./a.py", "b.py", None]), pick(["x", None]), target, pick(["s", "t", None, "", f"u{rng.randrange(200)}"]), pick(["calls", "imports"]), "clash", "clash", -1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    distinct = {(norm(r[1]), r[2], norm(r[3]), r[4], r[5]) for r in rows}
    out = set()
    for field, i in (("target_file", 2), ("target_symbol", 3)):
        for v, n in Counter(d[i] for d in distinct).items():
            if v and n * 50 >= len(distinct):
                out.add((field, v))
    return out


def tables(spark):
    files = spark.createDataFrame([("lib/hot.py", 1), ("lib\\hot.py", 2), (None, 3), ("src/f1.py", 4)], "file string, n long")
    symbols = spark.createDataFrame([("s", "x"), ("s", "y"), (None, "z")], "symbol string, file string")
    return files, symbols


def test_heavy_values(spark):
    files, symbols = tables(spark)
    rows, df = edges(spark, 900)
    for count_sources in (True, False):
        totals = materialize(eager.edge_key_totals(df, files, symbols, count_sources), "t")
        got = [tuple(r) for r in eager.heavy_keys(totals).select("field", "key_value").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_totals_count_rows_edges_sources_and_pairs(spark):
    files, symbols = tables(spark)
    rows, df = edges(spark, 300, 2)
    got = {(r.field, r.key_value): r for r in eager.edge_key_totals(df, files, symbols).collect()}
    hot = [r for r in rows if norm(r[3]) == "lib/hot.py"]
    distinct = {(norm(r[1]), r[2], norm(r[3]), r[4], r[5]) for r in hot}
    r = got["target_file", "lib/hot.py"]
    assert (r.n_rows, r.n_edges, r.n_records, r.n_pairs) == (len(hot), len(distinct), 2, 2 * len(distinct))
    assert r.n_sources == len({d[0] for d in distinct} - {None})
    assert got["target_file", None].n_records == 0 and got["target_file", None].n_pairs == 0


def test_empty_edges(spark):
    files, symbols = tables(spark)
    _, df = edges(spark, 5)
    assert eager.heavy_keys(materialize(eager.edge_key_totals(df.limit(0), files, symbols), "t")).count() == 0


def test_empty_records(spark):
    files, symbols = tables(spark)
    rows, df = edges(spark, 300)
    totals = materialize(eager.edge_key_totals(df, files.limit(0), symbols.limit(0)), "t")
    assert {tuple(r) for r in eager.heavy_keys(totals).select("field", "key_value").collect()} == brute(rows)


def test_states_combine_like_the_join(spark):
    l = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, x long")  # noqa: E741
    r = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("c", 1)], "k string, y long")
    from pyspark.sql import functions as F

    left = eager.preaggregate(l, ["k"], ["x"], {"n_left": ("count", F.lit(1)), "sx": ("sum", F.col("x")), "mx": ("max", F.col("x"))})
    right = eager.preaggregate(r, ["k"], [], {"n_right": ("count", F.lit(1)), "sy": ("sum", F.col("y"))})
    got = {x.k: x for x in eager.join_states(left, right, ["k"], sums_left=["sx"], sums_right=["sy"]).collect()}
    want = l.join(r, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()[0]
    assert (got["a"].n_pairs, got["a"].sx, got["a"].sy, got["a"].mx) == (want.n, want.sx, want.sy, 2)
    assert got["b"].n_pairs == 0 and got[None].n_pairs == 0
