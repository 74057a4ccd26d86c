"""Runs over projects, stored versions, metadata, packed vectors and sources of several kinds."""

import threading

import pytest
from pyspark.sql import functions as F

from corvane.functions import metadata
from corvane.operators import codegraph, store, vectors
from corvane.plans import search
from corvane.session import discard, drop_materialized, intermediates, materialize, shared_dir
from corvane.sources import scan
from corvane.streaming import runs


def test_runs_retry_abort_and_pause(spark):
    tries = {"b": 0, "c": 0}

    def step(project):
        if project in tries:
            tries[project] += 1
            if project == "c" or tries[project] < 2:
                raise ValueError("broken")
        if project == "d":
            raise runs.Aborted("no memory")

    asked = iter([True] * 4 + [False])
    got = {r.project: (r.outcome, r.attempts, r.error) for r in runs.run_projects(spark, list("abcdef"), step, lambda: next(asked), 2).collect()}
    assert got == {"a": ("done", 1, None), "b": ("done", 2, None), "c": ("failed", 2, "broken"), "d": ("aborted", 1, "no memory"), "e": ("paused", 0, None), "f": ("paused", 0, None)}
    assert runs.run_projects(spark, [], step).count() == 0


def test_one_run_at_a_time(spark, tmp_path):
    lock = f"file://{tmp_path}/locks/index"
    with runs.exclusive(spark, lock) as one:
        got = []

        def other():
            with runs.exclusive(spark, lock) as two:
                got.append(two)

        t = threading.Thread(target=other)
        t.start()
        t.join()
        with runs.exclusive(spark, lock, stale_seconds=-1) as stale:
            assert one and got == [False] and stale
    with runs.exclusive(spark, lock) as again:
        assert again


def test_task_changes_and_sessions(spark, rows):
    a = spark.createDataFrame([("1", 5), ("2", 5), ("3", None), ("4", 7)], "id string, modified_at long")
    b = spark.createDataFrame([("1", 5), ("2", 6), ("3", None), ("5", 1)], "id string, modified_at long")
    assert rows(runs.task_changes(a, b)) == [("2", "changed"), ("4", "removed"), ("5", "added")]
    log = [("s", "start", 1), ("s", "tool", 2), ("s", "end", 3), ("s", "resume", 4), ("t", "start", 1), ("t", "end", 9), ("u", "tool", 2), (None, "start", 1), ("v", "start", 1), ("v", "start", 2), ("v", None, 3)]
    got = runs.session_records(spark.createDataFrame(log, "session string, kind string, ts long"), "session", "kind", "ts")
    assert rows(got) == [("s", 1, 1, None, 1), ("t", 1, 0, 9, 0), ("u", None, 0, None, 1), ("v", 1, 1, None, 1)]


def test_deletion_is_all_or_none(spark, tmp_path):
    df = spark.range(3)
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    for f in folders:
        df.write.parquet(f)

    def broken():
        raise OSError("registry")

    with pytest.raises(OSError, match="registry"):
        store.delete_folders(spark, folders, f"file://{tmp_path}/q", broken)
    assert [spark.read.parquet(f).count() for f in folders] == [3, 3]
    assert store.delete_folders(spark, [*folders, f"file://{tmp_path}/none"], f"file://{tmp_path}/q") == 2
    assert not any((tmp_path / x).exists() for x in "ab") and not list((tmp_path / "q").iterdir())


def test_builds_keep_the_last_two_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (1, 2, 3):
        assert store.write_build(spark.range(n), path) == n
    (tmp_path / "t" / "build=9").mkdir()  # broken off
    assert store.read_build(spark, path).count() == 3 and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["build=2", "build=3", "build=9"]
    assert store.pending(spark.range(5), spark.createDataFrame([(1,), (1,), (3,)], "id long"), "id").count() == 3


def test_collections_of_another_width_are_recreated(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", [1.0, 2.0]), ("b", "y", None)], "chunk_id string, project string, embedding array<float>")
    path = f"file://{tmp_path}/c"
    store.write_collection(df, path, "project", 2, recreate=True)
    wide = spark.createDataFrame([("c", "z", [1.0, 2.0, 3.0])], df.schema)
    store.write_collection(wide, path, "project", 3, recreate=True)
    assert [r.chunk_id for r in spark.read.parquet(path).collect()] == ["c"]
    store.write_collection(wide.withColumn("project", F.lit("w")), path, "project", 3, recreate=True)
    assert spark.read.parquet(path).count() == 2


def test_metadata_and_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, "a", [1.5, -2.0]), (2, None, None), (3, 'q"', [])], "id int, section string, v array<float>")
    back = df.select("*", metadata.from_text(metadata.to_text("id", "section"), "id int, section string, more string").alias("m"), vectors.pack_vector("v").alias("p"))
    back = back.select("*", vectors.unpack_vector("p").alias("u"), vectors.packed_dimension("p").alias("d"))
    for r in back.collect():
        assert (r.m.id, r.m.section, r.m.more) == (r.id, r.section, None) and r.u == r.v and r.d == (None if r.v is None else len(r.v))
    bad = spark.createDataFrame([("[1]",), ("x",), (None,), ("{}",)], "t string").select(metadata.from_text("t", "id int").alias("m")).collect()
    assert [None if r.m is None else r.m.id for r in bad] == [None] * 4 and bad[3].m is not None and bad[0].m is None


def test_batch_search_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 30)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 6)).round(1)
    v[5] = v[6] = v[7]
    rows = [(i, x.tolist(), 1, "e") for i, x in enumerate(v)] + [(200, None, 1, "e"), (201, [0.0] * 6, 1, "e"), (202, [1.0], 1, "e"), (None, [1.0] * 6, 1, "e")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, block int, e string")
    q = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in vectors.batch_knn(df, q, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(1 - (1 - unit @ unit.T) / 2, 4)
    want = {i: [int(j) for j in sorted(range(120), key=lambda j: (-s[i, j], j))[:4]] for i in range(0, 120, 5)}
    assert {k: [x for _, x in sorted(x)] for k, x in got.items()} == want
    assert vectors.batch_knn(df.limit(0), q, 4).count() == 0 and vectors.batch_knn(df, q.limit(0), 4).count() == 0


def test_virtual_environments_are_left_out(spark):
    files = spark.createDataFrame([("a/pyvenv.cfg",), ("a/lib/x.py",), ("ab/x.py",), ("b/c/env/pyvenv.cfg",), ("b/c/env/d/e.py",), ("b/c/x.py",), ("top.py",)], "path string")
    assert sorted(r.path for r in scan.outside_virtualenvs(files).collect()) == ["ab/x.py", "b/c/x.py", "top.py"]


@pytest.mark.parametrize("lang,text,calls", [
    ("javascript", "import d, {a as b} from './m';\nimport * as ns from 'lib';\nconst {q: w} = require('z');\nclass A {\n  load(x) {\n    b(1);\n    ns.f(x);\n  }\n}\nfunction h() {\n  w();\n}\ntop();\n",
     {("A.load", "./m.a"), ("A.load", "lib.f"), ("h", "z.q"), ("", "top")}),
    ("csharp", "public class A {\n    public int F(int a) {\n        return G(a);\n    }\n}\n", {("A.F", "G")}),
    ("ruby", "class A\n  def f(a)\n    g(a)\n  end\nend\nh(1)\n", {("A.f", "g"), ("", "h")}),
    ("go", "func F(a int) {\n\t/* x\n\ty(1) */\n\tg(1)\n}\n", {("F", "g")}),
])
def test_calls_have_their_owners(lang, text, calls):
    assert {(s, t) for s, t, kind, _ in codegraph.extract(text, lang, "f") if kind == "calls"} == calls


def test_sources_are_searched_with_their_models(spark):
    chunks = spark.createDataFrame(
        [(i, f"c{i}", f"p{i % 3}/a.py", f"p{i % 3}", i, "text", 1, 2, "s", i, [1.0, float(i)]) for i in range(9)],
        "row_id int, chunk_id string, source_file string, scope string, indexed_at int, content string, line_start int, line_end int, section string, chunk_index int, embedding array<float>",
    )
    projects = spark.createDataFrame([("p0", "a", 3), ("p1", "b", 3), ("p2", "broken", 3), ("p3", None, 3), ("p4", "a", 0)], "project string, model_id string, n_files long")

    def embedder(model):
        if model == "broken":
            raise OSError(model)
        return lambda text: [1.0, 0.0] if model == "a" else [0.0, 1.0]

    tables = search.Sources(chunks, projects)
    got, skipped = search.search_sources([f"project:p{i}" for i in range(6)] + ["web:x", "docs:t", "project:p0"], tables, "q", embedder, "a", limit=3, min_score=0.0)
    assert [(r.source, r.chunk_id) for r in got.collect()] == [("project:p0", "c0"), ("project:p1", "c7"), ("project:p1", "c4")]
    assert skipped == [("project:p2", "other model"), ("project:p3", "unknown model"), ("project:p4", "missing"), ("project:p5", "missing"), ("web:x", "unknown"), ("docs:t", "unknown")]
    assert search.search_sources(["x"], tables, "q", embedder, "a") == (None, [("x", "unknown")])


def test_graph_tables_are_made_once(spark):
    e = spark.createDataFrame([(1, "a", "s", "b", "t", "imports"), (2, "b", "s", "c", "t", "calls")], "edge_id int, source_file string, source_symbol string, target_file string, target_symbol string, edge_type string")
    one, two = (search.cached_graph_index(e, "edge_id") for _ in range(2))
    assert one is two and one.links.count() == 2
    others = [search.cached_graph_index(e.withColumn("edge_id", F.col("edge_id") + i), "edge_id") for i in range(1, 5)]
    assert search.cached_graph_index(e, "edge_id") is not one and others[-1].ranks.count() == 3


def test_prose_frames_and_words(spark, rows):
    from corvane.operators import prose

    body = " ".join(f"Sentence number {i} tells of thing{i}." for i in range(8))
    texts = [
        (1, "# Worker pool setup\n\nThe worker pool setup."), (2, "In today's world of queues all is well."), (3, f"{body}\n\nSentence number thing1 thing2 tells thing3 thing4 thing5 tells."), (4, f"{body}\n\nIn short this new matter deserves another closer look."),
        (5, "\n\n".join(f"So the part {i} goes." for i in range(4))), (6, "Looking around. Running away. Tested again. It ends here."), (7, None), (8, ""),
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    assert rows(prose.frame_findings(df, "id", "t")) == [(1, "opening restates title"), (2, "generic opening"), (3, "closing restates body"), (4, "summary closing"), (5, "paragraphs open alike")]
    assert rows(prose.participle_runs(df, "id", "t"), "id", "start", "length") == [(6, 0, 3)]
    bad = spark.createDataFrame([(1, "We delve into robust, simple, and clean process. It is crucial, crucial, and leverages the tool, ensuring x. More, allowing y. It's worth noting that\nWhy does it matter to us?\n## The Big Bad Words")], "id int, t string")
    got = {r.rule: r.n for r in prose.rule_findings(bad, "id", "t").collect()}
    assert got == {"banned word": 2, "figurative word": 1, "capped word": 1, "banned phrase": 1, "stacked adjectives": 1, "rhetorical opener": 1, "participle tail": 1, "title case": 1}
    lines = spark.createDataFrame([("a", i, f"// x{i}") for i in range(5)] + [("b", i, "//  x") for i in range(5)], "f string, line int, t string")
    assert rows(prose.uniform_spacing(lines, "f", "t")) == [("a", 5)]
    marks = spark.createDataFrame([("a", 1, "Utilizes `a — b` here"), ("a", 2, "one \u2013 two"), ("a", 3, "one - two - 3"), ("a", 4, "word " * 21), ("a", 5, "must " + "word " * 21)], "f string, line int, t string")
    assert rows(prose.comment_checks(marks, "f", "line", "t"), "line", "check") == [(1, "banned word"), (2, "dash"), (3, "spaced hyphen"), (4, "too long")]


def test_intermediates_are_deleted(spark):
    from pathlib import Path

    with intermediates(spark):
        kept = materialize(spark.range(3), "kept")
        assert kept.count() == 3
    assert not Path(kept._corvane_path.removeprefix("file:")).exists()
    gone = materialize(spark.range(3), "gone")
    discard(gone)
    discard(spark.range(1))
    assert gone._corvane_path not in spark.sparkContext._corvane_tables and shared_dir(spark)
    drop_materialized(spark)
    assert not spark.sparkContext._corvane_tables
