"""The retrieval operators on small literals and against plain Python."""

import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.paths import canonical_path
from corvane.operators import analytics, chunking, codegraph, graph, index, prose, ranking, vectors
from corvane.sources import logs, markup, scan

one = lambda spark, column, **values: spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


# --- text -----------------------------------------------------------------------------------------


def test_identifier_tokens(spark):
    tokens = lambda t: one(spark, tx.identifier_tokens("t"), t=t)
    assert tokens("_sweep_project") == ["_sweep_project", "sweep", "project"]
    assert tokens("HTTPServer sweepProject") == ["httpserver", "http", "server", "sweepproject", "sweep", "project"]
    assert tokens("") == [] and tokens("!!! ??? ...") == [] and tokens("plain") == ["plain"]


def test_paths(spark):
    rows = [(".\\a\\B.py",), ("./x/./y",), (None,), ("",)]
    got = [r.x for r in spark.createDataFrame(rows, "p string").select(canonical_path("p").alias("x")).collect()]
    assert got == ["a/B.py", "x/./y", None, ""]


def test_hashes_and_slugs(spark):
    import hashlib

    assert one(spark, tx.chunk_id(F.col("f"), F.col("i")), f="a/b.py", i=3) == hashlib.sha256(b"a/b.py::3").hexdigest()[:16]
    assert one(spark, tx.topic_slug("t"), t="  State & Federal  ") == "state-federal"
    assert one(spark, tx.prefixed_hash("t"), t="") is None
    with pytest.raises(Exception, match="name"):
        one(spark, tx.topic_slug("t"), t=" & ")


def test_citations_and_redaction(spark):
    assert one(spark, tx.citation("h", "p"), h="Preamble", p="45 CFR ") == "45 CFR"
    assert one(spark, tx.citation("h", "p"), h="Sec. 1.2", p="Code") == "Code Sec. 1.2"
    assert one(spark, tx.related_citations("t"), t="see <b>45 CFR 160.103</b> and Pub. L. 104-191") == ["45 CFR 160.103", "Pub. L. 104-191"]
    assert one(spark, tx.redact("t"), t="api_key = abc123 rest") == "api_key = ***REDACTED*** rest"


def test_snippets_lose_markup_and_hidden_characters(spark):
    assert one(spark, tx.clean_snippet("t"), t="<b>a</b>&nbsp;b​  ﬁ\x07\n c") == "a b fi c"
    assert len(one(spark, tx.clean_snippet("t"), t="word " * 100)) == 200
    assert one(spark, tx.clean_code("t"), t="a\n  b​") == "a\n  b"


def test_covers_line(spark):
    assert one(spark, tx.covered_files("t"), t="x\n- COVERS: `a.py`, [b/c.ts], \nCOVERS: d") == ["a.py", "b/c.ts"]


def test_language_and_model(spark):
    assert one(spark, tx.language_of("p"), p="a/B.CS") == "csharp" and one(spark, tx.language_of("p"), p="Makefile") is None
    assert one(spark, tx.model_of("p"), p="Rust") == "Salesforce/SFR-Embedding-Code-400M_R"
    assert one(spark, tx.model_of("p"), p="cobol") == tx.FALLBACK_MODEL


# --- chunking -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(1, 12))
def test_forced_pieces_fit_and_lose_only_blanks(text, limit):
    pieces = chunking.force_split(text, limit)
    assert all(len(p) <= 4 * limit and p.strip() for p in pieces)
    assert "".join(pieces).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_forced_pieces_of_literals():
    assert chunking.force_split(" \n ", 5) == [] and chunking.force_split("abc", 0) == ["abc"] and chunking.force_split("", 0) == []
    assert chunking.force_split("x" * 30 + "\n" + "y" * 30, 10)[0] == "x" * 30 + "\n"


def test_heading_sections():
    s = chunking.heading_sections("intro\n# One\na\n\n## Two\nb", r"#{1,3}\s+", False, "Introduction")
    assert [(h, c) for h, c, _, _ in s] == [("Introduction", "intro"), ("One", "a"), ("Two", "b")]
    kept = chunking.heading_sections("pre\nSec. 1.1 A\nx", r"Sec\.\s*\d", True, "Preamble")
    assert [(h, c) for h, c, _, _ in kept] == [("Preamble", "pre"), ("Sec. 1.1 A", "Sec. 1.1 A\nx")]


def test_chunkers_hold_the_limit():
    wall = "word " * 3000
    for chunks in (chunking.markdown_chunks(wall, 100, 1), chunking.document_chunks(wall, max_tokens=100), chunking.fallback_chunks(wall, "f", 100, 1)):
        # parts are weighed one by one, so the blank lines between them may add a token
        assert chunks and all(len(c[1]) // 4 <= 101 for c in chunks)


def test_python_chunks_follow_definitions():
    body = "\n".join(f"    x{i} = {i}" for i in range(20))
    text = f"import os\n\n@deco\ndef f():\n{body}\n\n\nclass C:\n    def m(self):\n    {body.replace(chr(10), chr(10) + '    ')}\n"
    got = chunking.python_chunks(text, "stem")
    assert [c[0] for c in got] == ["def f", "class C"] and got[0][1].startswith("@deco")
    small = chunking.python_chunks(text, "stem", max_tokens=60)
    assert {"class C", "C.m", "def f"} == {c[0] for c in small}
    assert chunking.python_chunks("def broken(:\n", "stem", 500, 1)[0][0] == "stem"


@pytest.mark.parametrize("suffix,text,names", [
    ("go", 'package x\n\nimport "a"\n\n// Add adds.\nfunc Add(a, b int) int {\n\treturn a + b\n}\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) F() {\n}\n', ["func Add", "type T", "func (t *T) F"]),
    ("ts", "import {a} from 'b';\n\n/** doc */\nexport class Foo extends Bar {\n  load(a: string): Row {\n    return 1;\n  }\n}\n\nexport const f = async (a) => {\n  return a;\n};\n", ["export class Foo", "export const f"]),
    ("rs", "use a;\n\n#[test]\npub fn f(a: u8) -> u8 {\n    a\n}\n\nimpl T for A {\n    fn g() {}\n}\n", ["pub fn f", "impl T for A"]),
    ("java", "package a;\n\n@X\npublic class A {\n    int f() {\n        return 1;\n    }\n}\n", ["public class A"]),
    ("kt", "fun f(a: Int): Int {\n    return a\n}\n\nobject B {\n    fun g() {}\n}\n", ["fun f", "object B"]),
    ("rb", "class A\n  def f(a)\n    1\n  end\nend\n\ndef g\n  2\nend\n", ["class A", "def g"]),
    ("lua", "local function f(a)\n  return a\nend\n\nM.g = function(a)\n  return a\nend\n", ["local function f", "M.g"]),
    ("sh", "f() {\n  echo a\n}\n\nfunction g {\n  echo b\n}\n", ["f", "function g"]),
    ("c", "#include <a>\n\n// doc\nint f(int a)\n{\n    return 1;\n}\n\nstruct s {\n    int a;\n};\n", ["int f", "struct s"]),
])
def test_structure_chunks_follow_definitions(suffix, text, names):
    got = chunking.structure_chunks(text, "stem", suffix)
    assert [c[0] for c in got] == names
    lines = text.split("\n")
    assert all(c[1] == "\n".join(lines[c[2] - 1 : c[3]]) for c in got)


def test_large_classes_are_cut_at_their_methods():
    text = "/** d */\npublic class A {\n    @Get\n    public int f(int a) {\n        return 1;\n    }\n\n    int g() {\n        return 2;\n    }\n}\n"
    got = chunking.structure_chunks(text, "x", "java", 20, 5)
    assert [c[0] for c in got] == ["public class A", "A.f", "A.g"] and got[1][1].startswith("    @Get")
    assert chunking.structure_chunks("just text\n" * 30, "stem", "java", 500, 5)[0][0] == "stem" and chunking.structure_chunks("x", "s", "zzz", 500, 0)[0][0] == "s"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=20), st.integers(1, 40), st.integers(0, 20))
def test_packed_ranges_cover_and_fit(sizes, limit, overlap):
    at = 0
    for i, j in chunking.packed_ranges(sizes, limit, overlap):
        assert i in (at, at - 1) and j > at and (i == at or sizes[i] // 4 <= overlap)
        if j - i > 1 + (i < at):  # what was added to more than one paragraph was within the limit
            assert sum(sizes[i : j - 1]) // 4 + sizes[j - 1] // 4 <= limit
        at = j
    assert at == len(sizes)


def test_heading_pattern_is_checked(spark):
    assert one(spark, chunking.heading_matches("t", r"Sec\.\s"), t="x\nSec. 1") and not one(spark, chunking.heading_matches("t", "Sec"), t="x Sec")


def test_chunk_texts_skips_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "hello world, " * 10)], "id long, t string")
    got = chunking.chunk_texts(df, "id", "t", lambda t, s: chunking.fallback_chunks(t, s, 500, 1)).collect()
    assert [r.id for r in got] == [3]
    assert chunking.chunk_texts(df.limit(0), "id", "t", lambda t, s: []).count() == 0


# --- ranking --------------------------------------------------------------------------------------


def lists(spark, *ranked):
    rows = [(i, r + 1, 1.0, x) for i, xs in enumerate(ranked) for r, x in enumerate(xs)]
    return spark.createDataFrame(rows, "list_id int, rank int, weight double, id string")


def test_fusion(spark):
    order = lambda *r: [x.id for x in ranking.reciprocal_rank_fusion(lists(spark, *r), "id").orderBy("fused_rank").collect()]
    assert order(["a", "b"], ["c", "b"])[0] == "b"  # in both lists
    assert order(["a:1", "a:9"], []) == ["a:1", "a:9"]  # the same file on two lines
    assert order(["a"], ["b"]) == ["a", "b"]  # ties keep the first list first
    assert ranking.reciprocal_rank_fusion(lists(spark, ["a"]).limit(0), "id").count() == 0


def test_fusion_keeps_the_richest_record(spark):
    df = lists(spark, ["a"], ["a"]).withColumn("extra", F.when(F.col("list_id") == 1, "calls"))
    got = ranking.reciprocal_rank_fusion(df, "id", record=F.struct("extra"), richness=F.col("extra").isNotNull().cast("int")).first()
    assert got.record.extra == "calls" and got.rrf_score == round(2 / 61, 6)


def test_bm25_keeps_the_literal_match(spark):
    docs = spark.createDataFrame([("x", "def _sweep_project(path)"), ("y", "unrelated words"), ("z", None)], "id string, t string")
    got = {r.id for r in ranking.bm25(docs, "id", F.coalesce("t", F.lit("")), "sweepProject").collect()}
    assert got == {"x"}
    assert ranking.bm25(docs, "id", F.coalesce("t", F.lit("")), "???").count() == 0


def test_scores(spark):
    s = lambda kind, hop: one(spark, ranking.structural_score(F.lit(0.8), F.col("k"), F.col("h")), k=kind, h=hop)
    assert s("imports", 1) == 0.72 and s("calls", 2) == 0.448 and s("other", 1) == 0.56
    assert one(spark, ranking.boosted_score(F.col("s"), F.col("p"), F.col("c")), s=0.95, p="docs/guide.md", c="avoid this example") == 1.0
    tier = lambda h: one(spark, ranking.source_tier(F.col("h"), ("good.org",), ("bad.com",)), h=h)
    assert [tier(h) for h in ("a.Good.org", "good.org", "notgood.org", "bad.com")] == [0, 0, 1, 2]


def test_knn(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vectors.knn(df, [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.5), (3, 0.0)]
    assert [r.vec_id for r in vectors.knn(df, [1.0, 0.0], 5, min_score=0.4).collect()] == [1, 2]


# --- graph ----------------------------------------------------------------------------------------


def link(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_neighbours_have_shortest_hops(spark):
    rng = random.Random(1)
    pairs = list({(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(25)})
    links = link(spark, pairs)
    for direction in ("both", "callers", "dependencies"):
        step = {}
        for a, b in pairs:
            if direction != "callers":
                step.setdefault(a, set()).add(b)
            if direction != "dependencies":
                step.setdefault(b, set()).add(a)
        want, frontier = {"n0": 0}, {"n0"}
        for hop in range(1, 4):
            frontier = {y for x in frontier for y in step.get(x, ())} - set(want)
            want |= {y: hop for y in frontier}
        got = {r.file: r.hop for r in graph.neighbours(links, spark.createDataFrame([("n0",)], "seed string"), 3, direction).collect()}
        assert got == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        graph.neighbours(links, links, 9)


def test_frontier_is_pruned_by_centrality(spark):
    links = link(spark, [("a", "b"), ("a", "c"), ("a", "d")])
    central = spark.createDataFrame([("d", 0.9)], "file string, score double")
    got = graph.neighbours(links, spark.createDataFrame([("a",)], "seed string"), 1, "dependencies", max_nodes=2, centrality=central).collect()
    assert {r.file for r in got} == {"d", "b"}


@pytest.mark.parametrize("small", [True, False])
def test_pagerank_sums_to_one(spark, small):
    links = link(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e")])
    got = {r.file: r.score for r in graph.pagerank(links, 40, tolerance=1e-6, in_memory=small).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "a"
    seeded = {r.file: r.score for r in graph.pagerank(links, 20, seeds=spark.createDataFrame([("c",), ("zzz",)], "file string"), in_memory=small).collect()}
    assert abs(sum(seeded.values()) - 1) < 1e-9 and seeded["d"] == 0.0
    assert graph.pagerank(links, 3, seeds=spark.createDataFrame([("zzz",)], "file string"), in_memory=small).count() == 0
    assert graph.pagerank(links.limit(0), 3, in_memory=small).count() == 0


def test_both_pageranks_stop_alike(spark):
    links = link(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e"), ("f", "d")])
    for seeds in (None, spark.createDataFrame([("d",)], "file string")):
        got = [{r.file: round(r.score, 12) for r in graph.pagerank(links, 60, seeds=seeds, tolerance=1e-3, check_every=4, in_memory=m).collect()} for m in (True, False)]
        assert got[0] == got[1] and len(got[0]) == 6


@pytest.mark.parametrize("name", ["pagerank", "personalized_pagerank"])
def test_converged_pagerank_solves_the_equations(spark, name):
    import numpy as np

    from corvane.plans import graph_queries as gq
    from tests.conftest import DATA

    links = sorted({(r.src, r.dst) for r in gq._links(spark, DATA).collect()})
    files = sorted({f for x in links for f in x})
    at, n = {f: i for i, f in enumerate(files)}, len(files)
    step = np.zeros((n, n))
    for a, b in links:
        step[at[b], at[a]] = 1
    tele = np.full(n, 1 / n)
    if name != "pagerank":
        seeds = [at[r.seed] for r in gq._seeds(gq._links(spark, DATA)).collect()]
        tele = np.bincount(seeds, minlength=n) / len(seeds)
    degree = step.sum(axis=0)
    step = np.where(degree > 0, step / np.maximum(degree, 1), tele[:, None])
    want = np.linalg.solve(np.eye(n) - 0.85 * step, 0.15 * tele)
    got = {r.file: r.score for r in gq.QUERIES[f"{name}_converged"](spark, DATA).collect()}
    assert set(got) == set(files) and max(abs(got[f] - want[at[f]]) for f in files) < 1e-7


def test_symbols_resolve_by_priority(spark):
    files = spark.createDataFrame([("src/app/util.py",), ("src/app/main.py",), ("web/Button/index.ts",), ("web/a.tsx",), ("lib/foo.ts",)], "file string")
    asked = [("src.app.util", "src/app/main.py"), (".util", "src/app/main.py"), ("./Button", "web/a.tsx"), ("@/lib/foo", "web/a.tsx"), ("../lib/foo.js", "web/a.tsx"), ("util as u", "x.py"), ("nothing", "x.py")]
    df = spark.createDataFrame(asked, "target_symbol string, source_file string")
    got = {r.target_symbol: r.resolved for r in graph.resolve_symbols(df, files).collect()}
    assert got == {
        "src.app.util": "src/app/util.py", ".util": "src/app/util.py", "./Button": "web/Button/index.ts", "@/lib/foo": "lib/foo.ts", "../lib/foo.js": "lib/foo.ts",
        "util as u": "src/app/util.py", "nothing": None,
    }


def test_external_symbols(spark):
    is_ext = lambda s, f: one(spark, graph.is_external(F.col("s"), F.col("f")), s=s, f=f)
    assert is_ext("react", "a.ts") and not is_ext("@/x", "a.ts") and not is_ext("./x", "a.ts")
    assert is_ext("os.path", "a.py") and is_ext("numpy", "a.py") and not is_ext("own.module", "a.py")
    assert is_ext("System.Text", "a.cs") and not is_ext("Own.Api", "a.cs") and is_ext("org.junit.Test", "A.java") and not is_ext("fooBar", "a.rs")


def test_namespaces_tell_libraries_from_own_modules(spark):
    files = spark.createDataFrame([("pkg/own/mod.py",), ("Acme.Api\\Orders.cs",), ("protos/google.api/x.py",), (None,)], "file string")
    rows = [
        ("requests.adapters", "a.py", "calls", True), ("own.mod", "a.py", "imports", False), ("google.cloud", "a.py", "imports", True), (".x", "a.py", "imports", False), ("np.z as q", "a.py", "imports", True),
        ("Acme.Widgets", "a.cs", "imports", False), ("Other.Widgets", "a.cs", "imports", True), ("Other.Widgets", "a.cs", "calls", False), ("google.x", "a.cs", "imports", False),
        ("react", "a.ts", "imports", True), (None, "a.py", "imports", False), ("", "a.cs", "imports", False), ("x", None, "imports", False),
    ]
    df = spark.createDataFrame(rows, "target_symbol string, source_file string, edge_type string, want boolean")
    assert [tuple(r) for r in graph.with_external(df, files).where("external <> want OR external IS NULL").collect()] == []


def test_files_are_gone_when_all_their_lives_have_ended(spark):
    manifest = spark.createDataFrame([("p/a.py", "x"), ("p/a.py", None), ("./p/b.py", "x"), ("p\\b.py", "y"), ("p/c.py", None), (None, "x")], "file string, deleted_at string")
    gone = index.ended_files(manifest)
    assert [r.file for r in gone.collect()] == ["p/b.py"]
    chunks = spark.createDataFrame([("./p/a.py",), ("p\\b.py",), ("p/c.py",), (None,)], "source_file string")
    assert {r.source_file for r in index.delete_files(chunks, gone).collect()} == {"./p/a.py", "p/c.py", None}
    edges = spark.createDataFrame([("p/a.py", ".\\p\\b.py"), ("./p/b.py", "p/a.py"), ("p/a.py", ""), ("p/a.py", None)], "source_file string, target_file string")
    c, e, m = index.drop_files(gone, chunks, edges, manifest)
    assert (c.count(), sorted(r.target_file or "-" for r in e.collect()), m.count()) == (3, ["-", "-"], 4)


def test_sweep_actions(spark):
    changes = spark.createDataFrame([(p, f"f{i}", s) for p, n, s in (("a", 50, "new"), ("b", 49, "changed"), ("c", 60, "deleted"), ("d", 90, "unchanged")) for i in range(n)], "project string, file string, state string")
    projects = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", None), ("e", None)], "project string, incomplete boolean")
    assert {r.project: (r.n_changed, r.action) for r in index.sweep_actions(changes, projects).collect()} == {"a": (50, "full"), "b": (49, "files"), "c": (60, "resume"), "d": (0, "none"), "e": (0, "none")}


def test_edge_maintenance(spark):
    e = spark.createDataFrame([("a", "b"), ("b", ""), ("c", "_external_"), ("c", "gone"), ("gone", "a")], "source_file string, target_file string")
    left = lambda df: sorted((r.source_file, r.target_file) for r in df.collect())
    current = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert left(graph.delete_ghosts(e, current)) == [("a", "b"), ("b", ""), ("c", "_external_")]
    assert left(graph.delete_referencing(e, spark.createDataFrame([("gone",), ("",)], "file string"))) == [("a", "b"), ("b", ""), ("c", "_external_")]


# --- index ----------------------------------------------------------------------------------------


def test_diff_partitions_the_files(spark):
    scan_ = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("u", index.UNREADABLE)], "file string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4"), ("u", index.UNREADABLE)], "file string, hash string")
    assert {r.file: r.state for r in index.diff(scan_, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted", "u": "unreadable"}


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1)], "id string, v int")
    got = {r.id: r.v for r in index.upsert(old, new, "id", [F.desc("v")]).collect()}
    assert got == {"a": 3, "b": 1, "c": 1}


def test_gates_are_rows(spark):
    p = spark.createDataFrame([("a", "m", 3, False), ("b", None, 3, False), ("c", "n", 3, False), ("d", "m", 0, False), ("e", "m", 2, True)], "project string, model_id string, n_files long, incomplete boolean")
    got = {r.project: (r.reason, r.served) for r in index.index_gates(p, "m").collect()}
    assert got == {"a": ("ok", True), "b": ("unknown model", False), "c": ("other model", False), "d": ("missing", False), "e": ("incomplete", True)}


# --- analytics ------------------------------------------------------------------------------------


def test_language_vote_prefers_applications(spark):
    rows = [("p", "sql")] * 9 + [("p", "Python")] * 2 + [("q", "yaml")] * 2 + [("r", None), ("r", "unknown")]
    got = {r.g: r.dominant for r in analytics.language_vote(spark.createDataFrame(rows, "g string, lang string"), ["g"]).collect()}
    assert got == {"p": "python", "q": "yaml", "r": None}


def test_chain_detects_changes(spark):
    df = spark.createDataFrame([("u", i, f"e{i}") for i in range(5)], "k string, i int, b string")
    chain = analytics.build_chain(df, "k", ["i"], F.col("b"))
    assert analytics.verify_chain(chain, "k").count() == 0
    bad = chain.withColumn("body", F.when(F.col("line") == 3, "x").otherwise(F.col("body")))
    assert [(r.line, r.fault) for r in analytics.verify_chain(bad, "k").collect()] == [(3, "body differs")]
    cut = chain.where("line <> 2")
    assert [(r.line, r.fault) for r in analytics.verify_chain(cut, "k").collect()] == [(3, "parent differs")]


def test_hazards(spark):
    cat = lambda t: one(spark, analytics.hazard_categories("t"), t=t)
    assert cat("cursor.execute(q)  # x") == ["sql"] and cat("# the password policy") == [] and cat("  # type: ignore") == ["test-weakening"]
    assert one(spark, analytics.path_hazards("t"), t="app/login_schema.py") == ["sql", "auth"]


def test_scope_globs(spark):
    files = spark.createDataFrame([("src/a/b.py",), ("src/x.ts",), ("web/src/x.ts",), ("lib/c.go",)], "file string")
    hit = lambda p: sorted(r.file for r in analytics.in_scope(files, spark.createDataFrame([(p,)], "pattern string")).collect())
    assert hit("src/*.ts") == ["src/x.ts", "web/src/x.ts"] and hit("src/**") == ["src/a/b.py", "src/x.ts", "web/src/x.ts"] and hit("b.py") == ["src/a/b.py"]


def test_hunks(spark):
    assert one(spark, analytics.hunk_header("t"), t="@@ -3 +4,2 @@ def f") == (3, 1, 4, 2)
    got = analytics.hunk_counts(spark.createDataFrame([("f", "+a\n+b\n-c\n d\n+++ x")], "file string, code string")).first()
    assert (got.added, got.removed) == (2, 1)


def test_sentences(spark):
    assert one(spark, prose.sentences("t"), t="Dr. Who came. He left early! \"So what?\" one") == ["Dr. Who came.", "He left early!", '"So what?" one']


# --- sources --------------------------------------------------------------------------------------


def test_secrets(spark):
    secret = lambda t: one(spark, scan.looks_secret(F.col("t")), t=t)
    assert secret("key AKIA" + "ABCDEFGHIJKLMNOP") and secret('{"password": "hunter2hunter2"}') and secret("DB_PASSWORD=abcdefgh12345678\n")
    assert not secret('password = "your_password_here"') and not secret('passwordErrorMessage = "abcdefgh12345678"') and not secret("password = get_password()")
    assert not secret('secret = "this is only prose, nothing else"') and not secret("") and not secret('apiKey = "${API_KEY_VALUE}"')


def test_scan_reads_folders(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "node_modules/b.py": b"y", "c.min.js": b"z", "d.bin": b"q", "e.py": b"\x00\x01", "f.py": b"\xff\xfe\xfa", "appsettings.dev.json": b"{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.content, r.hash) for r in scan.scan(scan.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.py", "f.py"} and got["f.py"] == (None, scan.UNREADABLE) and got["a.py"][0] == "x = 1"


def test_ignore_rules(spark):
    files = spark.createDataFrame([("a.log",), ("x/b.log",), ("keep.log",), ("out/c.py",), ("src/d.py",), ("docs/e.md",)], "path string")
    left = sorted(r.path for r in scan.drop_ignored(files, ["# note", "*.log", "!keep.log", "out/", "/docs/*.md"]).collect())
    assert left == ["keep.log", "src/d.py"]


def test_markup(spark):
    page = "<html><head><title>t</title></head><body><h2>Head</h2><p>A &amp; B<script>x</script></p><a href='u'>link</a></body></html>"
    assert one(spark, markup.html_to_text("t"), t=page) == "## Head\n\nA & B\nlink"
    xml = '<?xml version="1.0"?><DIV8 N="160.103" TYPE="SECTION" x="{&quot;a&quot;}"><HEAD>§ 160.103</HEAD><P>One  &lt;two&gt;</P><CITA>drop</CITA></DIV8>'
    assert one(spark, markup.regulation_to_text("t"), t=xml) == "§ 160.103\nOne <two>"
    assert one(spark, markup.section_numbers("t"), t=xml) == ["160.103"]


def test_links_and_crawl(spark):
    pages = spark.createDataFrame([("https://h.org/a/i.html", '<a href="/b/">x</a><a class="c" href="d.html#f">y</a><a href="https://o.org/">z</a><a href="/img.png">p</a>')], "url string, html string")
    links = markup.extract_links(pages)
    assert sorted(r.link for r in links.collect()) == ["https://h.org/a/d.html", "https://h.org/b", "https://h.org/img.png", "https://o.org"]
    kept = links.where(markup.worth_crawling("link", F.lit("h.org")))
    assert sorted(r.link for r in kept.collect()) == ["https://h.org/a/d.html", "https://h.org/b"]
    got = {r.url: r.depth for r in markup.crawl(kept, pages.select("url"), 2, 2).collect()}
    assert got == {"https://h.org/a/i.html": 0, "https://h.org/a/d.html": 1}


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in logs.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "projects.json").write_text('{"p": {"path": "/x", "n_files": 3}, "q": {"path": "/y"}}')
    got = {r.project: (r.path, r.n_files) for r in logs.read_registry(spark, str(tmp_path / "projects.json")).collect()}
    assert got == {"p": ("/x", 3), "q": ("/y", None)}


def test_edges_of_sources():
    py = "import os\nfrom .util import helper as h\nclass A(Base):\n    def m(self):\n        h(os.path.join('a'))\n"
    got = codegraph.extract(py, "python", "a.py")
    assert ("", "os", "imports", "EXTRACTED") in got and ("A", "Base", "inherits", "EXTRACTED") in got and ("A.m", ".util.helper", "calls", "INFERRED") in got
    cs = "using App.Core;\nclass S : Base, IThing {\n void M() { Helper.Run(); field.Go(); }\n}"
    got = codegraph.extract(cs, "csharp", "a.cs")
    assert ("", "App.Core", "imports", "EXTRACTED") in got and ("S", "IThing", "implements", "EXTRACTED") in got
    assert ("S.M", "Helper.Run", "calls", "INFERRED") in got and ("S.M", "Go", "calls", "INFERRED") in got and not any(t == "M" for _, t, *_ in got)


def test_metrics():
    loc, functions, classes, worst, rank, imports, calls, names = codegraph.python_metrics("import os\n# c\ndef f(x):\n    if x and os:\n        return g(x)\n")
    assert (loc, functions, classes, worst, rank, imports, calls, names) == (4, 1, 0, 3, "A", ["os"], ["g"], ["f"])
    assert codegraph.python_metrics("def (")[1] is None
    assert ast.parse("x")
