"""Indexing as a whole: an update gives what a new index would."""

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import index, store
from corvane.plans import indexing
from corvane.streaming import index_stream

BODY = "\n".join(f"    value_{i} = compute({i})" for i in range(12))


def scan(spark, files):
    rows = [(f, t) for f, t in files.items()]
    return spark.createDataFrame(rows, "file string, content string").withColumn("hash", F.coalesce(tx.short_hash("content"), F.lit(index.UNREADABLE)))


FIRST = {
    "app/main.py": f"from app.util import helper\nimport os\n\ndef main():\n{BODY}\n    helper()\n",
    "app/util.py": f"def helper():\n{BODY}\n",
    "app/gone.py": f"import app.util\n\ndef bye():\n{BODY}\n",
    "app/bad.py": None,
}


def test_update_equals_rebuild(spark, rows):
    second = {k: v for k, v in FIRST.items() if k != "app/gone.py"} | {"app/util.py": f"def helper(x):\n{BODY}\n", "app/new.py": f"import app.main\n\ndef n():\n{BODY}\n"}
    old = indexing.index_files(scan(spark, FIRST), iterations=5)
    updated, rebuilt = indexing.index_files(scan(spark, second), old, 5), indexing.index_files(scan(spark, second), iterations=5)
    cols = ["chunk_id", "file", "section", "content"]
    assert rows(updated.chunks, *cols) == rows(rebuilt.chunks, *cols)
    assert {r.file for r in rebuilt.chunks.collect()} == {"app/main.py", "app/util.py", "app/new.py"}
    edge = lambda i: {(r.source_file, r.target_symbol, r.target_file) for r in i.edges.collect()}
    assert edge(updated) == edge(rebuilt)
    assert ("app/main.py", "app.util", "app/util.py") in edge(rebuilt) and ("app/main.py", "os", "_external_") in edge(rebuilt)
    assert {r.file: round(r.score, 9) for r in updated.ranks.collect()} == {r.file: round(r.score, 9) for r in rebuilt.ranks.collect()}


def test_waiting_edges_resolve_when_their_file_arrives(spark):
    first = {"p/a.py": f"from .b import x\nimport p.gone\n\ndef a():\n{BODY}\n", "p/gone.py": f"def g():\n{BODY}\n"}
    second = {"p/a.py": first["p/a.py"], "p/b.py": f"def x():\n{BODY}\n"}
    old = indexing.index_files(scan(spark, first), iterations=2)
    edge = lambda i: {(r.source_file, r.target_symbol, r.target_file) for r in i.edges.collect()}
    assert ("p/a.py", ".b", "") in edge(old) and ("p/a.py", "p.gone", "p/gone.py") in edge(old)
    updated = indexing.index_files(scan(spark, second), old, 2)
    assert edge(updated) == edge(indexing.index_files(scan(spark, second), iterations=2)) and ("p/a.py", ".b", "p/b.py") in edge(updated)


def test_changed_documents_replace_their_chunks(spark):
    text = "Sec. 1.1 Scope\nThis rule covers all of it, whatever it may be.\n" * 3
    schema = "source_id string, topic string, prefix string, text string"
    one = spark.createDataFrame([("a", "Law", "", text), ("b", "Law", "", text + "b"), ("n", "Law", "", None)], schema)
    old = indexing.update_documents(indexing.ingest_documents(one.limit(0), spark.createDataFrame([], "source_id string, content_hash string"), r"Sec\.\s"), one, r"Sec\.\s")
    two = spark.createDataFrame([("a", "Law", "", "Sec. 2.1 Other\nIt covers something else entirely now.\n"), ("b", "Law", "", text + "b")], schema)
    new = indexing.update_documents(old, two, r"Sec\.\s")
    assert {r.citation for r in new.where("source_id = 'a'").collect()} == {"Sec. 2.1 Other"}
    kept = lambda df: sorted((r.chunk_id, r.content) for r in df.where("source_id = 'b'").collect())
    assert kept(new) == kept(old) and kept(old)


def test_documents_are_ingested_once(spark):
    text = "Preface text that is long enough to stay here.\nSec. 1.1 Scope\nThis rule covers all of it. See 45 CFR 160.103.\n" * 3
    sources = spark.createDataFrame([("a", "State Law", "Code", text), ("b", "State Law", "", "no heading here at all"), ("c", "x", "p", None)], "source_id string, topic string, prefix string, text string")
    known = spark.createDataFrame([], "source_id string, content_hash string")
    got = indexing.ingest_documents(sources, known, r"Sec\.\s", 500).collect()
    assert {r.source_id for r in got} == {"a"} and {r.topic for r in got} == {"state-law"}
    assert any(r.citation == "Code Sec. 1.1 Scope" and r.related == ["45 CFR 160.103"] for r in got)
    again = spark.createDataFrame([(r.source_id, r.content_hash) for r in got], "source_id string, content_hash string")
    assert indexing.ingest_documents(sources, again, r"Sec\.\s", 500).count() == 0


def test_collections(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("a", "x", [1.0, 2.0]), ("b", "y", None)], "chunk_id string, project string, embedding array<float>")
    store.write_collection(df, str(tmp_path / "t"), "project", 2)
    store.write_collection(df.where("project = 'x'").withColumn("chunk_id", F.lit("c")), str(tmp_path / "t"), "project", 2)
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c"]
    assert [r.chunk_id for r in store.read_collection(spark, str(tmp_path / "t"), "project", "y").collect()] == ["b"]
    with pytest.raises(Exception, match="width"):
        store.write_collection(df, str(tmp_path / "u"), "project", 3)
    assert store.fragmentation(spark, str(tmp_path / "t")).first().small == 2
    assert not store.compact_if_needed(spark, str(tmp_path / "t"), str(tmp_path / "v"), "project")
    assert store.compact_if_needed(spark, str(tmp_path / "t"), str(tmp_path / "v"), "project", 1)


def test_graph_status(spark):
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    around = spark.createDataFrame([("b", True)], "file string, is_caller boolean")
    one = lambda a, b: tuple(store.graph_status(a, b).first())
    assert one(links, around) == ("hit", 1, 1) and one(links, around.limit(0)) == ("empty", 0, 0) and one(links.limit(0), around.limit(0)) == ("absent", 0, 0)


def test_masks_and_instants(spark):
    df = spark.createDataFrame([('a `b` "c" d',), ("2024-01-01T10:00:00Z",), ("2024-01-01T10:00:00+02:00",), ("2024-01-01T10:00:00",), (None,)], "t string")
    got = df.select(tx.mask_exempt("t").alias("m"), tx.parse_instant("t").cast("string").alias("p")).collect()
    assert got[0].m == "a         d" and got[4].m is None and got[0].p is None
    assert [r.p for r in got[1:4]] == ["2024-01-01 10:00:00", "2024-01-01 08:00:00", "2024-01-01 10:00:00"]


def test_streamed_files_resume(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, index_stream.FILE_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    run = lambda: index_stream.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put("a", [("a.py", "one two three four five six seven eight nine ten " * 2, 1)])
    run()
    put("b", [("a.py", "another content that is long enough to be stored as a chunk", 2), ("b.py", "second file with enough content to be stored as a chunk", 1)])
    run()
    got = sorted((r.file, r.content.split()[0]) for r in index_stream.current_chunks(spark, str(tmp_path / "out")).collect())
    assert got == [("a.py", "another"), ("b.py", "second")]
