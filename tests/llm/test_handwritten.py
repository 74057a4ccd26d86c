"""Classifiers for files that nobody wrote by hand."""

import random

import numpy as np

from corvane.llm import handwritten as hw

SCHEMA = "source_file string, content string, path string, body double"
CODE = "def load_{0}(row):\n    value = read_{1}(row, {2})\n    if not value:\n        return None\n    return store(value)\n"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        repo = f"repo-{i % 9}"
        body = "".join(CODE.format(rng.choice("abcdef"), rng.choice("uvwxyz"), rng.randrange(999)) for _ in range(4))
        path, text = f"{repo}/src/mod_{i:x}.py", body
        kind = rng.randrange(10)
        if kind == 0:
            path = f"{repo}/node_modules/pkg-{i % 5}/mod_{i:x}.js"
        elif kind == 1:
            path = f"{repo}/src/mod_{i:x}.pb.go"
        elif kind == 2:
            text = f"# Code generated by tool{i % 7}gen v{i}.1. DO NOT EDIT.\n\n" + body
        elif kind == 3:
            text = "DATA = [" + ",".join(str(rng.randrange(10**6)) for _ in range(200)) + "]"
        elif kind == 4:
            text = "# Hand-written wrapper around the generated client.\n\n" + body
            path = f"{repo}/src/generator_{i:x}.py"
        if kind < 4:
            truth.add(path)
        rows.append((path, text, "clash", 0.0))
    return rows, truth


def test_finds_what_conventions_name(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows + [(rows[0][0], None, None, None), (None, "x", None, None), ("repo-1/empty.py", "", None, None), rows[5]], SCHEMA)
    got = [r.source_file for r in hw.not_handwritten(df).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & truth) >= 0.97 * len(truth) and len(set(got) - truth) <= 0.03 * len(truth)
    assert hw.scored_files(df).count() == len({r[0] for r in rows}) + 1


def test_held_out_repositories_are_measured(spark):
    rows, _ = corpus()
    got = {r.view: r for r in hw.held_out_accuracy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {*hw.VIEWS, "head without giveaways"} and all(r.recall is None or r.recall >= 0.8 for r in got.values())
    agreed = {(r.labelled, r.found): r.n for r in hw.against_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(agreed.values()) == len(rows)


def test_finds_wording_that_no_fact_labels(spark):
    rows, _ = corpus()
    plain = [(f"repo-{i % 9}/src/plain_{i}.py", f"# Code generated, tool {i % 7}. Never patch this output; run the task again.\n\n" + CODE.format("a", "b", i), None, None) for i in range(40)]
    rows += [(f"repo-{i % 9}/src/made_{i:x}.pb.py", p[1], None, None) for i, p in enumerate(plain)]  # labelled by their paths
    chunks = spark.createDataFrame(rows + plain[:12], "source_file string, content string, path string, body double")
    assert not any(any(hw.facts(p, c)) for p, c, *_ in plain)
    assert {p[0] for p in plain[:12]} <= {r.source_file for r in hw.not_handwritten(chunks).collect()}


def test_facts_and_masks():
    head = "// Made by `gen --in a` from b.proto, toolgen v1.2 (c) acme on 2024-01-02"
    for text in ("// a `gen --in a` b", "// from b.proto", "// toolgen v1.2", "// (c) acme", "// on 2024-01-02"):
        assert hw.head_fact(text, "proj") and hw.facts("proj/a.py", text + "\n\nx = 1")[1] and not hw.facts("proj/a.py", text + "\n\nx = 1", False)[1], text
    for text in ("// @generated", "# Code generated by x. DO NOT EDIT.", "// <auto-generated>"):
        assert hw.facts("proj/a.py", text + "\nx = 1", False)[1], text
    for text in ("// Copyright 2025 the proj team.", "// Writes the marker 'DO NOT EDIT'", "// Version 1.2 made it slow", "// Measured, it took 80.24 ms", "", "// --------------------------------------------------------"):
        assert not hw.head_fact(text, "proj"), text
    masked = hw.masked_head(head, "proj")
    assert not any(x in masked for x in ("gen --in", "proto", "toolgen", "1.2", "(c)", "2024"))
    assert "generated" not in hw.masked_head("# @generated by x", "proj", True)
    assert hw.body_fact("x = '" + "Ab3" * 90 + "'") and not hw.body_fact(CODE.format("a", "b", 1) * 5)


def test_empty_and_one_class(spark):
    df = spark.createDataFrame([("r/a.py", "x = 1", None, None)], SCHEMA)
    assert hw.not_handwritten(df.limit(0)).count() == 0 and hw.not_handwritten(df).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 50, 30).astype(np.uint32) + (0 if i % 4 else 40) for i in range(200)]
    labels = np.array([i % 4 == 0 for i in range(200)])
    for counted in (False, True):
        m = hw.fit_svm(rows, labels, counted)
        assert np.mean([(m.score(r) > 0) == y for r, y in zip(rows, labels)]) > 0.97


def test_many_texts_score_like_one():
    texts = ["", "ab", "some body of code", "x" * 5000, "日本語のテキスト", "a"]
    m = hw.Classifier(np.random.default_rng(1).normal(size=1 << hw.BITS).astype(np.float32), 0.3, 0.1, True)
    assert np.allclose(m.score_texts(texts, hw.GRAMS_BODY), [m.score(hw.grams(t, hw.GRAMS_BODY)) for t in texts], atol=1e-6)


def test_heads_are_masked_from_bodies():
    head, body = hw.split_chunk("// Code generated by x. DO NOT EDIT.\n\nimport a\nint x;\n//# sourceMappingURL=a.js.map")
    assert "generated" in head and "sourceMapping" in head and body.startswith("import a") and "sourceMapping" not in body
