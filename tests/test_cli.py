from __future__ import annotations

from factloom.cli import run


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_store(spark, tmp_path):
    path = str(tmp_path / "kv")
    spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("b", 3, "zz")], "key string, seq long, value string").write.parquet(path)
    assert rows(run(spark, ["keys", path])) == [("b",), ("a",)]
    assert rows(run(spark, ["find", path, "b"])) == [("b", "zz")] and rows(run(spark, ["find", path, "c"])) == [("c", "")]
    assert rows(run(spark, ["stats", path])) == [(2, 2, 3)]


def test_logs(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("Finished: 'f' FILE d/a.c REDUNDANT 1 ASSERTION 4 SUCCESS 3 REPORT 1\nREPORT Timeout 'r1'\nTRAIT: Field x\nTRAIT: Block y\nREPORT Timeout 'r2'\nTRAIT: Field x\nREPORT Timeout 'r3'\nTRAIT: Field z\n")
    assert rows(run(spark, ["scan", str(log)])) == [(1, 4, 3, 1, 0.8, 0.75)]
    assert rows(run(spark, ["scan", str(log), "--split"])) == [("d", 1, 5)]
    assert rows(run(spark, ["cluster", str(log)])) == [("Field x", 2, 2)]
    assert rows(run(spark, ["cluster", str(log), "--keep-last", "--exclude", "x$"])) == [("Field z", 1, 1)]


def test_worklist(spark, tmp_path):
    path = str(tmp_path / "calls")
    spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string").write.parquet(path)
    assert rows(run(spark, ["worklist", path])) == [("c", 0), ("b", 1), ("a", 2)]


def test_store_options(spark, tmp_path):
    path, root = str(tmp_path / "kv"), tmp_path / "src"
    root.mkdir()
    (root / "a.c").write_text("int x;")
    assert rows(run(spark, ["source", str(root), path, "--basedir", f"{root}/", "--initial", "--log", str(tmp_path / "log")])) == [(1,)]
    assert rows(run(spark, ["find", path, "a.c", "--plain-text"])) == [("int x;",)] and rows(run(spark, ["find", path, "a.c", "--raw-tags"])) == [("a.c", b"int x;".hex().upper())]
    assert rows(run(spark, ["keys", path, "--print-stats"])) == [(1, 3, 6)] and (tmp_path / "log").read_text().startswith("source")


def test_programs(spark, tmp_path):
    from factloom.operators.symbolic import EDGES

    path, names, xml = str(tmp_path / "edges"), tmp_path / "names", str(tmp_path / "xml")
    edges = [("f", 0, 1, "loop", "L", "i"), ("f", 1, 2, "assume", "i < arg0", None), ("f", 2, 3, "assign", "z", "b[i]"), ("g", 0, 1, "assume", "n <= ubound(b)", None), ("g", 1, 2, "call", "f", "n"), ("g", 2, 3, "call", "*p", "n"), ("h", 0, 1, "call", "g", "")]
    spark.createDataFrame(edges, EDGES).coalesce(1).write.parquet(path)
    names.write_text("f\n")
    found = {r.kind: r for r in run(spark, ["check", path, "--ck-verbose", "--ck-dump", "--ck-assigns", "--ck-sufficient", "--solver-constraint", "--xml-out", xml]).collect()}
    assert found["read_overflow"].verdict == "success" and found["read_overflow"].sufficient == "(arg0 - ubound(b, e) <= 0)"
    bad = found["read_underflow"]
    assert bad.verdict == "report" and "i + 1 <= 0" in bad.formula and bad.assigns and "yes" in bad.queries and spark.read.json(xml).count() == 1
    assert rows(run(spark, ["check", path, "--check-kind", "read_overflow", "--check-file", str(names), "--check-type", "b", "--timeout", "600", "--solver", "linear"])) == [("f", "read_overflow", 2, "success")]
    assert rows(run(spark, ["check", path, "--check-kind", "read_overflow", "--ck-depth", "1"])) == [("f", "read_overflow", 2, "report")]
    assert rows(run(spark, ["check", path, "--check-type", "other"])) == []
    out = rows(run(spark, ["effects", path, "--print-cfgs", "--print-memory", "--print-indirect", "--print-escape"]))
    assert {r[0] for r in out} == {"modset", "cfg", "memory", "indirect", "escape"} and ("modset", "h", "z") in out and ("indirect", "g", "*p") in out
    assert ("modset", "h", "z") not in rows(run(spark, ["effects", path, "--pass-limit", "1"]))
    assert {r[0] for r in rows(run(spark, ["infer", path, "--print-invariants"]))} >= {"assertion"}
