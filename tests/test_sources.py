from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import diagnostics
from graphloom.schema import EDGES
from graphloom.sources import difftext, extract, project, sensors, symbols
from graphloom.streaming import windows


def logs(spark, text):
    return spark.createDataFrame([(1, text)], "log_id int, text string")


def rows(df):
    return [(r["path"], r["line"], r["column"], r["severity"], r["message"], r["code"]) for r in df.orderBy("n").collect()]


def test_parsers(spark):
    json_log = '{"reason":"compiler-message","message":{"message":"m","code":{"code":"E1"},"level":"error","spans":[{"file_name":"x","line_start":1,"column_start":1,"is_primary":false},{"file_name":"a.rs","line_start":3,"column_start":4,"is_primary":true}]}}\n{"reason":"build-finished"}\nnot json'
    assert rows(diagnostics.parse(logs(spark, json_log), "cargo-json")) == [("a.rs", 3, 4, "Error", "m", "E1")]
    text = "test tests::mod::one ... FAILED\nthread 'x' panicked at src/lib.rs:12:5\ntest ok ... ok"
    assert rows(diagnostics.parse(logs(spark, text), "cargo-test")) == [("tests/mod/one", 0, None, "Error", "test tests::mod::one ... FAILED", None), ("src/lib.rs", 12, 5, "Error", "thread 'x' panicked at src/lib.rs:12:5", None)]
    assert rows(diagnostics.parse(logs(spark, "./main.go:10:5: undefined: foo\nx.go:bad: y"), "go-build")) == [("./main.go", 10, None, "Error", "5: undefined: foo", None)]
    go = "--- FAIL: TestA (0.0s)\n\ta.go:3: boom\n\ta.go:4: again\nok\n\tb.go:1: alone"
    assert [r[4] for r in rows(diagnostics.parse(logs(spark, go), "go-test"))] == ["[TestA (0.0s)] boom", "again", "alone"]
    assert rows(diagnostics.parse(logs(spark, "tests/a.py:10: ValueError: x\na.py:2: note\na.py:x: no"), "pytest")) == [("tests/a.py", 10, None, "Error", "ValueError: x", None), ("a.py", 2, None, "Warning", "note", None)]
    assert rows(diagnostics.parse(logs(spark, "FAIL src/a.test.js\nPASS b"), "jest")) == [("src/a.test.js", 0, None, "Error", "FAIL src/a.test.js", None)]
    report = '{"testResults":[{"assertionResults":[{"status":"failed","title":"t","fullName":"f","ancestorTitles":["a.test.js"],"failureMessages":["boom"],"lineNumber":7},{"status":"passed"}]}]}'
    assert rows(diagnostics.parse(logs(spark, report), "jest")) == [("a.test.js", 7, None, "Error", "boom", None)]
    for parser in diagnostics.PARSERS:
        assert diagnostics.parse(logs(spark, ""), parser).count() == 0
        assert diagnostics.parse(logs(spark, None), parser).count() == 0


def test_decorate(spark):
    from graphs import small

    out = diagnostics.decorate(small(spark), logs(spark, "/src/a.py:2: error\n/src/a.py:3: error x\n/src/a.py:4: w"), "pytest")
    assert out["summary"].first().asDict() == {"errors": 2, "warnings": 1, "files": 1}
    found = diagnostics.with_symbols(small(spark), spark.createDataFrame([("/src/a.rs", 5)], "path string, line int"))
    assert found.first()["symbol"] == "a"


def test_sensors_to_graph(spark):
    from graphs import small

    files = spark.createDataFrame([("api.yaml", "openapi: 3.0\npaths:\n  /m:\n    get:\n      operationId: main\n"), ("x.txt", "")], "path string, text string")
    found = sensors.openapi(files)
    assert [(r["method"], r["path"], r["operation_id"]) for r in found.collect()] == [("GET", "/m", "main")]
    nodes, edges = sensors.to_graph("openapi", found, small(spark).nodes)
    assert nodes.first()["name"] == "GET /m" and edges.first()["target_id"] == "main" and edges.first()["edge_type"] == "CallsHttp"
    proto = sensors.proto(spark.createDataFrame([("s.proto", "service S {\nrpc A (X) returns (Y);\n}")], "path string, text string"))
    _, edges = sensors.to_graph("proto", proto, small(spark).nodes)
    assert edges.first()["source_id"] == "a"


def test_extract(spark):
    files = spark.createDataFrame([("a.py", 'x = "/api/users"\ny = \'/ab\'\nfoo()\nnew()'), ("b.md", '"/api/users"')], "path string, text string")
    assert [(r["line"], r["value"]) for r in extract.string_literals(files).collect()] == [(0, "/api/users")]
    assert [r["target_name"] for r in extract.static_refs(files).collect()] == ["foo"]
    own = spark.createDataFrame([("a.py", "new")], "path string, name string")
    assert {r["target_name"] for r in extract.static_refs(files, own).where("edge_type = 'Calls'").collect()} == {"foo", "new"}
    assert [r["path"] for r in extract.find_files(files, "*.py").collect()] == ["a.py"]
    assert [tuple(r) for r in extract.list_dir(spark.createDataFrame([("d/e/f", ""), ("d/g", "")], "path string, text string"), "d").collect()] == [("e", True), ("g", False)]
    assert [r["text"] for r in extract.read_range(files, "a.py", 3, 4).orderBy("line").collect()] == ["foo()", "new()"]


def test_project(spark, tmp_path):
    urls = spark.createDataFrame([("git@h.org:o/r.git",), ("https://h.org/o/r",), ("nope",)], "u string")
    got = [r[0] and tuple(r[0]) for r in urls.select(project.owner_and_name(F.col("u"))).collect()]
    assert got == [("o", "r"), ("o", "r"), None]
    tuning = project.Tuning()
    tuning.ingestion.files_per_batch = 7
    project.save_tuning(tuning, tmp_path / "t.toml")
    assert project.load_tuning(tmp_path / "t.toml") == tuning
    (tmp_path / "bad.toml").write_text("[[[")
    assert project.load_tuning(tmp_path / "bad.toml") == project.load_tuning(tmp_path / "none.toml") == project.Tuning()
    assert project.profiles(spark).count() == 5


def test_streams(spark, tmp_path):
    rows = [(i, f"f{i // 2}", "Removed" if i == 5 else "Modified", f"2024-01-01 00:0{i}:00") for i in range(6)]
    df = windows.with_time(spark.createDataFrame(rows, "event_id int, path string, kind string, ts string"))
    path, root = f"file://{tmp_path}/in", f"file://{tmp_path}/overlay"
    put = lambda part: part.coalesce(1).write.mode("append").parquet(path)
    for part in (df.where("event_id < 3"), df.where("event_id >= 3"), df.where("event_id < 2")):
        put(part)
    overlay = windows.Overlay(spark, root=root)
    overlay.follow(windows.read_changes(spark, path, df.schema, 1))
    state = lambda o: {(r["path"], r["event_id"]) for r in o.table().collect()}
    assert state(overlay) == {("f0", 1), ("f1", 3)} and {(r["path"], r["event_id"]) for r in windows.latest_state(df).collect()} == state(overlay)
    # a new driver goes on from there; a late change doesn't revive a removed file, and what is merged stays
    put(df.where("event_id = 4").withColumn("event_id", F.lit(9)))
    for i in range(20):
        put(df.where("event_id = 0").withColumns({"event_id": F.lit(100 + i), "ts": F.col("ts") + F.expr(f"INTERVAL {i + 1} DAYS")}))
    again = windows.Overlay(spark, root=root)
    assert (state(again), again.batch) == (state(overlay), 2)
    again.follow(windows.read_changes(spark, path, df.schema, 1))
    assert state(again) == {("f0", 119), ("f1", 3)} == state(windows.Overlay(spark, root=root))
    assert again.batch == 23 and len(again.tables) <= windows.MERGED
    again.apply(df.where("event_id = 3").withColumn("event_id", F.lit(7)), 23)  # delivered again
    assert state(again) == {("f0", 119), ("f1", 3)}
    assert str(again.staleness().first()[0]).startswith("2024-01-21")
    seen = []
    stream = windows.deduplicated(windows.read_changes(spark, path, df.schema, 100).where("event_id < 9"), ["event_id"])
    windows.run_once(stream, lambda b, n: seen.extend(r["event_id"] for r in b.collect()))
    assert sorted(seen) == list(range(6))


def test_windows_of_streams_equal_those_of_tables(spark, tmp_path):
    rows = [(f"f{i % 3}", "Modified" if i % 2 else "Created", f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00") for i in range(40)] + [(None, "Created", "2024-01-02 00:00:00")]
    df = windows.with_time(spark.createDataFrame(rows, "path string, kind string, ts string"))
    path = f"file://{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    # two changes that come later: one closes all windows, the other is too late for any
    for late in ("2024-03-01 00:00:00", "2024-01-01 00:30:00"):
        windows.with_time(spark.createDataFrame([("late", "Created", late)], "path string, kind string, ts string")).coalesce(1).write.mode("append").parquet(path)
    for made in (windows.tumbling, windows.sliding, windows.sessions, windows.debounced):
        got = []
        windows.run_once(made(windows.read_changes(spark, path, df.schema, 1)), lambda b, n, got=got: got.extend(map(tuple, b.collect())))
        wanted = sorted(map(tuple, made(df).collect()), key=str)
        assert wanted and sorted(got, key=str) == wanted, made.__name__


def test_watched(spark):
    names = ["a.rs", "src/b.py", ".c/d.rs", "./e.rs", "x/./f.go", "x/.g.go", "h.txt", "i", "j.RS", "k.d/l", "m.rs~", None]
    df = spark.createDataFrame([(n, k) for n in names for k in ("Modified", "Removed", "Accessed")], "path string, kind string")
    assert {(r["path"], r["kind"]) for r in windows.watched(df).collect()} == {(n, k) for n in ("a.rs", "src/b.py", "x/./f.go") for k in ("Modified", "Removed")}
    assert {r["kind"] for r in windows.watched(df, removals=False).collect()} == {"Modified"}


def test_budgeted_pass(spark):
    from graphloom.streaming.budget import sliding_pass

    kinds = "path string, name string, kind string, parent string, line_start int, line_end int"
    marks = spark.createDataFrame([(f"/p/{i}.py", f"f{i}", "Function", None, 1, 5) for i in range(6)], kinds)
    nodes, edges = symbols.symbol_nodes(marks)
    graph = PropertyGraph.of(nodes, edges)
    refs = spark.createDataFrame([(f"/p/{i}.py", f"f{j}", t) for i in range(6) for j in range(6) for t in ("Calls", "Uses")], "path string, target_name string, edge_type string")
    dirty = spark.createDataFrame([(f"/p/{i}.py",) for i in (5, 4, 1, 0, 1)], "path string")
    done = sliding_pass(graph, dirty, marks, refs, 7, files=3, edges=10, embeddings=2)
    assert {r["path"] for r in done.nodes.collect()} == {"/p/0.py", "/p/1.py", "/p/4.py"} and done.nodes.where("last_lsp_sync = 7").count() == 6
    files = {r["id"] for r in nodes.where("node_type = 'File'").collect()}
    found = done.edges.collect()
    assert len(found) == 10 and {r["edge_type"] for r in found} == {"Calls"} and {r["source_id"] for r in found} <= files
    assert [len(r["embedding"]) for r in done.embedded.collect()] == [64, 64]
    after = done.on(graph)
    assert after.overlay_nodes.count() == 6 and after.nodes.where("embedding is not null").count() == 2 and after.edges.count() == edges.count() + 10


def test_search_embeds_what_has_no_vector(spark):
    from graphloom.operators import semantic

    nodes = spark.createDataFrame([(f"n{i}", "Function", "red" if i % 2 else "blue", "/p", None if i > 1 else [1.0, 0.0]) for i in range(6)], "id string, node_type string, name string, path string, embedding array<float>")
    graph = PropertyGraph.of(nodes, spark.createDataFrame([], EDGES))
    calls = lambda texts: [[0.0, 1.0] if t.startswith("red") else [1.0, 0.0] for t in texts]
    got = lambda **k: [r["id"] for r in semantic.semantic_search(graph, [0.0, 1.0], **k).collect()]
    assert (got(), got(model=calls), got(model=calls, on_demand=2)) == ([], ["n3", "n5"], ["n3"])
    assert semantic.prewarmed(graph, 2, calls).nodes.where("embedding is not null").count() == 4


def test_diffs(spark):
    old = {"same": "a\n", "gone": "x\ny", "edit": "1\n2\n3\n", "end": "a\n", "empty": "", "none": None}
    new = {"same": "a\n", "edit": "1\n2b\r\n3\n", "end": "a", "empty": "z\x0bz\n", "untracked": "u\n", "none": None}
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    got = {r["path"]: r["diff"] for r in difftext.file_diffs(table(old), table(new)).collect()}
    assert set(got) == {"gone", "edit", "end", "empty"}
    assert got["edit"] == "diff --git a/edit b/edit\nindex 01e79c3..39cea7c 100644\n--- a/edit\n+++ b/edit\n@@ -1,3 +1,3 @@\n 1\n-2\n+2b\r\n 3\n"
    assert got["gone"].endswith("..0000000\n--- a/gone\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y\n\\ No newline at end of file\n")
    assert got["end"].endswith("@@ -1 +1 @@\n-a\n+a\n\\ No newline at end of file\n") and got["empty"].endswith("@@ -0,0 +1 @@\n+z\x0bz\n")
    assert [r["path"] for r in difftext.file_diffs(table(old), table(new), "edit").collect()] == ["edit"]


def test_symbols(spark):
    rows = [("/p/a.py", "A", "Class", None, 1, 9), ("/p/a.py", "f", "Method", "A", 2, 3), ("/p/a.py", "x", "Field", "A", 4, 4), ("/p/a.py", "e", "Event", None, 5, 5)]
    nodes, edges = symbols.symbol_nodes(spark.createDataFrame(rows, "path string, name string, kind string, parent string, line_start int, line_end int"))
    assert {(r["name"], r["node_type"]) for r in nodes.collect()} == {("A", "Class"), ("f", "Method"), ("e", "Module"), ("a.py", "File")}
    by = {r["id"]: r["name"] for r in nodes.collect()}
    assert {(by[r["source_id"]], by[r["target_id"]]) for r in edges.collect()} == {("a.py", "A"), ("A", "f"), ("a.py", "e")}
