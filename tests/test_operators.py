import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import calls, changes, graph, imports, retrieval, store
from lodestone.operators.orphans import Reference, hot_keys, judge_references, orphan_report, parent_intervals, references
from tests.conftest import rows

EDGE = "id bigint, target string, indexed_at timestamp, tab string, key string, salts int"


def _orphans(spark, edges, seen, hot=200_000):
    e = spark.createDataFrame(edges, EDGE)
    s = spark.createDataFrame(seen, "key string, at timestamp, deleted boolean")
    return judge_references(references({"t": e}, [Reference("t", "target")]), parent_intervals(s), hot)


def test_orphans_verdicts_and_clashing_names(spark):
    from datetime import datetime as D

    early, mid, late = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)
    edges = [(1, "/a", mid, "x", "y", 1), (1, "/a", mid, "x", "y", 1), (2, " //b/ ", mid, None, None, None), (3, "/c", mid, None, None, None), (4, None, mid, None, None, None), (5, "  ", mid, None, None, None), (6, "/d", None, None, None, None), (7, "/d", early, None, None, None), (8, "/e", mid, None, None, None)]
    seen = [("/a", early, False), ("/b", early, False), ("/b", late, True), ("/d", mid, False), ("/e", mid, False), ("/e", mid, True), (None, mid, False)]
    for hot in (200_000, 1):
        df = _orphans(spark, edges, seen, hot)
        got = {(r["edge_id"], r["verdict"]) for r in df.collect()}
        assert got == {(1, "valid"), (2, "deleted"), (3, "missing"), (6, "valid"), (7, "late"), (8, "deleted")}
        assert df.count() == 7
    report = {(r["period"], r["verdict"]): r["n"] for r in orphan_report(df).collect()}
    assert report == {("2025-02", "deleted"): 2, ("2025-02", "missing"): 1, ("2025-01", "late"): 1}


def test_validity_intervals(spark):
    day = lambda m, d=1: f"2026-{m:02d}-{d:02d} 00:00:00"
    seen = [("a", day(1), False), ("a", day(1), False), ("a", day(1, 20), False), ("a", day(2), True), ("a", day(2, 3), True), ("a", day(4), False), ("b", day(5), False), ("b", day(5), True), ("c", None, False), ("c", day(3), True), ("c", day(6), False), (None, day(1), False)]
    s = spark.createDataFrame(seen, "key string, at string, deleted boolean").withColumn("at", F.col("at").cast("timestamp"))
    got = [(k, str(a)[:10], str(b)[:10], g) for k, a, b, g in rows(parent_intervals(s))]
    assert got == [("a", "2026-01-01", "2026-02-01", False), ("a", "2026-04-01", "None", False), ("b", "None", "None", True), ("c", "0002-01-01", "2026-03-01", False), ("c", "2026-06-01", "None", False)]
    at = lambda m: f"2026-{m:02d}-15 00:00:00"
    refs = [(i, "/" + k, None if m is None else at(m)) for i, (k, m) in enumerate([("a", 1), ("a", 3), ("a", 5), ("a", None), ("b", 4), ("c", 2), ("c", 4), ("c", 7), ("z", 1)])]
    e = spark.createDataFrame(refs, "id int, target string, at string").withColumn("indexed_at", F.col("at").cast("timestamp"))
    p = parent_intervals(s.withColumn("key", F.concat(F.lit("/"), "key")))
    for hot in (200_000, 1):
        j = judge_references(references({"t": e}, [Reference("t", "target")]), p, hot)
        assert [v for _, v in rows(j, "edge_id", "verdict")] == ["valid", "late", "valid", "valid", "deleted", "valid", "late", "valid", "missing"]
    sample = references({"t": e.where("id % 2 = 0")}, [Reference("t", "target")])
    assert rows(hot_keys(sample, 2, one_in=2), "hot_key") == [("/a",), ("/b",), ("/c",), ("/z",)] or len(rows(hot_keys(sample, 2, one_in=2))) >= 1


def test_orphans_empty(spark):
    assert _orphans(spark, [], []).count() == 0
    assert [r["verdict"] for r in _orphans(spark, [(1, "/a", None, None, None, None)], []).collect()] == ["missing"]


def test_orphans_hot_key_against_brute_force(spark):
    from datetime import datetime as D

    rnd = random.Random(3)
    at = D(2025, 1, 1)
    edges = [(i, "/hot" if i % 3 == 0 else f"/f{rnd.randrange(40)}", at, None, None, None) for i in range(3000)]
    seen = [(f"/f{i}", at, rnd.random() < 0.3) for i in range(0, 40, 2)] + [("/hot", at, True)]
    gone = {k: d for k, _, d in seen}
    want = sorted((i, "missing" if t not in gone else "deleted" if gone[t] else "valid") for i, t, *_ in edges)
    assert sorted((r["edge_id"], r["verdict"]) for r in _orphans(spark, edges, seen, 100).collect()) == want


def test_last_event_wins(spark):
    df = spark.createDataFrame([(1, "p", "update", 1), (2, "p", "deleted", 2), (3, "p", "update", 2), (4, "q", "deleted", 5), (5, "r", "update", None)], "change_id bigint, path string, change_type string, t int")
    df = df.withColumn("changed_at", F.timestamp_seconds("t"))
    assert rows(changes.last_event(df), "path", "change_type") == [("p", "update"), ("q", "deleted"), ("r", "update")]


def test_classify_tiers(spark):
    scan = spark.createDataFrame([("new", 5, "a"), ("old", 5, "b"), ("same", 50, "c"), ("diff", 50, "d"), ("touched", 5, "zz"), ("unknown", None, "e")], "path string, mtime_ms bigint, content string")
    stored = scan.select("path", F.sha2(F.when(F.col("path").isin("diff", "touched"), "x").otherwise(F.col("content")), 256).alias("hash"), F.lit(10).alias("last_indexed")).where("path <> 'new'")
    changed = spark.createDataFrame([("touched",)], "path string")
    got = dict(rows(changes.classify(scan, stored, changed), "path", "status"))
    assert got == {"new": "new", "old": "skipped_mtime", "same": "unchanged", "diff": "changed", "touched": "changed", "unknown": "unchanged"}
    assert changes.run_summary(changes.classify(scan, stored, changed)).first().asDict() == {"indexed": 3, "skipped_mtime": 1, "skipped_hash": 2}


def test_changed_or_new_falls_back_to_all(spark):
    scan = spark.createDataFrame([("a",), ("b",)], "path string")
    stored = spark.createDataFrame([("a", "h"), ("b", "h")], "path string, hash string")
    none = spark.createDataFrame([], "path string")
    assert changes.changed_or_new(scan, stored, none).count() == 2
    assert rows(changes.changed_or_new(scan, stored, scan.limit(1))) == [("a",)]


def test_stale_with_an_empty_scan(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "path string")
    assert changes.stale(stored, stored.limit(0)).count() == 2


def test_tag_graph(spark):
    tags = spark.createDataFrame([("X", "def", "f1", 1), ("X", "def", "f2", 2), ("X", "ref", "f3", 3), ("X", "ref", "f2", 4), ("Y", "ref", "f9", 5), (None, "ref", "f1", 6)], "name string, kind string, file string, seq bigint")
    e = graph.edges_from_tags(tags)
    assert rows(e) == [("f3", "f2")]
    assert rows(graph.nodes_from_tags(tags, e)) == [("f1",), ("f2",), ("f3",)]
    assert rows(graph.definitions(tags)) == [("f1", ["X"]), ("f2", ["X"])]


def test_pagerank_leaks_dangling_mass(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    one = dict(rows(graph.pagerank(e, iterations=1)))
    assert one["a"] == pytest.approx(0.075) and one["b"] == pytest.approx(0.5)
    full = dict(rows(graph.pagerank(e)))
    assert full["a"] == pytest.approx(0.075) and full["b"] == pytest.approx(0.13875)
    assert graph.pagerank(e.limit(0)).count() == 0


def test_pagerank_against_plain_python(spark):
    rnd = random.Random(5)
    pairs = sorted({(f"n{rnd.randrange(15)}", f"n{rnd.randrange(15)}") for _ in range(50)} - {(f"n{i}", f"n{i}") for i in range(15)})
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    s = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        t = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a in nodes:
            for b in out[a]:
                t[b] += 0.85 * s[a] / len(out[a])
        s = t
    got = dict(rows(graph.pagerank(spark.createDataFrame(pairs, "src string, dst string"))))
    assert got == pytest.approx(s) and sum(got.values()) <= 1 + 1e-9


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 5), (4, 1)], "k int, tokens int")
    assert rows(graph.within_budget(df, F.col("tokens"), 8, F.col("k")), "k") == [(1,), (2,)]


def test_enclosing(spark):
    c = spark.createDataFrame([(1, "f", 15), (2, "f", 30), (3, "f", 60), (4, "g", 15), (5, None, 1)], "call_id bigint, file string, line int")
    r = spark.createDataFrame([("f", "outer", "function", 1, 50), ("f", "inner", "function", 10, 20), ("f", "C", "class", 12, 18)], "file string, name string, kind string, start_line int, end_line int")
    assert rows(calls.enclosing(c, r), "call_id", "caller_symbol") == [(1, "inner"), (2, "outer"), (3, "<module>"), (4, "<module>"), (5, "<module>")]


def test_first_calls_and_noise(spark):
    c = spark.createDataFrame([("f", "a", 5, "run"), ("f", "a", 3, "run"), ("f", "a", 1, "log"), ("f", "a", 1, None)], "caller_file string, caller_symbol string, caller_line int, callee_name string")
    assert rows(calls.first_calls(calls.without_noise(c)), "caller_line", "callee_name") == [(3, "run")]


def test_import_candidates_in_order(spark):
    files = spark.createDataFrame([("/p/a.ts",), ("/p/a.tsx",), ("/p/d/index.ts",), ("/p/m.ts",), ("/p/exact.json",), ("/q/pkg/__init__.py",)], "path string")
    want = {"./a": "/p/a.ts", "./d": "/p/d/index.ts", "./m.js": "/p/m.ts", "./exact.json": "/p/exact.json", "../q/pkg": "/q/pkg/__init__.py", "/p/a": "/p/a.ts"}
    imp = spark.createDataFrame([("/p/x.ts", s, ["*"], 1) for s in [*want, "./none", "react"]], "from_file string, source_path string, symbols array<string>, line int")
    assert dict(rows(imports.resolve(imp, files), "source_path", "to_file")) == want


def test_overlap_boundary(spark):
    df = spark.createDataFrame([(1, 10, 6, 15), (1, 10, 5, 15), (1, 5, 6, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(retrieval.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [False, True, False]


RESULT = "filePath string, content string, score double, startLine int, endLine int, chunkName string, chunkType string, language string, source string"


def test_merge_is_greedy(spark):
    df = spark.createDataFrame([("f", "A", 0.9, 1, 10, "A", None, None, "semantic"), ("f", "B", 0.8, 5, 15, "B", None, None, "semantic"), ("f", "C", 0.7, 9, 20, "C", None, None, "semantic"), ("g", "D", 1.0, 1, 1, "D", None, None, "structural")], RESULT)
    m = retrieval.merge(retrieval.union_strategies(df))
    assert [r["content"] for r in retrieval.final_order(m, 9).collect()] == ["A", "C", "D"]
    again = retrieval.merge(m.withColumn("score", F.col("score") / 0.5))
    assert again.count() == 3


def test_weights(spark):
    df = spark.createDataFrame([("f", "", 1.0, 1, 1, "", None, None, "keyword"), ("f", "", 0.8, 1, 1, "", None, None, "semantic"), ("f", "", 1.0, 1, 1, "", None, None, "structural"), ("f", "", 1.0, 1, 1, "", None, None, "other")], RESULT)
    assert [round(r["score"], 6) for r in retrieval.weighted(df).collect()] == [0.3, 0.4, 0.2, 0.2]


def test_similarity_scores(spark):
    near = lambda xs: [round(r["score"], 6) for r in retrieval.similarity(spark.createDataFrame([(x,) for x in xs], "distance double")).orderBy("distance").collect()]
    assert near([0.2, 0.5]) == [0.8, 0.5] and near([1.0, 4.0]) == [0.75, 0.0]


def test_nearest_skips_unusable_vectors(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 0.0]), ("f", [0.0, 5.0])], "id string, vector array<float>")
    assert [r["id"] for r in retrieval.nearest(df, [1.0, 0.0], k=2).collect()] == ["a", "b"]
    assert [r["id"] for r in retrieval.nearest(df, [0.0, 1.0], k=1, metric="cosine").collect()] == ["f"]
    assert retrieval.nearest(df.limit(0), [1.0]).count() == 0


def test_keyword_scores_and_cap(spark):
    df = spark.createDataFrame([(f"f{i:02d}", "x\nhit  \n" * 7) for i in range(22)] + [("zz", "nothing"), ("null", None)], "filePath string, content string")
    got = retrieval.keyword_search(df, "^hit", limit=30).orderBy("filePath").collect()
    assert len(got) == 22 and got[0]["score"] == 1.0 and got[1]["score"] == pytest.approx(0.95) and got[18]["score"] == pytest.approx(0.1) and got[21]["score"] == pytest.approx(0.1)
    assert got[0]["content"].split("\n") == ["2: hit", "4: hit", "6: hit", "8: hit", "10: hit"] and (got[0]["startLine"], got[0]["endLine"]) == (2, 10)
    with pytest.raises(Exception):
        retrieval.keyword_search(df, "(").collect()


SYMBOL = "id string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, visibility string, language string, parameters array<struct<name:string,type:string,defaultValue:string>>, return_type string"


def test_symbol_order_and_text(spark):
    df = spark.createDataFrame([
        ("1", "loader", "loader", "function", "f", 1, 2, "s", "exported", "ts", [("a", "int", None), ("b", None, None)], "string"),
        ("2", "load", "C.load", "method", "f", 3, 4, "C.load", "internal", "ts", None, None),
        ("3", "LOADX", "LOADX", "function", "f", 5, 6, "", "internal", "ts", None, None),
        ("4", "a_b", "a_b", "function", "f", 5, 6, "", "internal", "ts", None, None),
    ], SYMBOL)
    got = retrieval.symbol_search(df, " load ").collect()
    assert [(r["chunkName"], r["score"]) for r in got] == [("C.load", 1.0), ("loader", 0.8), ("LOADX", 0.8)]
    assert got[1]["content"] == "export function loader(a: int, b): string\ns" and got[0]["content"] == "method C.load"
    assert retrieval.symbol_search(df, "   ").count() == 0 and retrieval.find_symbols(df, "a\\").count() == 0


def test_expand_context_budget(spark):
    res = spark.createDataFrame([("f", "x" * 40, 0.9, 1, 2, "run", None, None, "keyword", 1)], RESULT + ", pos int")
    c = spark.createDataFrame([("f", "run", 3, "big", "g"), ("f", "run", 4, "small", "g"), ("h", "main", 9, "run", None)], "caller_file string, caller_symbol string, caller_line int, callee_name string, callee_file string")
    s = spark.createDataFrame([("1", "big", "big", "function", "g", 1, 2, "y" * 400, "internal", "ts", None, None), ("2", "small", "small", "function", "g", 5, 6, "zzzz", "internal", "ts", None, None)], SYMBOL)
    # 10 tokens are used; `big` takes 100, so with 30 it ends its list, but the caller after it still fits.
    got = [r["content"] for r in calls.expand_context(res, c, s, max_tokens=30).orderBy("pos").collect()]
    assert got == ["x" * 40, "main calls run (line 9)"]
    got = [r["chunkName"] for r in calls.expand_context(res, c, s, max_tokens=500).orderBy("pos").collect()]
    assert got == ["run", "big", "small", "main"]
    assert calls.expand_context(res, c.limit(0), s).count() == 1


def test_store_versions(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/index")
    assert st.table("files").count() == 0
    f = lambda *ps: spark.createDataFrame([(p, "h", 1, 2, "ts", None) for p in ps], store.SCHEMAS["files"])
    y = lambda *ps: spark.createDataFrame([(f"{p}#x", "x", "x", "function", p, 1, 2, "", None, "internal", "ts", None, None) for p in ps], store.SCHEMAS["symbols"])
    e = spark.createDataFrame([("a", "b", "import", ["*"], 1)], store.SCHEMAS["dependency_edges"])
    paths = lambda *ps: spark.createDataFrame([(p,) for p in ps], "path string")
    v1 = st.upsert({"files": f("a", "b"), "symbols": y("a", "b"), "dependency_edges": e}, paths("a", "b"))
    st.upsert({"files": f("a"), "symbols": y("a")}, paths("a"))
    assert rows(st.table("files"), "path") == [("a",), ("b",)] and st.table("symbols").count() == 2
    assert st.table("dependency_edges").count() == 0 and st.table("dependency_edges", v1).count() == 1
    st.upsert({"files": f("a"), "symbols": y("a"), "dependency_edges": e}, paths("a"))
    st.remove(paths("b"))
    assert rows(st.table("files"), "path") == [("a",)] and st.table("dependency_edges").count() == 0 and st.orphans().count() == 0
    assert store.index_stats(st.table("files")).first().asDict() == {"files": 1, "chunks": 2, "oldest": 1, "newest": 1}
    assert store.index_stats(st.table("files").limit(0)).first().asDict() == {"files": 0, "chunks": 0, "oldest": None, "newest": None}
    assert store.staleness(st.table("files").limit(0), 5).first()["stale"] is False


def test_store_meets_other_writers_grows_and_is_swept(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    f = lambda *ps: spark.createDataFrame([(p, "h", 1, 2, "ts", None) for p in ps], store.SCHEMAS["files"])
    paths = lambda *ps: spark.createDataFrame([(p,) for p in ps], "path string")
    a, b = store.Store(spark, root, buckets=2), store.Store(spark, root, buckets=2)
    a.upsert({"files": f("x")}, paths("x"))
    create, other = a._create, []

    def slow(name, text):  # another writer comes in between
        if not other:
            other.append(b.upsert({"files": f("z")}, paths("z")))
        return create(name, text)

    monkeypatch.setattr(a, "_create", slow)
    a.upsert({"files": f("y")}, paths("y"))
    monkeypatch.setattr(a, "_create", create)
    assert rows(b.table("files"), "path") == [("x",), ("y",), ("z",)] and a.version() == b.version() == a.versions()[-1]
    # A manifest that was never completed is passed over, and its number isn't used again.
    (tmp_path / "index" / "manifests" / f"{9:020d}.json").write_text("{")
    assert rows(b.table("files"), "path") == [("x",), ("y",), ("z",)]
    small = store.Store(spark, root, bucket_bytes=1000)
    small.upsert({"files": f("w")}, paths("w"))
    assert small._manifest(small.version())["buckets"] > 2 and small.version() == f"{10:020d}" and rows(a.table("files"), "path") == [("w",), ("x",), ("y",), ("z",)]
    state = a.state_of("files")
    assert state == small.state_of("files") and a.vacuum(keep=1) >= 3 and a.table("files").count() == 4
    a.remove(paths("w"))
    assert a.state_of("files") != state and a.table("files").count() == 3
