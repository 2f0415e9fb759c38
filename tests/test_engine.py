import os

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.operators import extract
from lodestone.streaming.watch import batches_of_table, debounced, last_of_batch, run
from tests.conftest import rows

AUTH = """import { Logger } from './utils';

export class Gatekeeper {
  private key: string;

  constructor(key: string) {
    this.key = key;
  }

  admit(user: string, phrase: string): boolean {
    return this.inspect(user + phrase);
  }

  inspect(mark: string): boolean {
    return mark.length > 3;
  }
}

export function openGate(key: string): Gatekeeper {
  return new Gatekeeper(key);
}

export interface Ticket {
  user: string;
}
"""
USERS = """import { Gatekeeper } from './auth';

export class Desk {
  private gate: Gatekeeper;

  find(id: number): string {
    return formatDay(id);
  }
}

export type Role = 'guest' | 'host';

export enum Mood { Calm, Busy }
"""
UTILS = """const BASE = 'x';

export function formatDay(n: number): string {
  return String(n);
}

export const readJson = (text: string): unknown => {
  return decode(text);
};

interface Sink { write(line: string): void }

export class Logger {
  log(line: string): void {
    emit(line);
  }
}
"""
PY = '''from . import base
from .base import thing as other


class Box:
    """A box."""

    size: int = 3

    def put(self, x: int, y=2) -> int:
        return fold(x)


def main(a, *rest):
    Box().put(a)
'''


def test_typescript_symbols():
    got = {(s["qualified_name"], s["kind"]): s for s in extract.extract_one("/p/auth.ts", AUTH, "typescript")["symbols"]}
    assert got[("Gatekeeper", "class")]["visibility"] == "exported"
    assert got[("Gatekeeper.admit", "method")]["parent_symbol"] == "Gatekeeper"
    assert [p["name"] for p in got[("Gatekeeper.admit", "method")]["parameters"]] == ["user", "phrase"]
    assert got[("openGate", "function")]["return_type"] == "Gatekeeper" and ("Ticket", "interface") in got
    assert ("Gatekeeper.key", "field") in got and ("Gatekeeper.constructor", "method") in got
    users = {(s["name"], s["kind"]) for s in extract.extract_one("/p/users.ts", USERS, "typescript")["symbols"]}
    assert {("Role", "type"), ("Mood", "enum"), ("Desk", "class"), ("find", "method")} <= users
    utils = extract.extract_one("/p/utils.ts", UTILS, "typescript")
    names = {(s["name"], s["kind"], s["visibility"]) for s in utils["symbols"]}
    assert ("readJson", "function", "exported") in names and ("Sink", "interface", "internal") in names and not any(n == "BASE" for n, *_ in names)
    assert ("readJson", "decode") in {(c["caller_symbol"], c["callee_name"]) for c in utils["calls"]}


def test_imports():
    text = "import a, { b as c, type D } from './x';\nimport * as ns from \"y\";\nimport './side';\nconst z = require('./z');\nexport * from './q';\n"
    got = [(i["source_path"], i["symbols"], i["line"]) for i in extract.imports_of(text, "typescript")]
    assert got == [("./x", ["default", "b", "D"], 1), ("y", ["*"], 2), ("./side", ["*"], 3), ("./z", ["*"], 4), ("./q", ["*"], 5)]


def test_python_extraction():
    got = extract.extract_one("/p/m.py", PY, "python")
    assert {(s["qualified_name"], s["kind"]) for s in got["symbols"]} == {("Box", "class"), ("Box.size", "field"), ("Box.put", "method"), ("main", "function")}
    assert [(i["source_path"], i["symbols"]) for i in got["imports"]] == [("./", ["base"]), ("./base", ["thing"])]
    assert ("put", "fold") in {(c["caller_symbol"], c["callee_name"]) for c in got["calls"]}
    broken = extract.extract_one("/p/m.py", "def (", "python")
    assert len(broken["chunks"]) == 1 and broken["chunks"][0]["type"] == "module" and broken["symbols"] == []


def test_large_chunks_are_split():
    text = "export function big() {\n" + "  call(1, 2, 3);\n" * 2000 + "}\n"
    chunks = extract.extract_one("/p/b.ts", text, "typescript")["chunks"]
    assert len(chunks) > 1 and all(len(c["content"]) <= 8000 for c in chunks)
    assert chunks[0]["endLine"] + 1 == chunks[1]["startLine"]


def test_extract_handles_empty_and_null(spark):
    df = spark.createDataFrame([("a", "", "typescript"), ("b", None, "python"), ("c", "text", None)], "path string, content string, language string")
    assert rows(extract.chunks_of(extract.extract(df)), "id") == [("a:1-1",), ("c:1-1",)]
    assert extract.extract(df.limit(0)).count() == 0


def test_engine_end_to_end(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "node_modules").mkdir(parents=True)
    (root / "auth.ts").write_text(AUTH)
    (root / "users.ts").write_text(USERS)
    (root / "utils.ts").write_text(UTILS)
    (root / "node_modules" / "x.ts").write_text("export function hidden() {}")
    (root / "pic.png").write_bytes(b"\x00")
    e = Engine(spark, str(root), f"file://{tmp_path}/index")
    assert e.index_all() == {"indexed": 3, "skipped_mtime": 0, "skipped_hash": 0, "removed": 0, "unreadable": 0}
    st = e.status(now_ms=0)
    assert st["files"] == 3 and st["chunks"] > 3 and st["vectors"] == st["chunks"] and st["graph_edges"] == 2 and e.store.orphans().count() == 0
    names = [r["name"] for r in e.search_symbols("admit").collect()]
    assert names == ["admit"]
    assert e.dependencies(str(root / "users.ts"), depth=2) == {"imports": [str(root / "auth.ts")], "imported_by": [], "transitive": {str(root / "auth.ts"): [str(root / "utils.ts")]}}
    hits = e.search("formatDay", limit=5).collect()
    assert hits and [h["pos"] for h in hits] == list(range(1, len(hits) + 1)) and any("utils.ts" in h["filePath"] for h in hits)
    assert "Results:" in e.search_text("formatDay", strategy="keyword") and e.search("  ").count() == 0
    assert e.search("open", strategy="symbol", expand=True).count() >= 1
    assert e.repo_map(max_tokens=2048).count() == 3 and e.file_summary(str(root / "auth.ts")).startswith(f"// {root}/auth.ts\nimports: utils.ts\nused by: users.ts")
    state, edges = e.call_graph("formatDay")
    assert state == "ok" and [r["caller_symbol"] for r in edges.collect()] == ["find"] and e.call_graph("nope", "callees")[0] == "missing"
    # A second run has nothing to do; a changed, a new and a vanished file are told apart.
    assert e.index_all()["indexed"] == 0
    old = e.store.table("files").where(F.col("path").endswith("auth.ts")).first()["hash"]
    (root / "auth.ts").write_text(AUTH + "\nexport function later() {}\n")
    os.utime(root / "auth.ts", (4_000_000_000, 4_000_000_000))
    (root / "more.ts").write_text("export function more() {}\n")
    (root / "utils.ts").unlink()
    assert e.index_all() == {"indexed": 2, "skipped_mtime": 1, "skipped_hash": 0, "removed": 1, "unreadable": 0}
    assert e.store.table("files").where(F.col("path").endswith("auth.ts")).first()["hash"] != old
    assert rows(e.search_symbols("later"), "name") == [("later",)] and e.search_symbols("formatDay").count() == 0 and e.store.orphans().count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    df = spark.createDataFrame([(1.0, "p", "update"), (1.2, "p", "delete"), (1.3, "p", "update"), (1.4, "q", "delete"), (5.0, "q", "update")], "t double, path string, event_type string")
    df = df.select(F.timestamp_millis((F.col("t") * 1000).cast("bigint")).alias("ts"), "path", "event_type").coalesce(1)
    df.write.parquet(str(src))
    b = last_of_batch(debounced(df.withColumn("project", F.lit("p")), "project"))
    assert [(r["path"], r["event_type"]) for r in b.orderBy("opened", "path").collect()] == [("p", "update"), ("q", "delete"), ("q", "update")]
    assert batches_of_table(df.withColumn("project", F.lit("p")), "project").count() == 2
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = run(stream, lambda c, d: seen.append((rows(c), rows(d))), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == [([("p",), ("q",)], [])]


def test_git_source(spark, tmp_path):
    import subprocess

    from lodestone.sources import git

    git.register(spark)
    assert spark.read.format("lodestone_git").option("path", str(tmp_path / "none")).load().count() == 0
    run_ = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run_("init", "-q")
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.txt").write_text("1")
    run_("add", ".")
    run_("commit", "-qm", "first one")
    (tmp_path / "a.txt").write_text("2")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("3")
    df = spark.read.format("lodestone_git").option("path", str(tmp_path)).load()
    assert rows(df) == [("a.txt", "changed"), ("b.txt", "deleted"), ("c.txt", "untracked")]
    log = spark.read.format("lodestone_git").options(path=str(tmp_path), what="commits", since="2w").load().collect()
    assert [r["message"] for r in log] == ["first one"] and git.window_seconds("2w") == 1_209_600


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "auth.ts").write_text(AUTH)
    (root / "users.ts").write_text(USERS)
    (root / ".gitignore").write_text("# ours\nsecret.ts\nlogs/\n")
    (root / "secret.ts").write_text("export function hidden() {}\n")
    (root / "logs").mkdir()
    (root / "logs" / "a.ts").write_text("export function logged() {}\n")
    return root


def test_an_unchanged_tree_is_not_read(spark, tree, tmp_path, monkeypatch):
    from lodestone import api

    e = Engine(spark, str(tree), f"file://{tmp_path}/index")
    assert e.index_all()["indexed"] == 2 and sorted(p.rsplit("/", 1)[1] for (p,) in rows(e.store.table("files"), "path")) == ["auth.ts", "users.ts"]
    opened = []
    read = api.read_files
    monkeypatch.setattr(api, "read_files", lambda df: opened.append(df.count()) or read(df))
    assert e.index_all() == {"indexed": 0, "skipped_mtime": 2, "skipped_hash": 0, "removed": 0, "unreadable": 0} and opened == [0]
    plan = api.list_tree(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    # Touched but equal: opened, and told by its hash. Forced: all.
    os.utime(tree / "auth.ts", (4_000_000_000, 4_000_000_000))
    assert e.index_all()["skipped_hash"] == 1 and opened[-1] == 1
    assert e.index_all(force=True)["indexed"] == 2


def test_tools_as_text_and_resources(spark, tree, tmp_path):
    import json

    e = Engine(spark, str(tree), f"file://{tmp_path}/index")
    e.index_all()
    auth, users = str(tree / "auth.ts"), str(tree / "users.ts")
    assert f"Imported by:\n  <- {users}" in e.dependencies_text(auth) and "  { " in e.dependencies_text(users)
    assert 'in "' not in e.call_graph_text("nope") and "No recorded callers" in e.call_graph_text("nope") and e.symbols_text("admit").startswith("[1] ")
    assert "Has index    : yes" in e.status_text(now_ms=0) and auth in e.repo_map_text() and "(no commits found)" in e.changes_text()
    got = e.context("admit", "99")
    assert 0 < got.count() <= 20 and got.columns[-2:] == ["snippet", "pos"] and e.context("admit", "x").count() <= 5 and "<document index=" in e.context_text("admit")
    with pytest.raises(ValueError):
        e.context(" ")
    files = [json.loads(r["json"]) for r in e.resource("files").collect()]
    assert {f["path"] for f in files} == {auth, users} and json.loads(e.resource("stats").first()["json"])["files"] == 2
    one = json.loads(e.resource("file", auth).first()["json"])
    assert one["dependents"] == [users] and one["symbols"] and one["imports"] == []
    assert all(json.loads(r["json"])["kind"] == "class" for r in e.resource("symbols", "class").collect())
    for bad in (("file", "/etc/passwd"), ("other", None)):
        with pytest.raises(ValueError):
            e.resource(*bad)
    refs = {r[0] for r in rows(e.store.table("tags").where("kind = 'ref'"), "name")}
    assert "Logger" in refs and not refs & extract.IMPORT_NOISE


def test_version_control_tells_what_to_read(spark, tree, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    e = Engine(spark, str(tree), f"file://{tmp_path}/index")
    e.index_all()
    # An old time of modification doesn't hide a change that git reports.
    (tree / "auth.ts").write_text(AUTH + "\nexport function late() {}\n")
    os.utime(tree / "auth.ts", (1, 1))
    assert e.index_all()["indexed"] == 1 and e.search_symbols("late").count() == 1
    git("commit", "-qam", "two")
    got = dict(rows(e.changes_by_git(0), "path", "change_type"))
    assert got[str(tree / "auth.ts")] == "changed" and rows(e.changes_by_git()) == []
    log = e.recent_changes().collect()
    assert [r["message"] for r in log] == ["two", "one"] and (log[0]["files"], log[0]["insertions"]) == (1, 2)
    from lodestone.sources import git as source

    assert set(source.tracked(str(tree))) == {".gitignore", "auth.ts", "users.ts"} and not source.is_repository(str(tmp_path)) and e.__class__(spark, str(tmp_path / "index"), f"file://{tmp_path}/i2").changes_by_git() is None
    with pytest.raises(RuntimeError):
        source.git(str(tree), "no-such-command")


def test_scores_are_kept_until_the_graph_changes(spark, tree, tmp_path, monkeypatch):
    from lodestone import api

    e = Engine(spark, str(tree), f"file://{tmp_path}/index")
    e.index_all()
    runs = []
    rank = api.graph.pagerank
    monkeypatch.setattr(api.graph, "pagerank", lambda *a, **k: runs.append(1) or rank(*a, **k))
    first = rows(e.scores())
    assert e.search("auth", strategy="structural").count() == 2 and e.repo_map().count() == 2 and rows(e.scores()) == first and len(runs) == 1
    e.remove_files(spark.createDataFrame([(str(tree / "users.ts"),)], "path string"))
    assert e.scores().count() == 1 and len(runs) == 2


def test_live_events_wait_for_a_pause(spark, tmp_path):
    src = tmp_path / "live"
    for n, batch in enumerate([[(1, "p", "update"), (2, "p", "delete"), (2, "q", "update")], [(3, "p", "update"), (4, "r", "delete"), (4, "/t/node_modules/x.ts", "update")]]):
        df = spark.createDataFrame(batch, "t long, path string, event_type string").select(F.timestamp_seconds("t").alias("ts"), "path", "event_type")
        df.coalesce(1).write.mode("append").parquet(str(src))
        os.utime(src, None)
    from lodestone.sources.scan import wanted

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src)).where(wanted(F.col("path"), "/t"))
    seen = []
    q = run(stream, lambda c, d: seen.append((rows(c), rows(d))), str(tmp_path / "cp"), trigger="100 milliseconds", pause="300 milliseconds")
    try:
        for _ in range(600):
            if seen:
                break
            q.awaitTermination(0.1)
    finally:
        q.stop()
    assert seen == [([("p",), ("q",)], [("r",)])]
