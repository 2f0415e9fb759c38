"""The engine: an index over a source tree, and the tools that query it."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import prompts, render
from lodestone.functions.text import content_hash
from lodestone.operators import calls as calls_ops
from lodestone.operators import changes, embed, extract, graph, imports, retrieval
from lodestone.operators.store import Store, index_stats, staleness
from lodestone.session import materialize, release, ship
from lodestone.sources.scan import list_tree, plain_path, project_patterns, read_files, read_tree, wanted

STRATEGIES = ("hybrid", "semantic", "keyword", "structural", "symbol")


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


@dataclass
class Engine:
    """One index. root: the source tree, index_dir: where its tables live, both on storage that all executors share."""

    spark: SparkSession
    root: str
    index_dir: str
    model_dir: str | None = None
    exclude: tuple[str, ...] = ()

    def __post_init__(self):
        ship(self.spark)
        self.store = Store(self.spark, self.index_dir)

    # Building ---------------------------------------------------------------------------------------------------------

    def patterns(self) -> list[str]:
        return [*project_patterns(self.spark, self.root), *self.exclude]

    def changes_by_git(self, since_ms: int | None = None) -> DataFrame | None:
        """(path, change_type) that version control tells of, with full paths; None for a tree that isn't under it."""
        from lodestone.sources import git

        root = plain_path(self.root).rstrip("/")
        if not git.is_repository(root):
            return None
        git.register(self.spark)
        reader = self.spark.read.format("lodestone_git").options(path=root, what="changes")
        df = (reader.option("since_ms", str(since_ms)) if since_ms is not None else reader).load()
        return df.select(F.concat(F.lit(root + "/"), "path").alias("path"), "change_type")

    def index_all(self, force: bool = False, changed: DataFrame | None = None) -> dict:
        """Bring the index up to date with the tree; vanished files are removed.

        The tree is listed first. Only files that are new, that version control reports since the last run (changed, by
        default asked of git), or that were modified since they were indexed are opened; their content then tells which changed.
        """
        listing = list_tree(self.spark, self.root, list(self.exclude))
        stored = self.store.table("files").select("path", "hash", "last_indexed")
        if changed is None:
            newest = stored.agg(F.max("last_indexed")).first()[0]
            changed = self.changes_by_git(newest) if newest is not None else None
        status = materialize(changes.to_read(listing, stored, changed, force), "index-status")
        todo = changes.by_content(read_files(status.where("status <> 'skipped_mtime'")).where("content is not null"))
        todo = materialize(todo.select("path", "content", "language", "mtime_ms", F.col("new_hash").alias("hash"), "status"), "index-read")
        try:
            gone = changes.stale(stored, listing).select("path")
            removed = gone.count()
            if removed:
                self.store.remove(gone)
            summary = changes.run_summary(todo.select("status").unionByName(status.where("status = 'skipped_mtime'").select("status"))).first().asDict()
            if summary["indexed"]:
                self._write(todo.where("status in ('new', 'changed')").drop("status"))
            return summary | {"removed": removed, "unreadable": status.count() - sum(summary.values())}
        finally:
            release(status)
            release(todo)

    def index_files(self, paths: DataFrame) -> None:
        """Read the given files anew, whatever their state. No others are opened."""
        listing = list_tree(self.spark, self.root, list(self.exclude)).join(paths.select("path").distinct(), "path", "left_semi")
        work = materialize(read_files(listing).where("content is not null").select("path", "content", "language", "mtime_ms", content_hash(F.col("content")).alias("hash")), "index-read")
        try:
            self._write(work)
        finally:
            release(work)

    def remove_files(self, paths: DataFrame) -> None:
        self.store.remove(paths)

    def _write(self, work: DataFrame) -> None:
        """Extract and store files (path, content, language, mtime_ms, hash)."""
        got = materialize(extract.extract(work), "index-extracted")
        try:
            found = extract.imports_of_files(got)
            known = self.store.table("files").select("path").unionByName(work.select("path")).distinct()
            edges = imports.resolve(found, known).select("from_file", "to_file", F.lit("import").alias("kind"), "symbols", F.col("line").alias("from_line"))
            now = int(time.time() * 1000)
            chunks = embed.embed_chunks(extract.chunks_of(got), self.model_dir)
            counts = got.select("path", F.size("chunks").alias("chunk_count"))
            files = work.join(counts, "path").select("path", "hash", F.lit(now).cast("bigint").alias("last_indexed"), "chunk_count", F.coalesce("language", F.lit("")).alias("language"), F.col("mtime_ms").alias("mtime"))
            batch = {"files": files, "symbols": extract.symbols_of(got), "dependency_edges": edges, "call_edges": extract.calls_of(got), "chunks": chunks, "tags": extract.tags_of(got), "contents": work.select("path", "content")}
            self.store.upsert(batch, work.select("path"))
        finally:
            release(got)

    # Graph ------------------------------------------------------------------------------------------------------------

    def edges(self) -> DataFrame:
        return graph.edges_from_imports(self.store.table("dependency_edges")).union(graph.edges_from_tags(self.store.table("tags"))).distinct()

    def symbols_by_file(self) -> DataFrame:
        s = self.store.table("symbols")
        names = F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"])
        return s.groupBy(F.col("file_path").alias("file")).agg(names.alias("definitions"))

    def scores(self) -> DataFrame:
        """(node, score), computed at the first question after edges or files have changed, and kept until they do again."""
        name = f"scores/{self.store.state_of('dependency_edges', 'tags', 'files')}"
        if not self.store.exists(f"{name}/_SUCCESS"):
            ranks = graph.pagerank(self.edges(), self.store.table("files").select(F.col("path").alias("node")))
            ranks.write.mode("overwrite").parquet(f"{self.store.root}/{name}")
            for old in self.store._list("scores"):
                if f"scores/{old}" != name:
                    self.store._drop(f"scores/{old}")
        return self.spark.read.schema("node string, score double").parquet(f"{self.store.root}/{name}")

    # Tools ------------------------------------------------------------------------------------------------------------

    def search(self, query: str, strategy: str = "hybrid", limit: int = 10, file_pattern: str | None = None, expand: bool = False, live: bool = False) -> DataFrame:
        """Results in order, with `pos`. An unknown strategy counts as hybrid; a blank query finds nothing. Keywords are looked
        up in the contents as indexed, with live=True in the tree as it is."""
        _within("limit", limit, 1, 50)
        strategy = strategy if strategy in STRATEGIES else "hybrid"
        chunks, symbols = self.store.table("chunks"), self.store.table("symbols")
        if not query.strip():
            return chunks.limit(0).select(*[c for c in retrieval.RESULT if c not in ("score", "source")], F.lit(0.0).alias("score"), F.lit("").alias("source"), F.lit(0).alias("pos"))
        parts = []
        if strategy in ("hybrid", "semantic"):
            parts.append(retrieval.semantic_search(chunks, embed.embed_text(self.spark, query, self.model_dir), limit, file_pattern))
        if strategy in ("hybrid", "keyword"):
            src = read_tree(self.spark, self.root, list(self.exclude)) if live else self.store.table("contents")
            files = src.select(F.col("path").alias("filePath"), "content")
            parts.append(retrieval.keyword_search(files, query, limit, file_pattern, regex=_valid_regex(query)))
        if strategy in ("hybrid", "structural"):
            parts.append(retrieval.structural_search(self.scores(), self.symbols_by_file(), query, limit))
        if strategy in ("hybrid", "symbol"):
            parts.append(retrieval.symbol_search(symbols, query, limit))
        union = retrieval.union_strategies(*parts)
        merged = retrieval.merge(union) if strategy == "hybrid" else union
        top = retrieval.final_order(merged, limit).withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "seq", "pos"))).select(*retrieval.RESULT, "pos")
        if expand:
            c = calls_ops.resolve_callees(self.store.table("call_edges"), symbols)
            top = calls_ops.expand_context(top, c, symbols)
        return top

    def search_text(self, query: str, **options) -> str:
        return render.search_results(self.search(query, **options)).first()["text"]

    def repo_map(self, scope: str | None = None, max_tokens: int = 2048) -> DataFrame:
        _within("max_tokens", max_tokens, 256, 16_384)
        return graph.repo_map(self.scores(), self.edges(), self.symbols_by_file(), scope, max_tokens)

    def file_summary(self, path: str) -> str:
        e = self.edges()
        deps = [r["path"] for r in graph.dependencies(e, path).collect()]
        used = [r["path"] for r in graph.dependents(e, path).collect()]
        names = [r["name"] for r in self.store.table("symbols").where(F.col("file_path") == path).orderBy("start_line").select("name").collect()]
        arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
        return self.spark.range(1).select(render.file_summary(F.lit(path), arr(names), arr(deps), arr(used)).alias("t")).first()["t"]

    def dependencies(self, path: str, depth: int = 1) -> dict:
        """{imports, imported_by, transitive}: transitive holds, at depth 2, the first few of each of the first imports."""
        _within("depth", depth, 1, 2)
        e = self.edges()
        out = {"imports": [r["path"] for r in graph.dependencies(e, path).collect()], "imported_by": [r["path"] for r in graph.dependents(e, path).collect()], "transitive": {}}
        if depth == 2:
            for r in graph.two_hops(e).where(F.col("src") == path).orderBy("dep", "transitive").collect():
                out["transitive"].setdefault(r["dep"], []).append(r["transitive"])
        return out

    def call_graph(self, symbol: str, direction: str = "callers", limit: int = 50) -> tuple[str, DataFrame | list]:
        """('ok', edges), or ('missing' | 'ambiguous', the symbols of that name)."""
        _within("limit", limit, 1, 100)
        c = self.store.table("call_edges")
        if direction == "callers":
            return "ok", calls_ops.callers(c, symbol, limit)
        state, rows = calls_ops.resolve_symbol(self.store.table("symbols"), symbol)
        if state != "unique":
            return state, rows
        return "ok", calls_ops.callees(c, rows[0]["file_path"], rows[0]["name"], limit)

    def search_symbols(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return retrieval.find_symbols(self.store.table("symbols"), query, kind, _within("limit", limit, 1, 100))

    def recent_changes(self, since: str = "7d", limit: int = 20) -> DataFrame:
        from lodestone.sources import git

        git.register(self.spark)
        return self.spark.read.format("lodestone_git").options(path=self.root, what="commits", since=since, limit=str(_within("limit", limit, 1, 100))).load()

    def status(self, now_ms: int | None = None) -> dict:
        files = self.store.table("files")
        out = index_stats(files).first().asDict() | staleness(files, now_ms or int(time.time() * 1000)).first().asDict()
        g = graph.graph_stats(self.edges()).first()
        return out | {"vectors": self.store.table("chunks").count(), "graph_nodes": g["nodes"], "graph_edges": g["edges"], "index_dir": self.index_dir}

    # Tools as text ------------------------------------------------------------------------------------------------------

    def dependencies_text(self, path: str, depth: int = 1) -> str:
        found = self.dependencies(path, depth)
        last = self.store.table("dependency_edges").where(F.col("from_file") == path).groupBy("to_file").agg(F.max_by("symbols", "from_line").alias("symbols"))
        return render.dependencies(path, found, {r["to_file"]: r["symbols"] for r in last.collect()})

    def call_graph_text(self, symbol: str, direction: str = "callers", limit: int = 50) -> str:
        state, found = self.call_graph(symbol, direction, limit)
        rows = found.collect() if isinstance(found, DataFrame) else found
        return render.call_graph(symbol, direction, state, rows, rows[0]["caller_file"] if state == "ok" and rows and direction == "callees" else None)

    def symbols_text(self, query: str, kind: str | None = None, limit: int = 20) -> str:
        order = Window.orderBy(F.when(F.col("name") == query, 0).otherwise(1), F.when(F.col("visibility") == "exported", 0).otherwise(1), "name", "id")
        return render.symbols(self.search_symbols(query, kind, limit).withColumn("pos", F.row_number().over(order))).first()["text"]

    def status_text(self, now_ms: int | None = None) -> str:
        s = self.status(now_ms)
        when = None if s["newest"] is None else self.spark.range(1).select(render.iso_time(F.lit(s["newest"])).alias("t")).first()["t"]
        return render.status(s | {"newest_text": when})

    def repo_map_text(self, scope: str | None = None, max_tokens: int = 2048) -> str:
        return render.repo_map(self.repo_map(scope, max_tokens)).first()["text"]

    def changes_text(self, since: str = "7d", limit: int = 20) -> str:
        return render.commits(self.recent_changes(since, limit).collect(), since, limit)

    def context(self, query: str, limit: str | int | None = None, strategy: str = "hybrid", width: int = 500) -> DataFrame:
        """Search results for another program: (filePath, startLine, endLine, score, source, snippet, pos). limit is taken into
        1 to 20, 5 if it is no number; a blank query raises."""
        if not query.strip():
            raise ValueError("a query is needed")
        n = int(limit) if limit is not None and str(limit).lstrip("-").isdigit() else 5
        found = self.search(query, strategy, min(max(n or 5, 1), 20))
        return found.select("filePath", "startLine", "endLine", "score", "source", F.substring("content", 1, width).alias("snippet"), "pos")

    def context_text(self, query: str, limit: int = 5) -> str:
        """The results worth reading as numbered documents, best first."""
        block = prompts.context_blocks(F.col("score"), F.col("pos"), F.col("filePath"), F.col("snippet"))
        return "\n".join(r["b"] for r in self.context(query, limit).orderBy("pos").select(block.alias("b")).collect() if r["b"])

    def resource(self, name: str, key: str | None = None) -> DataFrame:
        """(json): the index for other programs, a row a record. stats; files; file (key: a path below the root) with its
        symbols, imports and dependents; symbols (key: a kind), the first 200 by name."""
        if name == "stats":
            return self.spark.range(1).select(F.lit(json.dumps(self.status())).alias("json"))
        if name == "files":
            return self.store.table("files").select(F.to_json(F.struct("path", "language", F.col("chunk_count").alias("chunks"))).alias("json"))
        if name == "symbols":
            return self.store.table("symbols").where(F.col("kind") == key).orderBy("name", "id").limit(200).select(F.to_json(F.struct("*")).alias("json"))
        if name != "file":
            raise ValueError(f"no resource {name}")
        if key is None or not config.within(plain_path(self.root), key):
            raise ValueError("the path is outside of the root")
        gather = lambda df, c: df.agg(F.sort_array(F.collect_list(c)).alias("x"))
        own = gather(self.store.table("symbols").where(F.col("file_path") == key), F.struct("start_line", "end_line", "name", "qualified_name", "kind", "signature"))
        e = self.edges()
        into, out = gather(graph.dependents(e, key), F.col("path")), gather(graph.dependencies(e, key), F.col("path"))
        one = own.select(F.col("x").alias("symbols")).crossJoin(out.select(F.col("x").alias("imports"))).crossJoin(into.select(F.col("x").alias("dependents")))
        return one.select(F.to_json(F.struct(F.lit(key).alias("path"), "symbols", "imports", "dependents")).alias("json"))

    def watch(self, events: DataFrame, checkpoint: str, trigger: str | None = None):
        """Keep the index up to date with a stream of events (path, event_type, ts). Events of files that a scan leaves out
        are dropped."""
        from lodestone.streaming.watch import run

        events = events.where(wanted(F.col("path"), self.root, self.patterns()))

        def apply(changed: DataFrame, deleted: DataFrame) -> None:
            if not changed.isEmpty():
                self.index_files(changed)
            if not deleted.isEmpty():
                self.remove_files(deleted)

        return run(events, apply, checkpoint, trigger)


def _valid_regex(query: str) -> bool:
    import re

    try:
        re.compile(query)
    except re.error:
        return False
    return True
