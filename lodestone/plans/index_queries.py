"""Queries over the tables of a code index, each by the operators of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import lang, prompts, render, text
from lodestone.functions.paths import canonical_path
from lodestone.operators import calls, changes, extract, graph, imports, retrieval, store
from lodestone.session import materialize, release
from lodestone.sources.scan import indexable
from lodestone.sources.tables import table, utc
from lodestone.streaming.watch import batches_of_table

#: A fixed present, so that results don't depend on when they are asked for: 2026-07-01 UTC.
NOW_MS = 1_782_864_000_000


# Bindings of the tables to the operators' relations -------------------------------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    """The current state of each indexed file."""
    return changes.latest_state(table(spark, d, "files").distinct())


def scanned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanned_files").distinct()


def code_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "code_chunks", *columns).distinct()


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each call once, whatever was redelivered."""
    return table(spark, d, "call_edges", "id", "caller_file", "caller_symbol", "caller_line", "callee_name", "callee_file").distinct()


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols as the chunks name them."""
    c = code_chunks(spark, d, "id", "chunkname", "chunktype", "signature", "startline", "endline", "filepath", "language").where("chunktype <> 'module'")
    public = F.coalesce(F.col("signature").startswith("export ") | F.col("signature").startswith("public "), F.lit(False))
    return c.select(
        "id", F.col("chunkname").alias("name"), F.col("chunkname").alias("qualified_name"), F.col("chunktype").alias("kind"), F.col("filepath").alias("file_path"),
        F.col("startline").alias("start_line"), F.col("endline").alias("end_line"), F.coalesce("signature", F.lit("")).alias("signature"),
        F.when(public, "exported").otherwise("internal").alias("visibility"), "language",
        F.lit(None).cast("array<struct<name:string,type:string,defaultValue:string>>").alias("parameters"), F.lit(None).cast("string").alias("return_type"),
    )


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst) between files, paths in one spelling."""
    e = table(spark, d, "dependency_edges", "from_file", "to_file", "kind").where("kind <> 'package'")
    return graph.edges_from_imports(e.select(canonical_path(F.col("from_file")).alias("from_file"), canonical_path(F.col("to_file")).alias("to_file")))


def names_by_file(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    return s.groupBy(F.col("file_path").alias("file")).agg(F.transform(F.sort_array(F.collect_set(F.struct("start_line", "name"))), lambda x: x["name"]).alias("definitions"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").distinct()


def usable_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").distinct()
    return c.select("id", "vector", F.col("filepath").alias("filePath"), F.col("chunkname").alias("chunkName"), F.col("chunktype").alias("chunkType"), F.col("startline").alias("startLine"), F.col("endline").alias("endLine"), "content", "language")


def query_vector(chunks: DataFrame) -> list[float]:
    """The usable vector of the smallest id, as a query."""
    ok = (F.size("vector") == text.VECTOR_DIM) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    row = chunks.where(ok).orderBy("id").select("vector").first()
    return list(row["vector"]) if row else [0.0] * text.VECTOR_DIM


# Scans and scalar functions -----------------------------------------------------------------------------------------------


def scan_filter(spark, d):
    return indexable(scanned(spark, d)).select("path", lang.detect_language(F.col("extension")).alias("detected"))


def languages(spark, d):
    s = scanned(spark, d).withColumn("detected", F.coalesce(lang.detect_language(F.col("extension")), F.lit("")))
    return s.groupBy("detected", lang.is_binary(F.col("extension")).alias("is_binary")).agg(F.count(F.lit(1)).alias("n"))


def supported_languages(spark, d):
    return lang.supported(spark).groupBy("language").agg(F.count(F.lit(1)).alias("extensions"))


def hashes(spark, d):
    return documents(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


def tokens(spark, d):
    c = code_chunks(spark, d, "id", "content").where("content is not null")
    return c.select("id", text.count_tokens(F.col("content")).alias("tokens"), text.exceeds_tokens(F.col("content")).alias("oversized"), F.length(text.truncate_to_tokens(F.col("content"), 100)).alias("kept"))


def signatures(spark, d):
    c = code_chunks(spark, d, "id", "content", "filepath", "startline", "endline")
    return c.select("id", text.first_line(F.col("content")).alias("sig"), text.chunk_id(F.col("filepath"), F.col("startline"), F.col("endline")).alias("made"), text.symbol_id(F.col("filepath"), F.lit("x")).alias("sym"))


def line_ranges(spark, d):
    c = code_chunks(spark, d, "id", "content")
    return c.select("id", text.line_range(F.col("content"), F.lit(2), F.lit(4)).alias("lines"))


def whole_files(spark, d):
    t = documents(spark, d).where("text is not null")
    n = F.size(F.split("text", "\n"))
    p = F.col("doc_id").cast("string")
    return t.select(text.chunk_id(p, F.lit(1), n).alias("id"), text.first_line(F.col("text")).alias("signature"), n.alias("endline"))


def file_names(spark, d):
    s = scanned(spark, d)
    from lodestone.functions.paths import basename, extension

    return s.select("path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), text.glob_match(F.col("path"), "*.ts").alias("is_ts"), text.glob_match(F.col("path"), "/srv/**/src/*/*.go").alias("is_go"))


def canonical_paths(spark, d):
    c = table(spark, d, "call_edges", "id", "callee_file").distinct()
    return c.select("id", canonical_path(F.col("callee_file")).alias("path"))


def placeholder_vectors(spark, d):
    t = documents(spark, d).where("text is not null").select("doc_id", text.placeholder_embedding(F.col("text")).alias("v"))
    return t.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[383], 6).alias("last"), F.size("v").alias("dim"))


def naive_tokens(spark, d):
    t = documents(spark, d).where("text is not null").select("doc_id", text.token_ids(F.col("text")).alias("ids"))
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.coalesce(F.array_max("ids"), F.lit(0)).alias("most"))


# Change detection and stores -------------------------------------------------------------------------------------------------


def files_latest(spark, d):
    return files(spark, d).select("path", "hash", "last_indexed", F.coalesce(F.col("chunk_count").cast("bigint"), F.lit(0)).alias("chunk_count"), "language")


def change_status(spark, d):
    f = table(spark, d, "files").distinct()
    first = f.groupBy("path").agg(F.min_by(F.struct("hash", "last_indexed"), F.struct("last_indexed", "hash")).alias("s")).select("path", "s.*")
    scan = files(spark, d).select("path", "hash", F.col("mtime").alias("mtime_ms"))
    return changes.classify(scan, first).select("path", "new_hash", "status")


def change_summary(spark, d):
    return changes.run_summary(change_status(spark, d))


def stale_files(spark, d):
    """Indexed files that are no longer there: not scanned, or deleted since."""
    f = files(spark, d).select(canonical_path(F.col("path")).alias("path"))
    gone = changes.last_event(_changes(spark, d)).where("change_type = 'deleted'").select("path")
    there = scanned(spark, d).select(canonical_path(F.col("path")).alias("path")).join(gone, "path", "left_anti")
    return changes.stale(f, there)


def _changes(spark, d):
    c = table(spark, d, "file_changes").distinct()
    return c.withColumn("path", canonical_path(F.col("path")))


def changed_or_new(spark, d):
    scan = scanned(spark, d).select("path").distinct()
    return changes.changed_or_new(scan, files(spark, d).select("path", "hash"), changes.changed_set(_changes(spark, d)))


def last_event_wins(spark, d):
    e = changes.last_event(_changes(spark, d))
    return e.select("path", "change_type", F.unix_micros(F.col("changed_at").cast("timestamp")).alias("at"))


def upsert_files(spark, d):
    new = changes.changed_set(_changes(spark, d)).select("path", text.content_hash(F.col("path")).alias("hash"), F.lit(NOW_MS).cast("bigint").alias("last_indexed"))
    return store.replace_by_key(files(spark, d).select("path", "hash", "last_indexed"), new, "path")


def remove_files(spark, d):
    gone = changes.last_event(_changes(spark, d)).where("change_type = 'deleted'").select("path")
    return store.delete_by_key(files(spark, d).select("path", "hash"), gone, "path")


def index_stats(spark, d):
    return store.index_stats(files(spark, d))


def stats_by_language(spark, d):
    f = files(spark, d)
    return f.groupBy(F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("chunk_count").cast("bigint")), F.lit(0)).alias("chunks"))


def index_staleness(spark, d):
    return store.staleness(files(spark, d), NOW_MS)


def files_as_json(spark, d):
    return files(spark, d).select(F.to_json(F.struct("path", "language", F.col("hash"))).alias("json"))


# Calls and symbols -----------------------------------------------------------------------------------------------------------


def callers(spark, d):
    return calls.callers(call_edges(spark, d).drop("id").distinct(), "reportMetric").select("caller_file", "caller_symbol", "caller_line")


def callees(spark, d):
    c = call_edges(spark, d).drop("id").distinct()
    first = c.where("caller_file is not null").agg(F.min("caller_file")).first()[0]
    return calls.callees(c, first or "").select("caller_symbol", "caller_line", "callee_name")


def first_calls(spark, d):
    return calls.first_calls(calls.without_noise(call_edges(spark, d)))


def enclosing_symbols(spark, d):
    c = call_edges(spark, d).select(F.col("id").alias("call_id"), canonical_path(F.col("caller_file")).alias("file"), F.col("caller_line").alias("line"))
    r = symbols(spark, d).select(F.col("file_path").alias("file"), "name", "kind", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    return calls.enclosing(c, r).select("call_id", "caller_symbol")


def resolved_callees(spark, d):
    c = call_edges(spark, d).select("id", "callee_name", F.lit(None).cast("string").alias("callee_file"))
    return calls.resolve_callees(c, symbols(spark, d)).where("callee_file is not null").select("id", "callee_file")


def symbol_prefix(spark, d):
    return retrieval.find_symbols(symbols(spark, d), "load").select("id", "name", "kind", "visibility")


def symbol_results(spark, d):
    return retrieval.symbol_search(symbols(spark, d), " load ", 15).select("filePath", "content", "score", "chunkName")


def symbols_by_kind(spark, d):
    return symbols(spark, d).groupBy("kind", "visibility").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


def edges_of_files(spark, d):
    e = table(spark, d, "dependency_edges", "from_file", "to_file", "kind", "symbols", "from_line").distinct()
    return e.where("kind = 'import'").select("from_file", "to_file", F.col("from_line").alias("line"), F.array_join("symbols", ",").alias("symbols"))


def resolved_imports(spark, d):
    """Imports as a source would write them, from the root of all files and without an extension, led back to files."""
    e = table(spark, d, "dependency_edges", "from_file", "to_file", "kind").where("kind <> 'package'")
    e = e.select(canonical_path(F.col("from_file")).alias("from_file"), canonical_path(F.col("to_file")).alias("to")).where("from_file like '/%' and to like '/%'")
    up = F.repeat(F.lit("../"), F.size(F.split("from_file", "/")) - 2)
    found = e.select("from_file", F.concat(up, F.regexp_replace(F.substring("to", 2, 100_000), r"\.[^./]+$", "")).alias("source_path")).distinct()
    return imports.resolve(found, scanned(spark, d).select("path")).select("from_file", "source_path", "to_file")


def extracted_symbols(spark, d):
    """Each chunk's content read as a file: symbols by kind and language."""
    c = code_chunks(spark, d, "id", "content", "language").select(F.col("id").alias("path"), "content", F.lower("language").alias("language"))
    return extract.symbols_of(extract.extract(c)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


def extracted_calls(spark, d):
    c = code_chunks(spark, d, "id", "content", "language").select(F.col("id").alias("path"), "content", F.lower("language").alias("language"))
    return extract.calls_of(extract.extract(c)).groupBy("callee_name").agg(F.count(F.lit(1)).alias("n"))


# Graph ------------------------------------------------------------------------------------------------------------------------


def _tags(spark, d):
    defs = symbols(spark, d).select("name", F.lit("def").alias("kind"), F.col("file_path").alias("file"), F.col("start_line").cast("bigint").alias("seq"))
    refs = call_edges(spark, d).select(F.col("callee_name").alias("name"), F.lit("ref").alias("kind"), F.col("caller_file").alias("file"), F.lit(0).cast("bigint").alias("seq"))
    return defs.unionByName(refs).where("file is not null")


def tag_edges(spark, d):
    return graph.edges_from_tags(_tags(spark, d))


def graph_stats(spark, d):
    return graph.graph_stats(import_edges(spark, d))


def degrees(spark, d):
    e = import_edges(spark, d)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def two_hops(spark, d):
    return graph.two_hops(import_edges(spark, d))


_kept: dict[tuple, DataFrame] = {}


def scores(spark, d):
    """(node, score) of the import graph: computed at the first question and kept while the table's files stay as they are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/dependency_edges.parquet")
    st = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (spark.sparkContext.applicationId, d, st.getModificationTime(), st.getLen())
    if key not in _kept:
        for old in [k for k in _kept if k[:2] == key[:2]]:
            release(_kept.pop(old))
        _kept[key] = materialize(graph.pagerank(import_edges(spark, d)), "scores")
    return _kept[key]


def pagerank(spark, d):
    return scores(spark, d).select("node", F.round("score", 9).alias("score"))


def ranked_files(spark, d):
    return graph.ranked(scores(spark, d)).select("node", F.round("score", 9).alias("score"))


def repo_map(spark, d):
    e = import_edges(spark, d)
    m = graph.repo_map(scores(spark, d), e, names_by_file(spark, d), max_tokens=2048)
    return m.select("path", F.round("rank", 9).alias("rank"), F.array_join("symbols", ",").alias("symbols"), F.size("dependencies").alias("n_out"), F.size("dependents").alias("n_in"))


def structural_search(spark, d):
    s = retrieval.structural_search(scores(spark, d), names_by_file(spark, d), "search load", 10)
    return s.select("filePath", F.round("score", 6).alias("score"), "chunkName")


# Search -----------------------------------------------------------------------------------------------------------------------


def _pages(spark, d):
    return documents(spark, d).where("text is not null").select(F.format_string("%08d", "doc_id").alias("filePath"), F.col("text").alias("content"))


def keyword_lines(spark, d):
    return retrieval.matching_lines(_pages(spark, d), r"returned \d+ chunks")


def keyword_search(spark, d):
    return retrieval.keyword_search(_pages(spark, d), r"Steps|TODO").select("filePath", "content", F.round("score", 6).alias("score"), "startLine", "endLine")


def semantic_topk(spark, d):
    e = table(spark, d, "embeddings").distinct()
    q = e.where("vec_id = 0").select("embedding").first()
    near = retrieval.nearest(e, list(q["embedding"]) if q else [0.0] * 64, "embedding", "vec_id")
    return retrieval.similarity(near).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def semantic_pattern(spark, d):
    c = usable_chunks(spark, d)
    return retrieval.semantic_search(c, query_vector(c), 10, "*.py", metric="l2").select("filePath", "startLine", "endLine", F.round("score", 5).alias("score"))


def hybrid_search(spark, d):
    """Semantic, keyword, structural and symbol results, fused."""
    c = usable_chunks(spark, d)
    names = names_by_file(spark, d)
    parts = [
        retrieval.semantic_search(c, query_vector(c), 10),
        retrieval.keyword_search(c.where("content is not null").select("filePath", "content"), "return", 10),
        retrieval.structural_search(scores(spark, d), names, "load search", 10),
        retrieval.symbol_search(symbols(spark, d), "load", 10),
    ]
    merged = retrieval.merge(retrieval.union_strategies(*parts))
    return retrieval.final_order(merged, 10).select(*[F.round(c, 6).alias(c) if c == "score" else F.col(c) for c in retrieval.RESULT])


def expanded_search(spark, d):
    from pyspark.sql import Window

    s = symbols(spark, d)
    top = retrieval.symbol_search(s, "joinPlatform", 10).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "filePath", "startLine")))
    return calls.expand_context(top, call_edges(spark, d), s)


def weighted_sources(spark, d):
    s = retrieval.symbol_search(symbols(spark, d), "load", 10)
    k = retrieval.keyword_search(_pages(spark, d), "TODO", 10)
    return retrieval.weighted(retrieval.union_strategies(k, s)).select("filePath", "startLine", F.round("score", 6).alias("score"), "seq")


def quality_gate(spark, d):
    t = documents(spark, d).join(table(spark, d, "documents", "doc_id", "repo").distinct(), "doc_id")
    scored = t.select("doc_id", "repo", F.least(F.coalesce(F.length("text"), F.lit(0)) / 5000.0, F.lit(1.0)).alias("score"))
    return retrieval.quality_gate(scored, "repo").select("doc_id", F.round("score", 6).alias("score"), "passed")


def recent_changes(spark, d):
    c = utc(table(spark, d, "file_changes").distinct())
    cut = F.timestamp_millis(F.lit(NOW_MS)) - F.expr("interval 60 days")
    return c.where(F.col("changed_at") >= cut).orderBy(F.desc("changed_at"), "change_id").limit(20).select("change_id", "path", "change_type")


def debounce_batches(spark, d):
    e = utc(table(spark, d, "events", "event_id", "ts", "user_id").distinct())
    b = batches_of_table(e, "user_id", "ts", 600)
    return b.select("user_id", "batch", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events")


# Task texts -------------------------------------------------------------------------------------------------------------------


def task_detect(spark, d):
    t = documents(spark, d).where("text is not null").select("doc_id", prompts.normalize(F.col("text")).alias("t"))
    t = t.withColumn("task", prompts.detect_task(F.col("t")))
    return t.select("doc_id", "task", prompts.detect_intensity(F.col("t"), F.col("task")).alias("intensity"))


def prompt_subjects(spark, d):
    t = documents(spark, d).where("text is not null").select("doc_id", prompts.normalize(F.col("text")).alias("t"))
    t = t.withColumn("task", prompts.detect_task(F.col("t")))
    return t.select("doc_id", prompts.subject(F.col("t"), F.col("task")).alias("subject"), prompts.was_stripped(F.col("t"), F.col("task")).alias("stripped"))


def budget_allocation(spark, d):
    rows = [(t, tool, w) for t, ws in prompts.TOOL_WEIGHTS.items() for tool, w in ws.items()]
    df = spark.createDataFrame(rows, "task string, tool string, weight double")
    return df.select("task", "tool", F.floor(F.lit(2048) * F.col("weight") + 1e-9).cast("bigint").alias("tokens"))


def tag_difference(spark, d):
    t = documents(spark, d).where("text is not null")
    missing = prompts.missing_tags(F.lit("<html><body><insert><owner>"), F.col("text"))
    return t.select("doc_id", F.array_join(F.sort_array(missing), ",").alias("missing"), prompts.answer_is_valid(F.lit("<html>"), F.col("text")).alias("valid"))


def import_decoration(spark, d):
    e = table(spark, d, "dependency_edges", "from_file", "to_file", "kind", "symbols", "from_line").distinct().where("kind <> 'package'")
    edges = e.where("from_file is not null and to_file is not null").select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")).distinct()
    return graph.decorated_imports(edges, e)


def file_detail(spark, d):
    f = scanned(spark, d).select(canonical_path(F.col("path")).alias("path")).distinct()
    return graph.file_detail(f, import_edges(spark, d), symbols(spark, d))


def prompt_sections(spark, d):
    """Each text as a request, composed."""
    t = prompts.with_enhanced(documents(spark, d).where("text is not null"), "text", "body")
    return t.select("doc_id", F.sha2("body", 256).alias("hash"), F.length("body").alias("chars"))


def usage_patterns(spark, d):
    s = table(spark, d, "scanned_files", "path").where("path is not null").distinct()
    return s.select("path", prompts.usage_patterns(F.col("path")).alias("u")).select("path", "u.*")


def track_merge(spark, d):
    p = _pages(spark, d)
    found = retrieval.keyword_search(p, "returned", 20)
    tools = p.where(F.col("content").contains("TODO")).orderBy("filePath").limit(20)
    return retrieval.merge_tracks(found, tools, 4000).select("filePath", F.round("score", 6).alias("score"), F.length("content").alias("chars"))


# Further functions ------------------------------------------------------------------------------------------------------------


def name_functions(spark, d):
    """Functions on names and source texts, over all scanned files."""
    s = table(spark, d, "scanned_files", "path").where("path is not null").distinct()
    dotted = F.concat(F.lit(".."), F.regexp_replace("path", r"[^A-Za-z0-9]+", "."))
    return s.select(
        "path",
        text.strip_quotes(F.concat(F.lit("'"), "path", F.lit("'"))).alias("bare"),
        text.module_path(dotted).alias("module"),
        text.strip_annotation(F.concat(F.lit(": "), "path", F.lit(" "))).alias("annotation"),
        text.qualified_name(F.lit("A"), F.substring_index("path", "/", -1)).alias("qualified"),
        F.length(text.embedding_input(F.col("path"), F.repeat("path", 60))).alias("embedded"),
        text.is_relative_import(F.col("path")).alias("relative"),
    )


def indexed_times(spark, d):
    return files(spark, d).select("path", render.iso_time(F.col("last_indexed")).alias("at"))


def file_outlines(spark, d):
    return names_by_file(spark, d).where("file is not null").select("file", retrieval.outline(F.col("file"), F.col("definitions")).alias("outline"))


def file_definitions(spark, d):
    return graph.definitions(_tags(spark, d).distinct()).select("file", F.array_join("definitions", ",").alias("definitions"))


def search_text(spark, d):
    """Results as the text that a tool gives."""
    from pyspark.sql import Window

    top = retrieval.symbol_search(symbols(spark, d), "joinPlatform", 10)
    return render.search_results(top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "filePath", "startLine"))))


def graph_with_batch(spark, d):
    """The import graph after a batch of tags was added."""
    return graph.add_tags(import_edges(spark, d), _tags(spark, d))


def graph_without_deleted(spark, d):
    gone = changes.last_event(_changes(spark, d)).where("change_type = 'deleted'").select("path")
    return graph.remove_file(graph.replace_graph(import_edges(spark, d).limit(0), import_edges(spark, d)), gone)
