"""All queries of the core, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from lodestone.functions import lang, prompts
from lodestone.plans import index_queries as q
from lodestone.plans import integrity

FLAGSHIP = "hybrid_search"

QUERIES = {
    "p2_found": integrity.p2_found,
    "p2_orphans_by_month": integrity.p2_orphans_by_month,
    "files_scan_filter": q.scan_filter,
    "language_detect": q.languages,
    "languages_supported": q.supported_languages,
    "content_hash": q.hashes,
    "chunk_tokens": q.tokens,
    "chunk_signature": q.signatures,
    "chunk_lines": q.line_ranges,
    "chunk_whole_file": q.whole_files,
    "file_names": q.file_names,
    "canonical_paths": q.canonical_paths,
    "embedding_placeholder": q.placeholder_vectors,
    "naive_tokenize": q.naive_tokens,
    "files_latest": q.files_latest,
    "change_classify": q.change_status,
    "change_summary": q.change_summary,
    "stale_files": q.stale_files,
    "changed_or_new": q.changed_or_new,
    "last_event_wins": q.last_event_wins,
    "upsert_files": q.upsert_files,
    "remove_files": q.remove_files,
    "index_stats": q.index_stats,
    "stats_by_language": q.stats_by_language,
    "index_staleness": q.index_staleness,
    "files_as_json": q.files_as_json,
    "callers": q.callers,
    "callees": q.callees,
    "call_edges_dedup": q.first_calls,
    "enclosing_symbol": q.enclosing_symbols,
    "callee_resolve": q.resolved_callees,
    "symbol_prefix_search": q.symbol_prefix,
    "symbol_search_scored": q.symbol_results,
    "symbols_by_kind": q.symbols_by_kind,
    "import_edges": q.edges_of_files,
    "import_resolve": q.resolved_imports,
    "extract_symbols": q.extracted_symbols,
    "extract_calls": q.extracted_calls,
    "tag_graph_edges": q.tag_edges,
    "graph_stats": q.graph_stats,
    "graph_degrees": q.degrees,
    "dependencies_depth2": q.two_hops,
    "pagerank": q.pagerank,
    "ranked_files": q.ranked_files,
    "repo_map_budget": q.repo_map,
    "structural_search": q.structural_search,
    "keyword_lines": q.keyword_lines,
    "keyword_search": q.keyword_search,
    "semantic_topk": q.semantic_topk,
    "semantic_postfilter": q.semantic_pattern,
    "hybrid_search": q.hybrid_search,
    "expand_context": q.expanded_search,
    "source_weights_union": q.weighted_sources,
    "quality_gate": q.quality_gate,
    "recent_changes": q.recent_changes,
    "debounce_batches": q.debounce_batches,
    "task_detect": q.task_detect,
    "prompt_subject": q.prompt_subjects,
    "budget_allocation": q.budget_allocation,
    "tag_set_difference": q.tag_difference,
    "import_decoration": q.import_decoration,
    "file_detail": q.file_detail,
    "prompt_sections": q.prompt_sections,
    "track_merge": q.track_merge,
    "usage_patterns": q.usage_patterns,
    "name_functions": q.name_functions,
    "indexed_times": q.indexed_times,
    "file_outlines": q.file_outlines,
    "file_definitions": q.file_definitions,
    "search_text": q.search_text,
    "graph_add_tags": q.graph_with_batch,
    "graph_remove_files": q.graph_without_deleted,
}

# Pieces of SQL -------------------------------------------------------------------------------------------------------------


def _canon(c: str) -> str:
    """One spelling of a path. A segment before '..' is taken away up to six times, deeper nesting isn't in any table."""
    flat = f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '[\\\\/]+', '/', 'g')"
    out = f"regexp_replace({flat}, '(/\\.)+(/|$)', '/', 'g')"
    for _ in range(6):
        out = f"regexp_replace({out}, '/[^/]+/\\.\\.(/|$)', '/')"
    return f"nullif(regexp_replace({out}, '(.)/$', '\\1'), '')"


_LATEST = "latest AS (SELECT path, hash, last_indexed, chunk_count, language, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed DESC, hash DESC) AS rn FROM (SELECT DISTINCT * FROM files)) WHERE rn = 1)"
_EVENTS = f"ev AS (SELECT path, change_type, changed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY changed_at DESC, change_id DESC) AS rn FROM (SELECT DISTINCT change_id, {_canon('path')} AS path, change_type, changed_at FROM file_changes)) WHERE rn = 1)"
_CALLS = "calls AS (SELECT DISTINCT id, caller_file, caller_symbol, caller_line, callee_name, callee_file FROM call_edges)"
_SYMBOLS = "symbols AS (SELECT DISTINCT id, chunkname AS name, chunktype AS kind, filepath AS file_path, startline AS start_line, endline AS end_line, coalesce(signature, '') AS signature, CASE WHEN signature LIKE 'export %' OR signature LIKE 'public %' THEN 'exported' ELSE 'internal' END AS visibility, language FROM code_chunks WHERE chunktype <> 'module')"
_EDGES = f"edges AS (SELECT DISTINCT src, dst FROM (SELECT {_canon('from_file')} AS src, {_canon('to_file')} AS dst FROM dependency_edges WHERE kind <> 'package') WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"
_NAMES = "names AS (SELECT file_path AS file, list(name ORDER BY start_line, name) AS definitions FROM (SELECT DISTINCT file_path, start_line, name FROM symbols) GROUP BY 1)"


def _pagerank() -> str:
    parts = [
        "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
        "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "w AS (SELECT e.src, e.dst, 0.85 / d.degree AS w FROM edges e JOIN (SELECT src, count(*) AS degree FROM edges GROUP BY 1) d ON e.src = d.src)",
        "s0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n.n AS score FROM nodes, n)",
    ]
    for i in range(1, 21):
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT o.node, 0.15::DOUBLE / n.n + coalesce(f.inflow, 0) AS score FROM nodes o CROSS JOIN n LEFT JOIN (SELECT w.dst, sum(s.score * w.w) AS inflow FROM w JOIN s{i - 1} s ON s.node = w.src GROUP BY 1) f ON f.dst = o.node)"
        )
    return ", ".join(parts)


def _bounded(expr: str) -> str:
    return f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:{expr})(?:[^\\p{{L}}\\p{{N}}_]|$)"


def _count_words(column: str, words: list[str]) -> str:
    return " + ".join(f"regexp_matches(lower({column}), '{_bounded(w)}')::INT" for w in words)


_NORMAL = "t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL)"
_SCORED = "scored AS (SELECT doc_id, t, " + ", ".join(f"{_count_words('t', ws)} AS {task}" for task, ws in prompts.TASK_WORDS.items()) + " FROM t)"
_TASKED = (
    "tasked AS (SELECT doc_id, t, CASE WHEN greatest(debug, coding, refactor, review, research) = 0 THEN 'research' "
    + " ".join(f"WHEN {task} = greatest(debug, coding, refactor, review, research) THEN '{task}'" for task in prompts.TASK_WORDS)
    + " END AS task FROM scored)"
)


def _lead(words: list[str]) -> str:
    return "(?is)^(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")\\s+(\\S.*)$"


_SUBJECT = (
    f"CASE WHEN regexp_matches(t, '{_lead(prompts.ANY_LEAD)}') THEN trim(regexp_extract(t, '{_lead(prompts.ANY_LEAD)}', 1)) "
    + " ".join(f"WHEN task = '{k}' AND regexp_matches(t, '{_lead(ws)}') THEN trim(regexp_extract(t, '{_lead(ws)}', 1))" for k, ws in prompts.TASK_LEAD.items())
    + " ELSE t END"
)
_LANGS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lang.LANGUAGES.items()) + ") AS l(ext, lang)"
_BIN = "(" + ", ".join(f"'{x}'" for x in lang.BINARY) + ")"
_USABLE = "usable AS (SELECT DISTINCT * FROM chunks WHERE len(vector) = 384 AND list_bool_and(list_transform(vector, lambda x: isfinite(x))))"

_RESULT = '"filePath", content, score, "startLine", "endLine", "chunkName", "chunkType", language, source'
_PAGES = "pages AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS \"filePath\", text AS content FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL)"


def _keyword(files: str, pattern: str, limit: int) -> str:
    """Results of a keyword search over a table of files, as a chain of expressions that ends with kw."""
    return (
        f"kl AS (SELECT \"filePath\", row_number() OVER () AS own, string_split(content, chr(10)) AS ls FROM {files}), "
        "kx AS (SELECT \"filePath\", own, i AS line, regexp_replace(ls[i], '\\s+$', '') AS text FROM kl, unnest(range(1, len(ls) + 1)) AS r(i)), "
        f"kk AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY line) AS rn FROM kx WHERE regexp_matches(text, '{pattern}')), "
        f"kg AS (SELECT \"filePath\", string_agg(line::VARCHAR || ': ' || text, chr(10) ORDER BY line, text) AS content, min(line)::INT AS \"startLine\", max(line)::INT AS \"endLine\" FROM kk WHERE rn <= 5 GROUP BY 1 ORDER BY 1 LIMIT {limit}), "
        "kw AS (SELECT \"filePath\", content, greatest(0.1, 1.0 - 0.05 * (row_number() OVER (ORDER BY \"filePath\") - 1))::DOUBLE AS score, \"startLine\", \"endLine\", regexp_extract(\"filePath\", '[^/]*$') AS \"chunkName\", 'module' AS \"chunkType\", NULL::VARCHAR AS language, 'keyword' AS source FROM kg)"
    )


def _symbol(prefix: str, limit: int) -> str:
    """Results of a symbol search, named sy, over the table symbols."""
    return (
        f"sy AS (SELECT file_path AS \"filePath\", CASE WHEN visibility = 'exported' THEN 'export ' ELSE '' END || kind || ' ' || name || CASE WHEN signature <> name AND signature <> '' THEN chr(10) || signature ELSE '' END AS content, "
        f"CASE WHEN name = '{prefix}' THEN 1.0 ELSE 0.8 END::DOUBLE AS score, start_line AS \"startLine\", end_line AS \"endLine\", name AS \"chunkName\", kind AS \"chunkType\", language, 'structural' AS source FROM (SELECT * FROM symbols WHERE name ILIKE '{prefix}%' "
        f"ORDER BY CASE WHEN name = '{prefix}' THEN 0 ELSE 1 END, CASE WHEN visibility = 'exported' THEN 0 ELSE 1 END, name, id LIMIT {limit}))"
    )


def _union(*parts: str) -> str:
    """The parts' rows with their strategy's number and their place in it, named u, with weighted scores."""
    each = " UNION ALL ".join(f'SELECT {_RESULT}, {i} AS seq, row_number() OVER (ORDER BY round(score, 12) DESC, "filePath", "startLine", "chunkName")::INT AS pos FROM {p}' for i, p in enumerate(parts))
    return f"u AS (SELECT * REPLACE (score * CASE source WHEN 'semantic' THEN 0.5 WHEN 'keyword' THEN 0.3 ELSE 0.2 END AS score) FROM ({each}))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _of_task(values: dict[str, str]) -> str:
    return "CASE task " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in values.items()) + " END"


def _composed() -> str:
    """The composed text of a request from t, task, level and subject."""
    full = "level <> 'light'"
    rules = (
        f"'Primary tool: ' || {_of_task({k: next(iter(w)) for k, w in prompts.TOOL_WEIGHTS.items()})} || '(query=\"' || substr(t, 1, 60) || '\")' || {_of_task({k: chr(10) + 'Secondary tools: ' + ', '.join(list(w)[1:]) if len(w) > 1 else '' for k, w in prompts.TOOL_WEIGHTS.items()})} "
        f"|| chr(10) || 'Look for: ' || {_of_task(prompts.FOCUS)} || CASE WHEN task IN ('debug', 'refactor') THEN chr(10) || 'Expand the best results by their callers and callees.' ELSE '' END"
    )
    framed = {k: v.split("{subject}") for k, v in prompts.TEMPLATES.items()}
    goal = f"CASE WHEN subject <> t THEN {_of_task({k: v[0] for k, v in framed.items()})} || subject || {_of_task({k: v[1] for k, v in framed.items()})} ELSE t || '. ' || {_of_task(prompts.SUFFIXES)} END || chr(10) || {_quoted(prompts.NOTE)} || chr(10) || 'Original request: ' || t"
    checks = _of_task({k: chr(10).join(f"  {i}. {c}" for i, c in enumerate([*own, *prompts.COMMON_CHECKS], 1)) for k, own in prompts.CHECKS.items()})
    fixed = lambda name: _quoted(prompts.BLOCKS[name])
    parts = [
        ("tool_rules", rules, None), ("parallel_tools", fixed("parallel_tools"), full), ("default_to_action", fixed("default_to_action"), full), ("investigate", fixed("investigate"), full),
        ("diagnosis", _of_task(prompts.DIAGNOSIS), full), ("keep_it_small", fixed("keep_it_small"), f"{full} AND task IN ('coding', 'refactor')"),
        ("work_style", f"'Task type: ' || task || ' | Intensity: ' || level || chr(10) || {_of_task(prompts.STYLE)}", None), ("grounding", fixed("grounding"), full),
        ("verification", checks, full), ("concise", fixed("concise"), None), ("objective", goal, None), ("done_criteria", _of_task(prompts.DONE), None),
    ]
    made = [(f"'<{n}>' || chr(10) || {x} || chr(10) || '</{n}>'", when) for n, x, when in parts]
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN {when} THEN {x} END" if when else x for x, when in made) + ")"


ORACLES: dict[str, str] = {
    "p2_found": f"""
        WITH seen AS (
            SELECT {_canon('path')} AS key, make_timestamp(last_indexed * 1000) AS "at", FALSE AS gone FROM files
            UNION ALL SELECT {_canon('path')}, changed_at, change_type = 'deleted' FROM file_changes),
        last AS (SELECT key, gone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC NULLS LAST, gone DESC) AS rn FROM seen) WHERE rn = 1),
        refs AS (
            SELECT 'call_edges' AS tab, id AS edge_id, 'callee_file' AS ref_field, {_canon('callee_file')} AS key FROM call_edges
            UNION ALL SELECT 'dependency_edges', id, 'from_file', {_canon('from_file')} FROM dependency_edges
            UNION ALL SELECT 'dependency_edges', id, 'to_file', {_canon('to_file')} FROM dependency_edges WHERE kind <> 'package')
        SELECT DISTINCT tab, edge_id, ref_field FROM refs LEFT JOIN last USING (key) WHERE refs.key IS NOT NULL AND coalesce(gone, TRUE)""",
    "p2_orphans_by_month": f"""
        WITH seen AS (
            SELECT {_canon('path')} AS key, make_timestamp(last_indexed * 1000) AS "at", FALSE AS gone FROM files
            UNION ALL SELECT {_canon('path')}, changed_at, change_type = 'deleted' FROM file_changes),
        state AS (SELECT key, "at", bool_or(gone) AS gone FROM seen GROUP BY 1, 2),
        last AS (SELECT key, gone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC NULLS LAST, gone DESC) AS rn FROM seen) WHERE rn = 1),
        refs AS (
            SELECT DISTINCT 'call_edges' AS tab, id AS edge_id, 'callee_file' AS ref_field, {_canon('callee_file')} AS key, indexed_at FROM call_edges
            UNION ALL SELECT DISTINCT 'dependency_edges', id, 'from_file', {_canon('from_file')}, indexed_at FROM dependency_edges
            UNION ALL SELECT DISTINCT 'dependency_edges', id, 'to_file', {_canon('to_file')}, indexed_at FROM dependency_edges WHERE kind <> 'package'),
        judged AS (SELECT r.*, CASE WHEN l.gone IS NULL THEN 'missing' WHEN l.gone THEN 'deleted' WHEN r.indexed_at IS NOT NULL AND coalesce(s.gone, TRUE) THEN 'late' ELSE 'valid' END AS verdict
            FROM refs r LEFT JOIN last l ON l.key = r.key ASOF LEFT JOIN state s ON s.key = r.key AND s."at" <= r.indexed_at WHERE r.key IS NOT NULL)
        SELECT tab, ref_field, coalesce(strftime(indexed_at, '%Y-%m'), 'unknown') AS period, verdict, count(*) AS n FROM judged WHERE verdict <> 'valid' GROUP BY 1, 2, 3, 4""",
    "files_scan_filter": f"""
        SELECT s.path, l.lang AS detected FROM (SELECT DISTINCT * FROM scanned_files) s LEFT JOIN {_LANGS} ON l.ext = lower(regexp_replace(s.extension, '^\\.', ''))
        WHERE NOT regexp_matches(replace(relativepath, '\\', '/'), '(^|/)(node_modules|\\.git|dist|build|__pycache__|\\.venv|venv|\\.next|\\.nuxt|coverage|\\.nyc_output|\\.index)/')
          AND NOT regexp_matches(replace(relativepath, '\\', '/'), '(^|/)(node_modules|\\.git|dist|build|__pycache__|\\.venv|venv|\\.env|\\.env\\.local|\\.next|\\.nuxt|coverage|\\.nyc_output|[^/]*\\.lock|package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml)(/|$)')
          AND coalesce(lower(regexp_replace(s.extension, '^\\.', '')), '') NOT IN {_BIN} AND coalesce(size_bytes, 0) <= 1048576""",
    "language_detect": f"""
        SELECT coalesce(l.lang, '') AS detected, coalesce(lower(regexp_replace(s.extension, '^\\.', '')) IN {_BIN}, FALSE) AS is_binary, count(*) AS n
        FROM (SELECT DISTINCT * FROM scanned_files) s LEFT JOIN {_LANGS} ON l.ext = lower(regexp_replace(s.extension, '^\\.', '')) GROUP BY 1, 2""",
    "languages_supported": f"SELECT lang AS language, count(*) AS extensions FROM {_LANGS} GROUP BY 1",
    "content_hash": "SELECT DISTINCT doc_id, sha256(text) AS hash FROM documents",
    "chunk_tokens": "SELECT id, (length(content) + 3) // 4 AS tokens, (length(content) + 3) // 4 > 2000 AS oversized, length(substr(content, 1, 400))::INT AS kept FROM (SELECT DISTINCT id, content FROM code_chunks) WHERE content IS NOT NULL",
    "chunk_signature": """
        SELECT id, substr(trim(string_split(content, chr(10))[1]), 1, 120) AS sig, filepath || ':' || startline::VARCHAR || '-' || endline::VARCHAR AS made, filepath || '#x' AS sym
        FROM (SELECT DISTINCT id, content, filepath, startline, endline FROM code_chunks)""",
    "chunk_lines": "SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS lines FROM (SELECT DISTINCT id, content FROM code_chunks)",
    "chunk_whole_file": """
        SELECT doc_id::VARCHAR || ':1-' || len(string_split(text, chr(10)))::VARCHAR AS id, substr(trim(string_split(text, chr(10))[1]), 1, 120) AS signature, len(string_split(text, chr(10)))::INT AS endline
        FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL""",
    "file_names": """
        SELECT path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.]\\.([^.]*)$', 1)) AS ext, regexp_matches(regexp_extract(path, '[^/]*$'), '^[^/]*\\.ts$') AS is_ts,
            regexp_matches(path, '^/srv/.+/src/[^/]*/[^/]*\\.go$') AS is_go
        FROM (SELECT DISTINCT * FROM scanned_files)""",
    "canonical_paths": f"SELECT id, {_canon('callee_file')} AS path FROM (SELECT DISTINCT id, callee_file FROM call_edges)",
    "embedding_placeholder": """
        WITH h AS (SELECT doc_id, sha256(text) AS h FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
        b AS (SELECT doc_id, list_transform(range(32), lambda i: (('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) / 127.5::DOUBLE - 1.0) AS b FROM h),
        v AS (SELECT doc_id, b, sqrt(12 * list_sum(list_transform(b, lambda x: x * x))) AS norm FROM b)
        SELECT doc_id, round(b[1] / norm, 6) AS first, round(b[32] / norm, 6) AS last, 384::INT AS dim FROM v""",
    "naive_tokenize": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')[1:512] AS ws FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
        u AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
        x AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 65535) % 30522 AS id FROM u)
        SELECT w.doc_id, count(x.id) AS n, coalesce(sum(x.id), 0)::BIGINT AS total, coalesce(max(x.id), 0)::BIGINT AS most FROM w LEFT JOIN x USING (doc_id) GROUP BY 1""",
    "files_latest": f"WITH {_LATEST} SELECT path, hash, last_indexed, coalesce(chunk_count, 0)::BIGINT AS chunk_count, language FROM latest",
    "change_classify": f"""
        WITH {_LATEST}, first AS (SELECT path, hash, last_indexed FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed, hash) AS rn FROM (SELECT DISTINCT * FROM files)) WHERE rn = 1)
        SELECT l.path, l.hash AS new_hash, CASE WHEN f.hash IS NULL THEN 'new' WHEN l.mtime <= f.last_indexed THEN 'skipped_mtime' WHEN l.hash = f.hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM latest l LEFT JOIN first f USING (path)""",
    "change_summary": f"""
        WITH {_LATEST}, first AS (SELECT path, hash, last_indexed FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_indexed, hash) AS rn FROM (SELECT DISTINCT * FROM files)) WHERE rn = 1),
        s AS (SELECT CASE WHEN f.hash IS NULL THEN 'new' WHEN l.mtime <= f.last_indexed THEN 'skipped_mtime' WHEN l.hash = f.hash THEN 'unchanged' ELSE 'changed' END AS status FROM latest l LEFT JOIN first f USING (path))
        SELECT count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (status = 'skipped_mtime') AS skipped_mtime, count(*) FILTER (status = 'unchanged') AS skipped_hash FROM s""",
    "stale_files": f"""
        WITH {_LATEST}, {_EVENTS}, there AS (SELECT {_canon('path')} AS path FROM scanned_files WHERE path IS NOT NULL EXCEPT SELECT path FROM ev WHERE change_type = 'deleted')
        SELECT {_canon('path')} AS path FROM latest WHERE {_canon('path')} NOT IN (SELECT path FROM there)""",
    "changed_or_new": f"""
        WITH {_LATEST}, {_EVENTS} SELECT path FROM (SELECT DISTINCT path FROM scanned_files) s
        WHERE path IN (SELECT path FROM ev WHERE change_type <> 'deleted') OR path NOT IN (SELECT path FROM latest WHERE hash IS NOT NULL)""",
    "last_event_wins": f"WITH {_EVENTS} SELECT path, change_type, epoch_us(changed_at) AS at FROM ev",
    "upsert_files": f"""
        WITH {_LATEST}, {_EVENTS}, new AS (SELECT path FROM ev WHERE change_type <> 'deleted')
        SELECT path, hash, last_indexed FROM latest WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, sha256(path), {q.NOW_MS} FROM new""",
    "remove_files": f"WITH {_LATEST}, {_EVENTS} SELECT path, hash FROM latest WHERE path NOT IN (SELECT path FROM ev WHERE change_type = 'deleted')",
    "index_stats": f"WITH {_LATEST} SELECT count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, min(last_indexed) AS oldest, max(last_indexed) AS newest FROM latest",
    "stats_by_language": f"WITH {_LATEST} SELECT lower(language) AS language, count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM latest GROUP BY 1",
    "index_staleness": f"WITH {_LATEST} SELECT max(last_indexed) AS newest, {q.NOW_MS} - max(last_indexed) AS age_ms, coalesce({q.NOW_MS} - max(last_indexed) > 3600000, FALSE) AS stale FROM latest",
    "files_as_json": f"WITH {_LATEST} SELECT to_json({{'path': path, 'language': language, 'hash': hash}})::VARCHAR AS json FROM latest",
    "callers": "SELECT caller_file, caller_symbol, caller_line FROM (SELECT DISTINCT caller_file, caller_symbol, caller_line, callee_name, callee_file FROM call_edges) WHERE callee_name = 'reportMetric' ORDER BY caller_file, caller_line, caller_symbol LIMIT 50",
    "callees": """
        SELECT caller_symbol, caller_line, callee_name FROM (SELECT DISTINCT caller_file, caller_symbol, caller_line, callee_name, callee_file FROM call_edges)
        WHERE caller_file = (SELECT min(caller_file) FROM call_edges) ORDER BY caller_symbol, caller_line, callee_name LIMIT 50""",
    "call_edges_dedup": "SELECT caller_file, caller_symbol, callee_name, min(caller_line) AS caller_line FROM call_edges WHERE callee_name IS NOT NULL AND callee_name NOT IN ("
    + ", ".join(f"'{x}'" for x in q.calls.CALL_NOISE)
    + ") GROUP BY 1, 2, 3",
    "enclosing_symbol": f"""
        WITH {_CALLS}, {_SYMBOLS}, c AS (SELECT id AS call_id, {_canon('caller_file')} AS file, caller_line AS line FROM calls),
        hit AS (SELECT c.call_id, s.name, row_number() OVER (PARTITION BY c.call_id ORDER BY s.start_line DESC, coalesce(s.end_line, s.start_line), s.name DESC) AS rn
            FROM c JOIN symbols s ON s.file_path = c.file AND c.line BETWEEN s.start_line AND coalesce(s.end_line, s.start_line) WHERE s.kind IN ('function', 'method'))
        SELECT c.call_id, coalesce(h.name, '<module>') AS caller_symbol FROM c LEFT JOIN hit h ON h.call_id = c.call_id AND h.rn = 1""",
    "callee_resolve": f"""
        WITH {_CALLS}, {_SYMBOLS}, one AS (SELECT name, min(file_path) AS file FROM symbols GROUP BY 1 HAVING count(DISTINCT file_path) = 1)
        SELECT c.id, o.file AS callee_file FROM calls c JOIN one o ON o.name = c.callee_name""",
    "symbol_prefix_search": f"""
        WITH {_SYMBOLS} SELECT id, name, kind, visibility FROM symbols WHERE name ILIKE 'load%' ORDER BY CASE WHEN name = 'load' THEN 0 ELSE 1 END, CASE WHEN visibility = 'exported' THEN 0 ELSE 1 END, name, id LIMIT 20""",
    "symbol_search_scored": f"""
        WITH {_SYMBOLS}, top AS (SELECT * FROM symbols WHERE name ILIKE 'load%' ORDER BY CASE WHEN name = 'load' THEN 0 ELSE 1 END, CASE WHEN visibility = 'exported' THEN 0 ELSE 1 END, name, id LIMIT 15)
        SELECT file_path AS filePath, CASE WHEN visibility = 'exported' THEN 'export ' ELSE '' END || kind || ' ' || name || CASE WHEN signature <> name AND signature <> '' THEN chr(10) || signature ELSE '' END AS content,
            CASE WHEN name = 'load' THEN 1.0 ELSE 0.8 END::DOUBLE AS score, name AS chunkName FROM top""",
    "symbols_by_kind": f"WITH {_SYMBOLS} SELECT kind, visibility, count(*) AS n, count(DISTINCT name) AS names FROM symbols GROUP BY 1, 2",
    "import_edges": "SELECT from_file, to_file, from_line AS line, array_to_string(symbols, ',') AS symbols FROM (SELECT DISTINCT from_file, to_file, kind, symbols, from_line FROM dependency_edges) WHERE kind = 'import'",
    "import_resolve": f"""
        WITH e AS (SELECT {_canon('from_file')} AS from_file, {_canon('to_file')} AS target FROM dependency_edges WHERE kind <> 'package'),
        found AS (SELECT DISTINCT from_file, repeat('../', len(string_split(from_file, '/')) - 2) || regexp_replace(substr(target, 2), '\\.[^./]+$', '') AS source_path FROM e WHERE from_file LIKE '/%' AND target LIKE '/%'),
        rel AS (SELECT *, '/' || regexp_replace(source_path, '^(\\.\\./)*', '') AS target FROM found),
        tries AS (SELECT from_file, source_path, i, CASE
            WHEN i = 0 THEN target WHEN i BETWEEN 1 AND 6 THEN target || ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'][i] WHEN i BETWEEN 7 AND 10 THEN target || ['/index.ts', '/index.tsx', '/index.js', '/index.jsx'][i - 6]
            WHEN i IN (11, 12) AND target LIKE '%.js' THEN regexp_replace(target, '\\.js$', '') || ['.ts', '.tsx'][i - 10] WHEN i >= 13 THEN target || ['.py', '/__init__.py'][i - 12] END AS cand
            FROM rel, unnest(range(15)) AS r(i))
        SELECT from_file, source_path, arg_min(cand, i) AS to_file FROM tries JOIN (SELECT DISTINCT path FROM scanned_files) s ON s.path = cand GROUP BY 1, 2""",
    "tag_graph_edges": f"""
        WITH {_CALLS}, {_SYMBOLS}, defs AS (SELECT name, file_path AS dst FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start_line DESC, file_path DESC) AS rn FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1)
        SELECT DISTINCT c.caller_file AS src, d.dst FROM calls c JOIN defs d ON d.name = c.callee_name WHERE c.caller_file <> d.dst""",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "graph_degrees": f"""
        WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1)
        SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM o FULL JOIN i ON o.node = i.node""",
    "dependencies_depth2": f"""
        WITH {_EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges)
        SELECT a.src, a.dst AS dep, b.dst AS transitive FROM k a JOIN k b ON b.src = a.dst WHERE a.k <= 10 AND b.k <= 5""",
    "pagerank": f"WITH {_EDGES}, {_pagerank()} SELECT node, round(score, 9) AS score FROM s20",
    "ranked_files": f"WITH {_EDGES}, {_pagerank()} SELECT node, round(score, 9) AS score FROM s20 ORDER BY round(s20.score, 12) DESC, node LIMIT 20",
    "repo_map_budget": f"""
        WITH {_EDGES}, {_SYMBOLS}, {_NAMES}, {_pagerank()},
        top AS (SELECT node AS path, score FROM s20 ORDER BY round(score, 12) DESC, node LIMIT 200),
        named AS (SELECT t.path, t.score, coalesce(array_to_string(n.definitions, ','), '') AS symbols, coalesce(array_to_string(n.definitions, ' '), '') AS spaced FROM top t LEFT JOIN names n ON n.file = t.path),
        packed AS (SELECT *, sum((length(path || ' ' || spaced) + 3) // 4) OVER (ORDER BY round(score, 12) DESC, path ROWS UNBOUNDED PRECEDING) AS used FROM named)
        SELECT p.path, round(p.score, 9) AS rank, p.symbols, (SELECT count(*) FROM edges e WHERE e.src = p.path)::INT AS n_out, (SELECT count(*) FROM edges e WHERE e.dst = p.path)::INT AS n_in FROM packed p WHERE used <= 2048""",
    "structural_search": f"""
        WITH {_EDGES}, {_SYMBOLS}, {_NAMES}, {_pagerank()},
        pool AS (SELECT node AS path, score FROM s20 ORDER BY round(score, 12) DESC, node LIMIT 30),
        r AS (SELECT p.path, p.score + CASE WHEN contains(lower(p.path), 'search') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce(array_to_string(n.definitions, ' '), '')), 'search') THEN 0.2 ELSE 0 END
            + CASE WHEN contains(lower(p.path), 'load') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce(array_to_string(n.definitions, ' '), '')), 'load') THEN 0.2 ELSE 0 END AS rank FROM pool p LEFT JOIN names n ON n.file = p.path)
        SELECT path AS filePath, round(rank / greatest((SELECT max(rank) FROM r), 1.0), 6) AS score, regexp_extract(path, '[^/]*$') AS chunkName FROM r ORDER BY round(rank, 12) DESC, path LIMIT 10""",
    "keyword_lines": """
        WITH l AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS filePath, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
        x AS (SELECT filePath, i AS line, regexp_replace(ls[i], '\\s+$', '') AS text FROM l, unnest(range(1, len(ls) + 1)) AS r(i)),
        k AS (SELECT *, row_number() OVER (PARTITION BY filePath ORDER BY line) AS rn FROM x WHERE regexp_matches(text, 'returned \\d+ chunks'))
        SELECT filePath, line::INT AS line, text FROM k WHERE rn <= 5""",
    "keyword_search": """
        WITH l AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS filePath, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
        x AS (SELECT filePath, i AS line, regexp_replace(ls[i], '\\s+$', '') AS text FROM l, unnest(range(1, len(ls) + 1)) AS r(i)),
        k AS (SELECT *, row_number() OVER (PARTITION BY filePath ORDER BY line) AS rn FROM x WHERE regexp_matches(text, 'Steps|TODO')),
        g AS (SELECT filePath, string_agg(line::VARCHAR || ': ' || text, chr(10) ORDER BY line) AS content, min(line)::INT AS startLine, max(line)::INT AS endLine FROM k WHERE rn <= 5 GROUP BY 1 ORDER BY 1 LIMIT 10)
        SELECT filePath, content, round(greatest(0.1, 1.0 - 0.05 * (row_number() OVER (ORDER BY filePath) - 1)), 6)::DOUBLE AS score, startLine, endLine FROM g""",
    "semantic_topk": """
        WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0),
        d AS (SELECT vec_id, list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM e, q ORDER BY round(list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), vec_id LIMIT 10)
        SELECT vec_id, round(distance, 6) AS distance, round(1.0 - distance / greatest((SELECT max(distance) FROM d), 1.0), 6) AS score FROM d""",
    "semantic_postfilter": f"""
        WITH {_USABLE}, q AS (SELECT list_transform(vector, lambda x: x::DOUBLE) AS qv FROM usable WHERE list_bool_or(list_transform(vector, lambda x: x <> 0)) ORDER BY id LIMIT 1),
        a AS (SELECT id, filepath, startline, endline, list_sum(list_transform(list_zip(list_transform(vector, lambda x: x::DOUBLE), qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM usable, q),
        near AS (SELECT * FROM a ORDER BY round(distance, 9), id LIMIT 20), kept AS (SELECT * FROM near WHERE regexp_matches(regexp_extract(filepath, '[^/]*$'), '^[^/]*\\.py$'))
        SELECT filepath AS filePath, startline AS startLine, endline AS endLine, round(1.0 - distance / greatest((SELECT max(distance) FROM kept), 1.0), 5) AS score FROM kept ORDER BY round(distance, 9), id LIMIT 10""",
    "hybrid_search": f"""
        WITH RECURSIVE {_EDGES}, {_SYMBOLS}, {_NAMES}, {_pagerank()}, {_USABLE},
        q AS (SELECT list_transform(vector, lambda x: x::DOUBLE) AS qv FROM usable WHERE list_bool_or(list_transform(vector, lambda x: x <> 0)) ORDER BY id LIMIT 1),
        near AS (SELECT usable.*, list_sum(list_transform(list_zip(list_transform(vector, lambda x: x::DOUBLE), qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM usable, q
            ORDER BY round(list_sum(list_transform(list_zip(list_transform(vector, lambda x: x::DOUBLE), qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), id LIMIT 10),
        se AS (SELECT filepath AS "filePath", content, 1.0 - distance / greatest((SELECT max(distance) FROM near), 1.0) AS score, startline AS "startLine", endline AS "endLine", chunkname AS "chunkName", chunktype AS "chunkType", language, 'semantic' AS source FROM near),
        texts AS (SELECT filepath AS "filePath", content FROM (SELECT DISTINCT * FROM chunks) WHERE content IS NOT NULL), {_keyword('texts', 'return', 10)}, {_symbol('load', 10)},
        pool AS (SELECT node AS path, score FROM s20 ORDER BY round(score, 12) DESC, node LIMIT 30),
        ranked AS (SELECT p.path, n.definitions, p.score + """
    + " + ".join(f"CASE WHEN contains(lower(p.path), '{w}') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce(array_to_string(n.definitions, ' '), '')), '{w}') THEN 0.2 ELSE 0 END" for w in ("load", "search"))
    + f""" AS rank FROM pool p LEFT JOIN names n ON n.file = p.path),
        st AS (SELECT path AS "filePath", '// ' || path || coalesce(array_to_string(list_transform(definitions, lambda x: chr(10) || '- ' || x), ''), '') AS content, rank / greatest((SELECT max(rank) FROM ranked), 1.0) AS score,
            1 AS "startLine", 1 AS "endLine", regexp_extract(path, '[^/]*$') AS "chunkName", 'module' AS "chunkType", NULL::VARCHAR AS language, 'structural' AS source FROM ranked ORDER BY round(rank, 12) DESC, path LIMIT 10),
        {_union('se', 'kw', 'st', 'sy')},
        c AS (SELECT *, row_number() OVER (PARTITION BY "filePath" ORDER BY round(score, 12) DESC, seq, pos) AS k FROM u),
        fold AS (SELECT "filePath", k, [struct_pack(a := "startLine", b := "endLine")] AS kept, TRUE AS taken FROM c WHERE k = 1
            UNION ALL SELECT f."filePath", f.k, CASE WHEN hit THEN kept ELSE list_append(kept, struct_pack(a := lo, b := hi)) END, NOT hit FROM (
                SELECT c."filePath", c.k, f.kept, c."startLine" AS lo, c."endLine" AS hi,
                    len(list_filter(f.kept, lambda x: least(x.b, c."endLine") - greatest(x.a, c."startLine") + 1 > 0 AND (least(x.b, c."endLine") - greatest(x.a, c."startLine") + 1) / (least(x.b - x.a, c."endLine" - c."startLine") + 1) > 0.5)) > 0 AS hit
                FROM fold f JOIN c ON c."filePath" = f."filePath" AND c.k = f.k + 1) f)
        SELECT {_RESULT.replace('score', 'round(score, 6) AS score')} FROM (SELECT c.* FROM c JOIN fold f ON f."filePath" = c."filePath" AND f.k = c.k WHERE f.taken ORDER BY round(c.score, 12) DESC, c.seq, c.pos LIMIT 10)""",
    "source_weights_union": f"WITH {_SYMBOLS}, {_symbol('load', 10)}, {_PAGES}, {_keyword('pages', 'TODO', 10)}, {_union('kw', 'sy')} SELECT \"filePath\", \"startLine\", round(score, 6) AS score, seq FROM u",
    "track_merge": f"""
        WITH {_PAGES}, {_keyword('pages', 'returned', 20)}, both_ AS (SELECT "filePath", content, score FROM kw UNION ALL (SELECT "filePath", content, 0.8 FROM pages WHERE contains(content, 'TODO') ORDER BY 1 LIMIT 20)),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "filePath" ORDER BY length(content) DESC, score DESC, content DESC) AS rn FROM both_) WHERE rn = 1),
        packed AS (SELECT *, sum((length(content) + 3) // 4) OVER (ORDER BY round(score, 12) DESC, "filePath" ROWS UNBOUNDED PRECEDING) AS used FROM best)
        SELECT "filePath", round(score, 6) AS score, length(content)::INT AS chars FROM packed WHERE used <= 4000""",
    "expand_context": f"""
        WITH RECURSIVE {_CALLS}, {_SYMBOLS}, {_symbol('joinPlatform', 10)}, results AS (SELECT *, row_number() OVER (ORDER BY score DESC, "filePath", "startLine") AS pos FROM sy), best AS (SELECT pos, "filePath", "chunkName" FROM results WHERE pos <= 3),
        d1 AS (SELECT * FROM (SELECT b.pos, c.callee_file, c.callee_name, row_number() OVER (PARTITION BY b.pos ORDER BY c.caller_line, c.callee_name) AS k FROM best b JOIN calls c ON c.caller_file = b."filePath" AND c.caller_symbol = b."chunkName") WHERE k <= 10),
        d2 AS (SELECT * FROM (SELECT d.pos, 0 AS phase, d.k, s.file_path AS "filePath", s.signature AS content, s.start_line AS "startLine", s.end_line AS "endLine", s.name AS "chunkName", s.kind AS "chunkType", s.language,
            row_number() OVER (PARTITION BY d.pos, d.k ORDER BY s.start_line, s.name) AS r FROM d1 d JOIN symbols s ON s.file_path = d.callee_file AND s.name = d.callee_name) WHERE r = 1),
        up AS (SELECT * FROM (SELECT b.pos, 1 AS phase, row_number() OVER (PARTITION BY b.pos ORDER BY c.caller_file, c.caller_line, c.caller_symbol) AS k, c.caller_file AS "filePath", c.caller_symbol || ' calls ' || c.callee_name || ' (line ' || c.caller_line || ')' AS content,
            c.caller_line AS "startLine", c.caller_line AS "endLine", c.caller_symbol AS "chunkName", NULL::VARCHAR AS "chunkType", NULL::VARCHAR AS language FROM best b JOIN calls c ON c.callee_name = b."chunkName") WHERE k <= 5),
        cand AS (SELECT *, (length(content) + 3) // 4 AS tokens, "filePath" || ':' || "startLine" AS place, pos || '/' || phase AS list, row_number() OVER (ORDER BY pos, phase, k) AS n FROM (SELECT * EXCLUDE (r) FROM d2 UNION ALL SELECT * FROM up)),
        fold AS (SELECT 0::BIGINT AS n, (SELECT coalesce(sum((length(content) + 3) // 4), 0)::BIGINT FROM results) AS used, (SELECT list(DISTINCT "filePath" || ':' || "startLine") FROM results) AS seen, []::VARCHAR[] AS closed, FALSE AS taken
            UNION ALL SELECT n, CASE WHEN fits THEN used + tokens ELSE used END, CASE WHEN fits THEN list_append(seen, place) ELSE seen END, CASE WHEN skip OR fits THEN closed ELSE list_append(closed, list) END, fits FROM (
                SELECT *, NOT skip AND used + tokens <= 4000 AS fits FROM (SELECT c.n, c.tokens, c.place, c.list, f.used, f.seen, f.closed, f.used >= 4000 OR list_contains(f.closed, c.list) OR list_contains(f.seen, c.place) AS skip FROM fold f JOIN cand c ON c.n = f.n + 1)))
        SELECT {_RESULT}, pos FROM results UNION ALL
        SELECT "filePath", content, 0.5, "startLine", "endLine", "chunkName", "chunkType", language, 'structural', (1000000 + row_number() OVER (ORDER BY n)) FROM cand WHERE n IN (SELECT n FROM fold WHERE taken)""",
    "quality_gate": """
        WITH s AS (SELECT DISTINCT d.doc_id, d.repo, least(coalesce(length(d.text), 0) / 5000.0::DOUBLE, 1.0) AS score FROM documents d), m AS (SELECT repo, max(score) AS best FROM s GROUP BY 1)
        SELECT doc_id, round(score, 6) AS score, best >= 0.5 AS passed FROM s JOIN m USING (repo) WHERE score >= 0.5 OR (score >= 0.3 AND best >= 0.5)""",
    "recent_changes": f"""
        SELECT change_id, path, change_type FROM (SELECT DISTINCT * FROM file_changes) WHERE changed_at >= make_timestamp({q.NOW_MS} * 1000) - INTERVAL 60 DAY ORDER BY changed_at DESC, change_id LIMIT 20""",
    "debounce_batches": """
        WITH e AS (SELECT DISTINCT event_id, ts, user_id FROM events), m AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 600000000 THEN 1 ELSE 0 END AS new FROM e),
        n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM m)
        SELECT user_id, batch, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM n GROUP BY 1, 2""",
    "task_detect": f"""
        WITH {_NORMAL}, {_SCORED}, {_TASKED}
        SELECT doc_id, task, CASE WHEN regexp_matches(lower(t), '{_bounded('|'.join(prompts.DEEP))}') THEN 'deep' WHEN regexp_matches(lower(t), '{_bounded('|'.join(prompts.LIGHT))}') THEN 'light'
            WHEN task = 'research' AND length(t) <= 200 THEN 'light' ELSE 'standard' END AS intensity FROM tasked""",
    "prompt_subject": f"WITH {_NORMAL}, {_SCORED}, {_TASKED} SELECT doc_id, {_SUBJECT} AS subject, {_SUBJECT} <> t AS stripped FROM tasked",
    "budget_allocation": "SELECT task, tool, floor(2048 * weight + 1e-9)::BIGINT AS tokens FROM (VALUES "
    + ", ".join(f"('{t}', '{tool}', {w}::DOUBLE)" for t, ws in prompts.TOOL_WEIGHTS.items() for tool, w in ws.items())
    + ") AS b(task, tool, weight)",
    "tag_set_difference": """
        WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, text, regexp_extract_all(text, '<(\\w+)>', 1) AS tags FROM t)
        SELECT doc_id, array_to_string(list_sort(list_filter(['html', 'body', 'insert', 'owner'], lambda x: NOT list_contains(tags, x))), ',') AS missing, length(trim(text)) > 100 AND list_contains(tags, 'html') AS valid FROM g""",
    "import_decoration": """
        WITH e AS (SELECT DISTINCT from_file, to_file, symbols, from_line FROM dependency_edges WHERE kind <> 'package' AND from_file IS NOT NULL AND to_file IS NOT NULL),
        l AS (SELECT from_file AS src, to_file AS dst, coalesce(symbols, []) AS s, row_number() OVER (PARTITION BY from_file, to_file ORDER BY coalesce(from_line, -1) DESC, array_to_string(coalesce(symbols, []), ',') DESC) AS rn FROM e)
        SELECT src, dst, CASE WHEN len(s) = 0 OR s[1] = '*' THEN '' ELSE array_to_string(s[1:5], ', ') || CASE WHEN len(s) > 5 THEN ', ...' ELSE '' END END AS names FROM l WHERE rn = 1""",
    "file_detail": f"""
        WITH {_EDGES}, {_SYMBOLS}, f AS (SELECT DISTINCT {_canon('path')} AS path FROM scanned_files), s AS (SELECT file_path AS path, count(*) AS n FROM symbols GROUP BY 1),
        i AS (SELECT src AS path, count(*) AS n FROM edges GROUP BY 1), d AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY 1)
        SELECT f.path, coalesce(s.n, 0) AS symbols, coalesce(i.n, 0) AS imports, coalesce(d.n, 0) AS dependents FROM f LEFT JOIN s USING (path) LEFT JOIN i USING (path) LEFT JOIN d USING (path)""",
    "prompt_sections": f"""
        WITH {_NORMAL}, {_SCORED}, {_TASKED}, lev AS (SELECT doc_id, t, task, {_SUBJECT} AS subject, CASE WHEN regexp_matches(lower(t), '{_bounded('|'.join(prompts.DEEP))}') THEN 'deep' WHEN regexp_matches(lower(t), '{_bounded('|'.join(prompts.LIGHT))}') THEN 'light'
            WHEN task = 'research' AND length(t) <= 200 THEN 'light' ELSE 'standard' END AS level FROM tasked),
        body AS (SELECT doc_id, CASE WHEN t <> '' THEN {_composed()} END AS body FROM lev)
        SELECT doc_id, sha256(body) AS hash, length(body)::INT AS chars FROM body""",
    "usage_patterns": """
        WITH b AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM (SELECT DISTINCT path FROM scanned_files WHERE path IS NOT NULL)),
        x AS (SELECT path, lower(regexp_extract(base, '[^.]\\.([^.]*)$', 1)) AS ext, CASE WHEN regexp_matches(base, '[^.]\\.[^.]*$') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS stem FROM b)
        SELECT path, stem AS name, stem AS pattern, CASE WHEN ext IN ('vue', 'tsx', 'jsx', 'svelte') THEN '*.{vue,tsx,jsx,svelte}' ELSE '*.' || ext END AS glob, 'import.*' || stem AS import_pattern,
            CASE WHEN ext IN ('vue', 'tsx', 'jsx', 'svelte') THEN '*.{vue,tsx,jsx,ts,js}' ELSE '*.' || ext END AS import_glob, 'from.*' || stem || '|import.*' || stem AS dependency_pattern FROM x""",
    "name_functions": """
        WITH s AS (SELECT DISTINCT path, '..' || regexp_replace(path, '[^A-Za-z0-9]+', '.', 'g') AS dotted FROM scanned_files WHERE path IS NOT NULL),
        m AS (SELECT *, regexp_extract(dotted, '^(\\.*)', 1) AS dots, replace(regexp_replace(dotted, '^\\.+', ''), '.', '/') AS rest FROM s)
        SELECT path, path AS bare, CASE WHEN length(dots) = 0 THEN rest WHEN length(dots) = 1 THEN './' || rest ELSE repeat('../', length(dots) - 1) || rest END AS module, trim(path) AS annotation, 'A.' || regexp_extract(path, '[^/]*$') AS qualified,
            least(2000, 61 * length(path) + 1)::INT AS embedded, starts_with(path, './') OR starts_with(path, '../') OR starts_with(path, '/') AS relative FROM m""",
    "indexed_times": f"WITH {_LATEST} SELECT path, strftime(make_timestamp(last_indexed * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM latest",
    "file_outlines": f"WITH {_SYMBOLS}, {_NAMES} SELECT file, '// ' || file || array_to_string(list_transform(definitions, lambda x: chr(10) || '- ' || x), '') AS outline FROM names WHERE file IS NOT NULL",
    "file_definitions": f"""
        WITH {_SYMBOLS}, t AS (SELECT DISTINCT name, file_path AS file, start_line AS seq FROM symbols WHERE file_path IS NOT NULL)
        SELECT file, string_agg(name, ',' ORDER BY seq, name) AS definitions FROM t GROUP BY 1""",
    "search_text": f"""
        WITH {_SYMBOLS}, {_symbol('joinPlatform', 10)}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, "filePath", "startLine") AS pos FROM sy)
        SELECT CASE WHEN count(*) = 0 THEN 'No results found.' ELSE 'Results: ' || count(*) || ' found | top score: ' || printf('%.2f', max(score)) || ' | sources: structural' || chr(10) || chr(10)
            || string_agg('[' || pos || '] ' || "filePath" || ' (lines ' || "startLine" || '-' || "endLine" || ', score: ' || printf('%.2f', score) || ', source: ' || source || ')' || chr(10) || '    ' || replace(substr(content, 1, 300), chr(10), chr(10) || '    '), chr(10) || chr(10) ORDER BY pos) END AS text FROM r""",
    "graph_add_tags": f"""
        WITH {_EDGES}, {_CALLS}, {_SYMBOLS}, defs AS (SELECT name, file_path AS dst FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start_line DESC, file_path DESC) AS rn FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1)
        SELECT src, dst FROM edges UNION SELECT c.caller_file, d.dst FROM calls c JOIN defs d ON d.name = c.callee_name WHERE c.caller_file <> d.dst""",
    "graph_remove_files": f"WITH {_EDGES}, {_EVENTS}, gone AS (SELECT path FROM ev WHERE change_type = 'deleted' AND path IS NOT NULL) SELECT src, dst FROM edges WHERE src NOT IN (SELECT path FROM gone) AND dst NOT IN (SELECT path FROM gone)",
}
