"""Results as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_results(df: DataFrame) -> DataFrame:
    """(text): one row: a header, and a numbered block for each result (with `pos`), its first 300 characters indented."""
    head = F.format_string("[%d] %s (lines %d-%d, score: %.2f, source: %s)", F.col("pos"), "filePath", "startLine", "endLine", "score", "source")
    block = F.concat(head, F.lit("\n    "), F.regexp_replace(F.substring("content", 1, 300), "\n", "\n    "))
    rows = df.agg(
        F.sort_array(F.collect_list(F.struct("pos", block.alias("b"), "source"))).alias("r"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top")
    )
    sources = F.array_join(F.array_distinct(F.transform("r", lambda x: x["source"])), ", ")
    meta = F.format_string("Results: %d found | top score: %.2f | sources: %s", F.col("n"), F.col("top"), sources)
    text = F.concat(meta, F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["b"]), "\n\n"))
    return rows.select(F.when(F.col("n") == 0, "No results found.").otherwise(text).alias("text"))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"\n  {label}: "), F.array_join(values, ", "))).otherwise("")


def repo_map(df: DataFrame) -> DataFrame:
    """(text): a block for each entry of a repository map, best first."""
    block = F.concat(F.format_string("%s (rank: %.4f)", "path", "rank"), _listed("symbols", F.col("symbols")), _listed("imports", F.col("dependencies")), _listed("imported by", F.col("dependents")))
    rows = df.agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("o"), "path", block.alias("b")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["b"]), "\n")
    return rows.select(F.when(F.size("r") == 0, "No entries in repo map.").otherwise(text).alias("text"))


def file_summary(path: Column, symbols: Column, dependencies: Column, dependents: Column) -> Column:
    """`// path`, what it imports and what imports it by base name, and a line for each symbol."""
    base = lambda a: F.array_join(F.transform(a, lambda p: F.substring_index(p, "/", -1)), ", ")
    parts = [
        F.concat(F.lit("// "), path),
        F.when(F.size(dependencies) > 0, F.concat(F.lit("imports: "), base(dependencies))),
        F.when(F.size(dependents) > 0, F.concat(F.lit("used by: "), base(dependents))),
        F.when(F.size(symbols) > 0, F.array_join(F.transform(symbols, lambda s: F.concat(F.lit("- "), s)), "\n")),
    ]
    return F.concat_ws("\n", *parts)


def iso_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def symbols(df: DataFrame) -> DataFrame:
    """(text): one row: a numbered block for each symbol (with `pos`): kind and name, place, signature, and what is known of
    its parameters and result."""
    params = F.array_join(F.transform("parameters", lambda p: F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"])), ", ")
    place = F.concat(F.lit("    file: "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    block = F.concat_ws(
        "\n",
        F.concat(F.format_string("[%d] ", "pos"), F.when(F.col("visibility") == "exported", "export ").otherwise(""), "kind", F.lit(" "), "qualified_name"),
        place,
        F.concat(F.lit("    signature: "), F.coalesce("signature", F.lit(""))),
        F.when(F.size(F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string,defaultValue:string>>"))) > 0, F.concat(F.lit("    params: "), params)),
        F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit("    returns: "), "return_type")),
    )
    rows = df.agg(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))).alias("r"))
    return rows.select(F.when(F.size("r") == 0, "No symbols found.").otherwise(F.array_join(F.transform("r", lambda x: x["b"]), "\n\n")).alias("text"))


def _names(names: Sequence[str] | None, most: int = 5) -> str:
    if not names or names[0] == "*":
        return ""
    return "  { " + ", ".join(names[:most]) + (", ..." if len(names) > most else "") + " }"


def dependencies(path: str, found: Mapping, names: Mapping[str, Sequence[str]]) -> str:
    """What a file imports, with the names that it brings in, what imports it, and the next level if it was asked for."""
    out = [f"Dependencies for: {path}", ""]
    out += ["Imports (direct):", *(f"  -> {d}{_names(names.get(d))}" for d in found["imports"])] if found["imports"] else ["Imports: (none found)"]
    out += ["", *(["Imported by:", *(f"  <- {d}" for d in found["imported_by"])] if found["imported_by"] else ["Imported by: (none found)"])]
    if found["transitive"]:
        out += ["", "Transitive imports (depth 2):"]
        for d, further in found["transitive"].items():
            out += [f"  {d} imports:", *(f"    -> {t}" for t in further)]
    return "\n".join(out)


def call_graph(symbol: str, direction: str, state: str, rows: Sequence, file: str | None = None) -> str:
    """Callers or callees as text, or why there are none."""
    if state == "missing":
        return f'No symbol "{symbol}" found in the index.'
    if state == "ambiguous":
        return "\n".join([f'Symbol "{symbol}" is defined in {len(rows)} places:', *(f"  {r['file_path']}:{r['start_line']}" for r in rows)])
    if direction == "callers":
        head = f'Callers of "{symbol}" ({len(rows)} found):'
        lines = [f"  {r['caller_symbol']}\n    in: {r['caller_file']}:{r['caller_line']}" for r in rows]
    else:
        head = f'Callees of "{symbol}" in {file} ({len(rows)} found):'
        lines = [f"  -> {r['callee_name']}  (line {r['caller_line']})" for r in rows]
    return "\n".join([head, "", *lines]) if rows else f'No recorded {direction} for "{symbol}"' + (f" in {file}." if file else ".")


def status(values: Mapping) -> str:
    """The state of an index, a line a value."""
    yes = lambda v: "yes" if v else "no"
    rows = {
        "Has index": yes(values["files"]), "Data path": values["index_dir"], "Last indexed": values["newest_text"] or "never", "Stale (>1h)": yes(values["stale"]), "Files": values["files"],
        "Chunks": values["chunks"], "Vectors": values["vectors"], "Graph nodes": values["graph_nodes"], "Graph edges": values["graph_edges"],
    }
    return "\n".join(["Index status:", *(f"  {k:<13}: {v}" for k, v in rows.items())])


def commits(rows: Sequence, since: str, limit: int) -> str:
    """Commits as a table, with the number of lines that each adds and takes away."""
    out = [f"Recent commits (since {since}, max {limit}):", ""]
    if not rows:
        return "\n".join([*out, "(no commits found)"])
    return "\n".join([*out, "| Hash | Message | Files | + | - |", "|------|---------|-------|---|---|", *(f"| {r['hash'][:9]} | {r['message']} | {r['files']} | {r['insertions']} | {r['deletions']} |" for r in rows)])


#: Guided requests, by name, with {x} for their one parameter.
GUIDES = {
    "explore": "Get to know this code base.\n1. Ask `index_status` whether the index is current.\n2. Ask `get_repo_map`{x} for the files that matter.\n3. Ask `get_file_summary` for the first three of them.\n4. Ask `get_dependencies` for the one that starts it all.\n5. Say what the code does, of which parts it is made, and how they fit together.",
    "find": "Find where {x} is implemented.\n1. Ask `search_codebase` for it, with `expand`.\n2. Ask `search_symbols` for names that come up.\n3. Read the files found and say where it begins, what does the work, and what calls it.",
    "analyse": "Say what depends on {x}.\n1. Ask `get_dependencies` for it, at depth 2.\n2. Ask `get_call_graph` for its main functions.\n3. Say what a change to it would touch, nearest first.",
    "review": "Review the latest changes ({x}).\n1. Ask `get_recent_changes` for them.\n2. Ask `get_file_summary` for each changed file, and `get_call_graph` for changed functions.\n3. Report what is wrong or risky, gravest first, with places.",
}


def guide(name: str, value: str | None = None) -> str:
    """A guided request; the value is the scope, feature, file or time that it is about."""
    return GUIDES[name].replace("{x}", (f' with scope "{value}"' if value else "") if name == "explore" else value or ("7d" if name == "review" else ""))
