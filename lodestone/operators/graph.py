"""The graph of files: building it from tags or imports, ranking, neighbourhoods and the repository map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import count_tokens
from lodestone.session import materialize, release

DAMPING, ITERATIONS = 0.85, 20


def edges_from_tags(tags: DataFrame) -> DataFrame:
    """Distinct (src, dst) from tags (name, kind 'def' or 'ref', file, seq).

    A reference points to the file of the name's last definition by seq (then file); references to one's own file are
    dropped. The definitions are reduced to one row a name before the join, so a name with very many references is split by
    the join's skew handling and joins one row.
    """
    last = F.max_by("file", F.struct("seq", "file"))
    defs = tags.where("kind = 'def' and name is not null").groupBy("name").agg(last.alias("dst"))
    refs = tags.where("kind = 'ref' and name is not null").select("name", F.col("file").alias("src")).distinct()
    return refs.join(defs, "name").where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def nodes_from_tags(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): files with a definition or with a resolved reference."""
    return tags.where("kind = 'def'").select(F.col("file").alias("node")).union(nodes(edges)).distinct()


def definitions(tags: DataFrame) -> DataFrame:
    """(file, definitions): names in order of seq, duplicates kept."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda s: s["name"])
    return tags.where("kind = 'def'").groupBy("file").agg(names.alias("definitions"))


def add_tags(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges of a batch, resolved among its own definitions, together with those that are there."""
    return edges.select("src", "dst").union(edges_from_tags(batch)).distinct()


def edges_from_imports(imports: DataFrame, src: str = "from_file", dst: str = "to_file") -> DataFrame:
    """Distinct (src, dst) of two known, different files."""
    e = imports.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return e.where("trim(src) != '' and trim(dst) != '' and src != dst").distinct()


def replace_graph(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored edges if there are any, else the current ones."""
    return current.select("src", "dst") if stored.isEmpty() else stored.select("src", "dst").distinct()


def remove_file(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that touch none of files (path), in either direction."""
    gone = files.select(F.col("path").alias("__p")).distinct()
    return edges.join(gone, edges["src"] == gone["__p"], "left_anti").join(gone, edges["dst"] == gone["__p"], "left_anti")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """(nodes, edges) of the graph that distinct edges make."""
    return edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))).select("nodes", "edges")


def pagerank(edges: DataFrame, all_nodes: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS, cut_every: int = 5) -> DataFrame:
    """(node, score) after a fixed number of steps; what a node without out-edges holds isn't handed on.

    Out-degrees are joined to the edges once. A step is one join on the source and one aggregation on the target, in which each
    node's own share takes part; it is pre-aggregated before its shuffle, so a target with a third of all edges is no hot key; every few steps the scores are
    written, so that lineage stays short and a lost executor costs little.
    """
    ns = (all_nodes if all_nodes is not None else nodes(edges)).select("node").distinct()
    n = ns.count()
    if n == 0:
        return ns.withColumn("score", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = materialize(edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("w")), "pagerank-edges")
    ns = materialize(ns, "pagerank-nodes")
    base = (1.0 - damping) / n
    scores = ns.withColumn("score", F.lit(1.0 / n))
    rest = ns.select("node", F.lit(base).alias("part"))
    written = None
    for step in range(1, iterations + 1):
        inflow = weighted.join(scores, weighted["src"] == scores["node"]).select(F.col("dst").alias("node"), (F.col("score") * F.col("w")).alias("part"))
        scores = rest.unionByName(inflow).groupBy("node").agg(F.sum("part").alias("score"))
        if step % cut_every == 0 and step < iterations:
            before, written = written, materialize(scores, "pagerank")
            scores = written
            if before is not None:
                release(before)
    return scores


def ranked(scores: DataFrame, top: int = 20) -> DataFrame:
    """The best nodes by score, rounded to 12 places so that sums in another order rank alike; ties by name."""
    return scores.orderBy(F.desc(F.round("score", 12)), "node").limit(top)


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path")).orderBy("path")


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path")).orderBy("path")


def two_hops(edges: DataFrame, first: int = 10, second: int = 5) -> DataFrame:
    """(src, dep, transitive): of each file its first dependencies, and of each of these the first few; not made distinct.

    Both caps are part of the operation, and they bound what a file with very many edges sends into the join.
    """
    one = Window.partitionBy("src").orderBy("dst")
    numbered = edges.withColumn("k", F.row_number().over(one))
    direct = numbered.where(F.col("k") <= first).select("src", F.col("dst").alias("dep"))
    onward = numbered.where(F.col("k") <= second).select(F.col("src").alias("dep"), F.col("dst").alias("transitive"))
    return direct.join(onward, "dep").select("src", "dep", "transitive")


def within_budget(df: DataFrame, tokens: Column, budget: int, *order: Column) -> DataFrame:
    """The rows before the first one that no longer fits: tokens are never negative, so that is a running sum.

    The window has one partition: df is a short ranked list, as its callers limit it first.
    """
    running = F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__sum", running).where(F.col("__sum") <= budget).drop("__sum")


def repo_map(scores: DataFrame, edges: DataFrame, symbols: DataFrame, scope: str | None = None, max_tokens: int = 4000, top: int = 200) -> DataFrame:
    """(path, rank, symbols, dependencies, dependents) of the best files, as many as fit into max_tokens.

    symbols: (file, definitions). scope keeps files whose path begins with it or has it after a '/'.
    """
    best = ranked(scores, top).withColumnRenamed("node", "path")
    if scope:
        best = best.where(F.col("path").startswith(scope) | F.col("path").contains("/" + scope.lstrip("./")))
    names = symbols.select(F.col("file").alias("path"), "definitions")
    best = best.join(names, "path", "left").withColumn("symbols", F.coalesce("definitions", F.array().cast("array<string>"))).drop("definitions")
    text = F.concat_ws(" ", "path", F.array_join("symbols", " "))
    text = F.concat("path", F.lit(" "), F.array_join("symbols", " "))
    packed = within_budget(best, count_tokens(text), max_tokens, F.desc(F.round("score", 12)), F.col("path"))
    gather = lambda a, b: edges.join(packed.select(F.col("path").alias(a)), a, "left_semi").groupBy(a).agg(F.sort_array(F.collect_set(b)).alias("x")).withColumnRenamed(a, "path")
    none = F.array().cast("array<string>")
    out = packed.join(gather("src", "dst").withColumnRenamed("x", "dependencies"), "path", "left").join(gather("dst", "src").withColumnRenamed("x", "dependents"), "path", "left")
    return out.select("path", F.col("score").alias("rank"), "symbols", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def decorated_imports(edges: DataFrame, stored: DataFrame, most: int = 5) -> DataFrame:
    """(src, dst, names): each edge with the names that its last stored import brings in, the first few, then `...`.

    stored: (from_file, to_file, symbols, from_line). A whole-module import, whose first name is `*`, shows none.
    """
    last = stored.where("from_file is not null and to_file is not null").groupBy(F.col("from_file").alias("src"), F.col("to_file").alias("dst")).agg(
        F.max_by(F.struct("symbols"), F.struct(F.coalesce("from_line", F.lit(-1)), F.array_join(F.coalesce("symbols", F.array().cast("array<string>")), ","))).alias("s")
    )
    names = F.coalesce(F.col("s.symbols"), F.array().cast("array<string>"))
    shown = F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, ", ...").otherwise(""))
    hidden = (F.size(names) == 0) | (F.try_element_at(names, F.lit(1)) == "*")
    return edges.select("src", "dst").join(last, ["src", "dst"], "left").select("src", "dst", F.when(hidden, "").otherwise(shown).alias("names"))


def file_detail(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbols, imports, dependents): of each file how many. symbols: (file_path). Counted apart, then joined by path."""
    n = F.count(F.lit(1))
    s = symbols.groupBy(F.col("file_path").alias("path")).agg(n.alias("symbols"))
    i = edges.groupBy(F.col("src").alias("path")).agg(n.alias("imports"))
    d = edges.groupBy(F.col("dst").alias("path")).agg(n.alias("dependents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("path").join(s, "path", "left").join(i, "path", "left").join(d, "path", "left").select("path", zero("symbols"), zero("imports"), zero("dependents"))
