"""Search: by meaning, by keyword, by symbol and by structure, and the fusion of their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import glob_match, like_prefix
from lodestone.functions.vectors import cosine_distance, squared_l2
from lodestone.operators.graph import ranked

#: Columns of every strategy's results.
RESULT = ["filePath", "content", "score", "startLine", "endLine", "chunkName", "chunkType", "language", "source"]
# The weight of each source in the fusion; others weigh as structural.
WEIGHTS = {"semantic": 0.5, "keyword": 0.3, "structural": 0.2}
OVERLAP = 0.5


def nearest(df: DataFrame, query: Sequence[float], vector: str = "vector", key: str = "id", k: int = 10, metric: str = "l2") -> DataFrame:
    """df's k rows nearest to the query, with `distance`; ties by key. metric: l2 (squared) or cosine.

    The query is a literal, so this is one narrow pass with a top-k in each task and one over the tasks' bests. Vectors that
    are null, of another length, or not finite are passed over.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    fit = df.where((F.size(vector) == len(query)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    d = squared_l2(F.col(vector), q) if metric == "l2" else cosine_distance(F.col(vector), q)
    return fit.withColumn("distance", d).orderBy(F.round("distance", 9), key).limit(k)


def similarity(df: DataFrame) -> DataFrame:
    """score = 1 - distance / max(distances, 1), over the rows at hand, which are a top-k list."""
    return df.withColumn("score", 1.0 - F.col("distance") / F.greatest(F.max("distance").over(Window.partitionBy()), F.lit(1.0)))


def semantic_search(chunks: DataFrame, query: Sequence[float], limit: int = 10, pattern: str | None = None, metric: str = "l2", prefilter: bool = False) -> DataFrame:
    """The chunks nearest to the query vector.

    With a file pattern twice as many are fetched, filtered, scored over what is left, and then cut, which may give fewer
    than limit; prefilter=True filters before the search instead.
    """
    src = chunks.where(glob_match(F.col("filePath"), pattern)) if pattern and prefilter else chunks
    near = nearest(src, query, k=limit * 2 if pattern and not prefilter else limit, metric=metric)
    if pattern and not prefilter:
        near = near.where(glob_match(F.col("filePath"), pattern))
    return similarity(near).orderBy(F.round("distance", 9), "id").limit(limit).withColumn("source", F.lit("semantic")).select(*RESULT)


def matching_lines(files: DataFrame, query: str, pattern: str | None = None, per_file: int | None = 5, regex: bool = True) -> DataFrame:
    """(filePath, line, text): the lines of files (filePath, content) that match, at most per_file of each file.

    Lines are numbered within their file on the fly; the cap is applied within each file's own row, so nothing is shuffled.
    An invalid expression raises.
    """
    src = files.where(glob_match(F.col("filePath"), pattern)) if pattern else files
    import re as _re

    expr = query if regex else _re.escape(query)
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, r"\s+$", "").alias("text")))
    hits = F.filter(lines, lambda s: s["text"].rlike(expr))
    if per_file is not None:
        hits = F.slice(hits, 1, per_file)
    return src.where(F.col("content").rlike("(?m)" + expr)).select("filePath", F.explode(hits).alias("h")).select("filePath", "h.line", "h.text")


def keyword_search(files: DataFrame, query: str, limit: int = 10, pattern: str | None = None, regex: bool = True) -> DataFrame:
    """One result a file, in order of path: its matching lines. The i-th file, from 0, scores max(0.1, 1 - 0.05 i)."""
    found = matching_lines(files, query, pattern, 5, regex).groupBy("filePath").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("m"))
    top = found.orderBy("filePath").limit(limit)
    i = F.row_number().over(Window.orderBy("filePath")) - 1
    return top.select(
        "filePath",
        F.array_join(F.transform("m", lambda s: F.concat(s["line"].cast("string"), F.lit(": "), s["text"])), "\n").alias("content"),
        F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.05) * i).alias("score"),
        F.col("m")[0]["line"].alias("startLine"),
        F.element_at("m", -1)["line"].alias("endLine"),
        F.substring_index("filePath", "/", -1).alias("chunkName"),
        F.lit("module").alias("chunkType"),
        F.lit(None).cast("string").alias("language"),
        F.lit("keyword").alias("source"),
    )


def find_symbols(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name begins with query: exact ones first, then exported ones, then by name."""
    df = symbols.where(like_prefix(F.col("name"), query))
    if kind:
        df = df.where(F.col("kind") == kind)
    return df.orderBy(F.when(F.col("name") == query, 0).otherwise(1), F.when(F.col("visibility") == "exported", 0).otherwise(1), "name", "id").limit(limit)


def symbol_text() -> Column:
    """`export kind qualified(params): return`, and the signature below it if it says more."""
    params = F.transform("parameters", lambda p: F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"]))
    head = F.concat(
        F.when(F.col("visibility") == "exported", "export ").otherwise(""),
        F.col("kind"),
        F.lit(" "),
        F.col("qualified_name"),
        F.coalesce(F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")")), F.lit("")),
        F.when(F.coalesce(F.col("return_type"), F.lit("")) != "", F.concat(F.lit(": "), F.col("return_type"))).otherwise(""),
    )
    more = F.when((F.col("signature") != F.col("qualified_name")) & (F.col("signature") != ""), F.col("signature"))
    return F.concat_ws("\n", head, more)


def symbol_search(symbols: DataFrame, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """Results for symbols: exact names score 1, prefixes 0.8. A blank query finds nothing."""
    q = query.strip()
    found = find_symbols(symbols, q, kind, limit).where(F.lit(bool(q)))
    score = F.when((F.col("name") == q) | (F.col("qualified_name") == q), 1.0).otherwise(0.8)
    return found.select(
        F.col("file_path").alias("filePath"), symbol_text().alias("content"), score.alias("score"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"),
        F.col("qualified_name").alias("chunkName"), F.col("kind").alias("chunkType"), "language", F.lit("structural").alias("source"),
    )


def outline(path: Column, symbols: Column) -> Column:
    return F.array_join(F.concat(F.array(F.concat(F.lit("// "), path)), F.transform(symbols, lambda s: F.concat(F.lit("- "), s))), "\n")


def boost(query: str, path: Column, symbols: Column) -> Column:
    """0.3 for each term of the query in the path, 0.2 for each in the symbols."""
    total = F.lit(0.0)
    words = F.lower(F.array_join(symbols, " "))
    for term in query.lower().split():
        total = total + F.when(F.lower(path).contains(term), 0.3).otherwise(0.0) + F.when(words.contains(term), 0.2).otherwise(0.0)
    return total


def structural_search(scores: DataFrame, symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Files by rank among the 3 * limit best of the graph, raised by the query's terms. symbols: (file, definitions)."""
    pool = ranked(scores, 3 * limit).withColumnRenamed("node", "filePath")
    pool = pool.join(symbols.withColumnRenamed("file", "filePath"), "filePath", "left").withColumn("definitions", F.coalesce("definitions", F.array().cast("array<string>")))
    rank = F.col("score") + boost(query, F.col("filePath"), F.col("definitions"))
    top = pool.withColumn("rank", rank)
    top = top.withColumn("norm", F.greatest(F.max("rank").over(Window.partitionBy()), F.lit(1.0))).orderBy(F.desc(F.round("rank", 12)), "filePath").limit(limit)
    return top.select(
        "filePath", outline(F.col("filePath"), F.col("definitions")).alias("content"), (F.col("rank") / F.col("norm")).alias("score"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"),
        F.substring_index("filePath", "/", -1).alias("chunkName"), F.lit("module").alias("chunkType"), F.lit(None).cast("string").alias("language"), F.lit("structural").alias("source"),
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two line ranges, ends included, share more than half of the shorter one."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    shorter = F.least(a_end - a_start, b_end - b_start) + 1
    return (shared > 0) & (shared / shorter > OVERLAP)


def union_strategies(*results: DataFrame) -> DataFrame:
    """All results with `seq`, the strategy's number, and `pos`, the place in its own order (score, then path and line)."""
    parts = []
    for i, r in enumerate(results):
        order = Window.orderBy(F.desc(F.round("score", 12)), "filePath", "startLine", "chunkName")
        parts.append(r.select(*RESULT).withColumns({"seq": F.lit(i), "pos": F.row_number().over(order)}))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def weighted(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """score times the weight of its source."""
    w = F.lit(weights["structural"])
    for name, x in weights.items():
        w = F.when(F.col("source") == name, x).otherwise(w)
    return df.withColumn("score", F.col("score") * w)


def merge(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted results without overlapping ones: in each file, from the best down, one is kept if it overlaps none kept.

    df is the union of the strategies' short lists, so a file's candidates are few; they are folded in order within one row.
    """
    w = weighted(df, weights)
    row = F.struct((-F.round("score", 12)).alias("o"), "seq", "pos", *RESULT)
    files = w.groupBy("filePath").agg(F.sort_array(F.collect_list(row)).alias("c"))
    kept_type = files.schema["c"].dataType.simpleString()
    fold = F.aggregate(
        "c",
        F.array().cast(kept_type),
        lambda kept, r: F.when(F.exists(kept, lambda k: overlaps(k["startLine"], k["endLine"], r["startLine"], r["endLine"])), kept).otherwise(F.array_append(kept, r)),
    )
    return files.select(F.explode(fold).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in RESULT], F.col("r.seq").alias("seq"), F.col("r.pos").alias("pos"))


def final_order(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc(F.round("score", 12)), "seq", "pos").limit(limit)


def quality_gate(df: DataFrame, group: str, low: float = 0.3, good: float = 0.5) -> DataFrame:
    """Drops scores below low, and those below good where a group has no good one; with `passed`, whether it has."""
    best = F.max("score").over(Window.partitionBy(group))
    return df.withColumn("passed", best >= good).where((F.col("score") >= good) | (F.col("score") >= low) & F.col("passed"))


def merge_tracks(index: DataFrame, tools: DataFrame, budget: int, tool_score: float = 0.8) -> DataFrame:
    """Results of the index and of plain file tools (filePath, content), one a file, as many of the best as fit into budget.

    Tool results score tool_score. Of several results for a file the more detailed, that is longer, one stays. Both sides are
    short result lists.
    """
    from lodestone.functions.text import count_tokens
    from lodestone.operators.graph import within_budget

    both = index.select("filePath", "content", "score").unionByName(tools.select("filePath", "content", F.lit(tool_score).alias("score")))
    best = both.groupBy("filePath").agg(F.max_by(F.struct("content", "score"), F.struct(F.length("content"), "score", "content")).alias("b")).select("filePath", "b.*")
    return within_budget(best, count_tokens(F.col("content")), budget, F.desc(F.round("score", 12)), F.col("filePath"))
