"""Call edges: who calls what, from where, and the context around search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import count_tokens

# Callees that are too common to be worth an edge.
CALL_NOISE = "log warn error info debug trace resolve reject all race allSettled keys values entries assign freeze push pop map filter reduce forEach find some every join split trim slice replace match test parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout clearInterval require".split()


def without_noise(calls: DataFrame, callee: str = "callee_name") -> DataFrame:
    return calls.where(F.col(callee).isNotNull() & ~F.col(callee).isin(*CALL_NOISE))


def first_calls(calls: DataFrame) -> DataFrame:
    """One row for each file, caller and callee: the first line of such a call."""
    return calls.groupBy("caller_file", "caller_symbol", "callee_name").agg(F.min("caller_line").alias("caller_line"))


def callers(calls: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Calls of a symbol, by its bare name or the last part of a qualified one."""
    bare = symbol.rsplit(".", 1)[-1]
    return calls.where(F.col("callee_name").isin(symbol, bare)).orderBy("caller_file", "caller_line", "caller_symbol").limit(limit)


def callees(calls: DataFrame, file: str, symbol: str | None = None, limit: int = 50) -> DataFrame:
    """What a file calls, or one symbol of it."""
    df = calls.where(F.col("caller_file") == file)
    if symbol is not None:
        return df.where(F.col("caller_symbol") == symbol).orderBy("caller_line", "callee_name").limit(limit)
    return df.orderBy("caller_symbol", "caller_line", "callee_name").limit(limit)


def enclosing(calls: DataFrame, ranges: DataFrame, file: str = "file", line: str = "line", call: str = "call_id") -> DataFrame:
    """calls with `caller_symbol`: the innermost function or method around each call's line, '<module>' if there is none.

    ranges: (file, name, kind, start_line, end_line). An equi-join on the file with the range as a residual condition; the
    innermost is the one that starts last, of those the one that ends first. It is found by an aggregation, so that each call
    keeps one row however many functions surround it.
    """
    r = ranges.where(F.col("kind").isin("function", "method")).select(F.col(file).alias("__f"), "name", "start_line", "end_line")
    hit = calls.join(r, (F.col(file) == F.col("__f")) & F.col(line).between(F.col("start_line"), F.col("end_line")))
    inner = hit.groupBy(call).agg(F.max_by("name", F.struct("start_line", (-F.col("end_line")).alias("e"), "name")).alias("__name"))
    return calls.join(inner, call, "left").withColumn("caller_symbol", F.coalesce("__name", F.lit("<module>"))).drop("__name")


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with callee_file filled in where exactly one file defines the name."""
    one = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.min("file_path").alias("__a"), F.max("file_path").alias("__b")).where("__a = __b").select("callee_name", F.col("__a").alias("__file"))
    return calls.join(one, "callee_name", "left").withColumn("callee_file", F.coalesce("callee_file", "__file")).select(*calls.columns)


def resolve_symbol(symbols: DataFrame, name: str, limit: int = 10) -> tuple[str, list]:
    """('missing' | 'unique' | 'ambiguous', rows) of the symbols with just this name, bare or qualified."""
    rows = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("file_path", "start_line").limit(limit).collect()
    return ("missing" if not rows else "unique" if len(rows) == 1 else "ambiguous"), rows


def expand_context(results: DataFrame, calls: DataFrame, symbols: DataFrame, max_tokens: int = 4000, top: int = 3, n_callees: int = 10, n_callers: int = 5, resolve: bool = True) -> DataFrame:
    """results (with `pos`) and, below them, the callees and callers of the best, as long as they fit into max_tokens.

    Candidates come in order of their result, callees before callers; a place (file and line) that is there already is passed
    over, and one that doesn't fit ends its list, but not the lists after it. So the budget isn't a running sum; the few
    candidates (top * (n_callees + n_callers) at most) are folded in order within one row.
    """
    best = results.where(F.col("pos") <= top).select("pos", "filePath", "chunkName")
    c = calls.select("caller_file", "caller_symbol", "caller_line", "callee_name", "callee_file")
    down = best.join(c, (F.col("filePath") == F.col("caller_file")) & (F.col("chunkName") == F.col("caller_symbol")))
    wd = Window.partitionBy("pos").orderBy("caller_line", "callee_name")
    down = down.withColumn("k", F.row_number().over(wd)).where(F.col("k") <= n_callees)
    s = symbols.select(F.col("file_path").alias("sf"), "name", "qualified_name", F.col("start_line").alias("sl"), F.col("end_line").alias("el"), F.col("signature").alias("sg"), F.col("kind").alias("sk"), F.col("language").alias("lg"))
    ws = Window.partitionBy("pos", "k").orderBy("sl", "qualified_name")
    down = down.join(s, (F.col("callee_file") == F.col("sf")) & ((F.col("callee_name") == F.col("name")) | (F.col("callee_name") == F.col("qualified_name")))).withColumn("r", F.row_number().over(ws)).where("r = 1")
    down = down.select("pos", F.lit(0).alias("phase"), "k", F.col("sf").alias("filePath"), F.col("sg").alias("content"), F.col("sl").alias("startLine"), F.col("el").alias("endLine"), F.col("qualified_name").alias("chunkName"), F.col("sk").alias("chunkType"), F.col("lg").alias("language"))
    up = best.select("pos", F.col("chunkName").alias("cn")).join(c, F.col("cn") == F.col("callee_name"))
    wu = Window.partitionBy("pos").orderBy("caller_file", "caller_line", "caller_symbol")
    up = up.withColumn("k", F.row_number().over(wu)).where(F.col("k") <= n_callers)
    text = F.concat("caller_symbol", F.lit(" calls "), "callee_name", F.lit(" (line "), F.col("caller_line").cast("string"), F.lit(")"))
    up = up.select("pos", F.lit(1).alias("phase"), "k", F.col("caller_file").alias("filePath"), text.alias("content"), F.col("caller_line").alias("startLine"), F.col("caller_line").alias("endLine"), F.col("caller_symbol").alias("chunkName"), F.lit(None).cast("string").alias("chunkType"), F.lit(None).cast("string").alias("language"))
    candidates = (down.unionByName(up) if resolve else up).withColumn("tokens", count_tokens(F.col("content")))
    fields = ["pos", "phase", "k", "tokens", "filePath", "content", "startLine", "endLine", "chunkName", "chunkType", "language"]
    listed = candidates.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))
    base = results.agg(F.coalesce(F.sum(count_tokens(F.col("content"))), F.lit(0)).alias("used"), F.collect_set(F.concat_ws(":", "filePath", F.col("startLine").cast("string"))).alias("seen"))
    one = listed.crossJoin(base)
    item = one.schema["c"].dataType.elementType.simpleString()
    state = F.struct(F.col("used").alias("used"), F.col("seen").alias("seen"), F.array().cast(f"array<{item}>").alias("kept"), F.array().cast("array<string>").alias("closed"))

    def step(acc: Column, x: Column) -> Column:
        place = F.concat_ws(":", x["filePath"], x["startLine"].cast("string"))
        group = F.concat_ws("/", x["pos"].cast("string"), x["phase"].cast("string"))
        skip = (acc["used"] >= max_tokens) | F.array_contains(acc["closed"], group) | F.array_contains(acc["seen"], place)
        fits = acc["used"] + x["tokens"] <= max_tokens
        taken = F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["seen"], place).alias("seen"), F.array_append(acc["kept"], x).alias("kept"), acc["closed"].alias("closed"))
        shut = F.struct(acc["used"].alias("used"), acc["seen"].alias("seen"), acc["kept"].alias("kept"), F.array_append(acc["closed"], group).alias("closed"))
        return F.when(skip, acc).when(fits, taken).otherwise(shut)

    added = one.select(F.posexplode(F.aggregate("c", state, step)["kept"]).alias("n", "x"))
    added = added.select(
        "x.filePath", "x.content", F.lit(0.5).alias("score"), "x.startLine", "x.endLine", "x.chunkName", "x.chunkType", "x.language", F.lit("structural").alias("source"), (F.col("n") + 1_000_001).cast("int").alias("pos")
    )
    return results.unionByName(added)
