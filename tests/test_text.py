import pytest
from pyspark.sql import functions as F

from lodestone.functions import lang, prompts, render, text
from lodestone.functions.paths import canonical_path, extension
from lodestone.sources.scan import indexable, is_ignored
from tests.conftest import rows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "want"), [
    (" /a//b\\c/\n", "/a/b/c"), ("/a/./b/../c", "/a/c"), ("../x/../y", "../y"), ("/../a", "/a"), ("  ", None), (None, None), ("/A/b", "/A/b"), ("a/b/../../c", "c"), ("/", "/"),
])
def test_canonical_path(spark, path, want):
    assert one(spark, path, canonical_path) == want


@pytest.mark.parametrize(("value", "want"), [("", 0), ("abcd", 1), ("abcde", 2), (None, None)])
def test_tokens(spark, value, want):
    assert one(spark, value, text.count_tokens) == want


@pytest.mark.parametrize(("path", "pattern", "want"), [("a/b/c.ts", "*.ts", True), ("src/a/b.ts", "src/*.ts", False), ("src/a", "src/**", True), ("a+b.ts", "a+b.ts", True), ("aab.ts", "a+b.ts", False)])
def test_glob(spark, path, pattern, want):
    assert one(spark, path, lambda c: text.glob_match(c, pattern)) is want


@pytest.mark.parametrize(("value", "want"), [("'a'", "a"), ('"a\'', '"a\''), ("`x`", "x"), ("a", "a")])
def test_strip_quotes(spark, value, want):
    assert one(spark, value, text.strip_quotes) == want


@pytest.mark.parametrize(("value", "want"), [(".pkg.mod", "./pkg/mod"), ("..pkg", "../pkg"), ("...a.b", "../../a/b"), ("a.b", "a/b")])
def test_module_path(spark, value, want):
    assert one(spark, value, text.module_path) == want


def test_placeholder_embedding(spark):
    import hashlib

    import numpy as np

    for dim in (384, 40, 20):
        v = np.array(one(spark, "abc", lambda c: text.placeholder_embedding(c, dim)))
        h = hashlib.sha256(b"abc").digest()
        want = np.array([h[i % 32] / 127.5 - 1 for i in range(dim)])
        assert np.allclose(v, want / np.linalg.norm(want))


def test_naive_tokens(spark):
    from lodestone.operators.embed import naive_ids

    for t in ("Hello  big\nWorld", "", "  ", "über naïve"):
        assert one(spark, t, text.token_ids) == naive_ids(t)


def test_languages(spark):
    assert [one(spark, e, lang.detect_language) for e in ("TS", ".py", "mjs", "xyz", None)] == ["typescript", "python", "javascript", None, None]
    assert [one(spark, e, lang.is_binary) for e in (".PNG", "ts", None)] == [True, False, False]
    assert one(spark, "/a/.env", extension) == "" and one(spark, "/a/b.TAR.Gz", extension) == "gz"


def test_ignore_rules(spark):
    df = spark.createDataFrame([("node_modules/a.js",), ("src/x.lock",), ("src/keep.lock",), ("docs/build/x",), ("src/a.ts",), ("tmp/a",), ("a/tmp/b",)], "p string")
    got = {r["p"]: r["i"] for r in df.withColumn("i", is_ignored(F.col("p"), ["# note", "", "/tmp/", "!keep.lock"])).collect()}
    assert got == {"node_modules/a.js": True, "src/x.lock": True, "src/keep.lock": False, "docs/build/x": True, "src/a.ts": False, "tmp/a": True, "a/tmp/b": False}


def test_indexable_keeps_unknown_sizes(spark):
    df = spark.createDataFrame([("a.ts", "ts", None), ("b.ts", "ts", 2_000_000), ("c.png", "png", 1), ("d", None, 5), ("build/e.ts", "ts", 1)], "relativepath string, extension string, size_bytes bigint")
    assert rows(indexable(df), "relativepath") == [("a.ts",), ("d",)]


@pytest.mark.parametrize(("value", "task"), [("Fix the auth timeout bug", "debug"), ("hello world", "research"), ("Refactor and simplify it", "refactor"), ("add a fix", "debug"), ("fixée", "research")])
def test_detect_task(spark, value, task):
    assert one(spark, value, prompts.detect_task) == task


@pytest.mark.parametrize(("value", "task", "want"), [("x" * 201, "research", "standard"), ("short", "research", "light"), ("quick fix", "debug", "light"), ("quick security fix", "debug", "deep"), ("a", "debug", "standard")])
def test_intensity(spark, value, task, want):
    assert one(spark, value, lambda c: prompts.detect_intensity(c, F.lit(task))) == want


def test_subject(spark):
    assert one(spark, "Fix the login", lambda c: prompts.subject(c, F.lit("debug"))) == "the login"
    assert one(spark, "help me fix it all", lambda c: prompts.subject(c, F.lit("research"))) == "it all"
    assert one(spark, "fix", lambda c: prompts.subject(c, F.lit("debug"))) == "fix"
    assert one(spark, "rename x", lambda c: prompts.subject(c, F.lit("refactor"))) == "rename x"


def test_tags(spark):
    df = spark.createDataFrame([("<a><b>", "<a>" + "x" * 100), ("<a>", "short <a>"), ("<a>", None)], "r string, v string")
    got = [tuple(r) for r in df.select(prompts.missing_tags(F.col("r"), F.col("v")).alias("m"), prompts.answer_is_valid(F.col("r"), F.col("v")).alias("ok")).collect()]
    assert got[0] == (["b"], False) and got[1] == ([], False) and got[2][1] is None


def test_render(spark):
    schema = "pos int, filePath string, content string, score double, startLine int, endLine int, source string"
    df = spark.createDataFrame([(1, "a", "x\ny", 0.5, 1, 2, "semantic"), (2, "b", "z", 0.25, 3, 3, "keyword")], schema)
    t = render.search_results(df).first()["text"]
    assert t.startswith("Results: 2 found | top score: 0.50 | sources: semantic, keyword\n\n[1] a (lines 1-2, score: 0.50, source: semantic)\n    x\n    y\n\n[2] b")
    assert render.search_results(df.limit(0)).first()["text"] == "No results found."


def test_composed_requests(spark):
    texts = [("fix the  login bug in\nthe parser, it is critical",), ("rename x",), ("Explain how chunks are stored",), ("   ",), (None,)]
    got = [r["b"] for r in spark.createDataFrame(texts, "t string").select(prompts.enhanced(F.col("t")).alias("b")).collect()]
    assert got[0].startswith('<tool_rules>\nPrimary tool: search_codebase(query="fix the login bug in the parser, it is critical")\nSecondary tools: get_recent_changes')
    assert "Expand the best results" in got[0] and "<diagnosis>" in got[0] and "1. The cause is mended" in got[0] and "5. Nothing that worked is broken." in got[0] and "<keep_it_small>" not in got[0]
    assert "Find out why the login bug in the parser, it is critical fails" in got[0] and got[0].endswith("</done_criteria>") and "Original request: fix the login bug" in got[0]
    assert "<diagnosis>" not in got[1] and "Intensity: light" in got[1] and "rename x. Deliver the change" in got[1] and got[3] is None and got[4] is None
    assert prompts.BLOCKS["concise"] in got[2] and "Explain how chunks are stored from the code." in got[2]
    flags = [("--enhancer fix it",), ("fix --enhancer it",), ("fix it",), ("--enhancer",), ("--enhancers fix",)]
    assert [r["f"] for r in spark.createDataFrame(flags, "t string").select(prompts.flagged(F.col("t")).alias("f")).collect()] == ["fix it", "fix it", None, None, None]
    u = spark.createDataFrame([("/a/AspireFilter.vue",), ("/a/mod.PY",), ("/a/.env",)], "p string").select(prompts.usage_patterns(F.col("p")).alias("u")).select("u.*").collect()
    assert u[0]["glob"] == "*.{vue,tsx,jsx,svelte}" and u[0]["import_pattern"] == "import.*AspireFilter" and u[1]["glob"] == "*.py" and u[2]["name"] == ".env"


def test_settings(tmp_path):
    from lodestone import config

    assert config.read_variables("# no\nA=1\nexport B = \"x y\"\nC='q'\nbad line\n1X=2\nD=\n") == {"A": "1", "B": "x y", "C": "q", "D": ""}
    assert config.resolve("A", {}, {"A": ""}, {"A": "2"}) == "2" and config.resolve("A", {}) is None
    a = config.parse_arguments(["--path", str(tmp_path), "--no-watch", "--exclude", "a, b,", "--exclude", "c", "--pool-size", "x", "--port", "30", "--flag", "--pool-size", "3"])
    assert (a.root, a.watch, a.exclude, a.pool_size, a.extras) == (str(tmp_path), False, ["a", "b", "c"], 3, {"--port": "30"}) and config.parse_arguments([]).watch
    (tmp_path / "marker").write_text("")
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert config.find_up(str(deep), "marker") == str(tmp_path) and config.find_up(str(deep), "marker", 2) is None
    assert config.index_folder("/base/", "/src/my app").startswith("/base/data/my_app-")
    assert config.within("/a/b", "c/d") and config.within("/a/b", "/a/b") and not config.within("/a/b", "../x") and not config.within("/a/b", "/a/bc")
    assert config.provider({"PROMPT_ENHANCER_PROVIDER": "Gemini", "GEMINI_API_KEY": "k"}) == "gemini" and config.provider({}, "openai") is None and config.provider({}, "ollama") == "ollama" and config.provider({}, "other") is None
    assert config.model_name({"OLLAMA_MODEL": "m"}, "ollama") == "m" and config.model_name({}, "openai", "d") == "d" and config.model_name({}, "zz") is None


def test_refining_falls_back():
    from lodestone.config import refine

    def fails(_):
        raise OSError

    ok = lambda want, got: "<a>" in got
    assert refine("r", "<a>", None, ok) == "<a>" and refine("r", "<a>", fails, ok) == "<a>" and refine("r", "<a>", lambda _: "no tag", ok) == "<a>"
    sent = []
    assert refine("r", "<a>", lambda x: sent.append(x) or "<a> better", ok, lambda _: "ctx") == "<a> better" and sent[0].index("ctx") < sent[0].index("Composed")
    assert refine("r", "<a>", lambda x: "<a> x", ok, fails) == "<a> x"


def test_texts_of_tools(spark):
    from lodestone.functions import render

    d = render.dependencies("/a.ts", {"imports": ["/b.ts", "/c.ts"], "imported_by": [], "transitive": {"/b.ts": ["/d.ts"]}}, {"/b.ts": list("uvwxyz"), "/c.ts": ["*"]})
    assert d == "Dependencies for: /a.ts\n\nImports (direct):\n  -> /b.ts  { u, v, w, x, y, ... }\n  -> /c.ts\n\nImported by: (none found)\n\nTransitive imports (depth 2):\n  /b.ts imports:\n    -> /d.ts"
    assert render.call_graph("f", "callers", "ok", [dict(caller_symbol="g", caller_file="/a", caller_line=3)]) == 'Callers of "f" (1 found):\n\n  g\n    in: /a:3'
    assert render.call_graph("f", "callees", "ok", [dict(callee_name="h", caller_line=4)], "/a").endswith("  -> h  (line 4)") and "No recorded callers" in render.call_graph("f", "callers", "ok", [])
    assert "No symbol" in render.call_graph("f", "callees", "missing", []) and "2 places" in render.call_graph("f", "callees", "ambiguous", [dict(file_path="/a", start_line=1)] * 2)
    assert "| abcdef123 | m | 1 | 2 | 3 |" in render.commits([dict(hash="abcdef1234567", message="m", files=1, insertions=2, deletions=3)], "7d", 5) and "(no commits" in render.commits([], "7d", 5)
    s = spark.createDataFrame([(1, "exported", "function", "f", "/a", 1, 2, "f()", [("x", "int", None), ("y", None, None)], "str"), (2, "internal", "class", "C", "/a", 3, 4, None, None, None)], "pos int, visibility string, kind string, qualified_name string, file_path string, start_line int, end_line int, signature string, parameters array<struct<name:string,type:string,defaultValue:string>>, return_type string")
    assert render.symbols(s).first()["text"] == "[1] export function f\n    file: /a:1-2\n    signature: f()\n    params: x: int, y\n    returns: str\n\n[2] class C\n    file: /a:3-4\n    signature: "
    assert render.symbols(s.limit(0)).first()["text"] == "No symbols found." and "scope \"src\"" in render.guide("explore", "src") and "(7d)" in render.guide("review")


def test_batches_of_a_model_fall_back_to_single_texts():
    from lodestone.operators.embed import embedded

    calls = []

    def run(part):
        calls.append(len(part))
        if len(part) > 1 and [9] in part:
            raise ValueError
        return [sum(x) for x in part]

    assert embedded([[i] for i in range(12)], run, 5) == list(range(12)) and calls == [5, 5, 1, 1, 1, 1, 1, 2]


def test_requests_of_a_table_are_composed_from_columns(spark, folder):
    from lodestone.plans import index_queries

    texts = [("fix the crash in a.py",), ("quick rename",), ("  explain   how it works ",), ("refactor and simplify <b>",), ("",), (None,)]
    df = spark.createDataFrame(texts, "text string")
    both = prompts.with_enhanced(df.withColumn("one", prompts.enhanced(F.col("text"))), "text", "body")
    assert both.columns == ["text", "one", "body"] and both.where("not one <=> body").count() == 0 and both.where("body is null").count() == 2
    plan = index_queries.prompt_sections(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("array_intersect(") == 5  # each is computed once a row
