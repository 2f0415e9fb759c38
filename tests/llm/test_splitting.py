import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import splitting as s
from tests.conftest import rows


def check(text, first, limit, overlap):
    got = s.split_text(text, first, limit, overlap)
    assert "".join(c[2][c[5] :] for c in got) == text
    for k, (no, n, piece, a, b, over, tokens, lo, hi) in enumerate(got):
        assert (no, n) == (k + 1, len(got)) and len(piece) <= limit * 4 and tokens == -(-len(piece) // 4)
        assert over == (min(overlap * 4, a) if k else 0) and text[a - over : b] == piece
        assert lo == first + text.count("\n", 0, a - over) and hi == max(lo, first + text.count("\n", 0, b) - piece.endswith("\n"))
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {}\n\r\t#-e\u0301é", max_size=400), st.integers(2, 20), st.integers(0, 1))
def test_round_trip(text, limit, overlap):
    check(text, 5, limit, overlap)


def test_cuts_between_functions():
    body = "".join(f"def f{i}(x):\n    y = x + {i}\n    return y\n\n" for i in range(300))
    got = check(body, 10, 500, 0)
    assert len(got) < 14 and all(c[2].startswith("def ") for c in got)


def test_a_comment_is_no_heading():
    body = "import os\n" + "".join(f"def f{i}(x):\n    y = x + {i}\n    return y\n# a note on g{i}\ndef g{i}():\n    return 2\n" for i in range(200))
    assert s.form(body) == s.form(body, "py") == s.form(body, "YAML") == "code" and s.form("# Title\n\nSome words.\n") == s.form(body, ".md") == "prose"
    tree = s.parse(["import os", "def f():", "    x = 1", "# a note on g", "def g():", "    y = 2", "class A {", "  b() {", "    c", "  }", "}"], "code")
    assert [(n.first, n.last) for n in tree] == [(0, 11), (0, 1), (1, 3), (2, 3), (3, 4), (4, 6), (5, 6), (6, 11), (7, 10), (8, 9)]
    got = check(body, 1, 300, 0)
    assert all(c[2].split("\n")[0][:1] in "di#" for c in got)


def test_siblings_are_merged_and_only_oversized_nodes_are_opened():
    method = lambda i, n: f"  m{i}() {{\n" + "    step();\n" * n + "  }\n"
    text = "class A {\n" + "".join(method(i, 3) for i in range(4)) + "}\nclass B {\n" + "".join(method(i, 12) for i in range(6)) + "}\nclass C {\n" + method(0, 2) + "}\n"
    got = [c[2] for c in check(text, 1, 110, 0)]
    assert got[0].startswith("class A {") and got[0].endswith("  }\n}\n")  # whole, and not merged with a part of B
    assert got[1].startswith("class B {\n  m0()") and all(g.startswith(("class", "  m", "}")) for g in got) and got[-1].startswith("class C {")


def test_lists_and_markup():
    items = "".join(f"- point {i}\n  that goes on\n  - below it\n" for i in range(300))
    got = [c[2] for c in check("# Title\n\nA list:\n\n" + items, 1, 100, 0)]
    assert all(g.startswith(("# Title", "- point")) for g in got)
    page = "<html>\n<body>\n" + "".join(f"<section>\n<h2>Part {i}</h2>\n<p>Some words.</p>\n<br>\n</section>\n" for i in range(200)) + "</body>\n</html>\n"
    assert s.form(page) == s.form(page, "html") == "markup"
    got = [c[2] for c in check(page, 1, 100, 0)]
    assert all(g.startswith(("<html>", "<section>", "</body>")) for g in got)


def test_headings_are_kept_with_their_text():
    text = "".join(f"# Part {i}\n\n" + "".join(f"## Section {i}.{j}\n\n" + "words and more words. " * 20 + "\n\n" for j in range(5)) for i in range(6))
    got = check(text, 1, 400, 0)
    assert all(c[2].startswith("#") for c in got)


def test_one_long_line():
    got = check("word " * 10_000, 1, 100, 10)
    assert all(c[2].endswith(" ") for c in got[:-1])
    check("x" * 100_000, 1, 100, 0)
    check("\n".join("y" * random.Random(i).randrange(50) for i in range(3000)), 7, 64, 3)


def test_frame(spark):
    df = spark.createDataFrame([("a", "x\n" * 5000, 3, "keep", 1), ("b", "short", 1, "keep", 2), ("c", None, 1, "keep", 3), ("d", "", None, "keep", 4)], "id string, content string, line int, other string, n_pieces int")
    got = s.split_items(df, "content", "line", 2000, 0)
    assert rows(got, "id", "piece_no", "startline", "endline", "other") == [("a", 1, 3, 4002, "keep"), ("a", 2, 4003, 5002, "keep")]
    every = s.split_items(df, "content", "line", 2000, 0, oversized_only=False)
    assert rows(every.where("id <> 'a'"), "id", "n_pieces", "content") == [("b", 1, "short"), ("d", 1, "")]
    assert s.split_items(df.limit(0), "content").count() == 0
    with pytest.raises(ValueError):
        s.split_items(df, "content", None, 10, 10)


def test_limit_is_exact(spark):
    df = spark.createDataFrame([("at", "a" * 8000), ("over", "a" * 8001)], "id string, content string")
    assert {r[0] for r in rows(s.split_items(df, "content"), "id")} == {"over"}
