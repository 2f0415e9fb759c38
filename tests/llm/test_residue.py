import json
import random
import re
from re import _parser

import pytest

from lodestone.llm import residue as r
from tests.conftest import rows

REAL = "We moved the parser into its own module. It reads each file once and reports the first error it meets."


@pytest.mark.parametrize(("text", "kind"), [
    ("Please enable JavaScript to view this page.", "script"), ("Docs | Home | Help\n\n404 Not Found\n\nBack to top", "error"), ("Lorem ipsum dolor sit amet, tempor incidunt ut labore et dolore magna.", "filler"),
    ("asdf foo bar test qwer asdf blah 1234 foo", "filler"), ("# {{title}}\n\n## Usage\nTBD\n\n**Contact\n[Insert email here]", "template"), ("Hello ${NAME},\n\nYour ticket {{ ticket }} for %COMPANY% was closed on [[date]].", "template"),
    ("No content available.", "empty"), ("undefined undefined\n[object Object]\nNaN of null", "empty"), ("Your text goes here.\n\nClick to edit this text.", "placeholder"), ("Seite nicht gefunden. Zurück zur Startseite.", "error"),
    ('{"error": {"code": 404, "message": "Not Found"}}', "error"), ("Under construction\n\nTerms - Privacy - Status", "placeholder"), ("Checking your browser before accessing x.example. Ray 37a0dda5c5e43a1e", "error"),
    ("Error 404\nNot Found. The requested path /a/b does not exist on this server.", "error"),
])
def test_residue(text, kind):
    assert r.judge(text).kind == kind


@pytest.mark.parametrize("text", [
    REAL, "Fixed, thanks.", "Same here with 31 files.", 'The crawler stored pages that only said "Please enable JavaScript"; we skip them now.', "The server answered `404 Not Found` whenever the cache was cold; the cause was a missing slash.",
    "Templates use `{{ url }}` for values and `{% if %}` for branches.", "> Error 500\n> Internal Server Error\n\nThis is what users saw while the index was being rebuilt last night.", "```\nconst x = `${root}/${name}`;\n```", "def f(x):\n    # TODO: write this section\n    return x + 1",
    "We replaced the lorem ipsum in the start page with the final copy from marketing.", "TODO: index the kitchen once the encoder is stable; until then results stay late.", "", "   \n", None,
])
def test_content(text):
    assert r.judge(text).kind is None


def example(parsed, rnd):
    """A text that the parsed pattern accepts, as far as its assertions allow."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op in ("ANY", "NOT_LITERAL"):
            out += "x"
        elif op == "IN":
            kind, value = rnd.choice(arg)
            kind = str(kind)
            out += chr(value) if kind == "LITERAL" else chr(value[0]) if kind == "RANGE" else "q" if kind == "NEGATE" else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " "}.get(str(value), "x")
        elif op == "BRANCH":
            out += example(rnd.choice(arg[1]), rnd)
        elif op == "SUBPATTERN":
            out += example(arg[-1], rnd)
        elif op == "MAX_REPEAT":
            out += "".join(example(arg[2], rnd) for _ in range(rnd.randint(arg[0], min(int(arg[1]), arg[0] + 4))))
    return out


def test_the_filter_by_strings_loses_nothing():
    rnd = random.Random(3)
    texts = ["[object Object] [object Object]", "[object Object] of [object Object]", "of of of of"]
    for p in (*r.ERROR, *r.SCRIPT, *r.EMPTY, *r.PLACEHOLDER):
        parsed = _parser.parse(p, re.I)
        for _ in range(60):
            e = example(parsed, rnd)
            texts += [e, e.upper(), f"zzk zzm zzq {e}", f"{e} {e}"]
    for t in texts:
        assert r.sign(t) == next((k for k, _, rx in r._EVIDENCE if rx.search(t)), None), t
    assert [r.judge(t).kind for t in texts[:2]] == ["empty", "empty"] and len(r._FREE) < 4


def test_long_text_is_read_whole():
    assert r.judge(REAL * 5000 + "\nPlease enable JavaScript to view this page.").kind is None
    assert r.judge("Please enable JavaScript.\n" * 20_000).kind == "script"


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_error_answers_in_json_of_any_length(n):
    frames = [f"at handler{i} (router.js:{i})" for i in range(n)]
    assert r.judge(json.dumps({"error": {"code": 500, "message": "Internal failure", "stack": frames}})).kind == "error"
    assert r.judge(json.dumps({"status": 404, "detail": " ".join(frames), "path": "/a/b"}, indent=1)).kind == "error"
    assert r.judge(json.dumps({"error": None, "status": "ok", "items": [REAL] * n})).kind is None
    assert r.judge(json.dumps({"code": 404, "message": "partly found", "items": [REAL] * n})).kind is None


BANNER = "Gantry Harbor Archive of the Northern Reading Room, open since the first of May"


def recurring(docs):
    return [(i, "h", f"{BANNER}\n\nNo content available." if i < 10 else f"{BANNER}\n\nArticle {'x' * i} tells of the winter in which the river froze to its bed.") for i in docs]


def test_recurrent_lines_are_subtracted(spark):
    docs = recurring(range(40)) + [(90, "other", f"{BANNER}\n\nNo content available."), (91, None, None), (92, "h", "  ")]
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:3]], "doc_id bigint, repo string, text string, kind string")
    assert r.judge(docs[0][2]).kind is None
    for listed in (r.LISTED, 0):  # broadcast, and joined
        assert rows(r.find_residue(df, listed=listed), "id", "kind") == [(i, "empty") for i in range(10)]
    often = r.recurrent_lines(df.where("text is not null"), "doc_id", "repo", "text")
    assert often.count() == 2 and {h for h, _ in rows(often)} == {"h"}
    assert r.find_residue(df.limit(0)).count() == 0


def test_numbers_of_lines_agree(spark):
    text = "A 12  b\r\n\n```x\rc 345 \x0c d\u2028e\n  a 7 B"
    got = spark.createDataFrame([(text,)], "t string").select(r.line_hashes(r.F.col("t")).alias("h")).first()["h"]
    assert len(got) == len(r._LINE_END.split(text)) and [x is None for x in got] == [False, True, False, False, False] and got[0] == got[4]


def test_the_residual_is_what_is_judged():
    page = "We use cookies on this site.\nYour session has expired."
    both, own = r.judge(page), r.judge(page, frozenset({0}))
    assert both.kind == own.kind == "error" and own.evidence_words == 4 < both.evidence_words
    # A banner on a page with little to say isn't what the page is about.
    assert r.judge("We use cookies on this site.\nAll of it is done.").kind is None or r.judge("We use cookies on this site.\nAll of it is done.", frozenset({0})).kind is None
    assert r.judge(f"{REAL}\nYour session has expired.", frozenset({0})).kind == "error" and r.judge(f"{REAL}\nYour session has expired.", frozenset({1})).kind is None
    # If there is nothing but boilerplate, it counts what that says; boilerplate without evidence is kept.
    assert r.judge(page, frozenset({0, 1})).kind == "error" and r.judge(REAL, frozenset({0})).kind is None
    # Marks of code stay, so what they enclose stays code.
    assert r.judge("```\n404 Not Found\n```\n" + REAL, frozenset({0, 2})).kind is None


def test_long_sentences():
    error = "We are sorry to tell you that the page that you were looking for could not be found on this server because it may have been moved or renamed or removed by its owner or because the address that you typed has a mistake in it so that you may want to check it once more or to go back to the home page and try again later"
    assert len(error.split()) > 58 and r.judge(error + ".").kind == "error"
    story = " ".join(["the crew kept the log of every storm that came over the bay"] * 20)
    assert r.judge(f"{story} and once an internal server error stopped them and {story}.").kind is None
