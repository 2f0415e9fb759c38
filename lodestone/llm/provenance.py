"""Files that nobody wrote by hand here: generated, minified, vendored, or data in the guise of code.

Each file is lexed and re-emitted in canonical formatting: a statement a line, one blank between tokens where a formatter would
put it. Compared with that, the original's layout tells: extreme expansion with most of the canonical blanks left out marks
minified text, perfect uniformity of the canonical lines' shapes generated text, dominance of literals a data blob. Secondary
evidence, reported as such, is what a file's comments say of its origin and a place among other projects' packages; being a
copy of a file that is marked as another project's is one more.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.files import assemble_known, scanned, with_text
from lodestone.llm.grammars import EXTENSIONS, language

# Folders that hold other projects' packages, each in a folder of its own.
VENDOR_DIRS = frozenset("vendor third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages web_modules site-packages dist-packages extern external externals deps pods carthage godeps _vendor vendored upstream".split())
# What heads, feet and module docstrings of generated files say.
GENERATED = (
    r"\bcode generated by\b.*\bdo not edit\b",
    r"\bdo not edit\b.*\bgenerated\b|\bgenerated\b.*\b(?:do not (?:edit|modify|change)|edits? will be (?:lost|overwritten)|don't (?:edit|modify))\b",
    r"@generated\b|<auto-?generated\b|\bauto-?generated (?:file|by|from|code)\b|\bautogenerated\b",
    r"\b(?:this (?:file|code|module|class) (?:is|was|has been) )(?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written) (?:automatically )?(?:by|from|with|using)\b",
    r"\b(?:machine|tool)-(?:written|generated|made)\b",
    r"\bgenerated (?:on|at) \S+ (?:from|by|using|with)\b|\bgenerated (?:by|from|with|using) \S+(?: v?\d[\w.]*)?[.!]?\s*$|\bgenerated from \S+\.\w+ (?:by|using|with)\b",
    r"\bedits will be overwritten\b|\bmanual changes (?:are|will be) (?:lost|overwritten)\b",
)
# What those of copied files say.
VENDORED = (
    r"\bvendored (?:copy|from|in|version)\b|\bvendored\b.*\bupstream\b",
    r"\b(?:taken|copied|imported|borrowed|lifted|extracted) (?:verbatim |unchanged |as is |directly )?from \S+.*(?:\d+\.\d+|upstream|licen[cs]e|https?://|release|version|commit)",
    r"\bbundled (?:snapshot|copy|version|release)\b|\bthird[- ]party (?:code|copy|library)\b",
    r"\bsend fixes to the upstream\b|\bupstream (?:project|repository|source):? \S+|\blocal (?:changes|modifications): (?:none|see)\b",
    r"\(c\) [\d\-, ]+ the \S+ authors, released under\b|\breleased under the (?:mit|bsd|apache|isc|mpl|lgpl)[\w\- ]* licen[cs]e\b",
)
# How a comment among code opens that speaks of its file, and not of the value or function beside it.
GENERATED_INSIDE = (
    r"code generated by\b.*\bdo not edit\b|@?generated by\b.*\bdo not (?:edit|modify|change)\b|do not edit\b.*\bgenerated\b",
    r"@generated(?:$|\W)|<auto-?generated\b|auto-?generated (?:file|code|from)\b",
    r"(?:auto[- ]?|automatically )?generated\b.*\b(?:do not (?:edit|modify|change)|edits? will be (?:lost|overwritten)|don't (?:edit|modify))\b",
    r"this (?:file|module) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written) (?:automatically )?(?:by|from|with|using)\b",
    r"(?:machine|tool)-(?:written|generated|made) (?:output|file|code|by|from)\b",
    r"generated (?:on|at) \S+ (?:from|by|using|with)\b|edits will be overwritten\b|manual changes (?:are|will be) (?:lost|overwritten)\b",
)
VENDORED_INSIDE = (r"(?:this (?:file|module) is an? )?(?:vendored|bundled) (?:copy|snapshot|version|release|from)\b", r"vendored\b.*\bupstream\b|send fixes to the upstream\b")
_GENERATED = re.compile("|".join(f"(?:{p})" for p in GENERATED), re.I)
_VENDORED = re.compile("|".join(f"(?:{p})" for p in VENDORED), re.I)
_GENERATED_INSIDE = re.compile(r"^[^\w@<]*(?:" + "|".join(GENERATED_INSIDE) + ")", re.I)
_VENDORED_INSIDE = re.compile(r"^\W*(?:" + "|".join(VENDORED_INSIDE) + ")", re.I)
_BLOCK_SCALAR = re.compile(r"(?:^|[:\-]\s+)[|>][+\-\d]*\s*(?:#.*)?$")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|''')")
_PACKAGE_DIR = re.compile(r"(?i)^[a-z@][\w.@\-]*[-@_]v?\d+\.\d+(?:\.\d+)*(?:[-+][\w.]+)?$")
_VERSION_DIR = re.compile(r"^v?\d+\.\d+(?:\.\d+)*$")

#: Canonical lines a line of a minified file, and how much of the canonical blanks between tokens it keeps at most.
EXPANSION, KEPT_BLANKS = 3.0, 0.6
#: A generated file's canonical lines are made of so few shapes (as 2 to the power of their entropy), each of which stands
#: there REPEATS times on average.
SHAPES, REPEATS = 6.0, 5.0
#: Literals are this much of a data blob's characters, and have so many characters for each name beside them.
LITERAL, LITERAL_PER_NAME = 0.7, 60.0
#: From so many tokens on a copy is known by its tokens alone, below it must be equal with its comments and blanks.
COPY_TOKENS = 40


@dataclass
class Layout:
    """What the canonical text tells of the original one."""

    lines: int  # of the original, without comments
    canonical: int
    expansion: float  # canonical lines a line
    kept_blanks: float  # blanks between tokens, as a share of the canonical ones
    shapes: float  # how many shapes its lines effectively have
    repeats: float  # lines a shape
    shape_tokens: float
    literals: float  # share of the characters, without strings that hold words or code
    per_name: float  # characters of literals a name
    fingerprint: str | None


_COMPOUND = frozenset("if elif else for while with try except finally def class async match case".split())
_LITERAL_BRACE = frozenset("= ( , : [ ? => return import export from const let var default in of && || ?? + ! ... := map".split())
_AFTER_CLOSE = frozenset("else catch finally while ) , ; . ] ( ?. as from".split())
_GOES_ON = frozenset("= + - * / % & | ^ < > <= >= == != === !== && || ?? ? : , . => := += -= ( [ ! ~ <- extends implements".split())
_SPACED = frozenset("= + - * / % & | ^ < > <= >= == != === !== && || ?? ? => := += -= *= /= |= &= ^= %= ||= &&= ??= ** << >> >>> <- -> //".split())
_TIGHT_BEFORE = frozenset(") ] , ; . ?. ( [ ++ -- : :: ...".split())
_TIGHT_AFTER = frozenset("( [ . ?. ! ~ @ ... :: ++ -- #".split())


@lru_cache(maxsize=None)
def _blank(a: str, b: str) -> bool:
    """Whether canonical text has a blank between two tokens of a line, given by their shapes."""
    if a in _TIGHT_AFTER:
        return False
    if b in _TIGHT_BEFORE:
        return b in "([" and (a in _SPACED or a in ",:;" or a in ("if", "for", "while", "switch", "catch", "return", "elif", "and", "or", "not", "in"))
    word = lambda t: t[0].isalnum() or t[0] in "_$@"
    return word(a) and word(b) or a in ",;:" or a in _SPACED or b in _SPACED or b in "{}" or a in "{})"


def shape(t: str, keywords: frozenset[str]) -> str:
    """s for a string, n for a number, i for a name, else the token itself."""
    c0 = t[0]
    if c0 in "\"'`" or len(t) > 2 and t[-1] in "\"'":
        return "s"
    if c0.isdigit() or c0 == "." and len(t) > 1 and t[1].isdigit():
        return "n"
    if (c0.isalpha() or c0 in "_$") and t not in keywords:
        return "i"
    return t


def emit(tokens: list[str], lang) -> list[list[str]]:
    """The lines of the canonical text, as tokens: a statement a line, a brace of a block at its line's end, comments left out."""
    lines: list[list[str]] = []
    cur: list[str] = []
    stack: list[str] = []
    closed = False
    python = lang.name == "python"
    for t in tokens:
        c0 = t[0]
        if c0 in "\r\n":
            top = stack[-1] if stack else "b"
            if cur and not closed and (not stack if python else top == "b" and cur[-1] not in _GOES_ON):
                lines.append(cur)
                cur = []
            continue
        if (c0 == "#") if python else (c0 == "/" and t[1:2] in ("/", "*")):
            continue
        if closed:
            closed = False
            if t not in _AFTER_CLOSE:
                lines.append(cur)
                cur = []
        if t in "([" or python and t == "{":
            stack.append("p")
        elif t in ")]" or python and t == "}":
            while stack and stack.pop() != "p":
                pass
        elif t == "{":
            prev = cur[-1] if cur else None
            literal = prev in _LITERAL_BRACE or lang.name == "go" and prev is not None and prev != ")" and cur[0] not in lang.keywords
            stack.append("o" if literal and prev != "=>" else "b")
            cur.append(t)
            if stack[-1] == "b":
                lines.append(cur)
                cur = []
            continue
        elif t == "}" and stack:
            if stack.pop() == "b":
                if cur:
                    lines.append(cur)
                cur, closed = ["}"], True
                continue
        cur.append(t)
        if t == ";" and (not stack or stack[-1] == "b") or python and not stack and t == ":" and cur[0] in _COMPOUND and "lambda" not in cur:
            lines.append(cur)
            cur = []
    if cur:
        lines.append(cur)
    return lines


def _prose(t: str) -> bool:
    """Whether a string holds words for people, or code, rather than data."""
    return len(t) >= 12 and sum(map(t.count, " \n\t")) >= 0.08 * len(t) and sum(c.isalpha() for c in t) >= 0.5 * len(t)


def layout(text: str, ext: str, tokens: list[str]) -> Layout:
    lang = language(EXTENSIONS[ext])
    keywords, python = lang.keywords, lang.name == "python"
    notes_ = (t for t in tokens if t[0] in "\r\n#/" and (t[0] in "\r\n" and "#" in t or (t[0] == "#" if python else t[:2] in ("//", "/*"))))
    remarks = sum(len(ln.strip()) for t in notes_ for ln in t.split("\n"))
    lines = emit(tokens, lang)
    shapes: Counter = Counter()
    known: dict[str, str] = {}
    literal = names = solid = blanks = count = 0
    for line in lines:
        form = []
        for t in line:
            x = known.get(t)
            if x is None:
                x = known[t] = shape(t, keywords)
            form.append(x)
            if x == "i":
                names += 1
            elif x == "n" or x == "s" and not _prose(t):
                literal += len(t)
        solid += sum(map(len, line))
        count += len(line)
        blanks += sum(map(_blank, form, form[1:]))
        if len(form) > 2:
            shapes[" ".join(form)] += 1
    rows = [r for r in map(str.strip, text.split("\n")) if r]
    own = [r for r in rows if not _COMMENT_LINE.match(r)]
    kept = max(0, sum(map(len, rows)) - solid - remarks)
    # Lines without a bracket, an assignment or a colon are prose, whatever the extension says.
    total = sum(n for x, n in shapes.items() if any(c in x for c in "(=:{["))
    few = 2 ** -sum(n / total * math.log2(n / total) for x, n in shapes.items() if any(c in x for c in "(=:{[")) if total else 1.0
    mark = None
    if count:
        whole = "\x00".join(t for line in lines for t in line) if count >= COPY_TOKENS else "\x01" + text.strip()
        mark = hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return Layout(
        len(own),
        len(lines),
        len(lines) / max(1, len(own)),
        kept / max(1, blanks),
        few,
        total / few,
        sum((x.count(" ") + 1) * n for x, n in shapes.items()) / max(1, sum(shapes.values())),
        literal / solid if solid else 0.0,
        literal / max(1, names),
        mark,
    )


def notes(text: str, ext: str, tokens: list[str] | None = None) -> list[tuple[bool, str]]:
    """(outside, line) of each comment line and docstring line of the whole text; string literals are left out.

    outside: it stands in the head, at the foot or in the module's docstring, before and after all code but a package clause.
    tokens: of the text, for extensions that have a lexer.
    """
    if tokens is None:
        return _noted_lines(text, ext)
    python = language(EXTENSIONS[ext]).name == "python"
    out: list[tuple[bool, str]] = []
    head, opening, last, clause = True, True, 0, False
    if python:  # its lexer leaves the first line out if that is a comment
        first = text.lstrip("\ufeff").split("\n", 1)[0].strip()
        if first[:1] == "#":
            out.append((True, first))
    for k, t in enumerate(tokens):
        c0 = t[0]
        if c0 in "\r\n":
            if python and "#" in t:
                out += [(head, ln) for ln in map(str.strip, t.split("\n")) if ln]
            opening, clause = True, False
            continue
        if t.startswith(("//", "/*")) and not python or c0 == "#" and python:
            out += [(head, ln) for ln in t.split("\n")]
            continue
        if opening and not clause and head and (t == "package" or not python and t in ("'use strict'", '"use strict"')):
            clause = True
        elif python and opening and len(t) > 2 and t[-1] in "\"'" and (k + 1 == len(tokens) or tokens[k + 1][0] in "\r\n#"):
            out += [(head, ln) for ln in t.split("\n")]  # a docstring
            opening = False
            last = len(out)
            head = False
            continue
        elif not clause:
            head = False
        if t == ";":
            clause = False
        opening = t == ";"
        last = len(out)
    return [(outside or k >= last, ln) for k, (outside, ln) in enumerate(out)]


def _noted_lines(text: str, ext: str) -> list[tuple[bool, str]]:
    """The same by lines, for text without a lexer. Block scalars of YAML and long strings of TOML are literals."""
    out: list[tuple[bool, str]] = []
    head, last, close, scalar, literal = True, 0, "", -1, False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        if scalar >= 0:
            if len(line) - len(line.lstrip()) > scalar:
                continue
            scalar = -1
        long = ext == "toml" and (line.count('"""') + line.count("'''")) % 2 == 1
        if literal or long:
            literal ^= long
        elif close or _COMMENT_LINE.match(line):
            out.append((head, line))
            if not close:
                close = "*/" if bare.startswith("/*") else "-->" if bare.startswith("<!--") else ""
            if close and close in line:
                close = ""
            continue
        elif ext in ("yaml", "yml") and _BLOCK_SCALAR.search(line):
            scalar = len(line) - len(line.lstrip())
        head, last = False, len(out)
    return [(outside or k >= last, ln) for k, (outside, ln) in enumerate(out)]


def marked(lines: list[tuple[bool, str]], outside: re.Pattern, inside: re.Pattern) -> bool:
    """Whether one of the lines that notes() gives bears a mark."""
    return any(outside.search(ln) if out else inside.search(ln) for out, ln in lines)


def place(relativepath: str | None) -> bool:
    """Whether a path lies within another project's package."""
    parts = [p for p in re.split(r"[\\/]+", (relativepath or "").strip()) if p not in ("", ".", "..")]
    low = [p.lower() for p in parts[:-1]]
    return any(p in VENDOR_DIRS and i + 1 < len(low) for i, p in enumerate(low)) or any(_PACKAGE_DIR.match(p) for p in parts[:-1]) or any(_VERSION_DIR.match(p) and i > 0 for i, p in enumerate(low))


@dataclass
class Judgement:
    kind: str | None  # vendored, generated, minified or data
    evidence: str | None  # layout, place or comment, the first that tells
    source: bool = False  # marked as another project's, so that copies of it are known
    mark: str | None = None


def judge(relativepath: str | None, ext: str, text: str | None) -> Judgement:
    """What a file is. The layout is asked first; where it lies and what its comments say is secondary evidence."""
    placed = place(relativepath)
    if not text:
        return Judgement("vendored", "place", True) if placed else Judgement(None, None)
    tokens = language(EXTENSIONS[ext]).lex(text) if ext in EXTENSIONS else None
    said = notes(text, ext, tokens)
    foreign = placed or marked(said, _VENDORED, _VENDORED_INSIDE)
    mark = None
    if tokens is not None:
        m = layout(text, ext, tokens)
        mark = m.fingerprint
        if m.expansion >= EXPANSION and m.kept_blanks <= KEPT_BLANKS:
            return Judgement("minified", "layout", foreign, mark)
        if m.literals >= LITERAL and m.per_name >= LITERAL_PER_NAME:
            return Judgement("data", "layout", foreign, mark)
        if m.shapes <= SHAPES and m.repeats >= REPEATS and m.shape_tokens >= 4:
            return Judgement("generated", "layout", foreign, mark)
    if foreign:
        return Judgement("vendored", "place" if placed else "comment", True, mark)
    if marked(said, _GENERATED, _GENERATED_INSIDE):
        return Judgement("generated", "comment", False, mark)
    return Judgement(None, None, False, mark)


def find_foreign(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, repo, ext, kind, evidence) of scanned files that aren't hand-written: vendored, generated, minified or data.

    evidence: layout, place, comment, or copy of a file that is marked as another project's. Missing contents are passed
    over, so a file may be judged by its place alone; null paths are passed over; a redelivered row counts once; an empty text
    is hand-written unless its place says otherwise.
    """
    src = with_text(scanned(files), chunks).select("path", "repo", "relativepath", "ext", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, repo, rel, ext, parts in zip(pdf["path"], pdf["repo"], pdf["relativepath"], pdf["ext"], pdf["parts"]):
                j = judge(rel if rel is not None else path, ext or "", assemble_known(parts))
                rows.append((path, repo, ext, j.kind, j.evidence, j.source, j.mark))
            yield pd.DataFrame(rows, columns=["path", "repo", "ext", "kind", "evidence", "source", "mark"])

    from lodestone.session import materialize

    judged = materialize(src.mapInPandas(run, "path string, repo string, ext string, kind string, evidence string, source boolean, mark string"), "provenance")
    # One row a fingerprint of vendored text, repeated for each of 8 salts over which possible copies are spread.
    known = judged.where("source and mark is not null").select("mark").distinct().withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    unmarked = judged.where("kind is null and mark is not null").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(8)).cast("int"))
    copies = unmarked.join(known, ["mark", "salt"], "left_semi").select("path", "repo", "ext", F.lit("vendored").alias("kind"), F.lit("copy").alias("evidence"))
    return judged.where("kind is not null").select("path", "repo", "ext", "kind", "evidence").unionByName(copies)
