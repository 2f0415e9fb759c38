"""Splitting oversized items at natural boundaries by structure-tree packing.

The text is parsed into a tree. Code is nested by its indentation, a line that only closes belongs to what it closes, and
comments are lines like others; prose by its headings, below them by paragraphs and lists; markup by its tags. Then the tree is
worked off from its leaves: adjacent sibling subtrees are merged as long as they stay within the limit, and only a node that
alone exceeds it is replaced by the pieces of its own children. The line that opens such a node goes with its first piece, those that close it with its
last. A line longer than the limit is cut after white space or punctuation where it has any, else after a fixed number of characters,
but never inside "\\r\\n" or before a combining mark.

Cores, the pieces without their overlap, lie end to end and give the content back exactly. A piece is its core preceded by
the `overlap` tokens of text before it, or by as much as there is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import extension
from lodestone.session import spread

#: A token is this many characters.
TOKEN_CHARS = 4

SCHEMA = "piece_no int, n_pieces int, content string, core_start bigint, core_end bigint, overlap_chars int, n_tokens bigint, startline bigint, endline bigint"

# Extensions of prose and of markup; those of any others are taken for code.
PROSE = frozenset("md markdown mdx rst adoc txt text".split())
MARKUP = frozenset("html htm xhtml xml svg xsl vue svelte".split())

#: The depth of a line that belongs to the node before it.
GOES_ON = -1

_HEADING = re.compile(r"(#{1,6})\s+\S|<h([1-6])\b", re.I)
_UNDERLINE = re.compile(r"(=|-){3,}\s*$")
_LIST = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s")
_CLOSER = re.compile(r"[)\]}>;,\s]*$|(?:end|fi|done|esac|else|elif|except|finally|catch)\b|[})\]]+\s*(?:else|catch|finally|while)\b|</")
_TAG = re.compile(r"<!--[\s\S]*?-->|<(/?)([A-Za-z][\w:\-]*)[^<>]*?(/?)>")
# Tags that need no closing one.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def form(text: str, extension: str | None = None) -> str:
    """code, prose or markup: by the extension if there is one, else by what most lines look like."""
    ext = (extension or "").strip().lstrip(".").lower()
    if ext:
        return "prose" if ext in PROSE else "markup" if ext in MARKUP else "code"
    lines = [ln for ln in text.split("\n") if ln.strip()]
    if text.lstrip()[:1] == "<" and sum(ln.lstrip()[:1] == "<" for ln in lines) > 0.5 * len(lines):
        return "markup"
    coded = sum(bool(re.search(r"[;{}()=:]\s*$|^\s*(?:def|class|import|return|func|if|for)\b.*[:({]", ln)) for ln in lines)
    return "code" if coded > 0.2 * len(lines) else "prose"


def _width(line: str) -> int:
    line = line.expandtabs(4)
    return len(line) - len(line.lstrip())


def _code_depths(lines: list[str]) -> list[int]:
    return [_width(ln) for ln in lines]


def _prose_depths(lines: list[str]) -> list[int]:
    """Headings by their level, paragraphs below them, list items below paragraphs. Lines that go on have GOES_ON."""
    out: list[int] = []
    before = ""  # the line before
    fenced = False
    for k, ln in enumerate(lines):
        text = ln.strip()
        after = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if text.startswith(("```", "~~~")):
            fenced, depth = not fenced, GOES_ON if fenced else 7
        elif fenced or not text:
            depth = GOES_ON
        elif (m := _HEADING.match(text)) and not ln[:1].isspace():
            depth = int(m.group(2) or len(m.group(1)))
        elif not before and _UNDERLINE.match(after) and len(after) >= 3:
            depth = 1 if after[0] == "=" else 2
        elif _LIST.match(text):
            depth = 8 + _width(ln)
        else:
            depth = GOES_ON if before and out[-1] not in range(1, 7) and not _UNDERLINE.match(lines[k - 1].strip()) else 7
        out.append(depth)
        before = text
    return out


def _markup_depths(lines: list[str]) -> list[int]:
    """How many tags are open where a line begins; a line that begins by closing some counts as outside of them."""
    open_: list[str] = []
    out = []
    for ln in lines:
        lead = len(re.match(r"(?:\s*</[\w:\-]+>)*", ln).group(0).split("</")) - 1
        out.append(max(0, len(open_) - lead))
        for m in _TAG.finditer(ln):
            name = (m.group(2) or "").lower()
            if not name or m.group(3) or name in _VOID:
                continue
            if not m.group(1):
                open_.append(name)
            elif name in open_:
                while open_.pop() != name:
                    pass
    return out


@dataclass
class Node:
    """Lines first to last (exclusive): the opening line and what stands below it, in order."""

    first: int
    last: int = 0
    children: list[int] = field(default_factory=list)


def parse(lines: list[str], kind: str) -> list[Node]:
    """The structure tree in preorder, the root first. Blank lines belong to what stands before them."""
    depths = {"code": _code_depths, "prose": _prose_depths, "markup": _markup_depths}[kind](lines)
    nodes = [Node(0, len(lines))]
    path: list[tuple[int, int]] = [(-1, 0)]  # (depth, node) of the open nodes
    for k, ln in enumerate(lines):
        text = ln.strip()
        if not text or depths[k] == GOES_ON:
            continue
        while len(path) > 1 and path[-1][0] > depths[k]:
            nodes[path.pop()[1]].last = k
        if len(path) > 1 and path[-1][0] == depths[k]:
            if kind != "prose" and _CLOSER.match(text):
                continue  # it closes that node and is a part of it
            nodes[path.pop()[1]].last = k
        nodes.append(Node(k))
        nodes[path[-1][1]].children.append(len(nodes) - 1)
        path.append((depths[k], len(nodes) - 1))
    for _, n in path[1:]:
        nodes[n].last = len(lines)
    return nodes


def _cut_line(text: str, start: int, end: int, size: int) -> list[int]:
    """Ends of pieces of at most `size` characters in text[start:end], which has no line end but its last."""
    ends = []
    at = start
    while end - at > size:
        to = at + size
        low = at + max(1, size // 2)
        cut = max((text.rfind(c, low, to) for c in " \t"), default=-1)
        if cut < 0:
            cut = max((text.rfind(c, low, to) for c in ",;|)]}>/&."), default=-1)
        to = cut + 1 if cut >= low else to
        if text[to - 1 : to + 1] == "\r\n":
            to -= 1
        while to > at + 1 and unicodedata.combining(text[to]):
            to -= 1
        if to <= at:
            to = at + size
        ends.append(to)
        at = to
    ends.append(end)
    return ends


def core_ends(text: str, limit: int, kind: str = "code") -> list[int]:
    """Where the cores end, in characters, each core at most `limit` characters long."""
    if len(text) <= limit:
        return [len(text)]
    lines = text.split("\n")
    starts = [0]
    for ln in lines:
        starts.append(starts[-1] + len(ln) + 1)
    starts[-1] = len(text)
    nodes = parse(lines, kind)
    pieces: dict[int, list[int]] = {}  # node -> where the pieces of an oversized node end
    for n in range(len(nodes) - 1, -1, -1):  # children come before their parents
        node = nodes[n]
        lo, hi = starts[node.first], starts[node.last]
        if hi - lo <= limit:
            continue
        # What the node has of its own: its opening line, and for lack of children its other lines.
        own_end = nodes[node.children[0]].first if node.children else node.last
        units: list[tuple[int, int, int | None]] = [(starts[k], starts[k + 1], None) for k in range(node.first, own_end)]
        units += [(starts[nodes[c].first], starts[nodes[c].last], c) for c in node.children]
        if node.children and units[-1][1] < hi:  # lines that close it
            units += [(starts[k], starts[k + 1], None) for k in range(nodes[node.children[-1]].last, node.last)]
        ends: list[int] = []
        begun = lo
        opening = True  # nothing but the node's opening stands in the open piece
        for a, b, child in units:
            if b - a <= limit:
                if child is None and begun == a and ends and a >= starts[own_end] and b - (ends[-2] if len(ends) > 1 else lo) <= limit:
                    ends[-1] = begun = b  # it closes what the last piece ends with
                    continue
                if b - begun > limit:
                    ends.append(a)
                    begun = a
                opening &= child is None and b <= starts[own_end]
                continue
            below = list(pieces[child]) if child is not None else _cut_line(text, a, b, limit)
            if begun < a and not (opening and below[0] - begun <= limit):
                ends.append(a)
            ends += below
            begun, opening = b, False
        if begun < hi:
            ends.append(hi)
        pieces[n] = ends
    return pieces[0]


def split_text(text: str, first_line: int, max_tokens: int, overlap_tokens: int, kind: str | None = None) -> list[tuple]:
    """Rows of SCHEMA for one content. first_line: the number of the content's first line; kind: see form()."""
    limit = max_tokens * TOKEN_CHARS
    over = overlap_tokens * TOKEN_CHARS
    ends = core_ends(text, limit if len(text) <= limit else limit - over, kind or form(text))
    rows, at, line, line_at = [], 0, first_line, 0
    for k, to in enumerate(ends):
        start = max(0, at - over)
        piece = text[start:to]
        if start >= line_at:
            line += text.count("\n", line_at, start)
        else:
            line -= text.count("\n", start, line_at)
        line_at = start
        last = line + piece.count("\n") - (1 if piece.endswith("\n") else 0)
        rows.append((k + 1, len(ends), piece, at, to, at - start, -(-len(piece) // TOKEN_CHARS), line, max(line, last)))
        at = to
    return rows


def split_items(df: DataFrame, content: str, first_line: str | None = None, max_tokens: int = 2000, overlap_tokens: int = 0, oversized_only: bool = True, path: str | None = None) -> DataFrame:
    """df's columns but `content`, with the columns of SCHEMA: one row a piece.

    path: a column with the item's path, from whose extension follows how its structure is read; without it, or where it is
    null or has no extension, the text tells. Items within the limit yield no row if oversized_only, else one piece; null content yields none. An empty text is one
    empty piece. Columns of df that are named like those of SCHEMA are dropped in favour of these. The work is narrow but for spreading a table
    of fewer parts than there are cores, and only oversized rows leave the JVM.
    """
    if overlap_tokens < 0 or max_tokens < 1 or overlap_tokens >= max_tokens:
        raise ValueError("0 <= overlap_tokens < max_tokens is needed")
    made = [f.split()[0] for f in SCHEMA.split(", ")]
    keep = [c for c in df.columns if c != content and c not in made]
    line = F.coalesce(F.col(first_line).cast("bigint"), F.lit(1)) if first_line else F.lit(1).cast("bigint")
    src = df.where(F.col(content).isNotNull())
    if oversized_only:
        src = src.where(F.length(content) > max_tokens * TOKEN_CHARS)
    ext = extension(F.col(path)) if path else F.lit("")
    src = spread(src.select(*keep, F.col(content).alias("__text"), line.alias("__line"), ext.alias("__ext")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema), SCHEMA])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = keep + made
        for pdf in batches:
            kept = [pdf[c].tolist() for c in keep]
            rows: list[tuple] = []
            size = 0
            for i, (text, ln, ext) in enumerate(zip(pdf["__text"], pdf["__line"], pdf["__ext"])):
                head = tuple(c[i] for c in kept)
                for r in split_text(text, int(ln), max_tokens, overlap_tokens, form(text, ext)):
                    rows.append(head + r)
                    size += len(r[2])
                    if size > 16_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return src.mapInPandas(cut, schema)
