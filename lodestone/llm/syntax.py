"""Source files that aren't valid in the language that their extension stands for."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.files import assemble, scanned, with_text
from lodestone.llm.grammars import EXTENSIONS, Language, language

_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$")
#: Nesting beyond this is left unjudged.
DEPTH = 60_000


def _line_of(lang: Language, text: str, token: int) -> int:
    """The line, from 1, on which token number `token` begins."""
    tokens = lang.lex(text)
    if lang.name == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    at = 0
    for t in tokens[: token + 1]:
        if t == "/re/":
            continue
        k = text.find(t, at)
        if k >= 0:
            last, at = k, k + len(t)
    if token >= len(tokens):
        return text.rstrip().count("\n") + 1
    first = tokens[token]
    return text.count("\n", 0, last) + 1 + (len(first) - len(first.lstrip("\n")) if first[:1] == "\n" else 0)


class Unjudged(Exception):
    """A text whose nesting or number of different brackets is beyond the parser."""


def _valid(lang: Language, text: str) -> bool:
    """Whether text is valid; if the memo has no room left for it, it is parsed once more with an empty one."""
    try:
        return lang.valid(text)
    except MemoryError:
        lang.grammar.fresh(at_once=True)
    except RecursionError as e:
        lang.grammar.fresh(at_once=True)
        raise Unjudged from e
    try:
        return lang.valid(text)
    except (RecursionError, MemoryError) as e:
        lang.grammar.fresh(at_once=True)
        raise Unjudged from e


def _place(lang: Language, text: str) -> tuple[int, list[str], int] | None:
    """(token, tokens, line) at which an invalid text stops being parsed, sought once more with an empty memo; None if the parser
    can't tell."""
    for _ in range(2):
        try:
            token = lang.failure(text)
            return None if token is None else (token, lang.lex(text), _line_of(lang, text, token))
        except (RecursionError, MemoryError, IndexError, KeyError):
            lang.grammar.fresh(at_once=True)
    return None


def check(text: str, ext: str) -> tuple[str, int | None] | None:
    """None if text is valid for the extension, else (cause, line). Raises Unjudged if the parser can't tell.

    cause: conflict (a merge marker stands where parsing failed or before), truncated (the text ends too early),
    other_language (it is valid in another one), syntax, or unknown: the text is invalid, but the parser failed where it looked for
    the place, whose line is then null, or at another language.
    """
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    lang = language(EXTENSIONS[ext])
    if _valid(lang, text):
        return None
    place = _place(lang, text)
    known = place is not None
    token, tokens, line = place or (0, [], None)
    lines = text.split("\n")
    marks = [text.count("\n", 0, m.start()) + 1 for m in _CONFLICT.finditer(text)]
    if known and marks and min(marks) <= line + 1 and any(abs(m - line) <= 60 for m in marks):
        return "conflict", line
    for name in ("python", "go", "java", "typescript", "javascript"):
        if name != lang.name and not (name == "javascript" and lang.name == "typescript"):
            other = language(name)
            try:
                if len(text.strip()) > 40 and _valid(other, text):
                    return "other_language", line
            except Unjudged:
                known = False
    if not known:
        return "unknown", line
    if token >= len(tokens) - 1 or line >= len(lines) - 1:
        return "truncated", line
    return "syntax", line


def judge_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, repo, language, ext, judged, cause, line) of each scanned file whose extension has a grammar.

    judged is false where a chunk's content is missing, there is none or the parser can't tell; such files have no cause. cause is null for valid
    files. language falls back to that of the extension. A redelivered row counts once; a null path is passed over; an empty
    text is valid but for Go and Java's need of nothing either: an empty Go file is invalid, as it lacks its package clause.
    """
    known = scanned(files).where(F.col("ext").isin(*EXTENSIONS))
    src = with_text(known, chunks).select("path", "repo", "language", "ext", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, repo, lang, ext, parts in zip(pdf["path"], pdf["repo"], pdf["language"], pdf["ext"], pdf["parts"]):
                text = assemble(parts)
                judged, found = text is not None, None
                try:
                    found = check(text, ext) if judged else None
                except Unjudged:
                    judged = False
                rows.append((path, repo, lang or EXTENSIONS[ext], ext, judged, found[0] if found else None, found[1] if found else None))
            out = pd.DataFrame(rows, columns=["path", "repo", "language", "ext", "judged", "cause", "line"])
            out["line"] = out["line"].astype("Int64")
            yield out

    return src.mapInPandas(run, "path string, repo string, language string, ext string, judged boolean, cause string, line bigint")


def rates(judged: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate): of the files that could be judged."""
    bad = F.count(F.when(F.col("cause").isNotNull(), 1))
    return judged.where("judged").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))
