"""Putting files together from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import canonical_path


def plain_extension(extension: Column) -> Column:
    """Lower case, without outer blanks and leading dot."""
    return F.lower(F.regexp_replace(F.trim(extension), r"^\.", ""))


def scanned(files: DataFrame) -> DataFrame:
    """(key, path, relativepath, ext, language, repo): one row a scanned path, whatever the order of redeliveries."""
    rows = files.select(
        canonical_path(F.col("path")).alias("key"), "path", "relativepath", plain_extension(F.col("extension")).alias("ext"), F.lower(F.trim("language")).alias("language"), "repo"
    ).where("key is not null")
    rest = F.min(F.struct("relativepath", "ext", "language", "repo")).alias("r")
    return rows.groupBy("key", "path").agg(rest).select("key", "path", "r.*")


def with_text(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with `parts`, the distinct (startline, content) of each file's chunks; null where it has none.

    chunks has filepath, startline, content. A file is as large as the scan lets it be (1 MiB by default), so its parts fit
    into one row; nothing else is gathered.
    """
    parts = (
        chunks.select(canonical_path(F.col("filepath")).alias("key"), F.struct(F.col("startline").alias("s"), F.col("content").alias("c")).alias("part"))
        .groupBy("key")
        .agg(F.collect_set("part").alias("parts"))
    )
    return files.join(parts, "key", "left")


def assemble(parts) -> str | None:
    """A file's text from its parts, lines between them empty; None if a part's content is missing or there is none.

    Of several parts that begin on one line the longest counts.
    """
    if parts is None or not len(parts):
        return None
    by_line: dict[int, str] = {}
    for p in parts:
        s, c = p["s"], p["c"]
        if c is None:
            return None
        s = 1 if s is None else int(s)
        if s not in by_line or len(c) > len(by_line[s]):
            by_line[s] = c
    out, line = [], 1
    for s in sorted(by_line):
        c = by_line[s]
        if out:
            out.append("\n" * max(0 if out[-1].endswith("\n") else 1, s - line))
            line = max(s, line)
        elif s > 1:
            out.append("\n" * (s - 1))
            line = s
        out.append(c)
        line = s + c.count("\n")
    return "".join(out)


def assemble_known(parts) -> str | None:
    """The same, but missing contents are passed over."""
    if parts is None:
        return None
    known = [p for p in parts if p["c"] is not None]
    return assemble(known)
