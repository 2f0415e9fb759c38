"""Scanning source trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lang import IGNORED, MAX_FILE_BYTES, SKIPPED_FOLDERS, detect_language, is_binary
from lodestone.functions.paths import extension


def ignore_rules(patterns: list[str]) -> list[tuple[bool, str]]:
    """(takes back, expression) of each pattern of an ignore list, in order. Comments and blank lines are left out.

    A pattern with a '/' that isn't its last character counts from the root, others at any depth; a match ignores all below
    it; '*' stays within a name, '**' doesn't, '?' is one character; '!' takes back.
    """
    rules = []
    for p in patterns:
        p = p.rstrip("\n").strip()
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p[1:] if back else p
        folder = p.endswith("/")
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.lstrip("/")
        out, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                out += "(?:.*/)?"
                i += 3
            elif p.startswith("**", i):
                out += ".*"
                i += 2
            elif p[i] == "*":
                out += "[^/]*"
                i += 1
            elif p[i] == "?":
                out += "[^/]"
                i += 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                out += "[" + p[i + 1 : j].replace("!", "^", 1) + "]"
                i = j + 1
            else:
                out += re.escape(p[i])
                i += 1
        rules.append((back, ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")))
    return rules


def is_ignored(relative: Column, patterns: list[str] | None = None) -> Column:
    """Whether a path is ignored by the defaults and then by a project's own patterns; the last rule that matches decides."""
    rules = ignore_rules([*IGNORED, *(patterns or [])])
    path = F.regexp_replace(relative, r"\\", "/")
    if not any(back for back, _ in rules):
        return path.rlike("|".join(f"(?:{rx})" for _, rx in rules))
    out = F.lit(False)
    for back, rx in rules:
        out = F.when(path.rlike(rx), F.lit(not back)).otherwise(out)
    return out


def in_skipped_folder(relative: Column) -> Column:
    names = "|".join(map(re.escape, SKIPPED_FOLDERS))
    return F.regexp_replace(relative, r"\\", "/").rlike(rf"(?:^|/)(?:{names})/")


def indexable(files: DataFrame, relative: str = "relativepath", size: str = "size_bytes", ext: str = "extension", patterns: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Rows that a scan keeps: not in a skipped folder, not ignored, not binary and not too large (an unknown size passes)."""
    keep = ~in_skipped_folder(F.col(relative)) & ~is_ignored(F.col(relative), patterns) & ~is_binary(F.coalesce(F.col(ext), F.lit("")))
    return files.where(keep & (F.coalesce(F.col(size), F.lit(0)) <= max_bytes))


#: A project's own list of what to ignore, at the root of its tree.
IGNORE_FILE = ".gitignore"


def plain_path(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub(r"^file:(?://)?(?=/)", "", path)


def project_patterns(spark: SparkSession, root: str) -> list[str]:
    """The lines of the tree's own ignore list; none if it has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
    finally:
        stream.close()


def wanted(path: Column, root: str, patterns: list[str] | None = None) -> Column:
    """Whether a file's path below root is none that a scan leaves out; the rule for events of a watcher too."""
    relative = F.substring(path, len(plain_path(root).rstrip("/")) + 2, 1 << 20)
    return ~in_skipped_folder(relative) & ~is_ignored(relative, patterns)


def list_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, relativepath, extension, language, size_bytes, mtime_ms) of the files below root that a scan keeps: a listing, no
    file is opened. The project's own ignore list counts before `patterns`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes).select("path", "length", "modificationTime")
    df = raw.withColumn("path", F.regexp_replace("path", r"^file:(?://)?(?=/)", ""))
    df = df.withColumn("relativepath", F.substring("path", len(plain_path(root).rstrip("/")) + 2, 1 << 20)).withColumn("extension", extension(F.col("path")))
    df = indexable(df, size="length", patterns=[*project_patterns(spark, root), *(patterns or [])], max_bytes=max_bytes)
    return df.select("path", "relativepath", "extension", detect_language(F.col("extension")).alias("language"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))


def read_files(listed: DataFrame) -> DataFrame:
    """listed (with `path`) and the `content` of each file, read where the tasks run; null for a file that can't be read.

    Only the files at hand are opened, whatever the tree holds beside them. Contents are decoded as UTF-8, what isn't is
    replaced.
    """
    from lodestone.session import spread

    fields = ", ".join(f"`{c}` {t}" for c, t in listed.dtypes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        systems: dict[str, fs.FileSystem] = {}
        for pdf in batches:
            for a in range(0, len(pdf), 64):  # so that few contents are held at a time
                part, out = pdf.iloc[a : a + 64].copy(), []
                for path in part["path"]:
                    uri = path if "://" in path else "file://" + path
                    base = re.match(r"[^:]+://[^/]*", uri).group(0)
                    try:
                        if base not in systems:
                            systems[base] = fs.LocalFileSystem() if base == "file://" else fs.FileSystem.from_uri(base + "/")[0]
                        where = uri[len("file://") :] if base == "file://" else uri[uri.index("://") + 3 :]
                        with systems[base].open_input_stream(where) as f:
                            out.append(f.read().decode("utf-8", "replace"))
                    except OSError:
                        out.append(None)
                part["content"] = np.array(out, dtype=object)
                yield part

    return spread(listed).mapInPandas(read, fields + ", content string")


def read_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The files of list_tree() with their content; those that can't be read are passed over."""
    return read_files(list_tree(spark, root, patterns, max_bytes)).where("content is not null")
