"""Version control as a data source: `spark.read.format("lodestone_git")` after `register(spark)`.

Options: path (the working tree), what ("changes", "commits" or "tracked"), since (for commits: hours, days or weeks as 24h, 7d,
2w), since_ms (for changes: also what was committed after that time), limit. A tree without version control has no rows; any
other failure raises. The working tree must be readable where tasks run.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

TIMEOUT = 10


def git(root: str, *args: str) -> list[str]:
    """The lines that git prints; raises if it fails."""
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=TIMEOUT, check=True).stdout
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"git {args[0]} failed in {root}: {e.stderr.strip()}") from e
    return [ln for ln in out.split("\n") if ln.strip()]


def is_repository(root: str) -> bool:
    try:
        return bool(git(root, "rev-parse", "--git-dir"))
    except (RuntimeError, OSError, subprocess.SubprocessError):
        return False


def tracked(root: str) -> list[str]:
    return [ln.strip() for ln in git(root, "ls-files")]


def changed_paths(root: str, since_ms: int | None = None) -> dict[str, str]:
    """Relative path -> changed, deleted or untracked: what differs from the last commit, and with since_ms also what commits
    after that time touched, which is told by the history of the head and settled by whether the file is there."""
    out: dict[str, str] = {}
    if git(root, "rev-list", "--all", "--max-count=1"):
        out |= {p: "deleted" for p in git(root, "diff", "--name-only", "--diff-filter=D", "HEAD")}
        out |= {p: "changed" for p in git(root, "diff", "--name-only", "--diff-filter=ACMR", "HEAD")}
        if since_ms is not None:
            before = git(root, "rev-list", "-1", f"--before={max(since_ms // 1000, 100_000_000)}", "HEAD")
            then = before[0] if before else git(root, "hash-object", "-t", "tree", os.devnull)[0]  # else all there is is new
            for p in git(root, "diff", "--name-only", then, "HEAD"):
                out.setdefault(p, "changed" if os.path.exists(os.path.join(root, p)) else "deleted")
    for p in git(root, "ls-files", "--others", "--exclude-standard"):
        out.setdefault(p, "untracked")
    return out


def window_seconds(since: str) -> int:
    """24h, 7d, 2w in seconds."""
    m = re.fullmatch(r"(\d+)([hdw])", since.strip())
    if not m:
        raise ValueError(f"not a time window: {since!r}")
    return int(m.group(1)) * {"h": 3600, "d": 86_400, "w": 604_800}[m.group(2)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", ".")
        self.what = options.get("what", "changes")
        self.since = options.get("since")
        self.since_ms = options.get("since_ms")
        self.limit = int(options.get("limit", "20"))

    def read(self, partition) -> Iterator[tuple]:
        if not is_repository(self.root):
            return
        if self.what == "tracked":
            for p in tracked(self.root):
                yield p, "tracked"
        elif self.what == "commits":
            if not git(self.root, "rev-list", "--all", "--max-count=1"):
                return
            args = ["log", "--shortstat", "--format=%x01%H%x09%ct%x09%s", "-n", str(self.limit)]
            if self.since:
                args.append(f"--since={window_seconds(self.since)} seconds ago")
            for entry in "\n".join(git(self.root, *args)).split("\x01")[1:]:
                head, *stat = entry.split("\n")
                h, at, subject = head.split("\t", 2)
                n = {w: int(k) for k, w in re.findall(r"(\d+) (file|insertion|deletion)", " ".join(stat))}
                yield h, int(at) * 1000, subject, n.get("file", 0), n.get("insertion", 0), n.get("deletion", 0)
        else:
            for p, kind in sorted(changed_paths(self.root, int(self.since_ms) if self.since_ms else None).items()):
                yield p, kind


class GitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_git"

    def schema(self) -> str:
        return "hash string, at_ms bigint, message string, files int, insertions int, deletions int" if self.options.get("what") == "commits" else "path string, change_type string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitDataSource)
