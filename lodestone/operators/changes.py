"""Change detection: which files are new, changed, unchanged or stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash


def latest_state(files: DataFrame) -> DataFrame:
    """One row a path: the state indexed last; of states indexed at once the one with the greater hash."""
    rest = [c for c in files.columns if c not in ("path", "last_indexed", "hash")]
    top = F.max_by(F.struct("last_indexed", "hash", *rest), F.struct(F.coalesce("last_indexed", F.lit(-1)), F.coalesce("hash", F.lit(""))))
    return files.where("path is not null").groupBy("path").agg(top.alias("s")).select("path", "s.*").select(*files.columns)


def last_event(changes: DataFrame, key: str = "path", kind: str = "change_type", at: str = "changed_at", seq: str = "change_id") -> DataFrame:
    """(key, kind, at) of each key's last event: later events undo earlier ones. Order is by time, then by sequence."""
    top = F.max_by(F.struct(F.col(kind).alias("kind"), F.col(at).alias("at")), F.struct(F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-1)), F.coalesce(F.col(seq), F.lit(-1))))
    return changes.groupBy(key).agg(top.alias("e")).select(key, F.col("e.kind").alias(kind), F.col("e.at").alias(at))


def changed_set(changes: DataFrame) -> DataFrame:
    """(path) of files whose last event isn't a deletion: changed together with untracked ones."""
    return last_event(changes).where(F.col("change_type") != "deleted").select("path")


def stale(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows whose file the scan didn't find; all of them if the scan found nothing."""
    return stored.join(scanned.select(key).distinct(), key, "left_anti")


def to_read(listing: DataFrame, stored: DataFrame, changed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """listing (path, mtime_ms) with `stored_hash` and `status`, by the tiers that need no content.

    stored: path, hash, last_indexed, one row a path. changed: path of files that version control reports. new: never
    indexed; skipped_mtime: not in changed and not modified since it was indexed (an unknown mtime never skips); forced: all
    others with force; check: else, the content has to tell.
    """
    s = stored.select(F.col("path").alias("__p"), F.col("hash").alias("stored_hash"), F.col("last_indexed").alias("__at"))
    df = listing.join(s, F.col("path") == F.col("__p"), "left")
    touched = F.lit(False)
    if changed is not None:
        df = df.join(changed.select(F.col("path").alias("__c")).distinct(), F.col("path") == F.col("__c"), "left")
        touched = F.col("__c").isNotNull()
    status = F.when(F.col("stored_hash").isNull(), "new").when(F.lit(force), "forced").when(~touched & (F.col("mtime_ms") <= F.col("__at")), "skipped_mtime").otherwise("check")
    return df.select(*listing.columns, "stored_hash", status.alias("status"))


def by_content(read: DataFrame) -> DataFrame:
    """read (as of to_read(), with `content` or `hash`) with `new_hash`, and its status settled: new, changed or unchanged."""
    h = F.col("hash") if "hash" in read.columns else content_hash(F.col("content"))
    df = read.withColumn("new_hash", h)
    settled = F.when(F.col("status") == "forced", "changed").when(F.col("status") != "check", F.col("status")).when(F.col("new_hash") == F.col("stored_hash"), "unchanged").otherwise("changed")
    return df.withColumn("status", settled).drop("stored_hash")


def classify(scan: DataFrame, stored: DataFrame, changed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """scan (path, mtime_ms, content or hash) with `new_hash` and `status`, all tiers at once: new, changed, unchanged or
    skipped_mtime. Where contents are yet to be read, to_read() tells which are needed."""
    return by_content(to_read(scan, stored, changed, force)).select(*scan.columns, "new_hash", "status")


def changed_or_new(scan: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Scanned rows that are reported as changed or have no stored hash; all rows if there would be none."""
    known = stored.where("hash is not null").select("path").distinct()
    c = changed.select("path").distinct().withColumn("__c", F.lit(True))
    k = known.withColumn("__k", F.lit(True))
    kept = scan.join(c, "path", "left").join(k, "path", "left").where(F.col("__c").isNotNull() | F.col("__k").isNull()).select(*scan.columns)
    return scan if kept.isEmpty() else kept


def run_summary(classified: DataFrame) -> DataFrame:
    """(indexed, skipped_mtime, skipped_hash): one row; files skipped by either tier are reported."""
    n = lambda s: F.count(F.when(F.col("status").isin(*s), 1))
    return classified.agg(n(("new", "changed")).alias("indexed"), n(("skipped_mtime",)).alias("skipped_mtime"), n(("unchanged",)).alias("skipped_hash"))
