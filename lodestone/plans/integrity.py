"""Queries on references between the tables of the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import canonical_path
from lodestone.operators.orphans import DELETED, MISSING, Reference, hot_keys, judge_references, orphan_report, parent_intervals, references
from lodestone.sources.tables import table

#: References to one key beyond which it is divided, and the part of the rows by which such keys are found.
HOT, SAMPLE = 200_000, 16


def file_references() -> tuple[Reference, ...]:
    """The columns that name files; to_file of kind package names a package."""
    is_file = F.coalesce(F.lower(F.trim("kind")), F.lit("")) != "package"
    return (
        Reference("call_edges", "callee_file"),
        Reference("dependency_edges", "from_file"),
        Reference("dependency_edges", "to_file", where=is_file),
    )


def file_sightings(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, at, deleted): a files row is a sighting at last_indexed, a file_changes row one at changed_at."""
    a = files.select(canonical_path(F.col("path")).alias("key"), F.timestamp_millis("last_indexed").alias("at"), F.lit(False).alias("deleted"))
    b = changes.select(
        canonical_path(F.col("path")).alias("key"),
        F.col("changed_at").cast("timestamp").alias("at"),
        (F.coalesce(F.lower(F.trim("change_type")), F.lit("")) == "deleted").alias("deleted"),
    )
    return a.unionByName(b)


def judged_file_references(spark: SparkSession, folder: str) -> DataFrame:
    frames = {
        "call_edges": table(spark, folder, "call_edges", "id", "callee_file", "indexed_at"),
        "dependency_edges": table(spark, folder, "dependency_edges", "id", "from_file", "to_file", "kind", "indexed_at"),
    }
    # Which keys are hot is told by every 16th row, whose paths alone are brought to one spelling for it.
    sample = references({t: df.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0) for t, df in frames.items()}, file_references())
    seen = file_sightings(table(spark, folder, "files", "path", "last_indexed"), table(spark, folder, "file_changes", "path", "change_type", "changed_at"))
    return judge_references(references(frames, file_references()), parent_intervals(seen), few=hot_keys(sample, HOT, one_in=SAMPLE))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, edge_id, ref_field): references whose file doesn't exist when all data is in."""
    return judged_file_references(spark, folder).where(F.col("verdict").isin(MISSING, DELETED)).select("tab", "edge_id", "ref_field").distinct()


def p2_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, ref_field, period, verdict, n): orphan references, redelivered rows counted once; late ones are told apart."""
    once = judged_file_references(spark, folder).dropDuplicates(["tab", "edge_id", "ref_field"])
    return orphan_report(once)
