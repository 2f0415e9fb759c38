"""References to records that don't exist: missing, deleted or arriving late.

A parent exists in the intervals between a sighting and the deletion that follows it. References and these intervals are
brought to one spelling of the key, co-partitioned and sorted by key and time, and both streams are merged in one linear pass:
each reference takes the state that its parent was in at its time. Sightings are reduced to changes of state before that, day
by day and then by key, so a key with a third of all sightings costs no more than another. Keys with very many references are
split by a salt, for which their parents' few intervals are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestone.functions.paths import canonical_path

#: Verdicts on a reference.
MISSING, DELETED, LATE, VALID = "missing", "deleted", "late", "valid"


@dataclass(frozen=True)
class Reference:
    """A column of a table that names a key elsewhere. `where` limits it to the rows in which it does."""

    table: str
    field: str
    id: str = "id"
    at: str = "indexed_at"
    where: Column | None = None


def references(frames: dict[str, DataFrame], refs: Sequence[Reference], key=canonical_path) -> DataFrame:
    """(tab, edge_id, ref_field, key, at): each reference once, however often its row was delivered.

    Null and blank values are no references. Extra columns of the tables are never read, so their names can't clash.
    """
    parts = []
    for t in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == t]
        made = F.array(
            *[
                F.struct(
                    F.lit(r.field).alias("ref_field"),
                    F.when(r.where if r.where is not None else F.lit(True), key(F.col(r.field))).alias("key"),
                    F.col(r.id).cast("bigint").alias("edge_id"),
                    F.col(r.at).cast("timestamp").alias("at"),
                )
                for r in own
            ]
        )
        parts.append(frames[t].select(F.lit(t).alias("tab"), F.explode(made).alias("r")).select("tab", "r.*").where("key is not null"))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("tab", "edge_id", "ref_field", "key", "at")


#: Before and after all times.
EVER, NEVER = "0002-01-01 00:00:00", "9999-12-31 00:00:00"


def parent_intervals(sightings: DataFrame) -> DataFrame:
    """(key, since, until, gone) from sightings (key, at, deleted): a row for each interval [since, until) in which the parent
    exists; until is null while it does. A key that was only ever deleted has one row without since. gone: whether the latest
    sighting is a deletion.

    Of sightings at one instant a deletion is the later. A sighting without a time counts as the earliest. Repeated rows
    change nothing. No group is gathered: windows read their partitions once, in order of time.
    """
    t = F.coalesce(F.col("at").cast("timestamp"), F.lit(EVER).cast("timestamp"))
    seen = sightings.where("key is not null").select("key", t.alias("t"), F.to_date(t).alias("day"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    once = seen.repartition("key", "day").groupBy("key", "day", "t").agg(F.max("deleted").alias("deleted"))

    def changes(df: DataFrame, w: WindowSpec) -> DataFrame:
        was = F.lag("deleted").over(w)
        return df.withColumn("was", was).where(F.col("was").isNull() | (F.col("was") != F.col("deleted"))).drop("was")

    by_day, by_key = Window.partitionBy("key", "day").orderBy("t"), Window.partitionBy("key").orderBy("t")
    turns = changes(changes(once, by_day), by_key)  # what is left of a key alternates
    last = F.max(F.struct("t", "deleted")).over(Window.partitionBy("key"))
    turns = turns.withColumns({"until": F.lead("t").over(by_key), "gone": last["deleted"], "only": F.min("deleted").over(Window.partitionBy("key"))})
    return turns.where("not deleted or only").select("key", F.when(~F.col("deleted"), F.col("t")).alias("since"), F.when(~F.col("deleted"), F.col("until")).alias("until"), "gone")


def hot_keys(refs: DataFrame, hot: int, most: int = 10_000, one_in: int = 1) -> DataFrame:
    """(hot_key, salts): the keys with over `hot` references, at most the `most` largest of them. refs may be a sample of
    every `one_in`th reference: the list only divides work, and changes no result.

    Whatever the input's size, a key that isn't among them has at most about `hot` or 1/most of all references. The counts are
    aggregated before and after the shuffle; only the hot keys themselves, at most `most` rows, come to the driver.
    """
    spark = refs.sparkSession
    n = refs.groupBy("key").agg((F.count(F.lit(1)) * one_in).alias("n")).where(F.col("n") > hot)
    rows = [(r["key"], -(-r["n"] // hot)) for r in n.orderBy(F.desc("n"), "key").limit(most).collect()]
    return spark.createDataFrame(rows, "hot_key string, salts int")


def judge_references(refs: DataFrame, parents: DataFrame, hot: int = 200_000, few: DataFrame | None = None) -> DataFrame:
    """refs with a column `verdict`, for every reference.

    missing: no sighting of the key; deleted: the latest sighting is a deletion; late: the parent exists in the end, but
    didn't at the time of the reference, as it wasn't there yet or had been deleted for a while; valid: else, also if the
    reference has no time.

    parents: as of parent_intervals(). few: as of hot_keys(), by default counted over refs; it is broadcast, as its length is
    bounded. References to its keys are spread over several tasks, for each of which the key's intervals are repeated.
    """
    few = F.broadcast(few if few is not None else hot_keys(refs, hot))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    ever, never = F.lit(EVER).cast("timestamp"), F.lit(NEVER).cast("timestamp")
    state = lambda at, there: F.struct(at.alias("t"), there.alias("there"))
    p = parents.join(few, F.col("key") == F.col("hot_key"), "left")
    p = p.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "gone", F.array(state(ever, F.col("since") <= ever), state(F.col("since"), F.lit(True)), state(F.col("until"), F.lit(False))).alias("s"))
    p = p.select("key", "salt", "gone", F.inline("s")).where("t is not null")
    none = [F.lit(None).cast(t).alias(c) for c, t in refs.dtypes if c != "key"]
    turns = p.select("key", *none, "salt", "t", F.coalesce("there", F.lit(False)).cast("int").alias("what"), F.struct(F.coalesce("there", F.lit(False)).alias("there"), "gone").alias("state"))
    own = refs.join(few, F.col("key") == F.col("hot_key"), "left").select(
        "key",
        *[refs[c] for c in refs.columns if c != "key"],
        F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("tab", "edge_id", "ref_field"), salts)).cast("int").alias("salt"),
        F.coalesce("at", never).alias("t"),
        F.lit(2).alias("what"),  # after what changes at its time
        F.lit(None).cast("struct<there:boolean,gone:boolean>").alias("state"),
    )
    w = Window.partitionBy("key", "salt").orderBy("t", "what").rowsBetween(Window.unboundedPreceding, 0)
    merged = turns.unionByName(own).withColumn("state", F.last("state", ignorenulls=True).over(w)).where("what = 2")
    verdict = F.when(F.col("state").isNull(), MISSING).when(F.col("state.gone"), DELETED).when(~F.col("state.there"), LATE).otherwise(VALID)
    return merged.select(*refs.columns, verdict.alias("verdict"))


def orphan_report(judged: DataFrame) -> DataFrame:
    """(tab, ref_field, period, verdict, n): orphan references by table, field and month of indexed_at, 'unknown' if null."""
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return judged.where(F.col("verdict") != VALID).groupBy("tab", "ref_field", period.alias("period"), "verdict").agg(F.count(F.lit(1)).alias("n"))
