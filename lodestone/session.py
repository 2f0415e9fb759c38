"""Session defaults and the durable scratch area."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the engine's defaults: UTC, adaptive execution and Arrow transfer.

    Settings already given to a running session are kept, so on a cluster the submitter decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in which lineage is cut.

    `spark.checkpoint.dir` is read from the session and must be shared by all executors. Only where it is unset, as in
    local tests, a temporary folder takes its place; with a cluster master that is an error, since another machine couldn't
    read it.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_scratch = path
    return out


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized df that nothing reads any more. Those that aren't released go with the JVM."""
    path = getattr(df, "_lodestone_scratch", None)
    if path:
        where, fs = _hadoop(df.sparkSession, path)
        fs.delete(where, True)


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 2)


_shipped: set[str] = set()


def package_archive(home: str) -> bytes:
    """A zip of the package's sources below `home`. Nothing is compiled and nothing is written beside them, so the package
    may lie on a read-only disk."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, inner, names in os.walk(home):
            inner.sort()
            for n in sorted(names):
                if n.endswith(".py"):
                    where = os.path.join(folder, n)
                    z.write(where, os.path.relpath(where, os.path.dirname(home)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python finds it wherever they run.

    The archive, about 100 KB, goes to the folder that the cluster shares (see scratch_dir) and is deleted with the JVM.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):  # else it runs from an archive already
        where, fs = _hadoop(spark, f"{scratch_dir(spark)}/lodestone-{uuid.uuid4().hex}.zip")
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(package_archive(home)))
        finally:
            stream.close()
        fs.deleteOnExit(where)
        sc.addPyFile(where.toString())
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work a row: repartitioned if its scan has fewer tasks than the cluster has cores, as
    when a table is one file of one row group. Otherwise it is left as it is, and nothing is shuffled."""
    want = default_parallelism(df.sparkSession)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def data_root() -> str:
    """Where entry() finds the small sample; LODESTONE_DATA overrides it."""
    return os.environ.get("LODESTONE_DATA", "/root/testdata")
