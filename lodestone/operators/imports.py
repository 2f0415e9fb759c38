"""Resolving relative imports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import canonical_path
from lodestone.functions.text import is_relative_import

# Endings that are tried in order, index files of a folder, and Python's.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx")
PYTHON = (".py", "/__init__.py")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (from_file, source_path, symbols, line) with `to_file`, only those that name a known file (files.path).

    Each import stands for a short list of candidates in order of preference: the path itself, with each ending, as a
    folder's index file, then .js as .ts or .tsx. The first that exists wins. Bare package names are passed over.
    """
    folder = F.regexp_replace("from_file", r"/[^/]*$", "")
    target = canonical_path(F.when(F.col("source_path").startswith("/"), F.col("source_path")).otherwise(F.concat(folder, F.lit("/"), F.col("source_path"))))
    stem = F.regexp_replace("target", r"\.js$", "")
    tries = [F.col("target"), *[F.concat("target", F.lit(e)) for e in ENDINGS], *[F.concat("target", F.lit("/" + i)) for i in INDEX_FILES]]
    tries += [F.when(F.col("target").endswith(".js"), F.concat(stem, F.lit(e))) for e in (".ts", ".tsx")]
    tries += [F.concat("target", F.lit(e)) for e in PYTHON]
    keyed = imports.where(is_relative_import(F.col("source_path"))).withColumn("target", target)
    # Imports are told apart by what they name, so a task that runs again gives the same, and each name is looked up once.
    cand = keyed.select("target").distinct().select("target", F.posexplode(F.array(*tries)).alias("rank", "path")).where("path is not null")
    known = files.select("path").distinct()
    first = cand.join(known, "path").groupBy("target").agg(F.min_by("path", "rank").alias("to_file"))
    return keyed.join(first, "target").select(*imports.columns, "to_file")
