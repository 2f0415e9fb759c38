"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand around a path without being part of it.
OUTER = r"^[\s ﻿]+|[\s ﻿]+$"


def canonical_path(path: Column) -> Column:
    """One spelling for each file.

    Outer blanks go, separators of either kind and any number become one '/', '.' segments vanish and '..' takes its
    parent with it; a trailing separator goes; letter case stays. '..' above an absolute root vanishes, above a relative
    start it stays. Null and blank give null. Only paths with dot segments pay for the segment fold.
    """
    flat = F.regexp_replace(F.regexp_replace(path, OUTER, ""), r"[\\/]+", "/")
    root = F.when(flat.startswith("/"), "/").otherwise("")

    def step(done: Column, seg: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (
            F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(flat.startswith("/"), done)
            .otherwise(F.array_append(done, seg))
        )
        return F.when(seg.isin("", "."), done).when(seg == "..", up).otherwise(F.array_append(done, seg))

    empty = F.array().cast("array<string>")
    folded = F.concat(root, F.array_join(F.aggregate(F.split(flat, "/"), empty, step), "/"))
    dotted = flat.rlike(r"(^|/)\.{1,2}(/|$)")
    clean = F.when(dotted, folded).otherwise(F.when(F.length(flat) > 1, F.regexp_replace(flat, "/$", "")).otherwise(flat))
    return F.when(F.length(clean) > 0, clean)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased extension without its dot, '' if there is none; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(basename(name), r"[^.]\.([^.]*)$", 1))
