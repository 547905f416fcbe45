"""The registered project that a path belongs to, for many paths and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The columns of paths (path, ...) and project: that of the longest root (projects:
    name, root) with which the path begins, as text; null where there is none.

    A path is looked up by its beginnings of those lengths that a root has, an
    equi-join.  There are no more lengths than the longest root has characters.
    Of projects with one root the least name counts.  The empty root owns all.
    """
    roots = projects.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("name").alias("_name"))
    lengths = [r.n for r in roots.select(F.length("_root").alias("n")).distinct().orderBy("n").collect()]
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    distinct = paths.select("path").where("path is not null").distinct()
    begun = distinct.select("path", F.explode(fits).alias("_n")).withColumn("_root", F.expr("left(path, _n)"))
    best = begun.join(roots, "_root").groupBy("path").agg(F.max_by("_name", "_n").alias("project"))
    return paths.drop("project").join(best, "path", "left").select(*[c for c in paths.columns if c != "project"], "project")
