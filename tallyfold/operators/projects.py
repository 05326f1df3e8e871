"""Project directories: encoding, decoding against known directories, nearest ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import paths


def nearest_project(rows: DataFrame, key: str, path: str, projects: DataFrame) -> DataFrame:
    """For each path the deepest ancestor (or itself) that is a known project; NULL for none."""
    full = F.concat(paths.ancestors(F.col(path)), F.array(F.col(path)))
    tried = rows.select(key, F.posexplode(full).alias("depth", "project"))
    found = (
        tried.join(projects.select("project"), "project", "left_semi")
        .groupBy(key)
        .agg(F.max_by("project", "depth").alias("project"))
    )
    return rows.select(key, path).join(found, key, "left")


def decode_projects(encoded: DataFrame, directories: DataFrame) -> DataFrame:
    """Encoded names back to directories; answered only where exactly one directory fits."""
    known = (
        directories.select("directory").distinct()
        .groupBy(paths.encode_project(F.col("directory")).alias("encoded"))
        .agg(F.count(F.lit(1)).alias("candidates"), F.min("directory").alias("only"))
    )
    return encoded.join(known, "encoded", "left").select(
        "encoded",
        F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
        F.when(F.col("candidates") == 1, F.col("only")).alias("directory"),
    )
