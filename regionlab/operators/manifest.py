"""Joins that line up pages, predictions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlab.functions.text import basename


def aligned(submission: DataFrame, solution: DataFrame, image: str = "image") -> DataFrame:
    """Rows of ``submission`` whose image is in ``solution``, and a row of ``[]`` for every image of the solution that it lacks."""
    wanted = solution.select(image).distinct()
    kept = submission.join(wanted, image, "left_semi")
    lacking = wanted.join(submission.select(image), image, "left_anti").withColumn("regions", F.lit("[]"))
    return kept.select(image, "regions").unionByName(lacking)


def missing(solution: DataFrame, submission: DataFrame, image: str = "image") -> DataFrame:
    return solution.select(image).distinct().join(submission.select(image), image, "left_anti")


def manifest(ids: DataFrame, metadata: DataFrame, order: str, image: str = "image", fallback: str = "images/") -> DataFrame:
    """(``image``, ``file_name``, ``source``, ``known``) of every id: of several metadata rows of a name the last by ``order``.

    Ids without metadata get a path under ``fallback`` and the source ``unknown``. The last row is found by ``max_by`` before the
    shuffle; both sides then join on the name, broadcast only if Spark finds one small.
    """
    named = metadata.where(F.col("file_name").isNotNull()).select(basename(F.col("file_name")).alias(image), F.struct("file_name", "source").alias("m"), F.col(order).alias("__o"))
    last = named.groupBy(image).agg(F.max_by("m", "__o").alias("m"))
    j = ids.select(image).join(last, image, "left")
    known = F.col("m").isNotNull()
    path = F.coalesce(F.col("m.file_name"), F.concat(F.lit(fallback), F.col(image)))
    return j.select(image, path.alias("file_name"), F.when(known, F.col("m.source")).otherwise("unknown").alias("source"), known.alias("known"))


def pending(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Pages without a result yet: a run that was broken off goes on where it stopped."""
    return pages.join(done.select(key), key, "left_anti")


def tagged_union(parts: dict[str, DataFrame], tag: str = "_origin") -> DataFrame:
    """All rows of all parts with the part's name; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def numbered_shards(df: DataFrame, key: str | Column, shards: int) -> DataFrame:
    """``shard`` 0..shards-1 of every row by the MD5 of its key as text, the same in any engine: independent runs share the work without a global sort.

    Null keys lie in shard 0.
    """
    k = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(k.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("shard", F.coalesce(F.pmod(number, F.lit(shards)), F.lit(0)).cast("int"))
