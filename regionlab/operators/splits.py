"""Reproducible splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_key(seed: int) -> str:
    return f":htr-cv-{seed}"  # fixed value: the suffix that is hashed with a file's name


def in_validation(file_name: Column, fraction: float = 0.10, seed: int = 42) -> Column:
    """Whether a file belongs to the validation part: the first 32 bits of its SHA-1 lie below ``fraction``. Null names do not."""
    h = F.conv(F.substring(F.sha1(F.concat(file_name, F.lit(split_key(seed))).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(h < F.lit(int(fraction * 2**32)), F.lit(False))


def hash_split(df: DataFrame, file_name: str = "file_name", fraction: float = 0.10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation). Membership depends on the name alone, so it is the same in every delivery and every stratum."""
    v = in_validation(F.col(file_name), fraction, seed)
    return df.where(~v), df.where(v)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random order of rows."""
    return df.orderBy(F.sha1(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key)


def sample_per_group(df: DataFrame, group: str, key: str, k: int = 1, seed: int = 42) -> DataFrame:
    """``k`` seeded random rows of every group (all columns)."""
    from pyspark.sql import Window

    h = F.sha1(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    w = Window.partitionBy(group).orderBy(h, key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def exclude(df: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not held out: keeps validation pages out of cleaned training data."""
    return df.join(held_out.select(key).distinct(), key, "left_anti")
