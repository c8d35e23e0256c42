"""Profiles of annotated pages and region texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlab.functions.text import alphabet
from regionlab.operators.records import REGION_TYPES
from regionlab.operators.scoring import is_scorable


def source_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("source", F.lit("_")).alias("source")).agg(F.count("*").alias("n"))


def with_shape(pages: DataFrame) -> DataFrame:
    """``aspect_ratio``, ``megapixels`` (null without a size) and ``num_regions``."""
    w, h = F.col("image_width").cast("double"), F.col("image_height").cast("double")
    return pages.withColumns({"aspect_ratio": F.try_divide(w, h), "megapixels": w * h / 1e6, "num_regions": F.greatest(F.coalesce(F.size("regions"), F.lit(0)), F.lit(0))})


def source_profile(pages: DataFrame) -> DataFrame:
    mean = lambda c: F.bround(F.avg(c), 2).alias(f"mean_{c}")
    return with_shape(pages).groupBy("source").agg(
        F.count("*").alias("pages"), F.sum("num_regions").alias("regions"), *[mean(c) for c in ("num_regions", "image_width", "image_height", "aspect_ratio", "megapixels")]
    )


def type_crosstab(long: DataFrame) -> DataFrame:
    """A row per source, a column per region type. The types are fixed, so no pass is spent on finding them."""
    return long.groupBy("source").pivot("type", list(REGION_TYPES)).count().na.fill(0, list(REGION_TYPES))


def scorable_share(long: DataFrame) -> DataFrame:
    """Regions of each source and the percentage that counts in scores; null for sources of which none does."""
    ok = is_scorable(F.struct("type", "language", "legibility"))
    by = long.groupBy("source").agg(F.count("*").alias("regions"), F.count_if(ok).alias("scorable"))
    return by.withColumn("percent", F.when(F.col("scorable") > 0, F.bround(F.col("scorable") * 100.0 / F.col("regions"), 1)))


def usable_texts(long: DataFrame) -> DataFrame:
    """Legible Ukrainian texts that are there; rows of null fields do not count."""
    return long.where((F.col("language") == "uk") & (F.col("legibility") == "legible") & ~F.col("type").isin("image", "graph") & F.coalesce(F.col("text") != "", F.lit(False)))


def length_stats(long: DataFrame) -> DataFrame:
    n = F.length("text")
    return long.where(F.coalesce(F.col("text") != "", F.lit(False))).groupBy("source").agg(F.bround(F.avg(n), 1).alias("mean"), F.max(n).alias("longest"), F.min(n).alias("shortest"))


def length_percentiles(long: DataFrame, below: int = 1000) -> DataFrame:
    """Exact percentiles with linear interpolation; lengths are few distinct values, which is what the aggregate holds."""
    n = long.where(F.coalesce(F.col("text") != "", F.lit(False))).select("source", F.length("text").alias("n")).where(F.col("n") < below)
    p = n.groupBy("source").agg(F.percentile("n", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias("p"))
    return p.select("source", *[F.col("p")[i].alias(c) for i, c in enumerate(("p90", "p95", "p99"))])


def character_counts(long: DataFrame, *by: str) -> DataFrame:
    """(``by``, ``ch``, ``n``). The characters are counted in every partition before anything is shuffled."""
    return long.where("text is not null").select(*by, F.explode(F.split("text", "")).alias("ch")).where("ch != ''").groupBy(*by, "ch").agg(F.count("*").alias("n"))


def alphabet_counts(counts: DataFrame) -> DataFrame:
    """Distinct characters of each class."""
    return counts.groupBy(alphabet(F.col("ch")).alias("alphabet")).agg(F.count("*").alias("characters"))


def rarest(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.where(alphabet(F.col("ch")) == "cyrillic").orderBy("n", "ch").limit(k)


def only_in(counts: DataFrame, source: str) -> DataFrame:
    """Characters that texts of no other source hold. ``counts`` by ``source``."""
    here, there = counts.where(F.col("source") == source), counts.where(~F.col("source").eqNullSafe(source))
    return here.select("ch").join(there.select("ch").distinct(), "ch", "left_anti")


def marked(long: DataFrame, mark: str = "~~") -> DataFrame:
    return long.groupBy("source").agg(F.count_if(F.contains(F.col("text"), F.lit(mark))).alias("marked"))


def outlier_files(long: DataFrame, longer_than: int) -> DataFrame:
    return long.where(F.length("text") > longer_than).select("file_name").distinct()


def region_count_stats(pages: DataFrame) -> DataFrame:
    n = F.col("num_regions")
    return with_shape(pages).agg(F.min(n).alias("least"), F.median(n).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("most"))
