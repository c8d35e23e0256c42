"""Cleaning of annotated regions: character vocabulary, filters of noisy text, statistics of what was dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionlab.functions.text import CYRILLIC, characters

MAX_LENGTH = 260
MAX_UNKNOWN = 2
_LOOP = r"(?d)(.)\1{9,}"


def regions_long(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and every non-null region's ``idx`` and fields, one row each."""
    long = pages.select(*keep, F.posexplode("regions").alias("idx", "r")).where("r is not null")
    return long.select(*keep, "idx", "r.*")


def vocabulary(pages: DataFrame) -> DataFrame:
    """(``ch``) all distinct characters of region texts. Distinct within a row first: little is shuffled."""
    texts = F.flatten(F.transform(F.col("regions"), lambda r: characters(F.coalesce(r["text"], F.lit("")))))
    return pages.select(F.explode(F.array_distinct(texts)).alias("ch")).distinct()


def vocabulary_text(pages: DataFrame, most: int = 1_200_000) -> str:
    """The vocabulary as one string, for ``unknown_characters``. There are at most as many characters as code points."""
    return "".join(sorted(r[0] for r in vocabulary(pages).limit(most).collect()))


def unknown_characters(text: Column, known: str) -> Column:
    """Characters of ``text`` outside ``known``, counted as often as they occur."""
    return F.length(F.translate(text, known, "")) if known else F.length(text)


def is_clean_silver(r: Column, known: str, max_length: int = MAX_LENGTH, max_unknown: int = MAX_UNKNOWN) -> Column:
    """Text that is there, not overlong, without a character ten times in a row, with few unknown characters."""
    t = F.coalesce(r["text"], F.lit(""))
    return (t != "") & (F.length(t) <= max_length) & ~t.rlike(_LOOP) & (unknown_characters(t, known) <= max_unknown)


def is_clean_train(r: Column, max_length: int = MAX_LENGTH) -> Column:
    t = F.coalesce(r["text"], F.lit(""))
    return (t != "") & (F.length(t) <= max_length)


def filter_regions(pages: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Pages with the regions that ``keep`` holds true of; pages left without any are dropped. Null elements are not regions."""
    kept = F.filter(F.col("regions"), lambda r: r.isNotNull() & F.coalesce(keep(r), F.lit(False)))
    return pages.withColumn("regions", kept).where(F.size("regions") > 0)


STATS = ("input_regions", "kept_regions", "dropped_regions", "input_pages", "kept_pages", "dropped_empty_pages")


def filter_stats(pages: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """One row of ``STATS``, in one pass."""
    own = F.filter(F.coalesce(F.col("regions"), F.filter(F.col("regions"), lambda r: F.lit(False))), lambda r: r.isNotNull())
    counts = pages.select(
        F.coalesce(F.size(own), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter(F.col("regions"), lambda r: r.isNotNull() & F.coalesce(keep(r), F.lit(False)))), F.lit(0)).alias("k")
    ).select(F.greatest("n", F.lit(0)).alias("n"), F.greatest("k", F.lit(0)).alias("k"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(
        total("n").alias("input_regions"), total("k").alias("kept_regions"), (total("n") - total("k")).alias("dropped_regions"), F.count("*").alias("input_pages"),
        F.count_if(F.col("k") > 0).alias("kept_pages"), F.count_if(F.col("k") == 0).alias("dropped_empty_pages"),
    )


def suits_as_example(rtype: Column, text: Column) -> Column:
    """Texts of 8 to 120 characters without marks of deletion or doubt; written words need two Cyrillic letters."""
    n = F.length(text)
    plain = ~F.contains(text, F.lit("~~")) & ~F.contains(text, F.lit("["))
    words = F.regexp_count(text, F.lit(f"[{CYRILLIC}]")) >= 2
    return (n >= 8) & (n <= 120) & plain & (~rtype.isin("handwritten", "printed") | words)


def usable_as_example(r: Column) -> Column:
    return (F.coalesce(r["language"], F.lit("uk")) == "uk") & (F.coalesce(r["legibility"], F.lit("legible")) != "illegible") & ~F.coalesce(r["type"], F.lit("handwritten")).isin("image", "graph")


def shortest_examples(long: DataFrame, k: int = 6) -> DataFrame:
    """(``type``, ``rank``, ``text``): the ``k`` shortest distinct suitable texts of each type, ties by text.

    ``long``: regions in long form. Copies go first; Spark then keeps ``k`` a type in every partition before the shuffle by type.
    """
    rtype, text = F.coalesce("type", F.lit("handwritten")), F.trim(F.coalesce("text", F.lit("")))
    ok = long.select(rtype.alias("type"), text.alias("text"), usable_as_example(F.struct("language", "legibility", "type")).alias("u")).where("u")
    ok = ok.where(suits_as_example(F.col("type"), F.col("text"))).select("type", "text").distinct()
    w = Window.partitionBy("type").orderBy(F.length("text"), "text")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("type", "rank", "text")
