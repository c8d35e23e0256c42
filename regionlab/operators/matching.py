"""One-to-one matching of boxes and non-maximum suppression, as folds over arrays within one page's row.

Both are sequential by nature: what is kept depends on what was kept before. A page holds tens of regions, so the folds run inside the
row, over a total order with the array position as tie-break, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlab.functions.geometry import iou, overlaps

MATCH = "array<struct<gi:int,pi:int,iou:double>>"


def candidate_pairs(gt: Column, pred: Column, threshold: float) -> Column:
    """All (cost = -iou, gi, pi) with an IoU of at least ``threshold``, best first, then by position. Regions need a ``bbox``."""

    def of(g: Column, gi: Column) -> Column:
        pairs = F.transform(pred, lambda p, pi: F.struct((-F.when(overlaps(g["bbox"], p["bbox"]), iou(g["bbox"], p["bbox"])).otherwise(0.0)).alias("cost"), gi.cast("int").alias("gi"), pi.cast("int").alias("pi")))
        return F.filter(pairs, lambda x: x["cost"] <= -threshold)

    return F.array_sort(F.flatten(F.transform(gt, of)))


def greedy_match(gt: Column, pred: Column, threshold: float = 0.5) -> Column:
    """``MATCH``: pairs accepted best first while both sides are free; ties go to the lower gt position, then the lower pred position."""

    def accept(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["gi"] == x["gi"]) | (k["pi"] == x["pi"]))
        return F.when(taken, kept).otherwise(F.array_append(kept, F.struct(x["gi"].alias("gi"), x["pi"].alias("pi"), (-x["cost"]).alias("iou"))))

    return F.aggregate(candidate_pairs(gt, pred, threshold), F.array().cast(MATCH), accept)


def join_matches(gt: DataFrame, pred: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(``key``, ``gi``, ``pi``, ``iou``) of long tables (``key``, ``idx``, ``bbox``): the pairs of the threshold join, before assignment.

    An equi-join on the page with the overlap as residual, for pages too large for one row.
    """
    g = gt.select(key, F.col("idx").alias("gi"), F.col("bbox").alias("gb"))
    p = pred.select(key, F.col("idx").alias("pi"), F.col("bbox").alias("pb"))
    pairs = g.join(p, key).where(overlaps(F.col("gb"), F.col("pb")))
    return pairs.withColumn("iou", iou(F.col("gb"), F.col("pb"))).where(F.col("iou") >= threshold).select(key, "gi", "pi", "iou")


def suppressed(regions: Column, threshold: float = 0.5, types: tuple[str, ...] | None = None) -> Column:
    """Positions (ascending) that non-maximum suppression keeps.

    Within each type, by falling area, then position: a box stays if its IoU with every box that stayed is below ``threshold``. Regions
    of a type outside ``types`` (default: none is exempt), of a null type or without a usable box all stay.
    """
    exempt = lambda r: r["type"].isNull() | r["bbox"].isNull() | (F.size(r["bbox"]) != 4) | (~r["type"].isin(*types) if types else F.lit(False))
    area = lambda b: F.greatest(F.lit(0.0), (b[2] - b[0]).cast("double")) * F.greatest(F.lit(0.0), (b[3] - b[1]).cast("double"))
    item = F.transform(regions, lambda r, i: F.struct(F.when(exempt(r), 0.0).otherwise(-area(r["bbox"])).alias("a"), i.cast("int").alias("i"), exempt(r).alias("e"), r["type"].alias("t"), F.transform(r["bbox"], lambda v: v.cast("double")).alias("b")))
    kept_type = "array<struct<i:int,e:boolean,t:string,b:array<double>>>"

    def keep(kept: Column, x: Column) -> Column:
        clear = x["e"] | F.forall(kept, lambda k: k["e"] | (k["t"] != x["t"]) | (iou(k["b"], x["b"]) < threshold))
        return F.when(clear, F.array_append(kept, F.struct(x["i"].alias("i"), x["e"].alias("e"), x["t"].alias("t"), x["b"].alias("b")))).otherwise(kept)

    items = F.filter(item, lambda x: x["i"].isNotNull())
    return F.array_sort(F.transform(F.aggregate(F.array_sort(items), F.array().cast(kept_type), keep), lambda k: k["i"]))
