"""Composite score of predictions: detection, class, region and page character error rates.

Everything about a page happens in its own row: regions stay nested, matching, texts and edit distances are projections. The only
shuffles are the join of solution and submission by image and the final one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlab.functions.distance import edit_distance
from regionlab.functions.normalize import bind, kind, normalize_text
from regionlab.operators.matching import greedy_match

WEIGHTS = {"det": 0.15, "cls": 0.05, "cer": 0.30, "page": 0.50}
REGIONS = "array<struct<bbox:array<double>,type:string,language:string,legibility:string,text:string>>"


class InvalidSubmission(ValueError):
    """What the author of a submission has to mend."""


def with_defaults(regions: Column) -> Column:
    """Typed regions with the defaults of absent fields; null arrays are empty, null elements left out."""

    def one(r: Column) -> Column:
        box = F.transform(r["bbox"], lambda v: v.cast("double"))
        d = {"type": "handwritten", "language": "uk", "legibility": "legible", "text": ""}
        return F.struct(box.alias("bbox"), *[F.coalesce(r[k], F.lit(v)).alias(k) for k, v in d.items()])

    return F.coalesce(F.transform(F.filter(regions, lambda r: r.isNotNull()), one), F.array().cast(REGIONS))


def boxed(regions: Column) -> Column:
    """Only regions with four coordinates."""
    return F.filter(regions, lambda r: r["bbox"].isNotNull() & (F.size(r["bbox"]) == 4) & F.forall(r["bbox"], lambda v: v.isNotNull()))


def is_scorable(r: Column) -> Column:
    """Neither picture nor graph, nor of another language, nor illegible; absent fields count as their defaults."""
    plain = ~F.coalesce(r["type"], F.lit("handwritten")).isin("image", "graph")
    return plain & (F.coalesce(r["language"], F.lit("uk")) != "other") & (F.coalesce(r["legibility"], F.lit("legible")) != "illegible")


def page_text(regions: Column, text=lambda r: F.coalesce(r["text"], F.lit(""))) -> Column:
    """Texts of scorable regions in reading order, a line each: by band of 15 pixels of the centre, then by its x, then by position."""
    b = lambda r: r["bbox"]
    key = F.transform(
        regions,
        lambda r, i: F.struct(
            F.floor((b(r)[1] + b(r)[3]) / 2 / 15).alias("band"), ((b(r)[0] + b(r)[2]) / 2).alias("x"), i.cast("int").alias("i"), text(r).alias("text"), is_scorable(r).alias("ok")
        ),
    )
    return F.array_join(F.transform(F.array_sort(F.filter(key, lambda k: k["ok"])), lambda k: k["text"]), "\n")


def last_per_image(submission: DataFrame, image: str = "image", order: str = "row_no") -> DataFrame:
    """Of several rows of an image the last one, all columns. A row of nulls for the order counts as the first.

    ``max_by`` keeps one row per image while rows are read, before they are shuffled, so an image sent again a million times is no
    heavier than any other.
    """
    cols = [c for c in submission.columns if c != image]
    best = submission.groupBy(image).agg(F.max_by(F.struct(*cols), F.struct(F.col(order))).alias("__s"))
    return best.select(image, *[F.col("__s")[c].alias(c) for c in cols])


def require_complete(solution: DataFrame, submission: DataFrame, image: str = "image") -> None:
    """Raises ``InvalidSubmission`` with the number of missing images and five of them."""
    missing = solution.select(image).distinct().join(submission.select(image), image, "left_anti")
    row = missing.agg(F.count("*").alias("n")).first()
    if row["n"]:
        some = [r[0] for r in missing.orderBy(image).limit(5).collect()]
        raise InvalidSubmission(f"{row['n']} image(s) are missing, such as {some}")


def require_valid(parsed: DataFrame, image: str = "image") -> None:
    """Raises ``InvalidSubmission`` for rows whose ``reason`` is not null (see ``operators.records``), naming one."""
    bad = parsed.where("reason is not null").orderBy(image).select(image, "error_field", "error_message").first()
    if bad:
        raise InvalidSubmission(f"{bad[0]}: {bad['error_field']}: {bad['error_message']}")


def require_columns(df: DataFrame, *names: str) -> None:
    if lacking := [n for n in names if n not in df.columns]:
        raise InvalidSubmission(f"columns are missing: {lacking}")


def distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))


def per_page(solution: DataFrame, submission: DataFrame, image: str = "image", threshold: float = 0.5, spread: int | None = None) -> DataFrame:
    """One row per row of ``solution``: its columns but ``regions``, then the sums that the score is made of.

    ``solution``, ``submission``: (``image``, ``regions``) with nested regions; ``submission`` holds each image once (``last_per_image``).
    An image without prediction has none. Null regions are empty; regions without a usable box are left out on both sides.
    """
    pred = submission.select(image, boxed(with_defaults(F.col("regions"))).alias("__pred"))
    keep = [c for c in solution.columns if c != "regions"]
    both = solution.select(*keep, boxed(with_defaults(F.col("regions"))).alias("__gt")).join(pred, image, "left")
    both = both.withColumn("__pred", F.coalesce("__pred", F.array().cast(REGIONS)))
    if spread:
        both = both.repartition(spread)
    # every text is normalized once, by its own region's type; a matched text once more where its partner's type asks for it
    whole = lambda r: F.struct(*[r[k].alias(k) for k in ("bbox", "type", "language", "legibility", "text")], normalize_text(r["text"], r["type"]).alias("norm"))
    m = both.withColumns({"__gt": F.transform("__gt", whole), "__pred": F.transform("__pred", whole), "__m": greedy_match(F.col("__gt"), F.col("__pred"), threshold)})
    gt, pr, ms = F.col("__gt"), F.col("__pred"), F.col("__m")

    def region_cer(x: Column) -> Column:
        g, p = F.get(gt, x["gi"]), F.get(pr, x["pi"])
        by_gt = F.when(kind(g["type"]) == kind(p["type"]), p["norm"]).otherwise(normalize_text(p["text"], g["type"]))
        return bind(F.struct(g["norm"].alias("g"), by_gt.alias("p")), lambda s: distance(s["p"], s["g"]) / F.greatest(F.length(s["g"]), F.lit(1)))

    scored = F.filter(ms, lambda x: is_scorable(F.get(gt, x["gi"])))
    dropped = F.transform(F.filter(ms, lambda x: ~is_scorable(F.get(gt, x["gi"]))), lambda x: x["pi"])
    own = lambda r: r["norm"]
    left = F.filter(pr, lambda r, i: ~F.array_contains(dropped, i.cast("int")))
    m = m.withColumns({"__cers": F.transform(scored, region_cer), "__gt_page": page_text(gt, own), "__pred_page": page_text(left, own)})
    n = F.size(ms)
    length = F.length("__gt_page")
    return m.select(
        *keep,
        n.alias("tp"), (F.size(pr) - n).alias("fp"), (F.size(gt) - n).alias("fn"),
        F.size(F.filter(ms, lambda x: F.get(gt, x["gi"])["type"] == F.get(pr, x["pi"])["type"])).alias("class_correct"),
        F.size("__cers").alias("cer_n"), F.aggregate("__cers", F.lit(0.0), lambda a, x: a + x).alias("cer_sum"),
        F.when(length > 0, edit_distance(F.col("__pred_page"), F.col("__gt_page")) / length).alias("page_cer"),
    )


REPORT = ("score", "det_f1", "det_precision", "det_recall", "class_acc", "region_cer", "page_cer", "tp", "fp", "fn", "pages")


def report(pages: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row of ``REPORT``; error rates without any term are 1, and are clamped only after averaging."""
    a = pages.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "class_correct", "cer_n")],
        F.sum("cer_sum").alias("cer_sum"), F.avg("page_cer").alias("page"), F.count("*").alias("pages"),
    )
    c = F.col
    a = a.withColumn("det_precision", c("tp") / F.greatest(c("tp") + c("fp"), F.lit(1))).withColumn("det_recall", c("tp") / F.greatest(c("tp") + c("fn"), F.lit(1)))
    a = a.withColumn("det_f1", 2 * c("det_precision") * c("det_recall") / F.greatest(c("det_precision") + c("det_recall"), F.lit(1e-9)))
    a = a.withColumn("class_acc", c("class_correct") / F.greatest(c("tp"), F.lit(1)))
    a = a.withColumn("region_cer", F.coalesce(F.try_divide(c("cer_sum"), c("cer_n")), F.lit(1.0))).withColumn("page_cer", F.coalesce(c("page"), F.lit(1.0)))
    kept = lambda x: F.greatest(F.lit(0.0), 1 - x)
    score = weights["det"] * c("det_f1") + weights["cls"] * c("class_acc") + weights["cer"] * kept(c("region_cer")) + weights["page"] * kept(c("page_cer"))
    return a.withColumn("score", score).select(*REPORT)


def format_report(row) -> str:
    """The report's row as lines of text."""
    return "\n".join(f"{k:<14}{v:.4f}" if isinstance(v, float) else f"{k:<14}{v}" for k, v in zip(REPORT, row, strict=True))
