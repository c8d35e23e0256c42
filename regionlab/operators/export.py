"""Shapes that leave the engine: submission rows and chat-style training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlab.functions.geometry import crop_box, enlarged, to_thousandths, usable
from regionlab.functions.normalize import strip
from regionlab.functions.text import stem, without_errors

DETECT_PROMPT = "Find every block of the page. Answer with JSON: a list 'blocks' of objects with bbox_2d (thousandths of the page), block_type and writing_type."
TRANSCRIBE_PROMPT = "Read the text of the picture exactly as it is written. Answer with JSON: an object with the member 'text'."
MIN_CROP = 16


def block_type(r: Column) -> Column:
    """struct(block_type, writing_type) of a region."""
    t = F.coalesce(r["type"], F.lit("handwritten"))
    written = t.isin("handwritten", "printed")
    return F.struct(F.when(written, "text_block").otherwise(t).alias("block_type"), F.when(written, t).otherwise("handwritten").alias("writing_type"))


def in_output_order(regions: Column) -> Column:
    """Regions by the top and left of their boxes, then by position."""
    keyed = F.transform(regions, lambda r, i: F.struct(r["bbox"][1].alias("y"), r["bbox"][0].alias("x"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a["y"], a["x"], a["i"]) < F.struct(b["y"], b["x"], b["i"]), -1).otherwise(1)), lambda k: k["r"])


def submission_regions(regions: Column) -> Column:
    """array of struct(bbox, type, text) of results; null results are empty, error markers an empty text."""
    out = F.transform(
        F.filter(regions, lambda r: r.isNotNull()),
        lambda r: F.struct(r["bbox"].alias("bbox"), F.coalesce(r["type"], F.lit("handwritten")).alias("type"), without_errors(r["transcription"]).alias("text")),
    )
    return F.coalesce(out, F.array().cast("array<struct<bbox:array<int>,type:string,text:string>>"))


def submission(results: DataFrame) -> DataFrame:
    """(``image``, ``regions``): results as rows of a submission file."""
    return results.select(F.concat(F.col("uuid"), F.lit(".jpg")).alias("image"), F.to_json(submission_regions(F.col("regions"))).alias("regions"))


def chat(image: Column, prompt: str, response: Column) -> Column:
    """The nested ``messages`` of a sample; absent members stay null and do not appear in JSON."""
    part = lambda t, img, txt: F.struct(F.lit(t).alias("type"), img.cast("string").alias("image"), txt.cast("string").alias("text"))
    none = F.lit(None)
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", image, none), part("text", none, F.lit(prompt))).alias("content"))
    return F.array(user, F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, response)).alias("content")))


def detect_blocks(regions: Column, w: Column, h: Column) -> Column:
    """array of struct(bbox_2d in thousandths, block_type, writing_type); regions without a usable box cannot be shown and are left out."""
    ok = F.filter(regions, lambda r: r.isNotNull() & usable(r["bbox"]))

    def one(r: Column) -> Column:
        b = block_type(r)
        return F.struct(to_thousandths(r["bbox"], w, h).alias("bbox_2d"), b["block_type"].alias("block_type"), b["writing_type"].alias("writing_type"))

    return F.transform(ok, one)


def detect_samples(pages: DataFrame, prompt: str = DETECT_PROMPT) -> DataFrame:
    """(``file_name``, ``messages``) of every page."""
    blocks = F.coalesce(detect_blocks(F.col("regions"), F.col("image_width"), F.col("image_height")), F.array().cast("array<struct<bbox_2d:array<int>,block_type:string,writing_type:string>>"))
    return pages.select("file_name", chat(F.col("file_name"), prompt, F.to_json(F.struct(blocks.alias("blocks")))).alias("messages"))


def crops(pages: DataFrame, *keep: str, margin: float = 0.05) -> DataFrame:
    """``keep`` and (``idx``, ``text``, ``crop``, ``out_size``, ``crop_name``) of every region that gives a training sample.

    Its text is not blank, it is legible, of no other language, neither picture nor graph, and its crop, widened by ``margin`` and
    clamped to the page, measures 16 pixels or more on either side. Pages of unknown size give none.
    """
    long = pages.select(*keep, "file_name", "image_width", "image_height", F.posexplode("regions").alias("idx", "r")).where("r is not null")
    r, text = F.col("r"), strip(F.coalesce(F.col("r.text"), F.lit("")))
    ok = (text != "") & (F.coalesce(r["legibility"], F.lit("")) != "illegible") & (F.coalesce(r["language"], F.lit("uk")) != "other")
    ok = ok & ~F.coalesce(r["type"], F.lit("")).isin("image", "graph") & usable(r["bbox"])
    w, h = F.col("image_width"), F.col("image_height")
    c = long.where(ok).withColumn("text", text).withColumn("crop", crop_box(r["bbox"], w, h, margin))
    c = c.withColumn("__w", F.col("crop")[2] - F.col("crop")[0]).withColumn("__h", F.col("crop")[3] - F.col("crop")[1]).where(F.least("__w", "__h") >= MIN_CROP)
    name = F.format_string("%s_%03d.jpg", stem(F.col("file_name")), F.col("idx"))
    return c.select(*keep, "file_name", "idx", "text", "crop", enlarged(F.col("__w"), F.col("__h")).alias("out_size"), name.alias("crop_name"))


def transcribe_samples(pages: DataFrame, prompt: str = TRANSCRIBE_PROMPT, margin: float = 0.05) -> DataFrame:
    """(``crop_name``, ``messages``) of every crop."""
    c = crops(pages, margin=margin)
    return c.select("crop_name", chat(F.col("crop_name"), prompt, F.to_json(F.struct("text"))).alias("messages"))
