"""Driver queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlab.functions import geometry, payload
from regionlab.functions.normalize import normalize_text
from regionlab.functions.text import basename, first_line, without_errors
from regionlab.operators import cleaning, export, manifest, matching, profile, records, scoring, splits
from regionlab.session import spread, table
from regionlab.sql_reference import reference_sql
from regionlab.sql_scores import SCORES


# what a query reads of a region unless it names less; the lines below regions are read by none of these
REGION = ("bbox", "type", "language", "legibility", "text")


def _metadata(spark: SparkSession, d: str, *cols: str, members: tuple[str, ...] = REGION) -> DataFrame:
    return table(spark, d, "metadata", regions=members).select(*cols)


def _long(spark: SparkSession, d: str, *keep: str, members: tuple[str, ...] = REGION) -> DataFrame:
    return cleaning.regions_long(_metadata(spark, d, *keep, "regions", members=members), *keep)


def _solution(spark: SparkSession, d: str) -> DataFrame:
    """Pages of val and test, one row each delivery."""
    pages = _metadata(spark, d, "row_id", "file_name", "split", "regions").where("split in ('val', 'test') and file_name is not null")
    return spread(pages.select("row_id", basename(F.col("file_name")).alias("image"), "regions"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """The last fit prediction of every image."""
    s = spread(table(spark, d, "sample_submission").select("row_id", "image", "regions"))
    p = s.select("row_id", "image", records.parsed_submission(F.col("image"), F.col("regions")).alias("p"))
    return scoring.last_per_image(p.where("p.reason is null").select("row_id", "image", F.col("p.regions").alias("regions")), order="row_id")


def score_per_page(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.per_page(_solution(spark, d), _predictions(spark, d))
    return p.select("row_id", "image", "tp", "fp", "fn", "class_correct", "cer_n", F.round("cer_sum", 6).alias("cer_sum"), F.round("page_cer", 6).alias("page_cer"))


def score_report(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.report(scoring.per_page(_solution(spark, d), _predictions(spark, d)))
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


def _matched(spark: SparkSession, d: str) -> DataFrame:
    prepare = lambda c: scoring.boxed(scoring.with_defaults(F.col(c)))
    gt = _solution(spark, d).select("row_id", "image", prepare("regions").alias("gt"))
    both = gt.join(_predictions(spark, d).select("image", prepare("regions").alias("pred")), "image")
    return both.withColumn("m", matching.greedy_match(F.col("gt"), F.col("pred")))


def region_matches(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).select("row_id", F.explode("m").alias("m"))
    return m.select("row_id", "m.gi", "m.pi", F.round("m.iou", 6).alias("iou"))


def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The threshold join on long tables."""
    idx = lambda df: df.select("row_id", F.posexplode("r").alias("idx", "x")).select("row_id", "idx", "x.bbox")
    both = _matched(spark, d)
    pairs = matching.join_matches(idx(both.withColumnRenamed("gt", "r")), idx(both.withColumnRenamed("pred", "r")), "row_id")
    return pairs.select("row_id", "gi", "pi", F.round("iou", 6).alias("iou"))


def match_confusion(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).select(F.explode(F.transform("m", lambda x: F.struct(F.get("gt", x["gi"])["type"].alias("gt_type"), F.get("pred", x["pi"])["type"].alias("pred_type")))).alias("t"))
    return m.groupBy("t.gt_type", "t.pred_type").agg(F.count("*").alias("n"))


def detection_counts(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d)
    return m.agg(F.sum(F.size("m")).alias("tp"), F.sum(F.size("pred") - F.size("m")).alias("fp"), F.sum(F.size("gt") - F.size("m")).alias("fn"))


def region_cer(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of every matched region that counts."""
    m = _matched(spark, d).select("row_id", "gt", "pred", F.explode("m").alias("m"))
    m = m.select("row_id", "m.gi", F.get("gt", F.col("m.gi")).alias("g"), F.get("pred", F.col("m.pi")).alias("p")).where(scoring.is_scorable(F.col("g")))
    m = m.select("row_id", "gi", normalize_text(F.col("g.text"), F.col("g.type")).alias("a"), normalize_text(F.col("p.text"), F.col("g.type")).alias("b"))
    return m.select("row_id", "gi", scoring.distance(F.col("b"), F.col("a")).alias("edits"), F.length("a").alias("length"))


def page_text_reading_order(spark: SparkSession, d: str) -> DataFrame:
    pages = _metadata(spark, d, "row_id", "regions")
    return pages.select("row_id", scoring.page_text(scoring.boxed(scoring.with_defaults(F.col("regions")))).alias("page_text"))


def nms_kept(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(_metadata(spark, d, "row_id", "regions", members=("bbox", "type"))).select("row_id", F.filter("regions", lambda r: r.isNotNull()).alias("r"))
    return pages.select("row_id", F.explode(matching.suppressed(F.col("r"))).alias("idx"))


def nms_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(_metadata(spark, d, "source", "regions", members=("bbox", "type"))).select("source", F.filter("regions", lambda r: r.isNotNull()).alias("r")).where("r is not null")
    return pages.groupBy("source").agg(F.sum(F.size("r")).alias("before"), F.sum(F.size(matching.suppressed(F.col("r")))).alias("after"))


def scorable_by_source(spark: SparkSession, d: str) -> DataFrame:
    return profile.scorable_share(_long(spark, d, "source", members=("type", "language", "legibility")))


def type_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profile.type_crosstab(_long(spark, d, "source", members=("type",)))


def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_summary(_metadata(spark, d, "source"))


def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_profile(_metadata(spark, d, "source", "image_width", "image_height", "regions", members=("type",)))


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_stats(_long(spark, d, "source", members=("text",)))


def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = profile.length_percentiles(_long(spark, d, "source", members=("text",)))
    return p.select("source", *[F.round(c, 6).alias(c) for c in ("p90", "p95", "p99")])


def region_count_stats(spark: SparkSession, d: str) -> DataFrame:
    r = profile.region_count_stats(_metadata(spark, d, "image_width", "image_height", "regions", members=("type",)))
    return r.select("least", F.col("median").cast("double").alias("median"), F.round("mean", 6).alias("mean"), "most")


def usable_texts(spark: SparkSession, d: str) -> DataFrame:
    return profile.usable_texts(_long(spark, d, "row_id", "source", members=("type", "language", "legibility", "text"))).groupBy("source").agg(F.count("*").alias("n"))


def char_frequency(spark: SparkSession, d: str) -> DataFrame:
    return profile.character_counts(_long(spark, d, members=("text",)))


def alphabet_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.alphabet_counts(char_frequency(spark, d))


def rare_chars(spark: SparkSession, d: str) -> DataFrame:
    return profile.rarest(char_frequency(spark, d))


def chars_only_in_source(spark: SparkSession, d: str) -> DataFrame:
    return profile.only_in(profile.character_counts(_long(spark, d, "source", members=("text",)), "source"), "school")


def char_vocab(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.vocabulary(_metadata(spark, d, "split", "regions", members=("text",)).where("split = 'train'").select("regions"))


def strike_markers(spark: SparkSession, d: str) -> DataFrame:
    return profile.marked(_long(spark, d, "source", members=("text",)))


def outlier_files(spark: SparkSession, d: str) -> DataFrame:
    return profile.outlier_files(_long(spark, d, "file_name", members=("text",)), 260)


def _silver_rule(spark: SparkSession, d: str):
    pages = _metadata(spark, d, "row_id", "split", "regions", members=("text",))
    known = cleaning.vocabulary_text(pages.where("split = 'train'"))
    return pages.where("split = 'silver'").drop("split"), lambda r: cleaning.is_clean_silver(r, known)


def clean_regions(spark: SparkSession, d: str) -> DataFrame:
    silver, rule = _silver_rule(spark, d)
    return cleaning.filter_regions(silver, rule).select("row_id", F.posexplode("regions").alias("kept_idx", "r")).select("row_id", "kept_idx", F.col("r.text").alias("text"))


def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.filter_stats(*_silver_rule(spark, d))


def clean_train_stats(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.filter_stats(_metadata(spark, d, "split", "regions", members=("text",)).where("split = 'train'"), cleaning.is_clean_train)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return _metadata(spark, d, "row_id", "file_name").select("row_id", splits.in_validation(F.col("file_name")).alias("in_validation"))


def split_source_summary(spark: SparkSession, d: str) -> DataFrame:
    m = _metadata(spark, d, "file_name", "source")
    return m.groupBy(F.coalesce("source", F.lit("_")).alias("source"), splits.in_validation(F.col("file_name")).alias("in_validation")).agg(F.count("*").alias("n"))


def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_per_group(_metadata(spark, d, "row_id", "source"), "source", "row_id")


def first_per_source(spark: SparkSession, d: str) -> DataFrame:
    return _metadata(spark, d, "row_id", "source", "file_name").groupBy("source").agg(F.min("row_id").alias("row_id"), F.min_by("file_name", "row_id").alias("file_name"))


def fewshot_topk(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.shortest_examples(_long(spark, d, members=("type", "language", "legibility", "text")))


def normalize_plain(spark: SparkSession, d: str) -> DataFrame:
    """Normalized texts of the regions that are neither formulas nor tables."""
    long = spread(_long(spark, d, "row_id", members=("type", "text"))).where(~F.coalesce(F.col("type").isin("formula", "table"), F.lit(False)))
    return long.select("row_id", "idx", normalize_text(F.col("text"), F.col("type")).alias("normalized"))


# Inputs of the normalization and what they come to.
GOLDEN = [
    ("x_{3} + y^{2}", "formula", "х_3 + у^2"), ("A | B | C", "table", "А|В|С"), ("x² + y₃", "formula", "х^2 + у_3"), ("H_{2}SO_{4}", "formula", "Н_2SО_4"),
    (r"\frac{1}{2}", "formula", "1/2"), (r"\sqrt{169}", "formula", "√169"), (r"\bar{x}", "formula", "х"), ("(1; -1)", "formula", "1\n-1"),
    ("| 3 2 | | -1 1 |", "formula", "3 2\n-1 1"), (r"\overrightarrow{AB}", "formula", "→АВ"), (r"\vec{a}", "formula", "→а"), ("2 * 3 = 6", "formula", "2 · 3 = 6"),
    (r"\therefore \overrightarrow{AB} \perp \overrightarrow{AC}", "formula", "∴ →АВ ⊥ →АС"), ("«Привіт»", "handwritten", '"Привіт"'),
]


def normalize_goldens(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([g[:2] for g in GOLDEN], "given string, type string").select("given", normalize_text(F.col("given"), F.col("type")).alias("normalized"))


def normalize_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas and tables, normalized."""
    long = spread(_long(spark, d, "row_id", members=("type", "text"))).where(F.col("type").isin("formula", "table"))
    return long.select("row_id", "idx", normalize_text(F.col("text"), F.col("type")).alias("normalized"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d, "row_id", "image_width", "image_height", members=("bbox",)).where(geometry.usable(F.col("bbox"))).select("row_id", "idx", "bbox", "image_width", "image_height")


def _flat(df: DataFrame, box: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def bbox_normalized(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return _flat(b.withColumn("b", geometry.to_thousandths(F.col("bbox"), F.col("image_width"), F.col("image_height"))), "b", "row_id", "idx")


def bbox_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a 1000 x 1000 frame on the page; those that cannot be are left out."""
    b = _boxes(spark, d)
    s = geometry.scale(F.transform("bbox", lambda v: v.cast("string")), F.col("image_width"), F.col("image_height"), F.lit(1000), F.lit(1000))
    return _flat(b.withColumn("b", s).where("b is not null"), "b", "row_id", "idx")


def bbox_bands(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("row_id", "idx", F.posexplode(geometry.bands(F.col("bbox"), F.lit(3))).alias("band", "b"))
    return _flat(b, "b", "row_id", "idx", "band")


def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).where("image_width > 0 and image_height > 0")
    return _flat(b.withColumn("b", geometry.crop_box(F.col("bbox"), F.col("image_width"), F.col("image_height"), 0.05)), "b", "row_id", "idx")


def fitted_sizes(spark: SparkSession, d: str) -> DataFrame:
    m = _metadata(spark, d, "row_id", "image_width", "image_height").where("image_width > 0 and image_height > 0")
    f = m.withColumn("f", geometry.fitted(F.col("image_width"), F.col("image_height"), 1_000_000))
    return f.select("row_id", F.col("f")[0].alias("w"), F.col("f")[1].alias("h"))


def payload_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that can be read from every prediction, broken ones included."""
    s = spread(table(spark, d, "sample_submission").select("row_id", "regions"))
    return s.select("row_id", F.size(payload.items(F.col("regions"), "blocks", "regions")).alias("items"))


def payload_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "sample_submission").select("row_id", "regions"))
    one = F.lit(1000)
    return s.select("row_id", F.posexplode(payload.blocks(F.col("regions"), one, one, one, one)).alias("no", "b")).select("row_id", "no", "b.block_type", "b.writing_type", F.get("b.bbox", F.lit(0)).alias("x1"))


def payload_repair(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the list that is left of every prediction."""
    s = spread(table(spark, d, "sample_submission").select("row_id", "regions"))
    return s.select("row_id", F.length(payload.repaired(F.col("regions"))).alias("kept"))


# Free type names and what they come to.
ALIASES = [("Signature of author", "handwritten"), ("round stamp", "image"), ("Logo", "image"), ("body text", "printed"), ("Formula", "Formula"), ("footer", "annotation"), (" table ", " table ")]


def type_aliases(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in ALIASES], "given string").select("given", payload.known_type(F.col("given")).alias("type"))


def missing_images(spark: SparkSession, d: str) -> DataFrame:
    return manifest.missing(_solution(spark, d).select("image"), table(spark, d, "sample_submission").select("image"))


def aligned_submission(spark: SparkSession, d: str) -> DataFrame:
    return manifest.aligned(table(spark, d, "sample_submission").select("image", "regions"), _solution(spark, d).select("image"))


def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "submission_raw").select("line_id", F.regexp_extract("line", r"^\"?([0-9a-f-]+\.jpg)", 1).alias("image")).where("image <> ''")
    return manifest.manifest(ids.select("image").distinct(), _metadata(spark, d, "row_id", "file_name", "source"), "row_id")


def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _metadata(spark, d, "row_id", "file_name").where("file_name is not null").select("row_id", F.regexp_replace(basename(F.col("file_name")), r"\.[^.]*$", "").alias("uuid"))
    return manifest.pending(pages, table(spark, d, "page_results"), "uuid").select("uuid", "row_id")


def union_origins(spark: SparkSession, d: str) -> DataFrame:
    m = _metadata(spark, d, "row_id", "source", "split")
    parts = {s: m.where(F.col("split") == s).select("row_id", "source") for s in ("train", "silver")}
    return manifest.tagged_union(parts).groupBy("_origin", "source").agg(F.count("*").alias("n"))


def submission_export(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("result_id", F.posexplode(export.submission_regions(F.col("regions"))).alias("idx", "r"))
    return _flat(p.select("result_id", "idx", "r.*"), "bbox", "result_id", "idx", "type", "text")


def submission_json(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the exported JSON, counted after it was read again."""
    s = export.submission(table(spark, d, "page_results").select("uuid", "regions"))
    n = F.size(F.from_json("regions", "array<struct<bbox:array<int>,type:string,text:string>>"))
    return s.groupBy("image").agg(F.sum(n).alias("regions"), F.count("*").alias("rows"))


def region_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("result_id", F.filter("regions", lambda r: r.isNotNull() & geometry.usable(r["bbox"])).alias("regions"))
    o = p.select("result_id", F.posexplode(export.in_output_order(F.col("regions"))).alias("place", "r"))
    return _flat(o.select("result_id", "place", "r.bbox"), "bbox", "result_id", "place")


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("result_id", F.posexplode("regions").alias("idx", "r")).where("r is not null")
    return p.select("result_id", "idx", first_line(without_errors(F.col("r.transcription"))).alias("line"))


def chat_transcribe_samples(spark: SparkSession, d: str) -> DataFrame:
    pages = _metadata(spark, d, "row_id", "file_name", "image_width", "image_height", "regions").where("file_name is not null")
    c = export.crops(pages, "row_id")
    return _flat(c, "crop", "row_id", "idx", "text", "crop_name", F.col("out_size")[0].alias("out_w"), F.col("out_size")[1].alias("out_h"))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    pages = _metadata(spark, d, "file_name", "image_width", "image_height", "regions").where("file_name is not null")
    s = export.transcribe_samples(pages)
    m = F.col("messages")
    return s.select("crop_name", m[0]["content"][0]["image"].alias("image"), F.get_json_object(m[1]["content"][0]["text"], "$.text").alias("text"))


def chat_detect_samples(spark: SparkSession, d: str) -> DataFrame:
    pages = _metadata(spark, d, "row_id", "image_width", "image_height", "regions", members=("bbox", "type"))
    b = pages.select("row_id", F.posexplode(export.detect_blocks(F.col("regions"), F.col("image_width"), F.col("image_height"))).alias("no", "b"))
    return _flat(b.select("row_id", "no", "b.*"), "bbox_2d", "row_id", "no", "block_type", "writing_type")


QUERIES = {
    f.__name__: f
    for f in (
        score_report, score_per_page, region_matches, match_candidates, match_confusion, detection_counts, region_cer, page_text_reading_order, nms_kept, nms_counts,
        scorable_by_source, type_crosstab, source_summary, source_profile, length_stats, length_percentiles, region_count_stats, usable_texts, char_frequency, alphabet_counts,
        rare_chars, chars_only_in_source, char_vocab, strike_markers, outlier_files, clean_regions, clean_stats, clean_train_stats, hash_split, split_source_summary,
        sample_per_source, first_per_source, fewshot_topk, normalize_plain, normalize_goldens, normalize_formulas, bbox_normalized, bbox_scaled, bbox_bands, crop_boxes,
        fitted_sizes, payload_items, payload_blocks, payload_repair, type_aliases, missing_images, aligned_submission, manifest_join, pending_pages, union_origins,
        submission_export, submission_json, region_order, first_lines, chat_transcribe_samples, chat_messages, chat_detect_samples,
    )
}
SQL = reference_sql(GOLDEN, ALIASES) | SCORES
