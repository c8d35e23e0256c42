"""Driver queries of the text problems, and their SQL where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.llm import confusables, mixing, overlap, packing, repetition, sql, subjects, tokens
from regionlab.operators import records
from regionlab.session import spread, table, written


def _pages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spread(table(spark, d, "metadata").select(*cols))


@F.pandas_udf(T.BooleanType())
def _submission_lookalike(images: pd.Series, regions: pd.Series) -> pd.Series:
    """Whether a fit row of predictions holds a region text that has a plainer form."""
    out = []
    for i, r in zip(images, regions, strict=True):
        good, bad = records.parse_submission(i, r)
        out.append(not bad and any(confusables.has_lookalike(g["text"]) for g in good))
    return pd.Series(out, dtype=bool)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text has a plainer form of the same skeleton."""
    pages = _pages(spark, d, "row_id", "text").where(confusables.lookalike(F.col("text"))).select(F.lit("metadata").alias("src_table"), "row_id")
    preds = spread(table(spark, d, "sample_submission").select("row_id", "image", "regions"))
    preds = preds.where(_submission_lookalike("image", "regions")).select(F.lit("sample_submission").alias("src_table"), "row_id")
    return pages.unionByName(preds)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(``src_table``, ``row_id``, ``region_idx``, ``text``): page texts (null index) and every region text of the fit predictions."""
    pages = _pages(spark, d, "row_id", "text").select(F.lit("metadata").alias("src_table"), "row_id", F.lit(None).cast("int").alias("region_idx"), "text")
    preds = spread(table(spark, d, "sample_submission").select("row_id", F.col("image").alias("im"), F.col("regions").alias("rg")))
    fit = records.load(preds, records.parsed_submission(F.col("im"), F.col("rg")), "row_id")[0]
    regions = fit.select("row_id", F.posexplode("regions").alias("region_idx", "r"))
    return pages.unionByName(regions.select(F.lit("sample_submission").alias("src_table"), "row_id", "region_idx", F.col("r.text").alias("text")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Page texts and region texts of predictions grouped by skeleton; a group is named by its first text."""
    texts = _texts(spark, d).select(F.struct("src_table", "row_id", "region_idx").alias("id"), "text")
    g = confusables.skeleton_groups(texts, "id")
    return g.select("skeleton_md5", "rows", "variants", F.col("first_id.src_table").alias("first_table"), F.col("first_id.row_id").alias("first_id"), F.col("first_id.region_idx").alias("first_region_idx"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every page text and every region text of the fit predictions in its one consistent form."""
    f = _texts(spark, d).select("src_table", "row_id", "region_idx", confusables.forms(F.col("text")).alias("f"))
    return f.select("src_table", "row_id", "region_idx", F.col("f.canonical").alias("text"), F.md5("f.skeleton").alias("skeleton_md5"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which at least two fifths repeat earlier runs of three or more words."""
    return repetition.repetitive(_pages(spark, d, "row_id", "text"), threshold=0.4, run=3)[0].select("row_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of repeated content of every page."""
    s = _pages(spark, d, "row_id", "text").select("row_id", repetition.shares(F.col("text")).alias("s"))
    return s.select("row_id", "s.words", *[F.round(f"s.{c}", 6).alias(c) for c in ("repeated_words", "repeated_lines", "repeated_sentences", "top_run")])


def _compared(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Pages of training and of val or test."""
    rows = _pages(spark, d, "row_id", "split", "source", "file_name", "text").where(F.col("split").isin("train", "val", "test"))
    side = F.when(F.col("split") == "train", "train").otherwise("eval")
    return overlap.pages(rows.withColumn("side", side), "row_id", "side", "file_name", "text", *keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of rows of the same page across training and evaluation."""
    return overlap.overlaps(_compared(spark, d)).select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p5_images(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of rows that have the same image."""
    pairs = overlap.overlaps(_compared(spark, d)).where("tie = 'image'")
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, and evaluation rows with any, per evaluation split and source."""
    source = F.coalesce(mixing.source_key(F.col("source")), F.lit("unknown"))
    by = overlap.report(_compared(spark, d, "split", "source"), [F.col("split"), source])
    return by.withColumnsRenamed({"__g0": "split", "__g1": "source"})


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Images and texts that training and evaluation share, exactly or almost, each once however many copies it has."""
    return overlap.class_links(_compared(spark, d))


def _limits(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["limit_name"]: r["capacity_tokens"] for r in table(spark, d, "pack_limits").collect()}


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with the container it lies in, for each capacity."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return packing.pack(packing.sized(docs, tokens.token_count(F.col("text"))), _limits(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its unused room."""
    return packing.containers(p6_packed(spark, d))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """What packing promises, for each capacity: documents placed, wholly so, and containers overfull, documents cut needlessly, numbers left out."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    sizes = packing.sized(docs, tokens.token_count(F.col("text")))
    packed = written(packing.pack(sizes, _limits(spark, d)))
    by = packed.groupBy("limit_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.max("piece").alias("cut")).join(sizes, "doc_id")
    docs_ = by.groupBy("limit_name", "capacity").agg(
        F.count("*").alias("documents"), F.count_if(F.col("placed") == F.col("n_tokens")).alias("wholly_placed"), F.count_if((F.col("cut") >= 0) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut_needlessly")
    )
    c = packing.containers(packed).groupBy("limit_name").agg(F.count_if(F.col("unused") < 0).alias("overfull"), (F.max("container") + 1 - F.count("*")).alias("gaps"))
    return docs_.join(c, "limit_name").select("limit_name", "capacity", "documents", "wholly_placed", "overfull", "cut_needlessly", "gaps")


def _mix(spark: SparkSession, d: str):
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    sized = written(docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens")))
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mix(spark, d)[0]


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What mixing promises: every source with its target, the documents it has, and those taken more often than allowed."""
    chosen, shares = _mix(spark, d)
    over = chosen.groupBy("source").agg(F.sum("repeats").alias("__r"), F.max("repeats").alias("most"))
    has = spread(table(spark, d, "documents").select("source", "text")).where(tokens.token_count(F.col("text")) > 0)
    has = has.groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    r = mixing.reached(chosen, shares).select("source", "target_share", "max_repeats").join(has, "source", "left").join(over, "source", "left")
    return r.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.coalesce("n", F.lit(0)).alias("documents"), F.coalesce((F.col("most") > F.col("max_repeats")).cast("long"), F.lit(0)).alias("over_cap"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.reached(*_mix(spark, d))


def _mixtures(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return subjects.subject_mixtures(docs, table(spark, d, "doc_labels").select("doc_id", "subject"), table(spark, d, "subjects"), whole=whole)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with each subject that about a fifth of their sentences or more deal with."""
    return subjects.subjects_of(_mixtures(spark, d)).select("doc_id", "subject")


def p8_mixtures(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of subjects of every document, by the weights of its row."""
    return _mixtures(spark, d, whole=True).select("doc_id", "subject", F.round("weight", 4).alias("weight"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus: documents that have a subject, sentences that deal with it and its part of all such sentences."""
    by = _mixtures(spark, d).groupBy("subject").agg(F.sum((F.col("share") >= subjects.MIN_SHARE).cast("long")).alias("documents"), F.sum("sentences").alias("sentences"))
    # a row per subject: the total over the few of them
    total = by.agg(F.sum("sentences").alias("t"))
    return by.join(F.broadcast(total)).select("subject", "documents", "sentences", F.round(F.col("sentences") / F.col("t"), 6).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_canonical": p1_canonical,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_links": p5_links,
    "p5_images": p5_images,
    "p6_packed": p6_packed,
    "p6_containers": p6_containers,
    "p6_kept": p6_kept,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_mixtures": p8_mixtures,
    "p8_composition": p8_composition,
}
SQL = {"p1_found": sql.P1_FOUND, "p4_found": sql.P4_FOUND, "p4_shares": sql.P4_SHARES, "p5_images": sql.P5_IMAGES, "p6_kept": sql.P6_KEPT, "p7_kept": sql.P7_KEPT}
