"""Readers and writers of the file formats around pages: JSON lines, submission CSV, result files, images, settings."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.functions.text import basename, stem

REGION = T.StructType([
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("type", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("legibility", T.StringType()), T.StructField("text", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("file_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()), T.StructField("regions", T.ArrayType(REGION)),
])
RESULT = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("regions", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("language", T.StringType()),
        T.StructField("legibility", T.StringType()), T.StructField("transcription", T.StringType()),
    ]))),
])
SPLITS = ("train", "silver", "test")


def split_path(root: str, split: str) -> str:
    """Where a split's manifest lies below ``root``; unknown splits raise ``ValueError``."""
    if split not in SPLITS:
        raise ValueError(f"{split!r} is none of {SPLITS}")
    return f"{root.rstrip('/')}/{split}/metadata.jsonl"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = PAGE, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are passed over. ``strict``: broken lines raise, else they come out as ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes JSON lines (null members are absent) and returns their number, counted in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(``image``, ``regions``) of well-formed submission files; see ``operators.records.load_files`` for broken ones."""
    return spark.read.schema("image string, regions string").csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_submission(df: DataFrame, path: str) -> None:
    df.select("image", "regions").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_submission_texts(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``text``) of whole files, for the error-recovering loader."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Per-page result files of a folder with ``file`` they came from; rows have no order of their own."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).withColumn("file", basename(F.input_file_name()))


def append_results(df: DataFrame, path: str) -> None:
    """Results added to a Parquet folder: with ``operators.manifest.pending`` a run that was broken off goes on."""
    df.write.mode("append").parquet(path)


def solution(pages: DataFrame) -> DataFrame:
    """(``image``, ``regions`` as JSON) of a manifest."""
    return pages.select(basename(F.col("file_name")).alias("image"), F.to_json("regions").alias("regions"))


def read_images(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(``path``, ``name``, ``stem``, ``length`` and ``content``); without ``content`` no image is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    cols = [F.col("path"), basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), F.col("length")]
    return df.select(*cols, *([F.col("content")] if content else []))


def read_settings(path: str) -> dict:
    """A YAML file's sections; a missing file or section is empty. Margins are laid over the default one, examples become pairs."""
    import yaml

    raw = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    transcribe = raw.get("transcribe") or {}
    examples = {k: [tuple(x) for x in v or []] for k, v in (transcribe.get("few_shot_examples") or {}).items()}
    return {k: raw.get(k) or {} for k in ("image", "postproc", "routing")} | {"margins": {"default": 0.05} | (transcribe.get("crop_margins") or {}), "examples": examples}


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """(``name``, ``written``) of ``df`` (``name``, ``content``): a file each below ``folder``; one that is there already is left, so a run that was broken off goes on.

    Rows of null content (an image that could not be read) give no file and ``written`` null. The folder may be on any file system that
    pyarrow knows. A file appears under its name only when it is whole.
    """

    def run(batches):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        where.create_dir(path)
        for pdf in batches:
            done = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                to = f"{path.rstrip('/')}/{name}"
                new = None if content is None or name is None else where.get_file_info(to).type == fs.FileType.NotFound
                if new:
                    part = f"{to}.{uuid.uuid4().hex}.part"
                    with where.open_output_stream(part) as f:
                        f.write(content)
                    where.move(part, to)
                done.append(new)
            yield pdf[["name"]].assign(written=pd.Series(done, dtype="boolean"))

    return df.select("name", "content").mapInPandas(run, "name string, written boolean")


def write_examples(examples: DataFrame, path: str, description: str = "example") -> None:
    """The few mined examples (``type``, ``rank``, ``text``; at most types x k rows) as YAML."""
    import yaml

    by: dict[str, list[list[str]]] = {}
    for r in examples.orderBy("type", "rank").collect():
        by.setdefault(r["type"], []).append([description, r["text"]])
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"transcribe": {"few_shot_examples": by}}, f, sort_keys=True, allow_unicode=True)
