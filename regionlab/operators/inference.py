"""Page inference around a pluggable model: routing, fan-out to tasks, calls, fan-in.

Only the model call leaves the JVM (``mapInPandas`` over batches of tasks); answers are read, boxes scaled, suppressed, banded and
ordered by expressions. A failing call gives an error marker for its task, never a failed page. A page's work is as many rows as it has
tasks, so large pages spread over the cluster.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.functions import payload, prompts
from regionlab.functions.geometry import bands, crop_box, enlarged
from regionlab.functions.text import first_line
from regionlab.operators.export import in_output_order
from regionlab.operators.matching import suppressed

FAILED = "[ERROR:model_failed]"
TRANSIENT = ("timeout", "temporarily", "429", "503", "connection")  # what a message must hold for the call to be tried again


@dataclass(frozen=True)
class Request:
    """One question to a model: what part of which image to look at, what to ask, and how long the answer may be."""

    task: str  # classify, detect, per_line, find_lines, lines or text
    image: str
    box: list[int] | None  # the part to cut out, margin included; None: the whole page
    size: list[int] | None  # what to scale the part to; None: as it is
    rtype: str | None
    prompt: str
    max_tokens: int


class VisionBackend(Protocol):
    """Answers of a model: (answer, width, height of the frame its coordinates are in)."""

    def __call__(self, request: Request) -> tuple[str, int, int]: ...


@dataclass(frozen=True)
class Config:
    """Settings of a run; maps are small and travel as literals."""

    nms: float | None = None  # IoU from which the lesser of two tasks of a type is dropped
    classify: bool = True
    find_lines: bool = False  # text blocks are cut into lines by a second question, else by the answer's lines
    per_line_from: int = 3  # a page of formulas is read line by line if that many lines are found
    attempts: int = 4
    at_once: int = 8  # calls of one task under way at a time
    margins: dict[str, float] = field(default_factory=lambda: {"default": 0.05})
    examples: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    math_sources: tuple[str, ...] = ("school", "university")
    deskew: bool = False  # pages are straightened before (``plans.pipelines.straighten``)
    deskew_most: float = 10.0

    @classmethod
    def of(cls, settings: dict, **more) -> Config:
        """From the sections of ``sources.files.read_settings``; what is absent keeps its default."""
        image, post, routing = (settings.get(k) or {} for k in ("image", "postproc", "routing"))
        given = {
            "nms": post.get("nms_iou"), "per_line_from": routing.get("math_shortcircuit_min_lines"), "deskew": image.get("deskew"),
            "deskew_most": image.get("deskew_max_angle_deg"), "margins": settings.get("margins"), "examples": settings.get("examples"),
        }
        return cls(**{k: v for k, v in given.items() if v is not None} | more)


# The longest answers by region type.
MAX_TOKENS = {"formula": 1024, "table": 1024, "annotation": 512}
TASK_TOKENS = {"classify": 64, "detect": 4096, "per_line": 4096, "find_lines": 2048, "lines": 2048}


def max_tokens(rtype: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MAX_TOKENS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, rtype), F.lit(1024))


def asked(tasks: DataFrame, cfg: Config) -> DataFrame:
    """``tasks`` (``task``, ``source``, ``box``, ``rtype``, ``image_width``, ``image_height``) with what a request needs: ``crop``, ``size``, ``prompt``, ``max_tokens``.

    Parts to be read are cut with the source's margin, clamped to the page, and enlarged if they are small and of one line; blocks whose
    lines are to be found with 3 % of their sides.
    """
    task, box = F.col("task"), F.col("box")
    margin_ = F.when(task == "find_lines", F.lit(0.03)).otherwise(margin(F.col("source"), cfg))
    crop = F.when(box.isNotNull(), crop_box(box, F.col("image_width"), F.col("image_height"), margin_))
    size = F.when((task == "text") & F.col("crop").isNotNull(), enlarged(F.col("crop")[2] - F.col("crop")[0], F.col("crop")[3] - F.col("crop")[1]))
    by_task = lambda of, default: reduce(lambda c, k: F.when(task == k, F.lit(of[k])).otherwise(c), TASK_TOKENS, default)
    return tasks.withColumn("crop", crop).withColumns(
        {"size": size, "prompt": by_task(prompts.PROMPTS, prompts.prompt(F.col("rtype"), cfg.examples)), "max_tokens": by_task(TASK_TOKENS, max_tokens(F.col("rtype")))}
    )


def margin(source: Column, cfg: Config) -> Column:
    m = F.create_map(*[F.lit(x) for kv in cfg.margins.items() for x in kv]) if cfg.margins else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(m, source), F.lit(cfg.margins.get("default", 0.05)))


def call_with_retry(backend: VisionBackend, attempts: int, request: Request, wait=time.sleep) -> tuple[str, int, int]:
    """Tries again after failures that may pass, waiting longer each time; other failures and the last one give the error marker."""
    for k in range(attempts):
        try:
            return backend(request)
        except Exception as e:
            if k + 1 == attempts or not any(w in str(e).lower() for w in TRANSIENT):
                return FAILED, 0, 0
            wait(min(20.0, 2.0**k) * (0.5 + random.random() / 2))
    return FAILED, 0, 0


def ask(tasks: DataFrame, backend: VisionBackend, cfg: Config) -> DataFrame:
    """``tasks`` with ``raw``, ``frame_w``, ``frame_h``. Calls of a batch run ``at_once`` at a time: a task waits for models, not for its core."""
    tasks = asked(tasks, cfg)
    schema = T.StructType([*tasks.schema.fields, T.StructField("raw", T.StringType()), T.StructField("frame_w", T.IntegerType()), T.StructField("frame_h", T.IntegerType())])
    ints = lambda x: None if x is None else [int(v) for v in x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(cfg.at_once) as pool:
            for pdf in batches:
                columns = (pdf[c] for c in ("task", "image", "crop", "size", "rtype", "prompt", "max_tokens"))
                requests = [Request(t, i, ints(b), ints(z), r, p, int(m)) for t, i, b, z, r, p, m in zip(*columns, strict=True)]
                got = list(pool.map(lambda q: call_with_retry(backend, cfg.attempts, q), requests))
                yield pdf.assign(raw=[g[0] for g in got], frame_w=[g[1] for g in got], frame_h=[g[2] for g in got])

    return tasks.mapInPandas(run, schema)


TASK = "array<struct<bbox:array<int>,rtype:string,legibility:string,multiline:boolean>>"


def block_tasks(blocks: Column) -> Column:
    """A text block is one task of several lines, any other block a task of its own type."""
    text = lambda b: b["block_type"] == "text_block"
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["bbox"].alias("bbox"), F.when(text(b), b["writing_type"]).otherwise(b["block_type"]).alias("rtype"), F.lit("legible").alias("legibility"), text(b).alias("multiline")
        ),
    )


def routed(per_line: Column, blocks: Column, is_math: Column, cfg: Config) -> Column:
    """Tasks of a page: its lines if it is a page of formulas with enough of them, else its blocks."""
    lines = F.transform(per_line, lambda t: F.struct(t["bbox"].alias("bbox"), t["rtype"].alias("rtype"), t["legibility"].alias("legibility"), F.lit(False).alias("multiline")))
    tasks = F.when(is_math & (F.size(lines) >= cfg.per_line_from), lines).otherwise(block_tasks(blocks))
    if cfg.nms is not None:
        kept = suppressed(F.transform(tasks, lambda t: F.struct(t["bbox"].alias("bbox"), t["rtype"].alias("type"))), cfg.nms)
        tasks = F.filter(tasks, lambda t, i: F.array_contains(kept, i.cast("int")))
    return tasks


REGION = "struct<type:string,bbox:array<int>,language:string,legibility:string,transcription:string>"


def region(rtype: Column, box: Column, legibility: Column, text: Column) -> Column:
    return F.struct(rtype.alias("type"), box.alias("bbox"), F.lit("uk").alias("language"), legibility.alias("legibility"), text.alias("transcription"))


def expanded(rtype: Column, box: Column, legibility: Column, multiline: Column, raw: Column) -> Column:
    """The regions of an answered task: a band for each line of a block, else one region with the answer's first line (or all of a block)."""
    lines = payload.text_lines(raw)
    whole = payload.transcription(raw)
    cut = bands(box, F.size(lines))
    banded = F.transform(F.arrays_zip(cut.alias("b"), lines.alias("t")), lambda z: region(rtype, z["b"], F.lit("legible"), z["t"]))
    one = lambda t: F.array(region(rtype, box, legibility, t))
    silent = rtype.isin("image", "graph") | (legibility == "illegible")
    return F.when(silent, one(F.lit(""))).when(multiline & rtype.isin("handwritten", "printed"), F.when(lines.isNotNull(), banded).otherwise(one(whole))).otherwise(one(first_line(whole)))


PAGE = ("uuid", "source", "image", "image_width", "image_height")


def lines_found(tasks: DataFrame, backend: VisionBackend, cfg: Config) -> DataFrame:
    """Tasks (a row each) of which every text block is cut into its lines by a question of its own; one without lines stays whole, as one line."""
    block = F.coalesce(F.col("multiline"), F.lit(False))
    found = ask(tasks.where(block).withColumn("task", F.lit("find_lines")), backend, cfg)
    c = F.col("crop")
    w, h = c[2] - c[0], c[3] - c[1]
    boxes = payload.lines(F.col("raw"), w, h, F.col("frame_w"), F.col("frame_h"), c[0], c[1])
    each = found.select(*PAGE, "no", F.posexplode(F.when(F.size(boxes) > 0, boxes).otherwise(F.array("box"))).alias("part", "box"), "rtype", "legibility", F.lit(False).alias("multiline"))
    return each.unionByName(tasks.where(~block).select(*PAGE, "no", F.lit(0).alias("part"), "box", "rtype", "legibility", "multiline"))


def run(pages: DataFrame, backend: VisionBackend, cfg: Config = Config()) -> DataFrame:
    """(``uuid``, ``source``, ``regions``) of pages (``uuid``, ``source``, ``image``, ``image_width``, ``image_height``)."""
    base = pages.select(*PAGE, F.lit(None).cast("array<int>").alias("box"), F.lit(None).cast("string").alias("rtype"))
    w, h, fw, fh, raw = (F.col(c) for c in ("image_width", "image_height", "frame_w", "frame_h", "raw"))
    maths = F.coalesce(F.col("source").isin(*cfg.math_sources), F.lit(False)) if cfg.classify else F.lit(False)

    first = base.withColumn("task", F.when(maths, "classify").otherwise("skip"))
    typed = ask(first.where("task = 'classify'"), backend, cfg).select("uuid", (payload.page_type(raw) == "math").alias("is_math"))
    jobs = first.drop("task").join(typed, "uuid", "left").withColumn("is_math", F.coalesce("is_math", F.lit(False)))
    asked_ = jobs.withColumn("task", F.explode(F.when(F.col("is_math"), F.array(F.lit("detect"), F.lit("per_line"))).otherwise(F.array(F.lit("detect")))))
    got = ask(asked_, backend, cfg)
    read = got.groupBy(*PAGE).agg(
        F.first(F.when(F.col("task") == "detect", payload.blocks(raw, w, h, fw, fh)), True).alias("blocks"),
        F.first(F.when(F.col("task") == "per_line", payload.per_line(raw, w, h, fw, fh)), True).alias("lines"),
        F.first("is_math").alias("is_math"),
    )
    empty_lines = F.array().cast("array<struct<bbox:array<int>,rtype:string,legibility:string>>")
    tasks = read.withColumn("tasks", routed(F.coalesce("lines", empty_lines), F.col("blocks"), F.col("is_math"), cfg))
    # from here on the page is as many rows as it has tasks; a page without any keeps one
    each = tasks.select(*PAGE, F.posexplode_outer("tasks").alias("no", "t"))
    each = each.select(*PAGE, "no", F.lit(0).alias("part"), F.col("t.bbox").alias("box"), F.col("t.rtype").alias("rtype"), F.col("t.legibility").alias("legibility"), F.col("t.multiline").alias("multiline"))
    if cfg.find_lines:
        each = lines_found(each, backend, cfg)
    mute = F.col("no").isNull() | F.col("rtype").isin("image", "graph") | (F.col("legibility") == "illegible")
    spoken = ask(each.where(~mute).withColumn("task", F.when(F.col("multiline"), "lines").otherwise("text")), backend, cfg)
    keep = ["uuid", "source", "no", "part", "box", "rtype", "legibility", "multiline"]
    answered = spoken.select(*keep, "raw").unionByName(each.where(mute).select(*keep, F.lit("").alias("raw")))
    regions = F.when(F.col("no").isNotNull(), expanded(F.col("rtype"), F.col("box"), F.col("legibility"), F.col("multiline"), raw))
    parts = answered.select("uuid", "source", F.struct("no", "part", regions.alias("r")).alias("p"), "no")
    fan_in = parts.groupBy("uuid", "source").agg(F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), F.col("p")))).alias("parts"))
    return fan_in.select("uuid", "source", in_output_order(F.flatten(F.transform("parts", lambda p: p["r"]))).alias("regions"))


def fake_backend(request: Request) -> tuple[str, int, int]:
    """A deterministic model for tests: every page has one text block of two lines and one picture."""
    task, image = request.task, request.image
    if task == "classify":
        return '{"page_type": "math"}' if "math" in image else '{"page_type": "text"}', 0, 0
    if task == "detect":
        return 'Sure: {"blocks": [{"bbox_2d": [10, 50, 90, 90], "block_type": "image"}, {"bbox_2d": ["10", "10", "90", "50"], "writing_type": "printed"}]}', 100, 100
    if task == "per_line":
        return '{"lines": [{"bbox": [0, 0, 50, 10]}, {"bbox": [0, 20, 50, 30], "block_type": "formula"}, {"bbox": [0, 40, 50, 50]}]}', 100, 100
    if task == "find_lines":
        return '{"lines": [[0, 0, 100, 40], {"bbox": [0, 50, 100, 100]}]}', 100, 100
    if task == "lines":
        return '{"lines": ["one", " ", "two"]}', 0, 0
    return '{"text": "x\\ny"}', 0, 0
