"""The engine's end-to-end plans: evaluate, clean, infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlab.functions.pixels import straightened
from regionlab.functions.text import basename
from regionlab.operators import cleaning, export, inference, manifest, records, scoring, splits
from regionlab.sources import files


def evaluate(solution: DataFrame, submission: DataFrame, order: str = "row_no", strict: bool = True) -> DataFrame:
    """Report of a submission (``image``, ``regions`` as JSON, ``order``) on a solution (``image``, nested ``regions``).

    ``strict``: unfit rows (also of images that the solution lacks) and missing images raise ``InvalidSubmission``. Else unfit rows and
    missing images count as empty pages.
    """
    parsed = submission.select("image", order, records.parsed_submission(F.col("image"), F.col("regions")).alias("p"))
    if strict:
        scoring.require_complete(solution, submission)
        scoring.require_valid(parsed.select("image", "p.reason", "p.error_field", "p.error_message"))
    typed = parsed.select("image", order, F.when(F.col("p.reason").isNull(), F.col("p.regions")).alias("regions"))
    return scoring.report(scoring.per_page(solution, scoring.last_per_image(typed, order=order)))


def clean(train: DataFrame, silver: DataFrame, held_out: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Cleaned pages and statistics of both parts. ``held_out``: pages (``file_name``) that must not be in the cleaned training part.

    By default the whole training part is cleaned, validation pages included.
    """
    if held_out is not None:
        train = splits.exclude(train, held_out, "file_name")
    known = cleaning.vocabulary_text(train)
    rules: dict[str, tuple[DataFrame, object]] = {"train": (train, cleaning.is_clean_train), "silver": (silver, lambda r: cleaning.is_clean_silver(r, known))}
    return {k: (cleaning.filter_regions(df, rule), cleaning.filter_stats(df, rule)) for k, (df, rule) in rules.items()}


def infer(pages: DataFrame, done: DataFrame | None, backend: inference.VisionBackend, out: str, cfg: inference.Config = inference.Config()) -> None:
    """Results of the pages that have none yet, appended to ``out``."""
    todo = manifest.pending(pages, done, "uuid") if done is not None else pages
    files.append_results(inference.run(todo, backend, cfg), out)


def straighten(images: DataFrame, folder: str, cfg: inference.Config) -> DataFrame:
    """Images (``name``, ``content``) as they are to be looked at, in ``folder``: turned by the slant of their ink if the settings say so. Those there already are left."""
    content = straightened(F.col("content"), most=cfg.deskew_most) if cfg.deskew else F.col("content")
    return files.write_files(images.select("name", content.alias("content")), folder)


SAMPLES = {"detect": export.detect_samples, "transcribe": export.transcribe_samples}


def export_samples(pages: DataFrame, out: str, names: tuple[str, ...] = files.SPLITS, tasks: tuple[str, ...] = ("detect", "transcribe"), images: DataFrame | None = None) -> dict[tuple[str, str], int]:
    """JSON lines of chat samples of every split and task below ``out``, and their numbers. ``pages`` has a ``split``.

    ``images`` (``name``): those that can be read; pages without one are left out, as their crops are.
    """
    if images is not None:
        pages = pages.withColumn("__name", basename(F.col("file_name"))).join(images.select(F.col("name").alias("__name")).distinct(), "__name", "left_semi").drop("__name")
    return {(s, t): files.write_jsonl(SAMPLES[t](pages.where(F.col("split") == s)), f"{out.rstrip('/')}/{s}/{t}") for s in names for t in tasks}
