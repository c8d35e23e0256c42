"""Sources combined to target shares of the total size.

Capped water-filling: the total is dealt out by target share; a source that would have to repeat more than its cap is clamped at its cap
and the excess is dealt to the others in proportion to their targets, until no source is above its cap. A source's allotment is a number
of epochs: every document is taken the whole number of times, and a seeded random part of them, in size equal to the fraction, once
more. Only per-source totals come to the driver.

The fractional part is exact to one document and needs no sort of a source: documents are dealt by a seeded hash to slices of
each source, ``SLICES`` or more; slices are taken in order as far as they fit, and only the slice in which the line falls is cut by a running sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionlab.session import kept

SLICES = 4096  # at least; more where a slice of all documents would hold over SLICE_ROWS of them
SLICE_ROWS = 100_000


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    cap: float  # epochs
    available: int
    allotted: float

    @property
    def epochs(self) -> float:
        return self.allotted / self.available if self.available else 0.0


def water_fill(targets: dict[str, tuple[float, float]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """``targets``: source -> (share, cap in epochs). ``total``: the size to reach; by default that of one epoch of all the sources.

    Shares are normalized to sum 1. Sources without data are clamped at 0. If all caps together lie below the total, every source is
    taken to its cap.
    """
    have = {s: int(available.get(s, 0)) for s in targets}
    weight = {s: max(0.0, t[0]) for s, t in targets.items()}
    limit = {s: have[s] * max(0.0, targets[s][1]) for s in targets}
    total = float(sum(have.values()) if total is None else total)
    got = dict.fromkeys(targets, 0.0)
    open_, left = {s for s in targets if weight[s] > 0}, total
    while open_ and left > 0:
        scale = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * scale >= limit[s]}
        if not over:
            for s in open_:
                got[s] = weight[s] * scale
            break
        for s in over:
            got[s] = limit[s]
            left -= limit[s]
        open_ -= over
    norm = sum(weight.values()) or 1.0
    return [Share(s, weight[s] / norm, targets[s][1], have[s], got[s]) for s in sorted(targets)]


def source_key(source: Column) -> Column:
    """Sources that differ only in letter case or outer blanks are one."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def mix(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", total: float | None = None, seed: int = 17) -> tuple[DataFrame, list[Share]]:
    """(chosen documents: ``source``, id, ``repeats``, ``n_tokens``; the shares).

    ``sized``: (id, ``source``, ``n_tokens``), written, since it is read more than once. Documents of sources without a target, of a null
    source or of no tokens are not chosen. Several targets of one source are added up, with the least cap of them. Equal seeds choose
    equal documents. ``targets`` is a short list of settings. Ids that occur twice are documents of their own; an id column named like
    another column of the result comes out as ``kept_<name>``.
    """
    spark = sized.sparkSession
    wanted: dict[str, tuple[float, float]] = {}
    for r in targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if r["s"] is not None:
            w, m = wanted.get(r["s"], (0.0, float("inf")))
            wanted[r["s"]] = (w + (r["target_share"] or 0.0), min(m, float(r["max_repeats"] or 0)))
    out_id = kept([id_col], {"source", "repeats", "n_tokens"})[id_col]
    sized, id_col = sized.select(F.col(id_col).alias("__id"), "source", "n_tokens"), "__id"
    docs = sized.select(id_col, source_key(F.col("source")).alias("source"), "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    slices = max(SLICES, -(-sized.count() // SLICE_ROWS))
    slice_of = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(slices)).cast("int")
    docs = docs.withColumn("__slice", slice_of)
    per_slice = docs.groupBy("source", "__slice").agg(F.sum("n_tokens").alias("__n"))
    shares = water_fill(wanted, {r["source"]: r["n"] for r in per_slice.groupBy("source").agg(F.sum("__n").alias("n")).collect()}, total)

    rows = [(s.source, int(min(s.epochs + 1e-12, s.cap)), s.allotted - int(min(s.epochs + 1e-12, s.cap)) * s.available) for s in shares]
    plan = spark.createDataFrame(rows, "source string, whole int, part double")
    running = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = per_slice.withColumn("__to", F.sum("__n").over(running)).join(F.broadcast(plan), "source")
    # part that may still be taken from this slice; a slice below the line is taken whole, one above not at all
    lines = lines.select("source", "__slice", "whole", "__n", (F.col("part") - (F.col("__to") - F.col("__n"))).alias("__room"))
    at = docs.join(lines, ["source", "__slice"])
    inside = at.where((F.col("__room") > 0) & (F.col("__room") < F.col("__n")))
    order = Window.partitionBy("source", "__slice").orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col)), id_col)
    cut = inside.withColumn("__before", F.sum("n_tokens").over(order) - F.col("n_tokens")).withColumn("__more", (F.col("__before") + F.col("n_tokens") / 2 <= F.col("__room")).cast("int"))
    rest = at.where(~((F.col("__room") > 0) & (F.col("__room") < F.col("__n")))).withColumn("__more", (F.col("__room") >= F.col("__n")).cast("int"))
    out = ["source", id_col, (F.col("whole") + F.col("__more")).alias("repeats"), "n_tokens"]
    chosen = rest.select(*out).unionByName(cut.select(*out)).where("repeats > 0")
    return chosen.withColumnRenamed("__id", out_id), shares


def reached(chosen: DataFrame, shares: list[Share]) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``available_tokens``, ``tokens``, ``documents``, ``share``) of every source."""
    spark = chosen.sparkSession
    rows = [(s.source, s.target, s.cap, s.available) for s in shares]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats double, available_tokens bigint")
    got = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"))
    all_ = got.agg(F.sum("tokens").alias("__t"))
    r = targets.join(got, "source", "left").join(F.broadcast(all_))
    return r.select("source", "target_share", "max_repeats", "available_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("tokens") / F.col("__t"), F.lit(0.0)).alias("share"))
