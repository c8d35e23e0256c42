"""Items of varying size packed into containers of fixed capacity, planned over the histogram of sizes.

An item above the capacity is cut into full containers and one remainder; every other item stays whole. What remains to be packed is a
multiset of sizes ``1..capacity``, so the plan needs only *how many* items there are of each size: best-fit decreasing runs over the
counts, placing whole groups of equal containers at a time. Its result is a list of slots: "the items of size l with ranks a.. go, q
apiece, into the containers from c on". Items then take their slots by joining on their rank within their size. The work on the driver
is bounded by the capacity, never by the number of items.

Ranks within a size are dealt without ever gathering a size in one task: items count by (size, part of the id), offsets come from the
small table of those counts, and only (size, part) groups are numbered. Slots are joined by size and range of ranks, so an item meets about
two of them however many slots its size has.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionlab.session import kept, written

PART_ROWS = 100_000  # about as many items of one size are numbered together; a task sorts one such part at a time
LEAST_PARTS = 64


@dataclass(frozen=True)
class Slot:
    """Items of ``size`` with ranks ``first .. first + count - 1`` fill the containers from ``container`` on, ``each`` to one."""

    size: int
    first: int
    count: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """(slots, number of containers) by best-fit decreasing over the counts of sizes ``1..capacity``.

    Open containers form groups of equal free space, each a range of container numbers. For the largest size first: of the groups with
    room the one with the least free space takes as many items a container as fit.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (start, number)
    levels: list[int] = []  # its keys, ascending
    slots: list[Slot] = []
    opened = 0

    def put(space: int, start: int, n: int) -> None:
        if space and n:
            if space not in free:
                levels.insert(bisect_left(levels, space), space)
                free[space] = []
            free[space].append((start, n))

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} does not lie in 1..{capacity}")
        left, rank = histogram[size], 0
        while left:
            i = bisect_left(levels, size)
            if i == len(levels):
                each = capacity // size
                n = max(1, left // each)
                put(capacity, opened, n)
                opened += n
                continue
            space = levels[i]
            start, n = free[space].pop()
            if not free[space]:
                del free[space]
                levels.pop(i)
            each = space // size
            if left < each:  # the last few share one container
                each = left
            used = min(n, left // each)
            slots.append(Slot(size, rank, used * each, start, each))
            put(space, start + used, n - used)
            put(space - each * size, start, used)
            rank += used * each
            left -= used * each
    return slots, opened


def numbered_parts(most: int) -> int:
    """Parts for the items of one size, by the number of items of the most frequent one."""
    return max(LEAST_PARTS, -(-most // PART_ROWS))


def by_rank(slots: list[Slot], histogram: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, Slot]]]:
    """((size, width), (size, bucket, slot)): the slots by ranges of ``width`` ranks that they reach into.

    A size has as many ranges as slots, so there are at most twice as many rows as slots, and a rank meets about two of them.
    """
    of: dict[int, list[Slot]] = {}
    for s in slots:
        of.setdefault(s.size, []).append(s)
    widths = [(size, -(-histogram[size] // len(held))) for size, held in of.items()]
    return widths, [(size, b, s) for size, w in widths for s in of[size] for b in range(s.first // w, (s.first + s.count - 1) // w + 1)]


def ranked(items: DataFrame, id_col: str, size: str, by: list[str], parts: int) -> DataFrame:
    """``items`` with ``rank`` (0-based, in the order of part and id) among those of equal ``by`` and ``size``."""
    b = items.withColumn("__b", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"))
    keys = [*by, size]
    counts = b.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    within = Window.partitionBy(*keys, "__b").orderBy(id_col)
    return b.withColumn("__r", F.row_number().over(within) - 1).join(offsets, [*keys, "__b"]).withColumn("rank", F.col("__r") + F.col("__o")).drop("__r", "__o", "__b")


ASSIGNED = "limit_name, capacity, container, doc_id, piece, n_tokens"


def pack(sizes: DataFrame, limits: dict[str, int], id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(``limit_name``, ``capacity``, ``container``, id, ``piece``, ``n_tokens``): where every piece of every item lies.

    ``sizes``: (id, size) with unique ids; it is read several times, so it should be written. Items of null or no size lie in no
    container. ``piece`` is -1 for a whole item, else the 0-based number of the piece of a cut one. Containers are numbered from 0 by
    limit: first the planned ones, then the full pieces of cut items, one container each. A limit below 1 raises ``ValueError``. Ids that
    occur twice are items of their own; an id column named like another column of the result comes out as ``kept_<name>``.
    """
    if bad := {k: c for k, c in limits.items() if c < 1}:
        raise ValueError(f"no capacity: {bad}")
    spark = sizes.sparkSession
    out_id = kept([id_col], {"limit_name", "capacity", "container", "piece", "n_tokens"})[id_col]
    items = sizes.select(F.col(id_col).alias("__id"), F.col(size).alias("__size")).where("__size > 0")
    id_col, size = "__id", "__size"
    named = F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(limits.items())])
    each = items.select(id_col, size, F.explode(named).alias("l")).select(id_col, size, "l.limit_name", "l.capacity")
    # what is planned: whole items and the remainders of cut ones
    cuts = F.when(F.col(size) > F.col("capacity"), F.floor(F.col(size) / F.col("capacity"))).otherwise(F.lit(0))
    each = each.withColumn("cuts", cuts.cast("long")).withColumn("rest", (F.col(size) - F.col("cuts") * F.col("capacity")).cast("int"))
    loose = each.where("rest > 0").select(id_col, "limit_name", "capacity", "rest", F.when(F.col("cuts") > 0, F.col("cuts")).otherwise(-1).cast("int").alias("piece"))

    # at most sum of the capacities rows
    histogram: dict[str, dict[int, int]] = {k: {} for k in limits}
    for r in loose.groupBy("limit_name", "rest").agg(F.count("*").alias("n")).collect():
        histogram[r["limit_name"]][r["rest"]] = r["n"]
    rows, widths, opened = [], [], {}
    for name, c in limits.items():
        slots, opened[name] = plan(histogram[name], c)
        wide, reached = by_rank(slots, histogram[name])
        widths += [(name, size, w) for size, w in wide]
        rows += [(name, size, b, s.first, s.count, s.container, s.each) for size, b, s in reached]
    parts = numbered_parts(max((n for h in histogram.values() for n in h.values()), default=0))
    # a row per size of a limit; then an item joins the slots of its range of ranks
    of_size = F.broadcast(spark.createDataFrame(widths, "limit_name string, rest int, width bigint"))
    slots = spark.createDataFrame(rows, "limit_name string, rest int, bucket bigint, first bigint, count bigint, start bigint, each bigint")
    placed = ranked(loose, id_col, "rest", ["limit_name"], parts).join(of_size, ["limit_name", "rest"]).withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    taken = placed.join(F.broadcast(slots) if len(rows) <= MOST_SLOTS else slots, ["limit_name", "rest", "bucket"])
    taken = taken.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
    planned = taken.select(
        "limit_name", "capacity", (F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container"), id_col, "piece", F.col("rest").cast("long").alias("n_tokens")
    )

    # full pieces: numbered behind the planned containers, by bucket so that no task holds them all
    cut = each.where("cuts > 0").withColumn("__b", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"))
    per = cut.groupBy("limit_name", "__b").agg(F.sum("cuts").alias("n"))
    before = Window.partitionBy("limit_name").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.create_map(*[x for k, n in opened.items() for x in (F.lit(k), F.lit(n).cast("long"))])
    per = per.select("limit_name", "__b", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start[F.col("limit_name")]).alias("__o"))
    running = F.sum("cuts").over(Window.partitionBy("limit_name", "__b").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1))
    full = cut.withColumn("__r", F.coalesce(running, F.lit(0))).join(per, ["limit_name", "__b"])
    full = full.select("limit_name", "capacity", F.col("__o").alias("o"), F.col("__r").alias("r"), id_col, F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("piece", "p"))
    full = full.select("limit_name", "capacity", (F.col("o") + F.col("r") + F.col("p")).alias("container"), id_col, "piece", F.col("capacity").alias("n_tokens"))
    return planned.unionByName(full).withColumnRenamed("__id", out_id)


MOST_SLOTS = 200_000  # slots that are broadcast (some 10 MB); beyond, the plan is joined by shuffle


def containers(assigned: DataFrame) -> DataFrame:
    """(``limit_name``, ``capacity``, ``container``, ``pieces``, ``used``, ``unused``) of every container."""
    by = assigned.groupBy("limit_name", "capacity", "container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used"))
    return by.withColumn("unused", F.col("capacity") - F.col("used"))


def sized(docs: DataFrame, count, id_col: str = "doc_id") -> DataFrame:
    """(id, ``n_tokens``), written: sizes are made once and read by the histogram, the ranks and the join."""
    return written(docs.select(id_col, count.cast("long").alias("n_tokens")))
