"""Records of evaluation splits that also lie, exactly or almost, in training.

Two pages are the same if they have the same image, or texts of which at least ``MIN_COMMON`` of the longer one's words are common in
order (a longest common subsequence), as read by eye: words come from ``confusables.words``.

1. Every page's words and keys are made once and written. Equal texts form one class; copies never meet before the result.
2. The evaluation classes are dealt to *shards* by length, each of at most ``SHARD_WORDS`` words. A shard becomes a compressed
   full-text index (``fmindex``).
3. Training classes are sent to the shards of compatible length and dealt to parts of ``PART_WORDS`` words; the task of a part loads its
   shard's index once. Backward search counts every run of two words of a text (``Index.search``), rare or not, before any is listed.
4. No pair of the rule shares fewer than ``least_common`` runs, so the texts of a query's most frequent runs need not be listed: of r runs
   due all but ``SPARE - 1`` may be left out. What was listed counts towards what is due then; texts that lack too many of each other's words
   (by their signatures) cannot be a pair either. Both are bounds: no pair is lost.
5. The runs that a candidate shares merge to maximal spans; their words must reach a bound too. The exact length of the common
   subsequence (bit-parallel) decides.
6. ``class_links`` gives the links of classes, ``report`` counts pairs from class sizes without listing them. ``overlaps`` lists every pair
   of rows; hot keys are salted on both sides.

Why two words: let c words be common in order, of texts of n and m words. They hold c - 1 pairs of neighbours. Each of the n + m - 2c other
words parts at most one of them, so 3c - 1 - n - m neighbours stay together in both texts. With c = 3/4 of the longer this is one or more
from three words on, but for two texts of four words each: texts that short are looked for by single words.

The cost is the training words times the shards of compatible length, and the chance hits, which grow with both sides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlab.llm.confusables import skeleton, words
from regionlab.llm.fmindex import Index, signatures
from regionlab.session import kept, written

MIN_COMMON = 0.75
SHARD_WORDS = 1_000_000  # of evaluation texts in an index
PART_WORDS = 1_000_000  # of training texts in a task
AT_ONCE = 200_000  # words of training texts searched together
EXPAND = 1_000_000  # hits listed at a time, or those of one query
SPARE = 4  # runs that a candidate must be seen to share, where so many are due
HOT = 20_000  # rows of one key on one side that are joined in one task


def run_length(n: int) -> int:
    """Words of a run that is looked up, by the length of the evaluation text; see ``least_common``."""
    return 1 if n <= 4 else 2


def common_due(n, m, min_common: float = MIN_COMMON):
    """Words that texts of ``n`` and ``m`` words have in common in order if they are almost the same (arrays or numbers)."""
    return np.ceil(min_common * np.maximum(n, m) - 1e-9).astype(np.int64)


def least_common(n, m, run: int, min_common: float = MIN_COMMON):
    """Places of either text from which texts that are almost the same share a run of one or two words at least."""
    c = common_due(n, m, min_common)
    return c if run == 1 else 3 * c - 1 - n - m


def least_covered(n, m, run: int, min_common: float = MIN_COMMON):
    """Words of either text that lie in shared runs at least: the common ones fall into n + m - 2c + 1 blocks at most, all but one of a word."""
    c = common_due(n, m, min_common)
    return c if run == 1 else 3 * c - n - m


def common_words(a: np.ndarray | list, b: np.ndarray | list) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for w in b:
        u = s & at.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def common_spans(a: list[int], b: list[int], run: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal spans of ``a`` whose every run of ``run`` words occurs in ``b``: the matches, merged."""
    held = {tuple(b[j : j + run]) for j in range(len(b) - run + 1)}
    out: list[tuple[int, int]] = []
    for i in range(len(a) - run + 1):
        if tuple(a[i : i + run]) in held:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + run)
            else:
                out.append((i, i + run))
    return out


class Search:
    """Looks the texts of one batch of queries up in an index."""

    def __init__(self, index: Index, queries: list[list[str]], min_common: float):
        self.index, self.min_common = index, min_common
        self.sizes = np.array([len(q) for q in queries], np.int64)
        self.coded = [index.numbered(q) for q in queries]
        self.numbers = np.array([x for q in self.coded for x in q], np.int64)
        self.of = np.repeat(np.arange(len(queries)), self.sizes)
        known = self.numbers > 0
        self.unknown = np.bincount(self.of[~known], minlength=len(queries))
        self.signs = signatures(len(queries), self.of[known], self.numbers[known], index.signs.shape[1] * 64)

    def due(self) -> np.ndarray:
        """Runs that each query shares with any text it is almost the same as."""
        lengths = np.unique(self.index.sizes)
        sizes, back = np.unique(self.sizes, return_inverse=True)
        n, m = lengths[None], sizes[:, None]
        least = np.where(np.minimum(n, m) >= common_due(n, m, self.min_common), least_common(n, m, self.index.run, self.min_common), np.iinfo(np.int64).max)
        return np.maximum(least.min(1), 1)[back]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, low, suffixes) of every place from which a run is known, those of most suffixes first within a query."""
        run = self.index.run
        n = len(self.numbers) - run + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        held = np.stack([self.numbers[k : n + k] for k in range(run)], 1)
        at = np.flatnonzero((self.of[:n] == self.of[run - 1 :]) & (held > 0).all(1))
        distinct, back = np.unique(held[at] @ np.array([len(self.index.first) ** k for k in range(run)]), return_inverse=True)
        once = np.zeros(len(distinct), np.int64)
        once[back] = at
        low, high = self.index.search(held[once])
        low, wide = low[back], (high - low)[back]
        query = self.of[at]
        order = np.lexsort((low, -wide, query))
        order = order[wide[order] > 0]
        return query[order], low[order], wide[order]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, text) of all pairs that no bound rules out."""
        due = self.due()
        query, low, wide = self.runs()
        begins = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        held = np.diff(np.r_[begins, len(query)])
        left_out = np.maximum(due - SPARE, 0)
        place = np.arange(len(query)) - np.repeat(begins, held)
        listed = (np.repeat(held, held) >= due[query]) & (place >= left_out[query])
        query, low, wide = query[listed], low[listed], wide[listed]
        # equal runs of one query lie side by side: looked up once, counted as often as they are there
        new = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (low[1:] != low[:-1])]) if len(query) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(query)])
        query, low, wide = query[new], low[new], wide[new]
        # whole queries at a time, so that all that is listed of a pair is counted together
        begins = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        ends, done = np.r_[begins[1:], len(query)], np.r_[0, np.cumsum(wide)]
        i = 0
        while i < len(begins):
            a = begins[i]
            i = max(i + 1, int(np.searchsorted(done[ends], done[a] + EXPAND, side="right")))
            b = ends[i - 1]
            run = np.repeat(np.arange(a, b), wide[a:b])
            text = self.index.owner[np.arange(len(run)) + (low[run] - (done[run] - done[a]))].astype(np.int64)
            pair = query[run] * len(self.index.keys) + text
            order = np.argsort(pair)
            pair = pair[order]
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            shared = np.add.reduceat(times[run][order], starts)
            q, t = pair[starts] // len(self.index.keys), pair[starts] % len(self.index.keys)
            n, m = self.index.sizes[t], self.sizes[q]
            c = common_due(n, m, self.min_common)
            ok = (np.minimum(n, m) >= c) & (shared >= least_common(n, m, self.index.run, self.min_common) - left_out[q])
            q, t, n, m, c = (x[ok] for x in (q, t, n, m, c))
            mine, theirs = self.signs[q], self.index.signs[t]
            ok = (np.bitwise_count(mine & ~theirs).sum(1) + self.unknown[q] <= m - c) & (np.bitwise_count(theirs & ~mine).sum(1) <= n - c)
            yield q[ok], t[ok]

    def close(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(query, text, common words, spans, words of the query in them) of all texts that are almost the same, equal ones included."""
        run = self.index.run
        found = list(self.candidates())
        if not found:
            return
        query, text = (np.concatenate(x) for x in zip(*found, strict=True))
        # the texts of all candidates are read back together: no more than the shard's words
        distinct, back = np.unique(text, return_inverse=True)
        texts = self.index.texts(distinct)
        for i, k, j in zip(query.tolist(), back.tolist(), text.tolist(), strict=True):
            a, b = self.coded[i], texts[k]
            spans = common_spans(a, b, run)
            covered = sum(y - x for x, y in spans)
            if covered >= least_covered(len(b), len(a), run, self.min_common):
                c = common_words(a, b)
                if c >= common_due(len(b), len(a), self.min_common):
                    yield i, j, c, len(spans), covered


LINKS = "train_key string, eval_key string, common int, spans int, covered int"


def close_to(index: Index, keys: list[str], queries: list[list[str]], min_common: float = MIN_COMMON) -> Iterator[tuple[str, str, int, int, int]]:
    """Rows of ``LINKS`` for the queries, texts of different keys only; long batches are taken in pieces."""
    held = np.cumsum([len(q) for q in queries]) // AT_ONCE
    cuts = np.flatnonzero(np.r_[True, held[1:] != held[:-1], True]) if len(queries) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for i, j, *counts in Search(index, queries[a:b], min_common).close():
            if keys[a + i] != index.keys[j]:
                yield keys[a + i], index.keys[j], *counts


@dataclass(frozen=True)
class Shard:
    no: int
    shortest: int
    longest: int
    run: int
    parts: int  # > 1: the texts of one length, dealt by hash to shards no .. no + parts - 1


def plan_shards(lengths: dict[int, int], most: int = SHARD_WORDS) -> list[Shard]:
    """Ranges of lengths with about ``most`` words each; a length that has more is split. Ranges keep to one run length."""
    out: list[Shard] = []
    no = 0
    run: list[int] = []
    held = 0

    def close() -> None:
        nonlocal no, run, held
        if run:
            out.append(Shard(no, run[0], run[-1], run_length(run[0]), 1))
            no += 1
        run, held = [], 0

    for n in sorted(lengths):
        size = (n + 1) * lengths[n]
        if run and (held + size > most or run_length(n) != run_length(run[0])):
            close()
        if size > most:
            parts = math.ceil(size / most)
            out.append(Shard(no, n, n, run_length(n), parts))
            no += parts
        else:
            run.append(n)
            held += size
    close()
    return out


def deals(shards: list[Shard], lengths: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(length, first shard, run, shards it is dealt to): both lists ascend, so one pass pairs them."""
    out, i = [], 0
    for n in sorted(lengths):
        while shards[i].longest < n:
            i += 1
        out.append((n, shards[i].no, shards[i].run, shards[i].parts))
    return out


def plan_routes(shards: list[Shard], lengths: dict[int, int], min_common: float, part_words: int) -> list[tuple[int, int, int]]:
    """(words of a training text, shard, parts of the shard's training texts) for all compatible lengths, by two ends that move up."""
    ns = sorted(lengths)
    words_ = np.r_[0, np.cumsum([n * lengths[n] for n in ns])]
    out = []
    for s in shards:
        a = int(np.searchsorted(ns, min_common * s.shortest - 1e-9))
        b = int(np.searchsorted(ns, s.longest / min_common + 1e-9, side="right"))
        parts = max(1, math.ceil(float(words_[b] - words_[a]) / part_words))
        out += [(n, s.no + k, parts) for n in ns[a:b] for k in range(s.parts)]
    return out


PAGES = "row_id bigint, side string, image_key string, text_key string, words string, n int"


def pages(df: DataFrame, row_id: str, side: str, file_name: str, text: str, *keep: str) -> DataFrame:
    """``PAGES`` and ``keep``: keys and words of every page, written. Texts without words are compared by their signs; blank ones have no key.

    ``side``: ``train`` or ``eval``; rows of another side, or of none, take no part. Kept columns that bear the name of a made one come
    out as ``kept_<name>``.
    """
    names = kept(keep, {"row_id", "side", "image_key", "text_key", "words", "n", "t"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = [words(t) for t in pdf["t"]]
            joined = [" ".join(x) for x in w]
            signs = ["" if x or not t else "\x00" + "".join(skeleton(t).split()) for x, t in zip(w, pdf["t"], strict=True)]
            key = [hashlib.md5((j or s).encode("utf-8", "surrogatepass")).hexdigest() if j or len(s) > 1 else None for j, s in zip(joined, signs, strict=True)]
            made = pdf.drop(columns="t").assign(text_key=key, words=joined, n=[len(x) for x in w])
            yield made[["row_id", "side", "image_key", "text_key", "words", "n", *names.values()]]

    name = F.lower(F.trim(F.regexp_replace(F.element_at(F.split(F.col(f"`{file_name}`"), r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")))
    image = F.when(name != "", name)
    carried = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    read = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{side}`").alias("side"), image.alias("image_key"), F.col(f"`{text}`").alias("t"), *carried)
    extra = "".join(f", `{n}` {read.schema[n].dataType.simpleString()}" for n in names.values())
    return written(read.where("side in ('train', 'eval')").mapInPandas(run, PAGES + extra))


def text_classes(p: DataFrame) -> DataFrame:
    """(``side``, ``text_key``, ``words``, ``n``): one row for all pages of a side with equal words; texts of one or two words have no near ones."""
    return p.where("n >= 3").groupBy("side", "text_key").agg(F.max("words").alias("words"), F.max("n").alias("n"))


def close_texts(p: DataFrame, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS, min_common: float = MIN_COMMON) -> DataFrame:
    """``LINKS``: different text classes of training and evaluation that are almost the same, with their common words in order, and the
    spans of the training text (and words in them) that runs of the other cover.

    ``min_common``: at least ``MIN_COMMON``, below which pairs need share no run.
    """
    if min_common < MIN_COMMON:
        raise ValueError(f"min_common is below {MIN_COMMON}")
    spark = p.sparkSession
    classes = written(text_classes(p))
    # two rows per length of a text
    lengths: dict[str, dict[int, int]] = {"train": {}, "eval": {}}
    for r in classes.groupBy("side", "n").agg(F.count("*").alias("c")).collect():
        lengths[r["side"]][r["n"]] = r["c"]
    shards = plan_shards(lengths["eval"], shard_words)
    routes = plan_routes(shards, lengths["train"], min_common, part_words)
    if not routes:
        return spark.createDataFrame([], LINKS)
    dealt = classes.where("side = 'eval'").join(F.broadcast(spark.createDataFrame(deals(shards, lengths["eval"]), "n int, no int, run int, deal int")), "n")
    dealt = dealt.select((F.col("no") + F.pmod(F.xxhash64("text_key"), F.col("deal")).cast("int")).alias("shard"), "run", "text_key", "words")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text_key")
        index = Index.build(pdf["text_key"].tolist(), pdf["words"].tolist(), int(pdf["run"].iloc[0]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [index.dump()]})

    # written, so that no index is built twice
    indexes = written(dealt.groupBy("shard").applyInPandas(build, "shard int, blob binary"))
    # a group for every part of a shard's training texts, with the shard's index; each has a partition of its own, so that what a task
    # reads does not grow with the data
    parts = dict(sorted({(no, k) for _, no, k in routes}))
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    groups = sum(parts.values())
    numbered = list(enumerate(own_partitions(spark, groups)))
    slots = lambda: F.broadcast(spark.createDataFrame(numbered, "no int, slot int"))
    of_shard = spark.createDataFrame([(no, first[no], k) for no, k in parts.items()], "shard int, first int, parts int")
    indexes = indexes.join(F.broadcast(of_shard), "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("no"), "blob").join(slots(), "no")
    # a row per length that occurs and shard that is compatible
    way = spark.createDataFrame([(n, first[no], k) for n, no, k in routes], "n int, first int, parts int")
    routed = classes.where("side = 'train'").join(F.broadcast(way), "n")
    routed = routed.select((F.col("first") + F.pmod(F.xxhash64("text_key"), F.col("parts"))).cast("int").alias("no"), "text_key", "words").join(slots(), "no")
    routed, indexes = (x.drop("no").repartition(groups, "slot") for x in (routed, indexes))

    def look_up(texts: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(texts) and len(index):
            found = list(close_to(Index.load(index["blob"].iloc[0]), texts["text_key"].tolist(), [t.split(" ") for t in texts["words"]], min_common))
        return pd.DataFrame(found, columns=["train_key", "eval_key", "common", "spans", "covered"])

    return routed.groupBy("slot").cogroup(indexes.groupBy("slot")).applyInPandas(look_up, LINKS)


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning into ``n`` partitions sends to one each."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < n:
        ids = spark.range(begin, begin + 16 * n, 1, 1).select(F.col("id").cast("int").alias("k"))
        for r in ids.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect():
            found.setdefault(r["p"], r["k"])
        begin += 16 * n
    return [found[p] for p in range(n)]


def class_links(p: DataFrame) -> DataFrame:
    """(``kind``, ``train_key``, ``eval_key``, ``common``): ties of classes: ``image`` and ``text`` of equal keys, ``close`` of near texts with the words they have in common.

    The rows of a class are those of ``p`` with its key, so a page that is a third of all rows is one class.
    """
    keys = lambda side, key: p.where((F.col("side") == side) & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    same = [keys("train", f"{k}_key").join(keys("eval", f"{k}_key"), "k").select(F.lit(k).alias("kind"), F.col("k").alias("train_key"), F.col("k").alias("eval_key"), F.lit(None).cast("int").alias("common")) for k in ("image", "text")]
    return same[0].unionByName(same[1]).unionByName(close_texts(p).select(F.lit("close").alias("kind"), "train_key", "eval_key", "common"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """Inner join on ``key``, in which a key of more than ``hot`` rows on a side is dealt to several tasks.

    Such a side's rows are split into groups of about ``hot``, and the other side's rows sent to each. A pair of rows meets in one task.
    """
    n = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / hot).cast("int").alias(name))
    cuts = n(left, "__a").join(n(right, "__b"), key).where("__a > 1 or __b > 1")
    whole = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = lambda df, c: F.pmod(F.xxhash64(*df.columns), whole(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), whole(c) - 1))
    # few keys are hot: Spark broadcasts their list if it is small, and joins by shuffle if not
    a = left.join(cuts, key, "left").select(*left.columns, own(left, "__a").alias("__x"), every("__b").alias("__y"))
    b = right.join(cuts, key, "left").select(*right.columns, every("__a").alias("__x"), own(right, "__b").alias("__y"))
    return a.join(b, [key, "__x", "__y"]).drop("__x", "__y")


def overlaps(p: DataFrame, near: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(``train_row``, ``eval_row``, ``tie``): every pair of rows, once. ``p``: result of ``pages``; ``near``: result of ``close_texts``.

    ``tie``: ``image``, ``text`` or ``close``, the first that holds. Every row of a repeated page counts. Rows without image or text key
    have no such ties.
    """
    near = close_texts(p) if near is None else near
    row = lambda side, key: p.where((F.col("side") == side) & F.col(f"{key}_key").isNotNull()).select(
        F.col("row_id").alias(f"{side}_row"), F.col("image_key").alias(f"{side}_image"), F.col(f"{key}_key").alias("k")
    )
    # keys are dealt to several tasks only where one is too large for a task
    keys = p.select("side", F.explode(F.array(F.concat(F.lit("i"), "image_key"), F.concat(F.lit("t"), "text_key"))).alias("k")).where("k is not null")
    salted = bool(keys.groupBy("side", "k").agg(F.count("*").alias("c")).where(F.col("c") > hot).head(1))

    def pairs(kind: str, key: str) -> DataFrame:
        t = row("train", key)
        if kind == "close":
            t = t.withColumnRenamed("k", "train_key").join(near.select("train_key", F.col("eval_key").alias("k")), "train_key").drop("train_key")
        both = salted_join(t, row("eval", key), "k", hot) if salted else t.join(row("eval", key), "k")
        # a pair of one image came out by that
        other = F.lit(True) if kind == "image" else ~F.coalesce(F.col("train_image") == F.col("eval_image"), F.lit(False))
        return both.where(other).select("train_row", "eval_row", F.lit(kind).alias("tie"))

    return pairs("image", "image").unionByName(pairs("text", "text")).unionByName(pairs("close", "text"))


def report(p: DataFrame, groups: list[Column], near: DataFrame | None = None) -> DataFrame:
    """By ``groups`` of evaluation rows (columns of ``p``): ``rows``, those tied to training, and pairs in all and by kind of tie.

    Pairs are counted from class sizes, never listed: rows times rows of every tie of classes, less those that the image ties as well.
    """
    near = written(close_texts(p)) if near is None else near
    names = [f"__g{k}" for k in range(len(groups))]
    e = p.where("side = 'eval'").select(*[g.alias(n) for g, n in zip(groups, names, strict=True)], "image_key", "text_key")
    e = e.groupBy(*names, "image_key", "text_key").agg(F.count("*").alias("rows"))
    t = p.where("side = 'train'").groupBy("image_key", "text_key").agg(F.count("*").alias("times"))
    tied = near.select(F.col("train_key").alias("text_key"), "eval_key")
    through = lambda df: df.join(tied, "text_key").drop("text_key").withColumnRenamed("eval_key", "text_key")
    of = lambda df, name, *by: df.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.sum("times").alias(name))
    texts, images = of(t, "times", "text_key"), of(t, "image", "image_key")
    e = e.join(images, "image_key", "left").join(texts.withColumnRenamed("times", "text"), "text_key", "left").join(of(through(texts), "close", "text_key"), "text_key", "left")
    # the rows that are of one image as well
    both = of(t, "times", "image_key", "text_key")
    e = e.join(both.withColumnRenamed("times", "both_text"), ["image_key", "text_key"], "left").join(of(through(both), "both_close", "image_key", "text_key"), ["image_key", "text_key"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    pairs = n("image") + n("text") + n("close") - n("both_text") - n("both_close")
    total = lambda c: F.sum(F.col("rows") * c)
    return e.groupBy(*names).agg(
        F.sum("rows").alias("rows"), F.sum(F.when(pairs > 0, F.col("rows")).otherwise(0)).alias("rows_in_train"), total(pairs).alias("pairs"),
        total(n("image")).alias("same_image"), total(n("text")).alias("same_text"), total(n("close")).alias("close_text"),
    )
