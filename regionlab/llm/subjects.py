"""Subjects of documents by an anchored non-negative factorization of the document-term matrix.

``V ~ W H``: rows of V are documents, columns are words (hashed to ``BINS`` columns, so the model has a fixed size however many
documents there are). Every subject is one component of H, and one further component takes the words of no subject. The components are
anchored by seeds: documents that people labelled and the subjects' descriptions give, for each word, the subjects in whose documents
it is more frequent than chance (``LEAN``). A subject's component starts with its own words and with none of those the seeds give to others;
multiplicative updates keep zeros, so a component cannot drift away from its subject. Words that no seed holds start in all components
and find their place through the documents they occur in. W and H are then updated in turn (multiplicative updates of the generalized
Kullback-Leibler divergence), each pass over *all* documents: W is solved within each batch of rows, H's numerators are summed per
partition before they are shuffled by column.

The components are the subjects, so the weights of a row are its mixture directly (``document_weights``). What a document *deals with* is
asked of its sentences, which are folded in as rows of their own: a sentence deals with the subject of its largest weight, if that is more
than a trace; a document has the subjects that at least ``min_share`` of its sentences with words deal with. Null and wordless texts have
no subject.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlab.llm.confusables import canonical
from regionlab.session import kept, written

BINS = 1 << 18  # columns of the document-term matrix
MIN_DOCS = 3  # words of fewer documents are slips of the pen
SWEEPS = 8  # updates of H at most, each a pass over all documents
SETTLED = 0.01  # updates end once no component moves more of its weight than this
INNER = 6  # updates of W within a pass
MIN_SHARE = 0.18  # "about a fifth"
AT_ONCE = 250_000  # words solved together; batches of long documents are taken in pieces
LEAN = 0.36  # how far a word must lean to a subject in the seeds to be its own: 0 is chance, 1 is there only
TRACE = 0.05  # weight of a sentence's subject below which it has none

_SENTENCE = re.compile(r"[.!?…]+\s+|\n+")
_TOKEN = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=1 << 18)
def _bin(word: str) -> int:
    return zlib.crc32(word.encode()) % BINS


def sentence_bins(text: str | None) -> list[list[int]]:
    """The columns of the words of each sentence that has any."""
    if not text:
        return []
    out = []
    for s in _SENTENCE.split(canonical(text).lower()):
        if w := [_bin(x) for x in _TOKEN.findall(s)]:
            out.append(w)
    return out


def term_matrix(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, ``lens``, ``bins``): words of all sentences in order, written once; every later pass reads it instead of the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [sentence_bins(t) for t in pdf[text]]
            yield pd.DataFrame({id_col: pdf[id_col], "lens": [[len(w) for w in x] for x in s], "bins": [[b for w in x for b in w] for x in s]})

    made = docs.select(id_col, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{id_col} bigint, lens array<int>, bins array<int>")
    return written(made)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches in pieces of about ``AT_ONCE`` words, whole documents each."""
    for pdf in batches:
        held = np.cumsum([len(b) for b in pdf["bins"]]) // AT_ONCE if len(pdf) else np.empty(0, np.int64)
        for _, piece in pdf.groupby(held, sort=True):
            yield piece.reset_index(drop=True)


def _coo(bins: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of a batch of rows, sorted by row."""
    if not len(bins):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    rows = np.repeat(np.arange(len(bins), dtype=np.int64), [len(b) for b in bins])
    keys, n = np.unique(rows * BINS + np.concatenate(bins), return_counts=True)
    return keys // BINS, keys % BINS, n.astype(np.float32)


def _solve(row: np.ndarray, h: np.ndarray, count: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have entries, their weights of sum 1 by component, each entry's count split over the components)."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    at = np.cumsum(np.r_[0, (row[1:] != row[:-1]).astype(np.int64)])
    w = np.full((h.shape[0], len(starts)), 1 / h.shape[0], np.float32)
    q = h
    for _ in range(inner):
        q = w[:, at] * h
        q *= count / np.maximum(q.sum(0), 1e-30)
        w = np.add.reduceat(q, starts, axis=1)
        w /= np.maximum(w.sum(0), 1e-30)
    return row[starts], w, q


@dataclass
class Model:
    """H restricted to its non-zero columns: ``columns`` ascending, ``h`` (components x columns); the last component is no subject."""

    subjects: list[str]
    columns: np.ndarray
    h: np.ndarray
    moved: list[float] = field(default_factory=list)  # by the last update

    def restrict(self, row: np.ndarray, col: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.columns):
            return row[:0], col[:0], count[:0], self.h[:, :0]
        i = np.minimum(np.searchsorted(self.columns, col), len(self.columns) - 1)
        ok = self.columns[i] == col
        return row[ok], col[ok], count[ok], self.h[:, i[ok]]


def _column_sums(batches: Iterator[pd.DataFrame], width: int, of) -> Iterator[pd.DataFrame]:
    """Sums of ``of(batch) -> (columns, values: width x columns)`` over a partition, emitted once per partition."""
    total = np.zeros((width, BINS), np.float32)
    for pdf in _pieces(batches):
        col, values = of(pdf)
        for k in range(width):
            total[k] += np.bincount(col, weights=values[k], minlength=BINS)
    at = np.flatnonzero(total.any(0))
    yield pd.DataFrame({"col": at.astype(np.int32), **{f"v{k}": total[k, at].astype(np.float64) for k in range(width)}})


def _few(matrix: DataFrame) -> DataFrame:
    """The rows in a number of tasks bound to the cluster's cores: each task's sums over all columns are shuffled, so their number must not grow with the data."""
    return matrix.coalesce(4 * matrix.sparkSession.sparkContext.defaultParallelism)


def _gather(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The per-column sums of all partitions; at most ``BINS`` rows, whatever the corpus."""
    p = df.groupBy("col").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(width)]).toPandas().sort_values("col")
    return p["col"].to_numpy(np.int64), p[[f"v{k}" for k in range(width)]].to_numpy(np.float64).T


def _schema(width: int) -> str:
    return "col int, " + ", ".join(f"v{k} double" for k in range(width))


def seed(matrix: DataFrame, id_col: str, labels: DataFrame, subjects: list[str], descriptions: list[str], lean: float = LEAN) -> Model:
    """Anchors: ``labels`` (id, subject) of any quality; unknown and null subjects are passed over, several labels share a document."""
    k = len(subjects)
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s.strip().lower()), F.lit(i))])
    known = labels.select(id_col, number[F.lower(F.trim("subject"))].alias("k")).where("k is not null and " + id_col + " is not null")
    weight = known.groupBy(id_col).agg(*[(F.sum((F.col("k") == i).cast("double")) / F.count("*")).alias(f"w{i}") for i in range(k)])

    def of(pdf: pd.DataFrame):
        row, col, n = _coo(list(pdf["bins"]))
        w = pdf[[f"w{i}" for i in range(k)]].to_numpy(np.float32)[row].T
        return col, np.concatenate([w, n * w, np.ones((1, len(col)), np.float32)])

    seeds = matrix.join(weight, id_col)
    held = seeds.agg(*[F.sum(f"w{i}") for i in range(k)]).first()  # labelled documents of each subject
    labelled = _few(seeds).mapInPandas(lambda b: _column_sums(b, 2 * k + 1, of), _schema(2 * k + 1))
    lc, lv = _gather(labelled, 2 * k + 1)

    def every(pdf: pd.DataFrame):
        row, col, n = _coo(list(pdf["bins"]))
        return col, np.stack([n, np.ones(len(col), np.float32)])

    col, v = _gather(_few(matrix).mapInPandas(lambda b: _column_sums(b, 2, every), _schema(2)), 2)
    total, docs = v
    col, total = col[docs >= MIN_DOCS], total[docs >= MIN_DOCS]

    per = np.zeros((2 * k + 1, BINS))
    per[:, lc] = lv
    for i, (name, text) in enumerate(zip(subjects, descriptions, strict=True)):
        for b in {b for s in sentence_bins(f"{name}. {text}") for b in s}:
            per[[i, k + i, 2 * k], b] += MIN_DOCS
    words_of = per[k : 2 * k].sum(1)
    per = per[:, col]

    def relative(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
        rate = counts / np.maximum(of, 1e-30)[:, None]
        return rate / np.maximum(rate.sum(0), 1e-30)

    # by documents and by words: what stands once in every document looks frequent in subjects of short documents by words, what
    # stands everywhere looks frequent in those of long ones by documents; a word of the subject is frequent by both
    share = np.minimum(relative(per[:k], np.array([(x or 0) + MIN_DOCS for x in held])), relative(per[k : 2 * k], words_of))
    firm = per[2 * k] >= 3  # enough seeds hold the word
    most = share.max(0, initial=0)
    kept = (most >= 1 / k + lean * (1 - 1 / k)) & (share >= 0.5 * most)
    anchored = np.where(firm, np.where(kept, share, 0), 0.5 / k)
    h = np.concatenate([anchored * total, (total * np.clip(1 - anchored.sum(0), 0.02, 1))[None]])
    h /= np.maximum(h.sum(1, keepdims=True), 1e-30)
    return Model(subjects, col, h.astype(np.float32))


def factor(matrix: DataFrame, model: Model, sweeps: int = SWEEPS, inner: int = INNER, settled: float = SETTLED) -> Model:
    """Alternating updates over all documents until a pass moves no more than ``settled`` of any component's weight."""
    width = len(model.h)
    for _ in range(sweeps if len(model.columns) else 0):
        sent = matrix.sparkSession.sparkContext.broadcast(model)

        def of(pdf: pd.DataFrame, sent=sent):
            row, col, n, h = sent.value.restrict(*_coo(list(pdf["bins"])))
            if not len(row):
                return col, np.zeros((width, 0), np.float32)
            return col, _solve(row, h, n, inner)[2]

        col, v = _gather(_few(matrix).mapInPandas(lambda b, of=of: _column_sums(b, width, of), _schema(width)), width)
        before = model.h[:, np.searchsorted(model.columns, col)]
        model = Model(model.subjects, col, (v / np.maximum(v.sum(1, keepdims=True), 1e-30)).astype(np.float32), [*model.moved])
        sent.unpersist()
        moved = 0.5 * np.abs(model.h - before).sum(1)
        model.moved.append(float(moved.max(initial=0)))
        if model.moved[-1] <= settled:
            break
    return model


MIXTURE = "subject_no int, sentences int, share double, weight double"


def mixtures(matrix: DataFrame, id_col: str, model: Model, trace: float = TRACE) -> DataFrame:
    """(id, ``subject``, ``sentences``, ``share``, ``weight``) of every document and subject with at least one sentence.

    ``share``: part of the document's sentences with words that deal with this one; ``weight``: its mean weight over them.
    """
    sent = matrix.sparkSession.sparkContext.broadcast(model)
    k = len(model.subjects)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in _pieces(batches):
            bins = [b for b in pdf["bins"]]
            lens = [n for n in pdf["lens"]]
            doc_of = np.repeat(np.arange(len(pdf)), [len(n) for n in lens])
            none = pd.DataFrame({id_col: pd.Series([], dtype="int64"), "subject_no": [], "sentences": [], "share": [], "weight": []})
            if not len(doc_of) or not len(m.columns):
                yield none
                continue
            sentence = np.repeat(np.arange(len(doc_of), dtype=np.int64), np.concatenate(lens))
            col = np.concatenate(bins).astype(np.int64)
            row, col, n, h = m.restrict(sentence, col, np.ones(len(col), np.float32))
            if not len(row):
                yield none
                continue
            at, w, _ = _solve(row, h, n, 8)
            top = w[:k].argmax(0)
            ok = w[top, np.arange(len(at))] > trace
            key = doc_of[at[ok]] * k + top[ok]
            pairs, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            weight = np.bincount(inverse, weights=w[top[ok], np.flatnonzero(ok)], minlength=len(pairs)) / np.maximum(count, 1)
            of_doc = np.array([len(n) for n in lens])
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[pairs // k], "subject_no": pairs % k, "sentences": count, "share": count / of_doc[pairs // k], "weight": weight})

    out = matrix.mapInPandas(run, f"{id_col} bigint, {MIXTURE}")
    names = F.array(*[F.lit(s) for s in model.subjects])
    return out.select(id_col, names[F.col("subject_no")].alias("subject"), "sentences", "share", "weight")


def document_weights(matrix: DataFrame, id_col: str, model: Model, trace: float = TRACE) -> DataFrame:
    """(id, ``subject``, ``weight``): the mixture of every document, the weights of its row over all components; the rest to 1 is of no subject. Weights up to ``trace`` are left out."""
    sent = matrix.sparkSession.sparkContext.broadcast(model)
    k = len(model.subjects)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            row, _, n, h = sent.value.restrict(*_coo(list(pdf["bins"])))
            at, w, _ = _solve(row, h, n, 8) if len(row) else (row, np.zeros((k + 1, 0), np.float32), n)
            i, subject = np.nonzero(w[:k].T > trace)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[at[i]], "subject_no": subject, "weight": w[subject, i].astype(np.float64)})

    names = F.array(*[F.lit(s) for s in model.subjects])
    return matrix.mapInPandas(run, f"{id_col} bigint, subject_no int, weight double").select(id_col, names[F.col("subject_no")].alias("subject"), "weight")


def subject_mixtures(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, whole: bool = False) -> DataFrame:
    """Seeds, factorization and ``mixtures`` (``whole``: ``document_weights``) in one. ``subjects`` (``subject``, ``description``) is a short fixed list.

    Documents without an id are left out; ids that occur twice are documents of their own with the labels of both. An id column named
    like another column of the result comes out as ``kept_<name>``.
    """
    named = subjects.orderBy("subject_id").collect()
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).where("__id is not null")
    matrix = term_matrix(docs, "__id", "__text")
    labels = labels.select(F.col(id_col).alias("__id"), "subject")
    model = seed(matrix, "__id", labels, [r["subject"] for r in named], [r["description"] or "" for r in named])
    out = kept([id_col], {"subject", "sentences", "share", "weight"})[id_col]
    of = document_weights if whole else mixtures
    return of(matrix, "__id", factor(matrix, model, sweeps)).withColumnRenamed("__id", out)


def subjects_of(mixed: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    return mixed.where(F.col("share") >= min_share)
