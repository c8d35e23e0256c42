"""Repetition inside single documents: shares of repeated content, and a cascade of rules that decides cheaply.

*Repeated words*: words that lie in a run of ``run`` or more words which has already begun earlier in the document, regardless of
letter case, punctuation and spacing; overlapping occurrences count. The share is over all words. Likewise *repeated lines* and
*repeated sentences*: those whose words equal the words of an earlier one; their shares are over the words, too.

To find the documents whose share of repeated words reaches a threshold, most documents need no exact count. Each rule of the
cascade is an upper bound of the share that rejects a document when it stays below the threshold. On a bounded sample every rule's
cost and its rate of rejection are measured and the rules run in the order of rejection per cost; the first rejection ends the work
on a document. The order changes the time, never the result: the exact share decides about whatever no rule rejects.

Null, empty and wordless texts have no words: their shares are 0 and they reach no threshold.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.llm.confusables import canonical, words

SAMPLE_ROWS = 400  # rows on which cost and selectivity are measured; they set the order of the rules only
SAMPLE_LENGTH = 100_000  # characters of such a row at most


def covered(w: Sequence[str], run: int) -> int:
    """Number of words within runs of ``run`` or more that began earlier."""
    seen: set[tuple[str, ...]] = set()
    total = reach = 0
    for i, gram in enumerate(zip(*[w[k:] for k in range(run)], strict=False)):
        if gram in seen:
            total += i + run - max(i, reach)
            reach = i + run
        else:
            seen.add(gram)
    return total


@dataclass(frozen=True)
class Rule:
    """``bound(words, run)`` is never below the number of covered words."""

    name: str
    bound: Callable[[Sequence[str], int], float]


def _too_short(w, run):
    # a second run needs at least one word more than the first; all but the first ``run`` starts may be covered
    return max(0, len(w) - 1) if len(w) > run else 0


def _spare_words(w, run):
    # every covered word is the copy of an earlier one
    return len(w) - len(set(w))


def _spare_pairs(w, run):
    # m covered words in a row hold at least m - 1 copied pairs, and m >= run
    n = len(w) - 1
    return (n - len(set(zip(w, w[1:], strict=False)))) * run / (run - 1) if n > 0 and run > 1 else len(w)


def _spare_runs(w, run):
    # each copied run covers at most ``run`` words
    n = len(w) - run + 1
    return (n - len(set(zip(*[w[k:] for k in range(run)], strict=False)))) * run if n > 0 else 0


RULES = (Rule("too_short", _too_short), Rule("spare_words", _spare_words), Rule("spare_pairs", _spare_pairs), Rule("spare_runs", _spare_runs))


@dataclass(frozen=True)
class Measured:
    name: str
    cost_us: float
    rejects: float

    @property
    def rank(self) -> float:
        return self.rejects / max(self.cost_us, 1e-3)


def plan_cascade(sample: Sequence[str | None], threshold: float, run: int = 3, rules: Sequence[Rule] = RULES) -> list[Measured]:
    """The rules ordered by rejection per cost as measured on the sample, those that reject nothing left out.

    Greedy: after each choice selectivity is measured again on what the chosen rules leave, since rules reject much the same documents.
    """
    docs = [w for w in map(words, sample) if w]
    left, rest, order = docs, list(rules), []
    while left and rest:
        tried = []
        for r in rest:
            t = time.perf_counter()
            kept = [w for w in left if r.bound(w, run) >= threshold * len(w)]
            us = (time.perf_counter() - t) * 1e6 / len(left)
            tried.append((Measured(r.name, us, 1 - len(kept) / len(left)), r, kept))
        best = max(tried, key=lambda x: (x[0].rank, x[0].name))
        if best[0].rejects == 0:
            break
        order.append(best[0])
        rest.remove(best[1])
        left = best[2]
    return order


def reaches(text: str | None, threshold: float, run: int, rules: Sequence[Rule]) -> bool:
    w = words(text)
    if not w:
        return False
    need = threshold * len(w)
    for r in rules:
        if r.bound(w, run) < need:
            return False
    return covered(w, run) >= need - 1e-9


def repetitive(df: DataFrame, text: str = "text", threshold: float = 0.4, run: int = 3, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[Measured]]:
    """(rows whose share of repeated words is at least ``threshold``, the cascade used). All columns stay."""
    # one text in eight by its hash, whole ones of a size that so many of fit the driver; the sample settles the order of the rules only
    drawn = df.select(F.col(text)).where((F.pmod(F.xxhash64(text), F.lit(8)) == 0) & (F.length(text) <= SAMPLE_LENGTH))
    sample = [r[0] for r in drawn.limit(sample_rows).collect()]
    plan = plan_cascade(sample, threshold, run)
    by_name = {r.name: r for r in RULES}
    rules = [by_name[m.name] for m in plan]

    @F.pandas_udf(T.BooleanType())
    def decide(texts: pd.Series) -> pd.Series:
        return pd.Series([reaches(t, threshold, run, rules) for t in texts], dtype=bool)

    return df.where(decide(F.col(text))), plan


_SENTENCE = re.compile(r"[.!?…]+\s+|\n+")


def _repeated_parts(parts: list[str], total: int) -> float:
    seen, again = set(), 0
    for p in parts:
        w = tuple(words(p))
        if not w:
            continue
        if w in seen:
            again += len(w)
        seen.add(w)
    return again / total if total else 0.0


SHARES = T.StructType([
    T.StructField("words", T.IntegerType()), T.StructField("repeated_words", T.DoubleType()), T.StructField("repeated_lines", T.DoubleType()),
    T.StructField("repeated_sentences", T.DoubleType()), T.StructField("top_run", T.DoubleType()),
])


def measure(text: str | None, run: int = 3) -> tuple[int, float, float, float, float]:
    """(words, shares of repeated words, lines and sentences, share of the words taken by the most frequent run)."""
    w = words(text)
    if not w:
        return 0, 0.0, 0.0, 0.0, 0.0
    s = canonical(text)
    n = len(w)
    counts: dict[tuple[str, ...], int] = {}
    for g in zip(*[w[k:] for k in range(run)], strict=False):
        counts[g] = counts.get(g, 0) + 1
    top = max(counts.values(), default=0)
    return n, covered(w, run) / n, _repeated_parts(s.split("\n"), n), _repeated_parts(_SENTENCE.split(s), n), min(1.0, top * run / n) if top > 1 else 0.0


def shares(text: Column, run: int = 3) -> Column:
    """struct of ``measure`` for every document."""

    @F.pandas_udf(SHARES)
    def go(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, run) for t in texts], columns=SHARES.fieldNames()).astype({"words": "int32"})

    return go(text)
