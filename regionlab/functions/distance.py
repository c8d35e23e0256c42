"""Edit distance of long texts.

Spark's ``levenshtein`` fills a table of the product of both lengths, some 60 ns a cell for texts beyond ASCII: 30 ms for a page of 700
characters, minutes for one of 60,000. Here a column of the table is two machine integers of as many bits as the text has characters
(bit-parallel, unit costs, code points), which takes 1/50 of the time at 700 characters. Short texts inside lambdas stay with Spark's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edits(a: str, b: str) -> int:
    """Least number of insertions, deletions and substitutions of code points."""
    if a == b:
        return 0
    # equal ends take no part
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)  # cells that are one more, one less than the cell above
    for c in b:
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less = ((more << 1) | 1) & full, (less << 1) & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return score


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """``edits`` of two text columns; null if either is null."""
    return _edits(a, b)


def best_place(pattern: str, text: str) -> tuple[int, int, int]:
    """(start, end, edits) of the part of ``text`` that is nearest to ``pattern``; of equal ones the first end, then the longest part.

    The same columns as in ``edits``, but a match may begin anywhere: ends first, then the start by the reversed texts.
    """
    if not pattern:
        return 0, 0, 0

    def ends(p: str, t: str, free: bool) -> list[int]:
        places: dict[str, int] = {}
        for k, c in enumerate(p):
            places[c] = places.get(c, 0) | (1 << k)
        full, last = (1 << len(p)) - 1, 1 << (len(p) - 1)
        up, down, score, out = full, 0, len(p), [len(p)]
        for c in t:
            eq = places.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            more, less = down | (full & ~(diagonal | up)), up & diagonal
            score += bool(more & last) - bool(less & last)
            out.append(score)
            more, less = ((more << 1) | (0 if free else 1)) & full, (less << 1) & full
            up, down = less | (full & ~(diagonal | more)), more & diagonal
        return out

    forward = ends(pattern, text, True)
    best = min(forward)
    end = forward.index(best)
    back = ends(pattern[::-1], text[:end][::-1], False)
    start = end - max(k for k, v in enumerate(back) if v == best)
    return start, end, best


PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())])


@F.pandas_udf(PLACE)
def _best_place(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if p is None or t is None else best_place(p, t) for p, t in zip(pattern, text, strict=True)]
    return pd.DataFrame(rows, columns=["start", "end", "edits"]).astype("Int32")


def aligned_part(pattern: Column, text: Column) -> Column:
    """struct(start, end, edits): where a line lies in the text that was dictated."""
    return _best_place(pattern, text)
