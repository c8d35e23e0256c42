"""Two predictions of a page put together, and predictions that agree with noisy labels. Both build on the greedy matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionlab.functions.geometry import enclosing
from regionlab.functions.text import CYRILLIC
from regionlab.operators.matching import greedy_match


def foreign(text: Column) -> Column:
    """Characters of a text that are no Cyrillic letters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{CYRILLIC}]", ""))


def merged(a: Column, b: Column, threshold: float = 0.3) -> Column:
    """Regions of two runs: matched ones once, with the box around both and the text of fewer foreign characters (of equal ones the first
    run's), then those of either run that have no partner. Other fields come from the run whose text is taken."""
    m = greedy_match(a, b, threshold)

    def pair(x: Column) -> Column:
        p, q = F.get(a, x["gi"]), F.get(b, x["pi"])
        taken = F.when(foreign(q["text"]) < foreign(p["text"]), q).otherwise(p)
        return taken.withField("bbox", enclosing(p["bbox"], q["bbox"]))

    alone = lambda own, side: F.filter(own, lambda r, i: ~F.exists(m, lambda x: x[side] == i.cast("int")))
    return F.concat(F.transform(m, pair), alone(a, "gi"), alone(b, "pi"))


def agreeing(pred: Column, noisy: Column, threshold: float = 0.3, most: float = 0.10) -> Column:
    """Predicted regions whose text differs from the matched noisy label's by at most ``most`` of its length."""
    m = greedy_match(noisy, pred, threshold)

    def near(x: Column) -> Column:
        g, p = F.coalesce(F.get(noisy, x["gi"])["text"], F.lit("")), F.coalesce(F.get(pred, x["pi"])["text"], F.lit(""))
        return F.levenshtein(g, p) <= F.length(g) * F.lit(most)

    return F.transform(F.filter(m, near), lambda x: F.get(pred, x["pi"]))
