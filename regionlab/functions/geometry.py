"""Column functions over bounding boxes (arrays ``[x1, y1, x2, y2]``).

Divisions are guarded: a zero or null denominator gives the defined result of the function, never an error under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PIXELS = 2048 * 28 * 28  # area budget of an encoded image
MIN_SIDE = 128  # crops with a longest side below this are enlarged ...
ENLARGED_SIDE = 256  # ... to this one


def _area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlaps(a: Column, b: Column) -> Column:
    """Whether the boxes share an area; cheap, and implied by any IoU above 0."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a positive overlap."""
    inner = (F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * (F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = _area(a) + _area(b) - inner
    return F.when(overlaps(a, b) & (union > 0), F.try_divide(inner, union)).otherwise(F.lit(0.0))


def usable(b: Column) -> Column:
    """A box that has four non-null coordinates."""
    return b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull())


def scale(box: Column, to_w: Column, to_h: Column, from_w: Column, from_h: Column, off_x: Column | int = 0, off_y: Column | int = 0) -> Column:
    """A box of one frame in another, as whole pixels: truncated, moved, corners in order.

    Null for fewer than four coordinates, coordinates that are no numbers (text that spells a number is one), an empty source frame or
    a result below 3 pixels on a side.
    """
    v = F.transform(box, lambda c: c.try_cast("double"))

    def at(i: int, to: Column, frm: Column, off) -> Column:
        # outside the range of whole pixels there is no box
        return F.try_divide(F.get(v, F.lit(i)) * to, frm).try_cast("int") + off

    x = [at(i, to_w, from_w, F.lit(off_x) if isinstance(off_x, int) else off_x) for i in (0, 2)]
    y = [at(i, to_h, from_h, F.lit(off_y) if isinstance(off_y, int) else off_y) for i in (1, 3)]
    out = F.array(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))
    fit = (F.size(box) >= 4) & (from_w > 0) & (from_h > 0) & x[0].isNotNull() & x[1].isNotNull() & y[0].isNotNull() & y[1].isNotNull()
    return F.when(fit & (F.abs(x[1] - x[0]) >= 3) & (F.abs(y[1] - y[0]) >= 3), out)


def to_thousandths(box: Column, w: Column, h: Column) -> Column:
    """Pixels as whole thousandths of the page, within 0..1000; null or empty pages count as one pixel."""
    one = lambda s: F.greatest(F.lit(1), F.coalesce(s, F.lit(1)))
    part = lambda i, s: F.greatest(F.lit(0), F.least(F.lit(1000), (box[i] * F.lit(1000.0) / one(s)).cast("int")))
    return F.array(part(0, w), part(1, h), part(2, w), part(3, h))


def bands(box: Column, n: Column) -> Column:
    """``n`` horizontal bands of equal height, top to bottom; the box itself for ``n`` up to 1."""
    step = (box[3] - box[1]).cast("double") / F.greatest(n, F.lit(1))
    cut = lambda i: (box[1] + i * step).cast("int")
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array(box[0], cut(i), box[2], cut(i + 1)))
    return F.when(n <= 1, F.array(box)).otherwise(many)


def crop_box(box: Column, w: Column, h: Column, margin: Column | float) -> Column:
    """The box widened by ``margin`` of its sides (truncated), clamped to the page."""
    m = F.lit(margin) if isinstance(margin, float) else margin
    dx, dy = ((box[2] - box[0]) * m).cast("int"), ((box[3] - box[1]) * m).cast("int")
    return F.array(F.greatest(F.lit(0), box[0] - dx), F.greatest(F.lit(0), box[1] - dy), F.least(w, box[2] + dx), F.least(h, box[3] + dy))


def fitted(w: Column, h: Column, max_pixels: int = MAX_PIXELS) -> Column:
    """(width, height) scaled down to the area budget, truncated; unchanged within it."""
    px = w.cast("double") * h.cast("double")
    k = F.sqrt(F.try_divide(F.lit(float(max_pixels)), px))
    return F.when(px > max_pixels, F.array((w * k).cast("int"), (h * k).cast("int"))).otherwise(F.array(w.cast("int"), h.cast("int")))


def enlarged(w: Column, h: Column) -> Column:
    """(width, height) of a crop, enlarged if its longest side is short."""
    side = F.greatest(w, h)
    k = F.try_divide(F.lit(float(ENLARGED_SIDE)), side)
    return F.when((side < MIN_SIDE) & (side > 0), F.array((w * k).cast("int"), (h * k).cast("int"))).otherwise(F.array(w.cast("int"), h.cast("int")))


def enclosing(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))
