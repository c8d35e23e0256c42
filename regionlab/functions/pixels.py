"""Work on pixels, in Arrow UDFs. Needs Pillow (and OpenCV to straighten pages), which are imported only when a UDF runs.

The arithmetic of boxes and sizes is in ``functions.geometry`` and needs neither.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _open(content: bytes):
    from PIL import Image, ImageOps

    return ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")


def _jpeg(image, quality: int) -> bytes:
    out = io.BytesIO()
    image.save(out, format="JPEG", quality=quality)
    return out.getvalue()


@F.pandas_udf(SIZE)
def _size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_open(c).size if c is not None else (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def upright_size(content: Column) -> Column:
    """struct(width, height) of an image as it is to be looked at (turned as its EXIF data say)."""
    return _size(content)


def cropped(content: Column, box: Column, out_size: Column, quality: int = 92) -> Column:
    """JPEG of a part of an image, resized to ``out_size``; null if any argument is."""

    @F.pandas_udf(T.BinaryType())
    def crop(contents: pd.Series, boxes: pd.Series, sizes: pd.Series) -> pd.Series:
        from PIL import Image

        def one(c, b, s):
            if c is None or b is None or s is None:
                return None
            part = _open(c).crop(tuple(int(v) for v in b))
            return _jpeg(part if part.size == tuple(s) else part.resize((int(s[0]), int(s[1])), Image.LANCZOS), quality)

        return pd.Series([one(*x) for x in zip(contents, boxes, sizes, strict=True)], dtype=object)

    return crop(content, box, out_size)


def straightened(content: Column, least: float = 0.3, most: float = 10.0, least_ink: int = 100, quality: int = 92) -> Column:
    """The page turned by the slant of its ink, if that lies between ``least`` and ``most`` degrees; else the page as it is."""

    @F.pandas_udf(T.BinaryType())
    def turn(contents: pd.Series) -> pd.Series:
        import cv2
        import numpy as np
        from PIL import Image

        def one(c):
            if c is None:
                return None
            image = _open(c)
            grey = np.asarray(image.convert("L"))
            _, ink = cv2.threshold(grey, 0, 255, cv2.THRESH_BINARY_INV + cv2.THRESH_OTSU)
            at = np.column_stack(np.where(ink > 0))
            if len(at) < least_ink:
                return c
            angle = cv2.minAreaRect(at[:, ::-1].astype(np.float32))[-1]
            angle = (angle + 45) % 90 - 45
            if not least <= abs(angle) <= most:
                return c
            return _jpeg(image.rotate(angle, resample=Image.BICUBIC, expand=False, fillcolor=(255, 255, 255)), quality)

        return pd.Series([one(c) for c in contents], dtype=object)

    return turn(content)
