"""Ensembles, alignment, prompts; what needs Pillow only if it is there."""

import random

import pytest
from pyspark.sql import functions as F

from regionlab.functions.distance import aligned_part, best_place, edits
from regionlab.functions.prompts import PROMPTS, prompt
from regionlab.operators import ensemble, records

R = "array<struct<bbox:array<double>,type:string,text:string>>"


def test_best_place(spark):
    rnd = random.Random(4)
    for _ in range(300):
        p, t = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 6))), "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        start, end, n = best_place(p, t)
        assert n == edits(p, t[start:end]) == min(edits(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    df = spark.createDataFrame([("слвоо два", "перше слово два три"), (None, "a"), ("", "a")], "p string, t string")
    got = [r[0] and (r[0]["start"], r[0]["end"], r[0]["edits"]) for r in df.select(aligned_part(F.col("p"), F.col("t"))).collect()]
    assert got == [(6, 15, 2), (None, None, None), (0, 0, 0)]


def test_merged(spark):
    a = [([0.0, 0.0, 10.0, 10.0], "printed", "cлово"), ([50.0, 0.0, 60.0, 10.0], "table", "x")]
    b = [([0.0, 0.0, 10.0, 8.0], "handwritten", "слово"), ([90.0, 0.0, 99.0, 10.0], "graph", None)]
    df = spark.createDataFrame([(a, b), ([], b)], f"a {R}, b {R}")
    got = [[(r["bbox"], r["type"], r["text"]) for r in x[0]] for x in df.select(ensemble.merged(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [([0, 0, 10, 10], "handwritten", "слово"), ([50, 0, 60, 10], "table", "x"), ([90, 0, 99, 10], "graph", None)]
    assert len(got[1]) == 2
    near = [([0.0, 0.0, 10.0, 10.0], "printed", "довге слово"), ([50.0, 0.0, 60.0, 10.0], "table", "інше")]
    noisy = [([0.0, 0.0, 10.0, 10.0], "printed", "довге слова"), ([50.0, 0.0, 60.0, 10.0], "table", "інша")]
    kept = spark.createDataFrame([(near, noisy)], f"a {R}, b {R}").select(ensemble.agreeing(F.col("a"), F.col("b"))).first()[0]
    assert [r["text"] for r in kept] == ["довге слово"]


def test_prompts(spark):
    df = spark.createDataFrame([("table",), ("printed",), (None,)], "t string")
    got = [r[0] for r in df.select(prompt(F.col("t"), {"table": [("cells", "а|б")]})).collect()]
    assert got[0].startswith(PROMPTS["table"]) and got[0].endswith("- cells → а|б")
    assert got[1] == got[2] == PROMPTS["text"]


def test_solution_types():
    assert records.parse_regions('[{"bbox": [1, 2, 3, 4], "type": "stamp"}]', None)[1] == []
    assert records.parse_regions('[{"bbox": [1, 2, 3, 4], "type": "stamp"}]')[1] != []


def test_pixels(spark):
    pytest.importorskip("PIL")
    import io

    from PIL import Image

    from regionlab.functions.pixels import cropped, upright_size

    out = io.BytesIO()
    Image.new("RGB", (40, 20)).save(out, format="PNG")
    df = spark.createDataFrame([(out.getvalue(), [0, 0, 10, 10], [20, 20])], "c binary, b array<int>, s array<int>")
    r = df.select(upright_size(F.col("c")).alias("z"), cropped(F.col("c"), F.col("b"), F.col("s")).alias("j")).first()
    assert tuple(r["z"]) == (40, 20)
    assert Image.open(io.BytesIO(r["j"])).size == (20, 20)
