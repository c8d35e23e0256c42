import pytest
from pyspark.sql import functions as F

from regionlab.operators import records, scoring
from regionlab.operators.matching import greedy_match, suppressed

GT = (
    '[{"bbox":[50,100,850,130],"type":"handwritten","text":"Доброго ранку"},{"bbox":[50,150,870,180],"type":"handwritten","text":"Сьогодні гарна погода"},'
    '{"bbox":[50,250,650,270],"type":"printed","text":"Завдання 1"},{"bbox":[700,50,950,250],"type":"image","text":""},{"bbox":[900,950,980,990],"type":"annotation","text":"5"}]'
)
PRED = (
    '[{"bbox":[52,101,852,131],"type":"handwritten","text":"Доброго ранку"},{"bbox":[50,148,860,184],"type":"handwritten","text":"Сьогодні гарна пагода"},'
    '{"bbox":[48,249,649,272],"type":"handwritten","text":"Завдання 1"},{"bbox":[710,60,945,248],"type":"image","text":""}]'
)
ID = "00000000-0000-0000-0000-000000000000.jpg"


def frames(spark, gt, pred):
    def parse(text):
        return spark.createDataFrame([(ID, text)], "im string, rg string").select(F.col("im").alias("image"), records.parsed_submission(F.col("im"), F.col("rg"))["regions"].alias("regions"))

    return parse(gt), parse(pred)


def test_golden(spark):
    r = scoring.report(scoring.per_page(*frames(spark, GT, PRED))).first()
    assert (r["tp"], r["fp"], r["fn"]) == (4, 0, 1)
    assert r["class_acc"] == 0.75
    assert r["region_cer"] == pytest.approx(1 / 63)
    assert r["page_cer"] == pytest.approx(3 / 48)
    assert r["score"] == pytest.approx(0.934821, abs=1e-6)


def test_same_and_empty(spark):
    assert scoring.report(scoring.per_page(*frames(spark, GT, GT))).first()["score"] == pytest.approx(1.0)
    r = scoring.report(scoring.per_page(*frames(spark, GT, ""))).first()
    assert (r["score"], r["region_cer"], r["page_cer"], r["det_f1"]) == (0, 1, 1, 0)


def test_rules(spark):
    """Predictions on regions that do not count are left out of the page; unmatched ones stay; pages without text have no rate."""
    gt = '[{"bbox":[0,0,100,20],"text":"а"},{"bbox":[0,100,100,120],"text":"зайве","legibility":"illegible"}]'
    pred = '[{"bbox":[0,0,100,20],"text":"а"},{"bbox":[0,100,100,120],"text":"будь"}]'
    assert scoring.per_page(*frames(spark, gt, pred)).first()["page_cer"] == 0
    more = '[{"bbox":[0,0,100,20],"text":"а"},{"bbox":[0,300,100,320],"text":"б"}]'
    assert scoring.per_page(*frames(spark, gt, more)).first()["page_cer"] == 2
    assert scoring.per_page(*frames(spark, '[{"bbox":[0,0,9,9],"type":"image"}]', pred)).first()["page_cer"] is None


def test_reading_order(spark):
    gt = '[{"bbox":[50,0,60,30],"text":"б"},{"bbox":[0,0,10,29.8],"text":"а"},{"bbox":[0,0,10,30],"text":"в"}]'
    df, _ = frames(spark, gt, "")
    # centres 15.0, 14.9 and 15.0: another band for the second, then by x
    assert df.select(scoring.page_text(F.col("regions"))).first()[0] == "а\nв\nб"


def test_ties_and_threshold(spark):
    a = '[{"bbox":[0,0,10,10]},{"bbox":[0,0,10,10]}]'
    df, other = frames(spark, a, '[{"bbox":[0,0,10,10]},{"bbox":[0,0,10,5]}]')
    m = df.join(other.withColumnRenamed("regions", "p"), "image").select(greedy_match(F.col("regions"), F.col("p")).alias("m")).first()["m"]
    assert [(x["gi"], x["pi"], x["iou"]) for x in m] == [(0, 0, 1.0), (1, 1, 0.5)]


def test_nms(spark):
    a = (
        '[{"bbox":[0,0,10,10],"type":"printed"},{"bbox":[0,0,10,20],"type":"printed"},{"bbox":[0,0,10,20],"type":"formula"},'
        '{"bbox":[0,0,10,19],"type":"printed"},{"bbox":[50,0,60,20],"type":"printed"}]'
    )
    df, _ = frames(spark, a, "")
    # an IoU equal to the threshold is too much; other types do not count
    assert df.select(suppressed(F.col("regions"))).first()[0] == [1, 2, 4]


def test_last_row_wins(spark):
    s = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("a", "3", 2), ("b", None, 1)], "image string, regions string, row_no int")
    assert {(r["image"], r["regions"]) for r in scoring.last_per_image(s).collect()} == {("a", "2"), ("b", None)}
    with pytest.raises(scoring.InvalidSubmission, match="1 image"):
        scoring.require_complete(spark.createDataFrame([("a",), ("c",), ("c",)], "image string"), s)
    scoring.require_complete(spark.createDataFrame([("a",)], "image string"), s)


def test_column_check(spark):
    with pytest.raises(scoring.InvalidSubmission):
        scoring.require_columns(spark.range(1), "regions")


def test_edit_distance(spark):
    import random

    from regionlab.functions.distance import edit_distance

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("абв я\n") for _ in range(rnd.randrange(40))) for _ in range(200)] + ["", ""]
    df = spark.createDataFrame([*zip(texts, reversed(texts), strict=True), (None, "a")], "a string, b string")
    assert df.where(~edit_distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b"))).count() == 0
