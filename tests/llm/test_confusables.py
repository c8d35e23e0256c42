import pickle
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlab.llm import confusables as c

CASES = [
    ("ｗｏｒｄ", "word"), ("ﬁn", "fin"), ("йти", "йти"), ("е́", None), ("сло­во", "слово"), ("a​b", "ab"), ("а б", "а б"), ("а б", "а б"), ("а　б", "а б"),
    ("сoн", "сон"), ("вօда", "вода"), ("лиϲт", "лист"), ("Тaнк", "Танк"), ("tеst", "test"), ("моiї", "моії"), ("cosine", None), ("слово", None), ("x² + y₃ ½ № … — «a»", None),
    ("ΔABC", None), ("αβγ", None), ("км/h", None), ("5-Б", None), ("", None), ("  ", None), ("a\tb\r\nc", None), ("\u212a", "K"),
    ("розділ Ⅳ", "розділ IV"), ("𝐀b𝟏", "Ab1"), ("ɡood ɑnd", "good and"), ("Ꭺpple", "Apple"), ("ꓑaper", "Paper"), ("ρис", "рис"), ("κіт", "кіт"), ("Αpк", "Арк"), ("јоіnѕ", "joins"), ("ᏣᎳᎩ", None), ("ꓮꓐ", None), ("hν ρgh sinα", None), ("ℝ ∈ ²", None), ("кот", None),
]


@pytest.mark.parametrize(("text", "plain"), CASES)
def test_cases(text, plain):
    assert c.canonical(text) == (plain if plain is not None else text)
    assert c.has_lookalike(text) == (plain is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcоeіxїйTВо́̆​ ｗﬁϲ1₂-. \n", max_size=30))
def test_settled(text):
    """Canonical texts are their own canonical texts, and look the same as what they stand for."""
    once = c.canonical(text)
    assert c.canonical(once) == once
    assert unicodedata.normalize("NFC", once) == once
    if once != text:
        assert c.has_lookalike(text) == (c.skeleton(once) == c.skeleton(text))


def test_fast_path():
    """Texts passed over quickly give what the full treatment gives."""
    for text in ("б1a слово", "слово x₂ b", "áb", "ѓа", "a2б", "б²a", "абв — «г» x"):
        full = unicodedata.normalize("NFC", text.translate(c._plain_table))
        full = c._WORD.sub(lambda m: c._DEFAULT._spelt(m[0]), full)
        assert c.canonical(text) == full


def test_more_groups(tmp_path):
    """Groups of a file in the public format join the built-in ones; pairs of signs and of several letters are passed over."""
    path = tmp_path / "confusables.txt"
    path.write_text("# list\n10D2 ;\t0434 ;\tMA # Georgian don, for the test only\n0031 ;\t006C ;\tMA\n006D ;\t0072 006E ;\tMA\n\n", encoding="utf-8-sig")
    groups = c.confusables_file(str(path))
    assert groups == ("дგ",)
    table = pickle.loads(pickle.dumps(c.Lookalikes(groups)))
    assert table.canonical("рიგ მoгა რгა") != "" and table.canonical("воგа") == "вода" and c.canonical("воგа") == "воგа"
    assert table.skeleton("გ") == table.skeleton("д") and table.plainer("воგа") and not table.plainer("вода")


def test_words():
    assert c.words("Пе́рше, СЛOВО!\nп'ять") == ["перше", "слово", "п", "ять"]
    assert c.words(None) == c.words("") == c.words("…!") == []


def test_groups(spark):
    rows = [("сон", 1), ("cон", 2), ("сoн", 3), ("сон", 4), ("інше", 5), (None, 6), ("", 7), ("x" * 200_000, 8)]
    df = spark.createDataFrame(rows, "text string, n int")
    got = {(r["first_id"], r["rows"], r["variants"]) for r in c.skeleton_groups(df, "n").collect()}
    assert got == {(1, 4, 3), (5, 1, 1), (7, 1, 1), (8, 1, 1)}
    assert c.skeleton_groups(df.limit(0), "n").count() == 0
    assert df.where(c.lookalike(F.col("text"))).count() == 2


def test_predictions_come_out_with_the_pages(spark, tmp_path):
    """Region texts of fit predictions have their canonical form and meet the pages in the groups; unfit rows give none."""
    from regionlab.llm import queries as q

    im = "0a1b2c3d-0000-4000-8000-0123456789ab.jpg"
    two = '[{"bbox": [1, 2, 3, 4], "text": "сoн"}, {"bbox": [1, 2, 3, 4]}, {"bbox": [1, 2, 3, 4], "text": "інше"}]'
    preds = [(1, im, two), (2, im, '[{"bbox": [1], "text": "сон"}]'), (3, im, None), (4, im, "[]"), (5, "x.jpg", two), (6, im, '[{"bbox": [1, 2, 3, 4], "text": "ｗord"}]')]
    spark.createDataFrame([(1, "сон"), (2, None)], "row_id long, text string").write.parquet(f"{tmp_path}/metadata.parquet")
    spark.createDataFrame(preds, "row_id long, image string, regions string").write.parquet(f"{tmp_path}/sample_submission.parquet")
    got = {(r["src_table"], r["row_id"], r["region_idx"]): r["text"] for r in q.p1_canonical(spark, str(tmp_path)).collect()}
    sub = "sample_submission"
    assert got == {("metadata", 1, None): "сон", ("metadata", 2, None): None, (sub, 1, 0): "сон", (sub, 1, 1): None, (sub, 1, 2): "інше", (sub, 6, 0): "word"}
    groups = {(r["first_table"], r["first_id"], r["first_region_idx"], r["rows"], r["variants"]) for r in q.p1_groups(spark, str(tmp_path)).collect()}
    assert groups == {("metadata", 1, None, 2, 2), (sub, 1, 2, 1, 1), (sub, 6, 0, 1, 1)}
