import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlab.operators import records

ID = "0a1b2c3d-0000-4000-8000-0123456789ab.jpg"
BOX = '{"bbox": [1, 2, 3.5, 4]}'


def csv(image, regions):
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    return f"{image},{quote(regions)}"


REASONS = [
    (csv(ID, f"[{BOX}]"), None),
    (f"{ID},", None),
    (f"{ID},[]", None),
    (f'"{ID}","[]"', None),
    (csv(ID, f"[\n{BOX}\n]") + "\r\n", None),
    (None, "column_count"),
    ("", "column_count"),
    (ID, "column_count"),
    (f"1,{ID},[]", "column_count"),
    (f"{ID},[{{}},{{}}]", "column_count"),
    (f'{ID},[{{"bbox": 1}}]', "quoting"),
    (f'{ID},"[]" ', "quoting"),
    (f'{ID},"[]";', "quoting"),
    (f'{ID},"[', "quoting"),
    (f'"{ID},"[]"', "quoting"),
    (f'{ID},"[{{\\"bbox\\": 1}}]"', "quoting"),
    (f"{ID},[]\n{ID},[]", "quoting"),
    ("image,regions", "invalid_value"),
    (ID[:-4] + ",[]", "invalid_value"),
    (ID.upper() + ",[]", "invalid_value"),
    (f"{ID}, []", None),
    (f"{ID},x[]", "invalid_value"),
    (f"{ID},nan", "invalid_value"),
    (f"{ID},{{}}", "invalid_value"),
]
VALUES = [
    (None, True), ("", True), ("[]", True), (" [ ] \n", True), (f"[{BOX}]", True), (f"[{BOX},{BOX}]", True), ('[{"bbox":[1,2,3,1e3],"type":"graph","text":null,"x":[{}]}]', True),
    ('[{"bbox":[1,2,3,4],"bbox":[1]}]', False), ("[1]", False), ("[[]]", False), ("[{}]", False), ('[{"bbox":[1,2,3]}]', False), ('[{"bbox":[1,2,3,"4"]}]', False), ('[{"bbox":[1,2,3,true]}]', False),
    ('[{"bbox":[1,2,3,NaN]}]', False), (f"[{BOX},]", False), (f"[{BOX}", False), (f"[{BOX}] x", False), (f"[{BOX}{BOX}]", False), ('[{"bbox":[1,2,3,4],"type":"figure"}]', False),
    ('[{"bbox":[1,2,3,4],"type":null}]', False), ("[{'bbox':[1,2,3,4]}]", False), ('[{"bbox":[1,2,3,4],"text":"a\nb"}]', False), (" []", False), ("﻿[]", False),
    ('[{"bbox":[1,2,3,' + "9" * 5000 + "]}]", True), ("[" * 100_000, False), ('[{"bbox":[1,2,3,4],"x":' + "[" * 50_000 + "]" * 50_000 + "}]", True),
]


@pytest.mark.parametrize(("line", "reason"), REASONS)
def test_reasons(line, reason):
    _, _, bad = records.parse_line(line)
    assert (bad[0][0] if bad else None) == reason


@pytest.mark.parametrize(("value", "fit"), VALUES)
def test_values(value, fit):
    assert (not records.parse_regions(value)[1]) == fit


def test_located_and_recovered():
    """All errors of a list come out, with the regions between them."""
    good, bad = records.parse_regions(f'[{BOX}, {{"bbox": [1]}}, {{"a" 1}}, {BOX}, 3]')
    assert len(good) == 2
    assert [b[2] for b in bad] == [27, 47, 77]


def test_file_goes_on_behind_broken_quotes():
    """A quote that is never closed swallows no record behind it; an anchor within a sound quoted field is none."""
    inner = csv(ID, "[]")
    text = f'image,regions\n{ID},"[{{""bbox\n{csv(ID, "[]")}\n{ID},"a\n{inner.replace(chr(34), chr(34) * 2)}"\n{ID},[]'
    got = [(r.fields, r.error and r.error[0]) for r in records.parse_records(text)]
    assert got[0] == (["image", "regions"], None)
    assert got[1] == ([], "quoting")
    assert got[2] == ([ID, "[]"], None)
    assert got[-1] == ([ID, "[]"], None)


field = st.text(alphabet='a,"\n\r ', max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(field, min_size=2, max_size=3), min_size=1, max_size=5))
def test_round_trip(rows):
    text = "\n".join(",".join('"' + f.replace('"', '""') + '"' for f in r) for r in rows)
    assert [r.fields for r in records.parse_records(text)] == rows


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='[]{}",:bo1 \\', max_size=40))
def test_agrees_with_a_json_parser(value):
    def plain(v):
        try:
            x = json.loads(v)
        except ValueError:
            return False
        return isinstance(x, list) and all(isinstance(o, dict) and isinstance(o.get("bbox"), list) and len(o["bbox"]) == 4 for o in x)

    assert (not records.parse_regions(value)[1]) == (value == "" or plain(value))


def test_load(spark):
    """Fit and unfit rows together are all rows; kept columns may clash with made ones; nulls and repeats come out."""
    rows = [(1, csv(ID, f"[{BOX}]"), "r"), (1, csv(ID, f"[{BOX}]"), "r"), (2, None, None), (3, f"{ID},", "x"), (4, '"', "y")]
    df = spark.createDataFrame(rows, "id int, line string, reason string")
    fit, unfit = records.load(df, records.parsed_line(F.col("line")), "id", "reason")
    assert sorted((r["id"], len(r["regions"])) for r in fit.collect()) == [(1, 1), (1, 1), (3, 0)]
    assert {(r["id"], r["kept_reason"], r["reason"]) for r in unfit.collect()} == {(2, None, "column_count"), (4, "y", "quoting")}
    fit, unfit = records.load(df.limit(0), records.parsed_line(F.col("line")), "id")
    assert fit.count() == unfit.count() == 0


def test_load_path(spark, tmp_path):
    """Files cut into many blocks give the records of a parser that reads them from end to end: broken quotes, line breaks in fields, long records."""
    rnd = random.Random(4)
    good = [csv(ID, f'[{{"bbox": [1, 2, 3, 4], "text": "{"x" * rnd.choice((1, 30, 900))}"}}]') for _ in range(150)]
    broken = [f'{ID},"[{BOX}', f'{ID},"a"b', "x.jpg,", f"{ID}", f'{ID},"[]",', f'"{ID},"[]"', f'{ID},"[\n{{""bbox"": [1, 2, 3, 4]}}\n\n]"', ""]
    texts = {"a.csv": "image,regions\n" + "\n".join(rnd.choice(broken) if rnd.random() < 0.3 else g for g in good) + "\n", "b.csv": "", "c.csv": "\n".join(good[:3]), "d.csv": "no record start\n" * 400, "e.csv": f'{ID},"[{BOX}\n' * 60}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, newline="")
    want = []
    for name, t in texts.items():
        for r in records.parse_records(t):
            line = t[r.start : r.end]
            if line and line != "image,regions":
                bad = records.parse_line(line)[2]
                want.append((name, bad[0][0] if bad else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1500", "20000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            fit, unfit = records.load_path(spark, str(tmp_path))
            got = [(r["path"].rsplit("/", 1)[1], None) for r in fit.collect()] + [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in unfit.collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        key = lambda x: (x[0], x[1] or "")
        assert sorted(got, key=key) == sorted(want, key=key)


def test_deep_values():
    """Values nest as deep as they like; what is wrong below is found."""
    for n in (10, 5_000, 200_000):
        deep = "[" * n + "]" * n
        box = '{"bbox": [1, 2, 3, 4], "extra": %s, "text": "x"}'
        good, bad = records.parse_regions(f"[{box % deep}, {box % 1}]")
        assert not bad and [g["text"] for g in good] == ["x", "x"]
        assert records.parse_regions(f"[{box % deep[:-1]}]")[1]
        nested = '{"a": ' * n + "{}" + "}" * n
        assert not records.parse_regions(f"[{box % nested}]")[1]
        assert records.parse_regions(f"[{box % nested.replace('{}', '{,}')}]")[1]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4)), st.integers(0, 400), st.sampled_from("[]{},:\"x 1"))
def test_deep_parser_agrees(value, at, sign):
    """The parser of deep values accepts what the other one does, and gives the same."""
    text = json.dumps(value)
    assert records._deep_value(text, 0) == records._value(text, 0)
    broken = text[: at % (len(text) + 1)] + sign + text[at % (len(text) + 1) :]

    def outcome(parse):
        try:
            return parse(broken, 0)
        except records.Unfit:
            return None

    assert outcome(records._deep_value) == outcome(records._value)


def test_errors_of_both_tables(spark, tmp_path):
    """p2_errors locates the errors of unfit predictions too, every one of a row."""
    from regionlab.queries_core import p2_errors

    preds = [(1, "r", ID, '[{"bbox": [1]}, {"bbox": [1, 2, 3, 4], "type": "x"}]'), (2, "r", "X.jpg", "{"), (3, "r", ID, f"[{BOX}]"), (4, "r", ID, None)]
    spark.createDataFrame([(1, "r", 1, f"{ID},"), (2, "r", 2, f"{ID}")], "line_id long, run_id string, line_no int, line string").write.parquet(f"{tmp_path}/submission_raw.parquet")
    spark.createDataFrame(preds, "row_id long, run_id string, image string, regions string").write.parquet(f"{tmp_path}/sample_submission.parquet")
    got = {(r["src_table"], r["rec_id"], r["error_no"]): (r["reason"], r["field"]) for r in p2_errors(spark, str(tmp_path)).collect()}
    bad = ("invalid_value", "regions")
    sub = "sample_submission"
    assert got == {("submission_raw", 2, 0): ("column_count", "record"), (sub, 1, 0): bad, (sub, 1, 1): bad, (sub, 2, 0): ("invalid_value", "image"), (sub, 2, 1): bad}
