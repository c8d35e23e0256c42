from pyspark.sql import functions as F

from regionlab.functions import payload
from regionlab.functions.text import strip_payload


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("raw"))).collect()]


def test_strict(spark):
    ok = ["[1,2]", ' {"a": 1} ', "null", "3"]
    no = ["[1,2] x", "[1,2]]", '{"a":1}}', "[1],", "1],[2", '1,"b":2', "[1,]", "NaN", "", None, "['a']"]
    assert all(one(spark, lambda r: payload.strict_json(r).isNotNull(), *ok))
    assert not any(one(spark, lambda r: payload.strict_json(r).isNotNull(), *no))


def test_items(spark):
    n = lambda r: F.size(payload.items(r, "blocks", "regions"))
    given = ["[1,2]", '{"blocks": [1]}', '{"regions": [1,2,3]}', '{"blocks": null, "regions": [1]}', '{"x": [1]}', 'so: [1,2] ok', "[ERROR:x]", "", None, '"a"', "[1"]
    assert one(spark, n, *given) == [2, 1, 3, 0, 0, 2, 0, 0, 0, 0, 0]


def test_blocks(spark):
    f = lambda r: F.to_json(payload.blocks(r, F.lit(200), F.lit(100), F.lit(100), F.lit(100)))
    got = one(spark, f, '[{"bbox_2d": ["10", 10, 50.9, 40], "block_type": "table"}, {"bbox": [50, 40, 10, 10]}, {"bbox": [1, 1, 2, 2]}, {"bbox": [1]}, {"bbox": ["a",1,2,3]}, {}]')
    assert got == ['[{"bbox":[20,10,101,40],"block_type":"table","writing_type":"handwritten"},{"bbox":[20,10,100,40],"block_type":"text_block","writing_type":"handwritten"}]']


def test_lines_and_per_line(spark):
    frame = [F.lit(100)] * 4
    assert one(spark, lambda r: payload.lines(r, *frame, 5, 7), '{"lines": [[0,0,10,10], {"bbox": [1,2,30,40]}]}') == [[[5, 7, 15, 17], [6, 9, 35, 47]]]
    got = one(spark, lambda r: payload.per_line(r, *frame)["rtype"], '{"regions": [{"bbox": [0,0,9,9]}, {"bbox": [0,0,9,9], "block_type": "formula"}]}')
    assert got == [["handwritten", "formula"]]


def test_texts(spark):
    assert one(spark, payload.transcription, '{"text": "a"}', '{"text": null}', "[]", "x", "[ERROR:e]", None, '{"x": 1}', "{}") == ["a", "", "[ERROR:parse_failed]", "[ERROR:parse_failed]", "[ERROR:e]", "[ERROR:parse_failed]", "", "[ERROR:parse_failed]"]
    assert one(spark, payload.text_lines, '{"lines": ["a", " ", 3]}', '{"text": "a\\nb"}', '["x"]', '{"text": " "}', "q", None) == [["a", "3"], ["a", "b"], ["x"], None, None, None]
    assert one(spark, payload.page_type, '{"page_type": "math"}', '{"page_type": "Math"}', "x", None) == ["math", "text", "text", "text"]


def test_repair(spark):
    # what is widest between brackets, cut behind its last object if it does not parse
    given = ['x [{"a": 1}] y', '[{"a": 1}, {"b": [2]}, {"c": [', '[{"a": [1]}, {"b"]', "[", "", None, "[1, 2"]
    assert one(spark, payload.repaired, *given) == ['[{"a": 1}]', '[{"a": 1}]', '[{"a": [1]}]', "[]", "[]", "[]", "[]"]


def test_types(spark):
    given = ["Signature", "a stamp", "Logo", "some text", "Formula", " table", "x", None]
    assert one(spark, payload.known_type, *given) == ["handwritten", "image", "image", "printed", "Formula", " table", "annotation", "annotation"]


def test_strip(spark):
    assert one(spark, strip_payload, '<think>a\nb</think>\n```json\n{"a": 1}\n```', "x", None) == ['{"a": 1}', "x", None]
