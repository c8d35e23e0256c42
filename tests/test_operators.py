"""Cleaning, splits, profiles, manifests, exports, inference, sources and streaming."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from regionlab.functions import geometry, text
from regionlab.operators import cleaning, export, inference, manifest, profile, splits
from regionlab.plans import pipelines
from regionlab.sources import files
from regionlab.streaming.scoring import score_arrivals

PAGE = "file_name string, source string, image_width int, image_height int, regions array<struct<bbox:array<int>,type:string,language:string,legibility:string,text:string>>"


def page(spark, *texts, name="images/a.jpg", source="school", w=100, h=100):
    return spark.createDataFrame([(name, source, w, h, [([0, 0, 50, 20], None, None, None, t) for t in texts])], PAGE)


def test_clean_silver(spark):
    known = "абв "
    texts = ["а" * 9, "а" * 10, "аб" * 130, "аб" * 130 + "в", "ааxx", "ааxxx", "", None, "в\n\n\n\n\n\n\n\n\n\n\nв"]
    got = cleaning.filter_regions(page(spark, *texts), lambda r: cleaning.is_clean_silver(r, known)).first()["regions"]
    assert [r["text"] for r in got] == ["а" * 9, "аб" * 130, "ааxx"]
    stats = cleaning.filter_stats(page(spark, *texts).unionByName(page(spark, None)), lambda r: cleaning.is_clean_silver(r, known)).first()
    assert tuple(stats) == (10, 3, 7, 2, 1, 1)
    assert cleaning.vocabulary_text(page(spark, "ба", "в", None)) == "абв"


def test_clean_nulls(spark):
    none = spark.createDataFrame([("a", None, None, None, None)], PAGE)
    assert cleaning.filter_regions(none, cleaning.is_clean_train).count() == 0
    assert tuple(cleaning.filter_stats(none, cleaning.is_clean_train).first()) == (0, 0, 0, 1, 0, 1)
    assert tuple(cleaning.filter_stats(none.limit(0), cleaning.is_clean_train).first()) == (0, 0, 0, 0, 0, 0)


def test_pipeline_clean(spark):
    train = page(spark, "абв").unionByName(page(spark, "ггг", name="b.jpg"))
    parts = pipelines.clean(train, page(spark, "абвг", "абвxyz"), held_out=train.where("file_name = 'b.jpg'"))
    assert parts["train"][0].count() == 1
    # without the held out page its letter is unknown, too: one unknown letter is allowed
    assert [r["text"] for r in parts["silver"][0].first()["regions"]] == ["абвг"]


def test_hash_split(spark):
    names = [f"images/{i}.jpg" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "file_name string")
    train, val = splits.hash_split(df)
    want = {n for n in names if int(hashlib.sha1(f"{n}:htr-cv-42".encode()).hexdigest()[:8], 16) < int(0.1 * 2**32)}
    assert {r[0] for r in val.collect()} == want
    assert train.count() == 501 - len(want)
    assert splits.exclude(df.where("file_name is not null"), val, "file_name").count() == 500 - len(want)


def test_examples(spark):
    df = spark.createDataFrame([(None, None, None, t) for t in ["слово до", "коротке", "[нерозб.] текст", "~~ні~~ слова", "latin only here", "слово до", "інше слово тут"]], "language string, legibility string, type string, text string")
    assert [r["text"] for r in cleaning.shortest_examples(df, 2).orderBy("rank").collect()] == ["слово до", "інше слово тут"]


def test_manifest(spark):
    meta = spark.createDataFrame([(1, "x/a.jpg", "s1"), (2, "y/a.jpg", "s2"), (3, None, "s3")], "o int, file_name string, source string")
    ids = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("a.jpg",)], "image string")
    got = sorted(tuple(r) for r in manifest.manifest(ids, meta, "o").collect())
    assert got == [("a.jpg", "y/a.jpg", "s2", True)] * 2 + [("b.jpg", "images/b.jpg", "unknown", False)]
    sub = spark.createDataFrame([("a.jpg", "1"), ("a.jpg", "2"), ("z.jpg", "3")], "image string, regions string")
    assert sorted(tuple(r) for r in manifest.aligned(sub, ids).collect()) == [("a.jpg", "1"), ("a.jpg", "2"), ("b.jpg", "[]")]
    u = manifest.tagged_union({"t": ids, "s": sub})
    assert u.columns == ["image", "_origin", "regions"]
    assert manifest.pending(ids, sub, "image").count() == 1


def test_geometry(spark):
    df = spark.createDataFrame([([10, 20, 30, 61],)], "b array<int>")
    one = lambda c: df.select(c).first()[0]
    b = F.col("b")
    assert one(geometry.bands(b, F.lit(3))) == [[10, 20, 30, 33], [10, 33, 30, 47], [10, 47, 30, 61]]
    assert one(geometry.bands(b, F.lit(0))) == [[10, 20, 30, 61]]
    assert one(geometry.crop_box(b, F.lit(32), F.lit(100), 0.5)) == [0, 0, 32, 81]
    assert one(geometry.to_thousandths(b, F.lit(25), F.lit(None).cast("int"))) == [400, 1000, 1000, 1000]
    assert one(geometry.fitted(F.lit(4000), F.lit(3000), 1_000_000)) == [1154, 866]
    assert one(geometry.enlarged(F.lit(64), F.lit(10))) == [256, 40]
    assert one(geometry.enclosing(b, F.array(*map(F.lit, (0, 30, 20, 40))))) == [0, 20, 30, 61]
    frame = [F.lit(v) for v in (200, 100, 100, 100)]
    scaled = lambda v: spark.createDataFrame([(v,)], "b array<string>").select(geometry.scale(F.col("b"), *frame)).first()[0]
    assert scaled(["40.9", "9", "10", "50"]) == [20, 9, 81, 50]
    assert scaled(["1", "2", "3"]) is None
    assert scaled(["1", "x", "3", "9"]) is None
    assert scaled(["1", "1", "9", "3"]) is None
    assert scaled(["0", "0", "1e300", "9"]) is None


def test_text_functions(spark):
    f = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert f(text.stem, "a/b.c.jpg") == "b.c"
    assert f(text.stem, "x/.hidden") == ".hidden"
    assert f(text.first_line, " a \nb") == "a"
    assert f(text.without_errors, "[ERROR:x] y") == f(text.without_errors, None) == ""
    assert f(text.distinct_characters, "baab") == "ab"
    assert len(f(text.preview, "x" * 501)) == 503
    lines = spark.createDataFrame([([" a ", "", "b"],), ([" "],), (None,)], "t array<string>").select(text.clean_lines(F.col("t"))).collect()
    assert [r[0] for r in lines] == [["a", "b"], None, None]


def test_profile(spark):
    p = page(spark, "аб", "a1").unionByName(page(spark, "~~x~~", source=None, w=0, h=0))
    long = cleaning.regions_long(p, "source", "file_name")
    assert {tuple(r) for r in profile.character_counts(long).collect()} == {("а", 1), ("б", 1), ("a", 1), ("1", 1), ("~", 4), ("x", 1)}
    assert {tuple(r) for r in profile.only_in(profile.character_counts(long, "source"), "school").collect()} == {("а",), ("б",), ("a",), ("1",)}
    shape = profile.with_shape(p).where("source is null").first()
    assert shape["aspect_ratio"] is None and shape["num_regions"] == 1


def test_export(spark):
    p = page(spark, " слово ", "", "ні", w=1000, h=1000)
    c = export.crops(p).orderBy("idx").collect()
    assert [(r["idx"], r["text"], r["crop"], r["out_size"], r["crop_name"]) for r in c] == [(0, "слово", [0, 0, 52, 21], [256, 103], "a_000.jpg"), (2, "ні", [0, 0, 52, 21], [256, 103], "a_002.jpg")]
    m = export.transcribe_samples(p).orderBy("crop_name").first()["messages"]
    assert [x["role"] for x in m] == ["user", "assistant"]
    assert json.loads(m[1]["content"][0]["text"]) == {"text": "слово"}
    blocks = json.loads(export.detect_samples(p).first()["messages"][1]["content"][0]["text"])["blocks"]
    assert blocks[0] == {"bbox_2d": [0, 0, 50, 20], "block_type": "text_block", "writing_type": "handwritten"}
    res = spark.createDataFrame([("u", [(None, [5, 9, 9, 9], "[ERROR:t]"), ("table", [1, 2, 3, 4], "x"), None]), ("v", None)], "uuid string, regions array<struct<type:string,bbox:array<int>,transcription:string>>")
    out = {r["image"]: json.loads(r["regions"]) for r in export.submission(res).collect()}
    assert out == {"u.jpg": [{"bbox": [5, 9, 9, 9], "type": "handwritten", "text": ""}, {"bbox": [1, 2, 3, 4], "type": "table", "text": "x"}], "v.jpg": []}
    ordered = res.select(export.in_output_order(F.filter("regions", lambda r: r.isNotNull())).alias("r")).first()["r"]
    assert [r["bbox"][1] for r in ordered] == [2, 9]


def test_inference(spark, tmp_path):
    def failing(request):
        if "bad" in request.image:
            raise RuntimeError("no such picture")
        return inference.fake_backend(request)

    rows = [("1", "school", "math1", 100, 100), ("2", "archive", "text1", 200, 100), ("3", "school", "bad", 100, 100)]
    pages = spark.createDataFrame(rows, "uuid string, source string, image string, image_width int, image_height int")
    out = str(tmp_path / "results")
    pipelines.infer(pages.where("uuid <> '2'"), None, failing, out)
    pipelines.infer(pages, spark.read.parquet(out), failing, out, inference.Config(nms=0.5))
    got = {r["uuid"]: r["regions"] for r in spark.read.parquet(out).collect()}
    assert [(r["type"], r["bbox"], r["transcription"]) for r in got["1"]] == [("handwritten", [0, 0, 50, 10], "x"), ("formula", [0, 20, 50, 30], "x"), ("handwritten", [0, 40, 50, 50], "x")]
    assert [(r["type"], r["bbox"], r["transcription"]) for r in got["2"]] == [("printed", [20, 10, 180, 30], "one"), ("printed", [20, 30, 180, 50], "two"), ("image", [20, 50, 180, 90], "")]
    assert got["3"] == []
    assert spark.read.parquet(out).count() == 3


REQUEST = inference.Request("text", "i", None, None, None, "read", 10)


def test_requests(spark):
    """Prompt, longest answer, margin and size of the part reach the model; blocks are cut into lines by a question of their own."""

    def telling(q):
        if q.task in ("text", "lines"):
            return json.dumps({"text": f"{q.task} {q.box} {q.size} {q.max_tokens} {q.prompt[:9]} {q.prompt[-3:]}"}), 0, 0
        return inference.fake_backend(q)

    pages = spark.createDataFrame([("1", "archive", "x", 1000, 1000), ("2", "school", "x", 1000, 50), ("3", "school", "x", 0, 0)], "uuid string, source string, image string, image_width int, image_height int")
    cfg = inference.Config(find_lines=True, margins={"default": 0.05, "archive": 0.1}, examples={"printed": [("d", "зр")]}, at_once=2)
    got = {r["uuid"]: [(x["type"], x["bbox"], x["transcription"]) for x in r["regions"]] for r in inference.run(pages, telling, cfg).collect()}
    # the block [100, 100, 900, 500] is looked at with 3 %: [76, 88, 924, 512]; its lines are 40 % and 50 % of that
    assert got["1"][:2] == [("printed", [76, 88, 924, 257], "text [0, 72, 1000, 273] [1000, 201] 1024 Read this  зр"), ("printed", [76, 300, 924, 512], "text [0, 279, 1000, 533] [1000, 254] 1024 Read this  зр")]
    assert got["1"][2] == ("image", [100, 500, 900, 900], "")
    assert len(got["2"]) == 3 and got["3"] == []
    whole = inference.run(pages.where("uuid = '1'"), telling, inference.Config()).first()["regions"]
    assert whole[0]["transcription"].startswith("lines [60, 80, 940, 520] None 2048 Read this")


def test_settings(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("image: {deskew: true}\npostproc: {nms_iou: 0.4}\ntranscribe:\n  crop_margins: {archive: 0.03}\n  few_shot_examples: {table: [[d, g]]}\nrouting: {math_shortcircuit_min_lines: 5}\n")
    c = inference.Config.of(files.read_settings(str(tmp_path / "s.yaml")), attempts=2)
    assert c == inference.Config(nms=0.4, per_line_from=5, attempts=2, margins={"default": 0.05, "archive": 0.03}, examples={"table": [("d", "g")]}, deskew=True)
    assert inference.Config.of(files.read_settings(str(tmp_path / "none.yaml"))) == inference.Config()


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a.jpg", b"1"), ("b.jpg", None), ("c.jpg", b"3")], "name string, content binary")
    (tmp_path / "c.jpg").write_bytes(b"old")
    assert {tuple(r) for r in files.write_files(df, str(tmp_path)).collect()} == {("a.jpg", True), ("b.jpg", None), ("c.jpg", False)}
    assert (tmp_path / "a.jpg").read_bytes() == b"1" and (tmp_path / "c.jpg").read_bytes() == b"old" and len(os.listdir(tmp_path)) == 2


def test_export_samples(spark, tmp_path):
    p = page(spark, "слово", w=1000, h=1000).withColumn("split", F.lit("train")).unionByName(page(spark, "інше", name="b.jpg", w=1000, h=1000).withColumn("split", F.lit("test")))
    images = spark.createDataFrame([("a.jpg",)], "name string")
    n = pipelines.export_samples(p, str(tmp_path), images=images)
    assert n == {("train", "detect"): 1, ("train", "transcribe"): 1, ("silver", "detect"): 0, ("silver", "transcribe"): 0, ("test", "detect"): 0, ("test", "transcribe"): 0}
    assert pipelines.export_samples(p, str(tmp_path), names=("test",), tasks=("transcribe",)) == {("test", "transcribe"): 1}


def test_retry():
    waits, calls = [], []

    def busy(*args):
        calls.append(args)
        if len(calls) < 3:
            raise RuntimeError("429 too many")
        return "ok", 1, 1

    assert inference.call_with_retry(busy, 4, REQUEST, wait=waits.append) == ("ok", 1, 1)
    assert len(waits) == 2

    def broken(*args):
        raise ValueError("nothing")

    assert inference.call_with_retry(broken, 4, REQUEST, wait=waits.append)[0] == inference.FAILED


def test_sources(spark, tmp_path):
    p = page(spark, 'a "quoted", text\nof lines')
    assert files.write_jsonl(p, str(tmp_path / "j")) == 1
    back = files.read_jsonl(spark, str(tmp_path / "j"))
    assert back.first()["regions"][0]["text"] == p.first()["regions"][0]["text"]
    (tmp_path / "bad.jsonl").write_text('{"file_name": "a"}\n\n{"file_name": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    loose = files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=False).collect()
    assert [r["file_name"] for r in loose if r["_corrupt_record"] is None] == ["a"]
    assert len(loose) == 2
    files.write_submission(files.solution(p), str(tmp_path / "csv"))
    s = files.read_submission(spark, str(tmp_path / "csv")).first()
    assert s["image"] == "a.jpg" and json.loads(s["regions"])[0]["text"].endswith("lines")
    with pytest.raises(ValueError):
        files.split_path("root", "other")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.y.jpg").write_bytes(b"123")
    r = files.read_images(spark, str(tmp_path / "img"), content=False).first()
    assert (r["name"], r["stem"], r["length"]) == ("x.y.jpg", "x.y", 3)
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "u.json").write_text('{"uuid": "u",\n "source": null, "regions": []}')
    assert files.read_results(spark, str(tmp_path / "res")).first()["file"] == "u.json"
    assert files.read_settings(str(tmp_path / "none.yaml"))["margins"] == {"default": 0.05}
    files.write_examples(spark.createDataFrame([("table", 1, "а|б")], "type string, rank int, text string"), str(tmp_path / "e.yaml"))
    assert files.read_settings(str(tmp_path / "e.yaml"))["examples"] == {"table": [("example", "а|б")]}


def test_streaming(spark, tmp_path):
    ident = "0a1b2c3d-0000-4000-8000-0123456789ab.jpg"
    solution = spark.createDataFrame([(ident, [([0.0, 0.0, 9.0, 9.0], "printed", "uk", "legible", "так")])], "image string, regions array<struct<bbox:array<double>,type:string,language:string,legibility:string,text:string>>")
    rows = [(ident, '[{"bbox": [0, 0, 9, 9], "type": "printed", "text": "так"}]', 1)]
    spark.createDataFrame(rows, "image string, regions string, row_no bigint").write.parquet(str(tmp_path / "in"))
    seen = []
    q = score_arrivals(spark, str(tmp_path / "in"), solution, str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect()), once=True)
    q.awaitTermination(120)
    assert [round(r["score"], 6) for r in seen] == [1.0]


def test_evaluate_is_strict(spark):
    solution = spark.createDataFrame([("a.jpg", None)], PAGE.replace("file_name", "image").split(", source")[0] + ", regions array<struct<bbox:array<double>,type:string,language:string,legibility:string,text:string>>")
    bad = spark.createDataFrame([("a.jpg", "[", 1)], "image string, regions string, row_no int")
    with pytest.raises(Exception, match="a.jpg"):
        pipelines.evaluate(solution, bad)
    assert pipelines.evaluate(solution, bad, strict=False).first()["pages"] == 1


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    r = e.entry(spark).first()
    assert 0 <= r["score"] <= 1


def test_sql_agrees(spark, tiny):
    """A few queries against their SQL on the smallest tables; the whole set runs outside the tests."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    for name in "p2_found p2_loaded p2_files p3_found p3_links hash_split clean_stats nms_kept manifest_join score_per_page score_report normalize_formulas ensemble_merged inferred_regions payload_blocks requests".split():
        df = e.queries()[name](spark, tiny)
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
        res = con.execute(e.oracle_sql()[name])
        at = {d[0]: i for i, d in enumerate(res.description)}
        assert got == sorted(map(repr, (tuple(r[at[c]] for c in cols) for r in res.fetchall()))), name
