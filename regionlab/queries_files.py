"""Driver queries of readers, writers, shards, ensembles, model answers and inference, and their SQL.

What is written and read again lies in the shared folder and goes when the session ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlab.functions import payload
from regionlab.functions.geometry import usable
from regionlab.functions.text import basename, clean_lines, distinct_characters, preview, strip_payload
from regionlab.operators import ensemble, inference, manifest, splits
from regionlab.queries_reference import REGION, _matched
from regionlab.session import shared_folder, spread, table, until_exit
from regionlab.sources import files
from regionlab.sql_reference import _BOTH, _LONG, _MATCHES_FROM, _NAME, _OK_BOX, _RES, _SHA_ORDER, _strip
from regionlab.sql_scores import distance


def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON lines and read again, by source."""
    path = shared_folder(spark, "manifest")
    pages = table(spark, d, "metadata", regions=REGION).select("file_name", "source", "image_width", "image_height", "regions")
    n = files.write_jsonl(pages, path)
    until_exit(spark, path)
    r = F.filter("regions", lambda x: x.isNotNull())
    back = files.read_jsonl(spark, path).select("source", F.coalesce(F.size(r), F.lit(0)).alias("n"), F.coalesce(F.aggregate(r, F.lit(0), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0))), F.lit(0)).alias("c"))
    return back.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.greatest("n", F.lit(0))).alias("regions"), F.sum("c").alias("characters")).withColumn("written", F.lit(n).cast("long"))


def submission_file(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as CSV and read again; null and empty regions are one in a file."""
    path = shared_folder(spark, "submission")
    files.write_submission(table(spark, d, "sample_submission"), path)
    until_exit(spark, path)
    back = files.read_submission(spark, path)
    return back.groupBy("image").agg(F.count("*").alias("rows"), F.sum(F.length(F.coalesce("regions", F.lit("")))).alias("characters"))


def results_file(spark: SparkSession, d: str) -> DataFrame:
    """Results appended in two runs, the second of which leaves out the pages of the first."""
    path = shared_folder(spark, "results")
    results = table(spark, d, "page_results").select("uuid", "source", "regions").where("uuid is not null")
    files.append_results(results.where("uuid < '8'"), path)
    until_exit(spark, path)
    files.append_results(manifest.pending(results, spark.read.parquet(path), "uuid"), path)
    return spark.read.parquet(path).groupBy("uuid").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.size("regions"), F.lit(0))).alias("regions"))


def solution_rows(spark: SparkSession, d: str) -> DataFrame:
    """Solution rows of the evaluation pages: the regions' JSON read again."""
    pages = table(spark, d, "metadata", regions=REGION).where("split in ('val', 'test') and file_name is not null")
    s = files.solution(pages.select("file_name", "regions")).withColumn("r", F.from_json("regions", "array<struct<bbox:array<int>,type:string,text:string>>"))
    return s.groupBy("image").agg(F.count("*").alias("rows"), F.sum(F.greatest(F.coalesce(F.size("r"), F.lit(0)), F.lit(0))).alias("regions"))


def file_sink(spark: SparkSession, d: str) -> DataFrame:
    """Files written twice, of which the second time none is new, and listed."""
    path = shared_folder(spark, "files")
    df = table(spark, d, "subjects").select(F.concat("subject", F.lit(".txt")).alias("name"), F.encode("description", "utf-8").alias("content"))
    new = sum(1 for _ in range(2) for r in files.write_files(df, path).where("written").collect())
    until_exit(spark, path)
    return files.read_images(spark, path, content=False).select("name", "stem", "length", F.lit(new).cast("long").alias("written"))


def run_shards(spark: SparkSession, d: str) -> DataFrame:
    return manifest.numbered_shards(table(spark, d, "metadata").select("row_id", "file_name"), "file_name", 7).select("row_id", "shard")


def ensemble_merged(spark: SparkSession, d: str) -> DataFrame:
    """Annotated and predicted regions of a page put together."""
    m = _matched(spark, d).select("row_id", F.explode(ensemble.merged(F.col("gt"), F.col("pred"))).alias("r"))
    return m.select("row_id", "r.type", "r.text", *[F.col("r.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def ensemble_agreeing(spark: SparkSession, d: str) -> DataFrame:
    """Predicted regions that agree with the annotated ones."""
    m = _matched(spark, d).select("row_id", F.explode(ensemble.agreeing(F.col("pred"), F.col("gt"))).alias("r"))
    return m.select("row_id", "r.type", "r.text", F.col("r.bbox")[0].alias("x1"), F.col("r.bbox")[1].alias("y1"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model made of results: JSON with words around it, broken, or an error marker."""
    p = table(spark, d, "page_results").select("result_id", F.posexplode("regions").alias("idx", "r")).where("r.transcription is not null")
    json = F.to_json(F.struct(F.col("r.transcription").alias("text")))
    n = F.pmod(F.col("result_id"), F.lit(4))
    raw = F.when(F.startswith(F.col("r.transcription"), F.lit("[ERROR:")), F.col("r.transcription")).when(n == 0, json).when(n == 1, F.concat(F.lit("Here it is: "), json, F.lit(" Done."))).when(n == 2, F.substring_index(json, "\"", 3)).otherwise(json)
    return p.select("result_id", "idx", raw.alias("raw"))


def payload_texts(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("result_id", "idx", payload.transcription(F.col("raw")).alias("text"))


def payload_lines(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("result_id", "idx", F.posexplode(payload.text_lines(F.col("raw"))).alias("line_no", "line"))


def known_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of results as known ones."""
    t = table(spark, d, "page_results").select(F.explode("regions").alias("r")).where("r is not null").select(F.col("r.type").alias("given"))
    return t.groupBy("given", payload.known_type(F.col("given")).alias("type")).agg(F.count("*").alias("n"))


def inferred_regions(spark: SparkSession, d: str) -> DataFrame:
    """The inference plan with the deterministic model over every page of a known size."""
    pages = table(spark, d, "metadata").where("file_name is not null and image_width > 0 and image_height > 0")
    pages = spread(pages.select(F.col("row_id").cast("string").alias("uuid"), "source", basename(F.col("file_name")).alias("image"), "image_width", "image_height"))
    r = inference.run(pages, inference.fake_backend).select("uuid", F.posexplode("regions").alias("idx", "r"))
    return r.select("uuid", "idx", "r.type", "r.transcription", *[F.col("r.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Previews, distinct characters and clean lines of page texts; answers without thoughts and fences."""
    t = table(spark, d, "metadata").select("row_id", "text").where("text is not null")
    fenced = F.concat(F.lit("<think>one\ntwo</think>\n```json\n"), F.col("text"), F.lit("\n``` \n"))
    lines = clean_lines(F.split("text", "\n", -1))
    return t.select(
        "row_id", preview(F.col("text")).alias("preview"), F.length(distinct_characters(F.col("text"))).alias("characters"), F.coalesce(F.size(lines), F.lit(0)).alias("lines"), strip_payload(fenced).alias("bare"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """What a model would be asked of every region of a page of known size: the part with its source's margin, its size, the longest answer."""
    cfg = inference.Config(margins={"default": 0.05, "archive": 0.03}, examples={"table": [("cells", "а|б")]})
    long = table(spark, d, "metadata", regions=("bbox", "type")).where("image_width > 0 and image_height > 0")
    long = long.select("row_id", "source", "image_width", "image_height", F.posexplode("regions").alias("idx", "r")).where(usable(F.col("r.bbox")))
    q = inference.asked(long.withColumns({"task": F.lit("text"), "box": F.col("r.bbox"), "rtype": F.col("r.type")}), cfg)
    crop = [F.col("crop")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return q.select("row_id", "idx", *crop, F.col("size")[0].alias("w"), F.col("size")[1].alias("h"), "max_tokens", F.contains("prompt", F.lit("Examples:")).alias("has_examples"))


def shuffled_head(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred pages in a seeded order."""
    return splits.shuffled(table(spark, d, "metadata").select("row_id", "source"), "row_id").limit(100)


def page_types(spark: SparkSession, d: str) -> DataFrame:
    """Answers about a page's kind, made of sources: right, unknown, broken."""
    s = F.coalesce("source", F.lit("?"))
    answer = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit('Well: {"page_type": "math", "of": '), F.to_json(F.struct(s.alias("s"))), F.lit("}"))).when(F.col("row_id") % 3 == 1, F.lit('{"page_type": "maths"}')).otherwise(F.lit('{"page_type": "math"'))
    return table(spark, d, "metadata").select("row_id", "source").select("row_id", payload.page_type(answer).alias("page_type"))


def payload_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines, some as bare lists of coordinates, and regions in per-line form from answers about results."""
    p = table(spark, d, "page_results").select("result_id", F.filter("regions", lambda r: r.isNotNull() & usable(r["bbox"])).alias("rs")).where(F.size("rs") > 0)
    bare = F.concat(F.lit('{"lines": ['), F.array_join(F.transform("rs", lambda r: F.to_json(r["bbox"])), ", "), F.lit("]}"))
    named = F.concat(F.lit("Answer:\n"), F.to_json(F.struct(F.transform("rs", lambda r: F.struct(r["bbox"].alias("bbox_2d"), r["type"].alias("block_type"))).alias("blocks"))))
    k = [F.lit(x) for x in (500, 500, 1000, 1000)]
    lines = p.select("result_id", F.lit("line").alias("kind"), F.posexplode(payload.lines(bare, *k, 7, 9)).alias("no", "b"), F.lit(None).cast("string").alias("type"))
    per = p.select("result_id", F.lit("region").alias("kind"), F.posexplode(payload.per_line(named, *k)).alias("no", "t")).select("result_id", "kind", "no", F.col("t.bbox").alias("b"), F.col("t.rtype").alias("type"))
    both = lines.unionByName(per)
    return both.select("result_id", "kind", "no", "type", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


QUERIES = {
    f.__name__: f
    for f in (
        manifest_file, submission_file, results_file, solution_rows, file_sink, run_shards, ensemble_merged, ensemble_agreeing, payload_texts, payload_lines, known_types, inferred_regions,
        text_functions, requests, shuffled_head, page_types, payload_boxes,
    )
}

_OWN = "list_filter(coalesce(regions, []), lambda r: r IS NOT NULL)"
_M = f"(SELECT row_id, x.gi AS gi, x.pi AS pi FROM (SELECT row_id, unnest(m) AS x FROM {_MATCHES_FROM.replace('@', '0.3')}))"
_TWO = f"(SELECT b.row_id, gi, pi, gt[gi + 1] AS g, pred[pi + 1] AS p FROM {_M} m JOIN {_BOTH} b ON m.row_id = b.row_id)"
_FOREIGN = "length(regexp_replace(coalesce({0}.text, ''), '[А-ЯҐЄІЇа-яґєії]', '', 'g'))"
_SECOND = f"{_FOREIGN.format('p')} < {_FOREIGN.format('g')}"
_ALONE = "SELECT row_id, coalesce(r.type, 'handwritten'), coalesce(r.text, ''), r.bbox[1]::DOUBLE, r.bbox[2]::DOUBLE, r.bbox[3]::DOUBLE, r.bbox[4]::DOUBLE FROM (SELECT row_id, unnest({0}) AS r, unnest(range(len({0}))) AS i FROM {1}) x WHERE NOT EXISTS (FROM {2} m WHERE m.row_id = x.row_id AND m.{3} = x.i)"
_RAW = "(SELECT result_id, ri::INT AS idx, r.transcription AS tr, result_id % 4 AS k FROM (SELECT result_id, unnest(regions) AS r, unnest(range(len(regions))) AS ri FROM page_results) WHERE r.transcription IS NOT NULL)"
_BAD = "tr LIKE '[ERROR:%'"

SQL = {
    "manifest_file": f"""SELECT source, count(*) AS pages, sum(len({_OWN}))::BIGINT AS regions, sum(coalesce(list_sum(list_transform({_OWN}, lambda r: coalesce(length(r.text), 0))), 0))::BIGINT AS characters,
(SELECT count(*) FROM metadata) AS written FROM metadata GROUP BY 1""",
    "submission_file": "SELECT image, count(*) AS rows, sum(length(coalesce(regions, '')))::BIGINT AS characters FROM sample_submission GROUP BY 1",
    "results_file": "SELECT uuid, count(*) AS rows, sum(coalesce(len(regions), 0))::BIGINT AS regions FROM page_results WHERE uuid IS NOT NULL GROUP BY 1",
    "solution_rows": f"SELECT {_NAME} AS image, count(*) AS rows, sum(len(coalesce(regions, [])))::BIGINT AS regions FROM metadata WHERE split IN ('val', 'test') AND file_name IS NOT NULL GROUP BY 1",
    "file_sink": "SELECT subject || '.txt' AS name, subject AS stem, octet_length(encode(description))::BIGINT AS length, (SELECT count(*) FROM subjects) AS written FROM subjects",
    "run_shards": "SELECT row_id, coalesce(('0x' || substr(md5(file_name), 1, 8))::BIGINT % 7, 0)::INT AS shard FROM metadata",
    "ensemble_merged": f"""SELECT row_id, coalesce(CASE WHEN {_SECOND} THEN p.type ELSE g.type END, 'handwritten') AS type, coalesce(CASE WHEN {_SECOND} THEN p.text ELSE g.text END, '') AS text,
least(g.bbox[1], p.bbox[1]) AS x1, least(g.bbox[2], p.bbox[2]) AS y1, greatest(g.bbox[3], p.bbox[3]) AS x2, greatest(g.bbox[4], p.bbox[4]) AS y2 FROM {_TWO}
UNION ALL {_ALONE.format("gt", _BOTH, _M, "gi")} UNION ALL {_ALONE.format("pred", _BOTH, _M, "pi")}""",
    "ensemble_agreeing": f"""SELECT row_id, coalesce(p.type, 'handwritten') AS type, b AS text, p.bbox[1] AS x1, p.bbox[2] AS y1
FROM (SELECT row_id, p, coalesce(g.text, '') AS a, coalesce(p.text, '') AS b FROM {_TWO}) WHERE {distance("a", "b")} <= length(a) * 0.1::DOUBLE""",
    "payload_texts": f"SELECT result_id, idx, CASE WHEN {_BAD} THEN tr WHEN k = 2 THEN '[ERROR:parse_failed]' ELSE tr END AS text FROM {_RAW}",
    "payload_lines": f"""SELECT result_id, idx, (row_number() OVER (PARTITION BY result_id, idx ORDER BY i) - 1)::INT AS line_no, line FROM (SELECT result_id, idx, i, {_strip("part")} AS line
FROM (SELECT result_id, idx, unnest(string_split(tr, chr(10))) AS part, unnest(range(len(string_split(tr, chr(10))))) AS i FROM {_RAW} WHERE NOT ({_BAD}) AND k <> 2)) WHERE line <> ''""",
    "known_types": f"""SELECT given, CASE WHEN c IN ('annotation', 'formula', 'graph', 'handwritten', 'image', 'printed', 'table') THEN given WHEN contains(c, 'signature') THEN 'handwritten' WHEN contains(c, 'stamp') OR contains(c, 'logo') THEN 'image'
WHEN contains(c, 'text') THEN 'printed' ELSE 'annotation' END AS type, count(*) AS n FROM (SELECT r.type AS given, {_strip("lower(coalesce(r.type, ''))")} AS c FROM (SELECT unnest(regions) AS r FROM page_results) WHERE r IS NOT NULL) GROUP BY 1, 2""",
    "inferred_regions": """WITH b AS (SELECT row_id::VARCHAR AS uuid, (10 * image_width // 100) AS x1, (90 * image_width // 100) AS x2, (10 * image_height // 100) AS ya, (50 * image_height // 100) AS yb, (90 * image_height // 100) AS yc
FROM metadata WHERE file_name IS NOT NULL AND image_width > 0 AND image_height > 0)
SELECT uuid, 0 AS idx, 'printed' AS type, 'one' AS transcription, x1, ya AS y1, x2, trunc(ya + (yb - ya) / 2.0)::INT AS y2 FROM b UNION ALL SELECT uuid, 1, 'printed', 'two', x1, trunc(ya + (yb - ya) / 2.0)::INT, x2, yb FROM b
UNION ALL SELECT uuid, 2, 'image', '', x1, yb, x2, yc FROM b""",
    "text_functions": f"""SELECT row_id, CASE WHEN length(text) > 500 THEN text[:250] || ' … ' || text[-250:] ELSE text END AS preview, len(list_distinct(regexp_extract_all(text, '(?s).')))::INT AS characters,
len(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip("s")}), lambda s: s <> ''))::INT AS lines, {_strip("text")} AS bare FROM metadata WHERE text IS NOT NULL""",
    "requests": f"""WITH b AS (SELECT row_id, idx, bbox, image_width AS w, image_height AS h, rtype, CASE WHEN source = 'archive' THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END AS m FROM {_LONG} WHERE {_OK_BOX} AND image_width > 0 AND image_height > 0),
c AS (SELECT row_id, idx, rtype, greatest(0, bbox[1] - trunc((bbox[3] - bbox[1]) * m)::INT) AS x1, greatest(0, bbox[2] - trunc((bbox[4] - bbox[2]) * m)::INT) AS y1,
least(w, bbox[3] + trunc((bbox[3] - bbox[1]) * m)::INT) AS x2, least(h, bbox[4] + trunc((bbox[4] - bbox[2]) * m)::INT) AS y2 FROM b)
SELECT row_id, idx, x1, y1, x2, y2, CASE WHEN s < 128 AND s > 0 THEN trunc((x2 - x1) * (256.0::DOUBLE / s))::INT ELSE x2 - x1 END AS w, CASE WHEN s < 128 AND s > 0 THEN trunc((y2 - y1) * (256.0::DOUBLE / s))::INT ELSE y2 - y1 END AS h,
CASE WHEN rtype = 'annotation' THEN 512 ELSE 1024 END AS max_tokens, coalesce(rtype = 'table', false) AS has_examples FROM (SELECT *, greatest(x2 - x1, y2 - y1) AS s FROM c)""",
    "shuffled_head": f"SELECT row_id, source FROM metadata ORDER BY {_SHA_ORDER} LIMIT 100",
    "page_types": "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'math' ELSE 'text' END AS page_type FROM metadata",
    "payload_boxes": f"""WITH r AS (SELECT result_id, rtype, idx, least(trunc(bbox[1] * 0.5::DOUBLE), trunc(bbox[3] * 0.5::DOUBLE))::INT AS x1, least(trunc(bbox[2] * 0.5::DOUBLE), trunc(bbox[4] * 0.5::DOUBLE))::INT AS y1,
greatest(trunc(bbox[1] * 0.5::DOUBLE), trunc(bbox[3] * 0.5::DOUBLE))::INT AS x2, greatest(trunc(bbox[2] * 0.5::DOUBLE), trunc(bbox[4] * 0.5::DOUBLE))::INT AS y2 FROM {_RES} WHERE {_OK_BOX}),
k AS (SELECT *, (row_number() OVER (PARTITION BY result_id ORDER BY idx) - 1)::INT AS no FROM r WHERE x2 - x1 >= 3 AND y2 - y1 >= 3)
SELECT result_id, 'line' AS kind, no, NULL::VARCHAR AS type, x1 + 7 AS x1, y1 + 9 AS y1, x2 + 7 AS x2, y2 + 9 AS y2 FROM k
UNION ALL SELECT result_id, 'region', no, CASE WHEN coalesce(rtype, 'text_block') = 'text_block' THEN 'handwritten' ELSE rtype END, x1, y1, x2, y2 FROM k""",
}
