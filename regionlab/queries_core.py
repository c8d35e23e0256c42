"""Driver queries of the general data problems 2 and 3, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlab.operators import nested, records
from regionlab.session import shared_folder, spread, table, until_exit
from regionlab.sql_reference import P2_FILES, P2_FOUND, P2_LOADED


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "submission_raw").select("line_id", "run_id", "line_no", "line"))


def _submission(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "sample_submission").select("row_id", "run_id", "image", "regions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Unfit rows of both tables with the first reason that holds."""
    raw = _raw(spark, d).select(F.lit("submission_raw").alias("src_table"), F.col("line_id").alias("rec_id"), records.parsed_line(F.col("line"), typed=False).alias("p"))
    sub = _submission(spark, d).select(
        F.lit("sample_submission").alias("src_table"), F.col("row_id").alias("rec_id"), records.parsed_submission(F.col("image"), F.col("regions"), typed=False).alias("p")
    )
    return raw.unionByName(sub).select("src_table", "rec_id", F.col("p.reason").alias("reason")).where("reason is not null")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The fit rows, loaded: one row per region (rows without regions once, with a null index)."""
    raw = records.load(_raw(spark, d), records.parsed_line(F.col("line")), "line_id")[0]
    sub = records.load(_submission(spark, d).withColumnRenamed("image", "im").withColumnRenamed("regions", "rg"), records.parsed_submission(F.col("im"), F.col("rg")), "row_id")[0]
    both = raw.select(F.lit("submission_raw").alias("src_table"), F.col("line_id").alias("rec_id"), "image", "regions").unionByName(
        sub.select(F.lit("sample_submission").alias("src_table"), F.col("row_id").alias("rec_id"), "image", "regions")
    )
    r = F.col("r")
    return both.select("src_table", "rec_id", "image", F.posexplode_outer("regions").alias("region_idx", "r")).select(
        "src_table", "rec_id", "image", "region_idx", *[r["bbox"][k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], r["type"].alias("type"), r["text"].alias("text")
    )


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every located error of the unfit rows of both tables, those behind the first one included."""
    raw = records.load(_raw(spark, d), records.parsed_line(F.col("line")), "line_id")[1]
    sub = records.load(_submission(spark, d), records.parsed_submission(F.col("image"), F.col("regions")), "row_id")[1]
    both = raw.select(F.lit("submission_raw").alias("src_table"), F.col("line_id").alias("rec_id"), "errors").unionByName(
        sub.select(F.lit("sample_submission").alias("src_table"), F.col("row_id").alias("rec_id"), "errors")
    )
    return both.select("src_table", "rec_id", F.posexplode("errors").alias("error_no", "e")).select(
        "src_table", "rec_id", "error_no", "e.reason", "e.field", F.col("e.at").alias("error_at"), "e.message"
    )


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The records written to submission files, broken quotes and all, and loaded from them: fit ones by image and number of regions."""
    folder = shared_folder(spark, "submissions")
    lines = _raw(spark, d).where("line is not null").select(F.regexp_replace("line", r"[\r\n]+\z", "").alias("value"))
    lines.write.text(folder)
    until_exit(spark, folder)
    fit, _ = records.load_path(spark, folder)
    return fit.groupBy("image", F.size("regions").alias("regions")).agg(F.count("*").alias("records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for every non-null region, line, word and alternative."""
    nodes = nested.interval_nodes(table(spark, d, "metadata").select("row_id", "regions"), "regions", ["row_id"], payload=False)
    return nodes.select("row_id", *[F.col(f"idx_{k}").alias(n) for k, n in enumerate(("region_idx", "line_idx", "word_idx", "alt_idx"), 1)])


def _p3_table(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = nested.node_tables(table(spark, d, "metadata").select("row_id", "file_name", "regions"), "regions", ["row_id", "file_name"])[kind]
        names = {"idx_1": "region_idx", "idx_2": "line_idx", "idx_3": "word_idx", "idx_4": "alt_idx"}
        # arrays leave as text so that the comparison with SQL has plain columns
        cols = []
        for f in t.schema.fields:
            c = F.col(f"`{f.name}`")
            if f.name == "bbox":
                c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null")
            cols.append(c.alias(names.get(f.name, f.name)))
        return t.select(*cols).drop("node_level")

    return run


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every node below a region with its parent: line and region, word and line, alternative and word."""
    nodes = nested.interval_nodes(table(spark, d, "metadata").select("row_id", "regions"), "regions", ["row_id"], payload=False, ancestors=True)
    return nested.parents(nodes, "row_id").select("row_id", F.col("ancestor_pre").alias("parent_pre"), "node_pre", "node_level")


QUERIES = {
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p2_errors": p2_errors,
    "p2_files": p2_files,
    "p3_found": p3_found,
    "p3_regions": _p3_table("regions"),
    "p3_lines": _p3_table("regions.lines"),
    "p3_words": _p3_table("regions.lines.words"),
    "p3_alternatives": _p3_table("regions.lines.words.alternatives"),
    "p3_links": p3_links,
}

_R = "SELECT row_id, file_name, unnest(regions) AS r, unnest(range(len(regions))) AS ri FROM metadata"
_L = f"SELECT row_id, file_name, ri, unnest(r.lines) AS l, unnest(range(len(r.lines))) AS li FROM ({_R}) WHERE r IS NOT NULL"
_W = f"SELECT row_id, file_name, ri, li, unnest(l.words) AS w, unnest(range(len(l.words))) AS wi FROM ({_L}) WHERE l IS NOT NULL"
_A = f"SELECT row_id, file_name, ri, li, wi, unnest(w.alternatives) AS a, unnest(range(len(w.alternatives))) AS ai FROM ({_W}) WHERE w IS NOT NULL"
_ALL = f"""SELECT row_id, ri::INT AS region_idx, -1::INT AS line_idx, -1::INT AS word_idx, -1::INT AS alt_idx FROM ({_R}) WHERE r IS NOT NULL
UNION ALL SELECT row_id, ri::INT, li::INT, -1, -1 FROM ({_L}) WHERE l IS NOT NULL
UNION ALL SELECT row_id, ri::INT, li::INT, wi::INT, -1 FROM ({_W}) WHERE w IS NOT NULL
UNION ALL SELECT row_id, ri::INT, li::INT, wi::INT, ai::INT FROM ({_A}) WHERE a IS NOT NULL"""
# labels from the order of the node paths: a parent (-1 below its level) sorts before what it holds
_LABELS = f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY row_id ORDER BY region_idx, line_idx, word_idx, alt_idx))::INT AS node_pre FROM ({_ALL})),
c AS (SELECT row_id, region_idx, line_idx, word_idx, alt_idx, node_pre,
  CASE WHEN line_idx < 0 THEN count(*) OVER (PARTITION BY row_id, region_idx)
       WHEN word_idx < 0 THEN count(*) OVER (PARTITION BY row_id, region_idx, line_idx)
       WHEN alt_idx < 0 THEN count(*) OVER (PARTITION BY row_id, region_idx, line_idx, word_idx) ELSE 1 END AS held,
  CASE WHEN line_idx < 0 THEN 1 WHEN word_idx < 0 THEN 2 WHEN alt_idx < 0 THEN 3 ELSE 4 END AS lvl FROM n),
t AS (SELECT row_id, region_idx, line_idx, word_idx, alt_idx, node_pre, (node_pre + held - 1 - lvl)::INT AS node_post, (node_pre + held - 1)::INT AS node_last, lvl FROM c)"""
_BOX = "array_to_string(list_transform({0}, lambda x: coalesce(x::VARCHAR, 'null')), ',')"

SQL = {
    "p2_found": P2_FOUND,
    "p2_loaded": P2_LOADED,
    "p2_files": P2_FILES,
    "p3_found": _ALL,
    "p3_regions": f"""{_LABELS} SELECT t.row_id, s.file_name, node_pre, node_post, node_last, region_idx, {_BOX.format("r.bbox")} AS bbox, r.type AS "type", r.language AS language, r.legibility AS legibility, r.text AS "text"
FROM t JOIN ({_R}) s ON t.row_id = s.row_id AND t.region_idx = s.ri WHERE lvl = 1""",
    "p3_lines": f"""{_LABELS} SELECT t.row_id, s.file_name, node_pre, node_post, node_last, region_idx, line_idx, l.line_no AS line_no, {_BOX.format("l.bbox")} AS bbox, l.text AS "text"
FROM t JOIN ({_L}) s ON t.row_id = s.row_id AND t.region_idx = s.ri AND t.line_idx = s.li WHERE lvl = 2""",
    "p3_words": f"""{_LABELS} SELECT t.row_id, s.file_name, node_pre, node_post, node_last, region_idx, line_idx, word_idx, w.text AS "text", w.confidence AS confidence
FROM t JOIN ({_W}) s ON t.row_id = s.row_id AND t.region_idx = s.ri AND t.line_idx = s.li AND t.word_idx = s.wi WHERE lvl = 3""",
    "p3_alternatives": f"""{_LABELS} SELECT t.row_id, s.file_name, node_pre, node_post, node_last, region_idx, line_idx, word_idx, alt_idx, a.text AS "text", a.score AS score
FROM t JOIN ({_A}) s ON t.row_id = s.row_id AND t.region_idx = s.ri AND t.line_idx = s.li AND t.word_idx = s.wi AND t.alt_idx = s.ai WHERE lvl = 4""",
    "p3_links": f"""{_LABELS} SELECT c.row_id, p.node_pre AS parent_pre, c.node_pre, c.lvl::INT AS node_level FROM t c JOIN t p ON c.row_id = p.row_id AND c.region_idx = p.region_idx AND p.lvl = c.lvl - 1
WHERE (p.lvl < 2 OR p.line_idx = c.line_idx) AND (p.lvl < 3 OR p.word_idx = c.word_idx)""",
}
