"""DuckDB SQL of the engine's own queries, over whole tables."""

from __future__ import annotations

_LONG = """(SELECT row_id, file_name, source, split, image_width, image_height, ri::INT AS idx, r.bbox AS bbox, r.type AS rtype, r.language AS language, r.legibility AS legibility, r.text AS rtext
FROM (SELECT row_id, file_name, source, split, image_width, image_height, unnest(regions) AS r, unnest(range(len(regions))) AS ri FROM metadata) WHERE r IS NOT NULL)"""
_OK_BOX = "bbox IS NOT NULL AND len(bbox) = 4 AND len(list_filter(bbox, lambda v: v IS NULL)) = 0"
_SCORABLE = "coalesce(rtype, 'handwritten') NOT IN ('image', 'graph') AND coalesce(language, 'uk') <> 'other' AND coalesce(legibility, 'legible') <> 'illegible'"
_TYPES = ("handwritten", "printed", "formula", "table", "annotation", "image", "graph")
_TYPE_LIST = ", ".join(f"'{t}'" for t in _TYPES)
_NAME = "regexp_extract(file_name, '[^/]*$')"
# an acceptable regions value; the cast is tried only on what is JSON
_ELEMENT_OK = f"""(json_type(e) = 'OBJECT' AND json_type(e, '$.bbox') = 'ARRAY' AND json_array_length(e, '$.bbox') = 4
  AND len(list_filter(json_extract(e, '$.bbox[*]'), lambda v: json_type(v) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT'))) = 0
  AND (NOT json_exists(e, '$.type') OR (json_type(e, '$.type') = 'VARCHAR' AND json_extract_string(e, '$.type') IN ({_TYPE_LIST}))))"""
# this JSON parser lets trailing commas and NaN pass; standard JSON has neither
_BARE = r"""regexp_replace({0}, '"([^"\\]|\\.)*"', '0', 'g')"""
_STRICT = f"""(json_valid({{0}}) AND NOT regexp_matches({_BARE}, '(?i),\\s*[\\]}}]|nan|inf'))"""
_ARRAY = f"CASE WHEN {_STRICT} THEN CASE WHEN json_type({{0}}) = 'ARRAY' THEN json_extract({{0}}, '$[*]') END END"
_REGIONS_OK = f"""coalesce(({{0}} IS NULL OR {{0}} = '' OR len(list_filter({_ARRAY}, lambda e: NOT coalesce({_ELEMENT_OK}, false))) = 0), false)"""
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[.]jpg"


def _regions_ok(c: str) -> str:
    return _REGIONS_OK.replace("{0}", c)


def _image_ok(c: str) -> str:
    return f"coalesce(regexp_full_match({c}, '{_UUID}'), false)"


_FIELD = r"""("([^"]|"")*"|[^",\r\n]*)"""
_FIELDS = f"""WITH r AS (SELECT line_id, line, coalesce(regexp_full_match(line, '{_FIELD}(,{_FIELD})*(\\r\\n|\\n|\\r)?'), false) AS good FROM submission_raw),
f AS (SELECT line_id, line, good, CASE WHEN good THEN length(bare) - length(replace(bare, ',', '')) + 1 END AS n FROM (SELECT *, regexp_replace(line, '"([^"]|"")*"', '', 'g') AS bare FROM r)),
s AS (SELECT line_id, good, n, line, regexp_extract(line, '^{_FIELD}', 1) AS a FROM f),
t AS (SELECT line_id, line, good, n, CASE WHEN a LIKE '"%' THEN replace(a[2:-2], '""', '"') ELSE a END AS image, line[length(a) + 2:] AS b FROM s),
u AS (SELECT line_id, line, good, n, image, CASE WHEN b LIKE '"%' THEN replace(regexp_extract(b, '(?s)^"(.*)"', 1), '""', '"') ELSE b END AS regions FROM t)"""
P2_FOUND = f"""{_FIELDS}
SELECT 'submission_raw' AS src_table, line_id AS rec_id, CASE WHEN line IS NULL THEN 'column_count' WHEN NOT good THEN 'quoting' WHEN n <> 2 THEN 'column_count' ELSE 'invalid_value' END AS reason
FROM u WHERE line IS NULL OR NOT good OR n <> 2 OR NOT ({_image_ok("image")} AND {_regions_ok("regions")})
UNION ALL SELECT 'sample_submission', row_id, 'invalid_value' FROM sample_submission WHERE NOT ({_image_ok("image")} AND {_regions_ok("regions")})"""

_TYPED = """'[{"bbox":["DOUBLE"],"type":"VARCHAR","language":"VARCHAR","legibility":"VARCHAR","text":"VARCHAR"}]'"""
# the fit records of both tables, and their regions
_FIT_RAW = f"SELECT 'submission_raw' AS src_table, line_id AS rec_id, image, trim(regions, chr(13) || chr(10)) AS regions FROM u WHERE coalesce(good AND n = 2, false) AND {_image_ok('image')} AND {_regions_ok('regions')}"
_FIT = f"""{_FIT_RAW} UNION ALL SELECT 'sample_submission', row_id, image, regions FROM sample_submission WHERE {_image_ok('image')} AND {_regions_ok('regions')}"""
_LISTED = f"CASE WHEN regions IS NULL OR regions = '' THEN [] ELSE from_json(regions, {_TYPED}) END"
P2_LOADED = f"""{_FIELDS}, v AS (SELECT src_table, rec_id, image, {_LISTED} AS rs FROM ({_FIT})),
x AS (SELECT src_table, rec_id, image, i::INT AS region_idx, rs[i + 1] AS r FROM (SELECT *, unnest(range(len(rs))) AS i FROM v) UNION ALL SELECT src_table, rec_id, image, NULL, NULL FROM v WHERE len(rs) = 0)
SELECT src_table, rec_id, image, region_idx, r.bbox[1] AS x1, r.bbox[2] AS y1, r.bbox[3] AS x2, r.bbox[4] AS y2, r.type AS "type", r.text AS "text" FROM x"""
P2_FILES = f"""{_FIELDS} SELECT image, len({_LISTED})::INT AS regions, count(*) AS records FROM ({_FIT_RAW}) GROUP BY 1, 2"""
_PRED = f"""(SELECT image, CASE WHEN regions IS NULL OR regions = '' THEN [] ELSE from_json(regions, {_TYPED}) END AS pred
FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY row_id DESC) AS k FROM sample_submission WHERE {_image_ok("image")} AND {_regions_ok("regions")}) WHERE k = 1)"""
_GT = f"""(SELECT row_id, {_NAME} AS image, list_filter(list_filter(coalesce(regions, []), lambda r: r IS NOT NULL), lambda r: {_OK_BOX.replace("bbox", "r.bbox")}) AS gt
FROM metadata WHERE split IN ('val', 'test') AND file_name IS NOT NULL)"""
_AREA = "(greatest(0.0, {0}[3] - {0}[1]) * greatest(0.0, {0}[4] - {0}[2]))"


def _iou(a: str, b: str) -> str:
    inner = f"((least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]))::DOUBLE * (least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])))"
    over = f"(least({a}[3], {b}[3]) > greatest({a}[1], {b}[1]) AND least({a}[4], {b}[4]) > greatest({a}[2], {b}[2]))"
    return f"(CASE WHEN {over} THEN {inner} / ({_AREA.format(a)} + {_AREA.format(b)} - {inner}) ELSE 0.0 END)"


_BOTH = f"(SELECT row_id, g.image, gt, pred FROM {_GT} g JOIN {_PRED} p ON g.image = p.image)"
_PAIRS = f"""(SELECT row_id, gi, pi, {_iou("gb", "pb")} AS iou FROM
(SELECT row_id, gi, gb, pred[pi + 1].bbox AS pb, pi FROM (SELECT row_id, gi, gt[gi + 1].bbox AS gb, pred, unnest(range(len(pred))) AS pi FROM (SELECT *, unnest(range(len(gt))) AS gi FROM {_BOTH}))))"""
_MATCHES_FROM = f"""(SELECT row_id, list_reduce(list_transform(list_sort(list({{'c': -iou, 'gi': gi, 'pi': pi}})), lambda x: [x]),
  lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.gi = x[1].gi OR k.pi = x[1].pi)) > 0 THEN a ELSE list_concat(a, x) END) AS m
FROM {_PAIRS} WHERE iou >= @ GROUP BY row_id)"""
_MATCHES = _MATCHES_FROM.replace("@", "0.5")

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = f"regexp_replace({{0}}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{0}", x)


def _normalize(x: str) -> str:
    steps = [
        (r"~~.*?~~\{(.*?)\}", r"\1"), (r"~~(.*?)~~", r"\1"), None, (r"[\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]", "-"), (r"[_\-]{3,}", "___"),
        (r'["\x{201C}\x{201D}\x{201E}\x{00AB}\x{00BB}\x{2033}]', '"'), (r"[''\x{2018}\x{2019}\x{02BC}\x{2032}]", "''"), (r"[ \t\x{00A0}\x{2000}-\x{200B}\x{3000}]+", " "),
        (rf"\([{_SPACE}]+", "("), (rf"[{_SPACE}]+\)", ")"), (r" +\(", "("), (r" +([_^])", r"\1"),
    ]
    x = f"coalesce({x}, '')"
    for s in steps:
        x = f"translate({x}, 'aceiopxyABCEHKMOPTX', 'асеіорхуАВСЕНКМОРТХ')" if s is None else f"regexp_replace({x}, '{s[0]}', '{s[1]}', 'g')"
    return _strip(x)


def _crosstab() -> str:
    return ", ".join(f"count(*) FILTER (rtype = '{t}') AS \"{t}\"" for t in _TYPES)


def _box(prefix: str = "bbox") -> str:
    return ", ".join(f"{prefix}[{k}] AS {n}" for k, n in enumerate(("x1", "y1", "x2", "y2"), 1))


def _cast_box(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"({x1})::INT AS x1, ({y1})::INT AS y1, ({x2})::INT AS x2, ({y2})::INT AS y2"


_CHARS = f"(SELECT source, split, unnest(regexp_extract_all(rtext, '(?s).')) AS ch FROM {_LONG} WHERE rtext IS NOT NULL)"
_CLASS = "CASE WHEN regexp_full_match(ch, '[А-ЯҐЄІЇа-яґєії]') THEN 'cyrillic' WHEN regexp_full_match(ch, '[A-Za-z]') THEN 'latin' WHEN regexp_full_match(ch, '[\\p{Nd}²³¹⁰-⁹₀-₉]') THEN 'digit' ELSE 'other' END"
_TEXTS = "rtext IS NOT NULL AND rtext <> ''"
# silver: longest run of a character by gaps and islands, unknown characters by an anti join with the training vocabulary
_SILVER = f"""(WITH s AS (SELECT row_id, idx, rtext FROM {_LONG} WHERE split = 'silver'),
c AS (SELECT row_id, idx, i, cs[i] AS ch FROM (SELECT row_id, idx, regexp_extract_all(rtext, '(?s).') AS cs, unnest(range(1, len(rtext) + 1)) AS i FROM s WHERE rtext <> '')),
v AS (SELECT DISTINCT ch FROM {_CHARS} WHERE split = 'train'),
runs AS (SELECT row_id, idx, max(n) AS longest FROM (SELECT row_id, idx, ch, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, idx, ch ORDER BY i) AS g FROM c WHERE ch <> chr(10)) GROUP BY row_id, idx, ch, g) GROUP BY 1, 2),
oov AS (SELECT row_id, idx, count(*) AS n FROM c WHERE ch NOT IN (SELECT ch FROM v) GROUP BY 1, 2)
SELECT s.row_id, s.idx, s.rtext, coalesce(s.rtext <> '' AND length(s.rtext) <= 260 AND coalesce(r.longest, 0) < 10 AND coalesce(o.n, 0) <= 2, false) AS kept
FROM s LEFT JOIN runs r ON s.row_id = r.row_id AND s.idx = r.idx LEFT JOIN oov o ON s.row_id = o.row_id AND s.idx = o.idx)"""


def _stats(kept_rows: str, split: str) -> str:
    return f"""WITH k AS (SELECT row_id, count(*) AS n, count(*) FILTER (kept) AS k FROM {kept_rows} GROUP BY row_id),
p AS (SELECT m.row_id, coalesce(k.n, 0) AS n, coalesce(k.k, 0) AS k FROM metadata m LEFT JOIN k ON m.row_id = k.row_id WHERE m.split = '{split}')
SELECT sum(n)::BIGINT AS input_regions, sum(k)::BIGINT AS kept_regions, (sum(n) - sum(k))::BIGINT AS dropped_regions, count(*) AS input_pages, count(*) FILTER (k > 0) AS kept_pages, count(*) FILTER (k = 0) AS dropped_empty_pages FROM p"""


_IN_VAL = "coalesce(('0x' || substr(sha1(file_name || ':htr-cv-42'), 1, 8))::BIGINT < 429496729, false)"
_SHA_ORDER = "sha1(row_id::VARCHAR || ':42'), row_id"
_EXAMPLE = f"""SELECT DISTINCT coalesce(rtype, 'handwritten') AS t, trim(rtext, ' ') AS x FROM {_LONG} WHERE coalesce(language, 'uk') = 'uk' AND coalesce(legibility, 'legible') <> 'illegible'
AND coalesce(rtype, 'handwritten') NOT IN ('image', 'graph')"""
_CYR2 = "length(regexp_replace(x, '[^А-ЯҐЄІЇа-яґєії]', '', 'g')) >= 2"
_RES = "(SELECT result_id, ri::INT AS idx, r.type AS rtype, r.bbox AS bbox, r.transcription AS tr FROM (SELECT result_id, unnest(regions) AS r, unnest(range(len(regions))) AS ri FROM page_results) WHERE r IS NOT NULL)"
_WIDE = r"regexp_extract(regions, '(?s)[\[\{].*[\]\}]')"
_ANSWER = f"CASE WHEN regions IS NULL OR regions = '' OR regions LIKE '[ERROR:%' THEN NULL WHEN {_STRICT.replace("{0}", "regions")} THEN regions WHEN {_STRICT.replace("{0}", _WIDE)} THEN {_WIDE} END"
_ITEMS = f"""(SELECT row_id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN coalesce(json_extract(j, '$.blocks[*]'), []) || CASE WHEN json_exists(j, '$.blocks') THEN [] ELSE coalesce(json_extract(j, '$.regions[*]'), []) END ELSE [] END AS items
FROM (SELECT row_id, {_ANSWER} AS j FROM sample_submission))"""
_CROP = f"""(SELECT row_id, file_name, idx, {_strip("coalesce(rtext, '')")} AS txt, image_width AS w, image_height AS h,
 greatest(0, bbox[1] - trunc((bbox[3] - bbox[1]) * 0.05::DOUBLE)::INT) AS x1, greatest(0, bbox[2] - trunc((bbox[4] - bbox[2]) * 0.05::DOUBLE)::INT) AS y1,
 least(image_width, bbox[3] + trunc((bbox[3] - bbox[1]) * 0.05::DOUBLE)::INT) AS x2, least(image_height, bbox[4] + trunc((bbox[4] - bbox[2]) * 0.05::DOUBLE)::INT) AS y2, rtype, language, legibility
FROM {_LONG} WHERE {_OK_BOX})"""
_SAMPLE = f"""(SELECT *, x2 - x1 AS cw, y2 - y1 AS ch, regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1') || '_' || lpad(idx::VARCHAR, 3, '0') || '.jpg' AS crop_name FROM {_CROP}
WHERE file_name IS NOT NULL AND txt <> '' AND coalesce(legibility, '') <> 'illegible' AND coalesce(language, 'uk') <> 'other' AND coalesce(rtype, '') NOT IN ('image', 'graph') AND x2 - x1 >= 16 AND y2 - y1 >= 16)"""


def _thousandth(v: str, side: str) -> str:
    return f"greatest(0, least(1000, trunc({v} * 1000.0::DOUBLE / greatest(1, coalesce({side}, 1)))))"


_NORM_BOX = _cast_box(*[_thousandth(f"bbox[{k}]", s) for k, s in ((1, "image_width"), (2, "image_height"), (3, "image_width"), (4, "image_height"))])


def _kept_boxes(threshold: float) -> str:
    """Non-maximum suppression: a fold over the regions of a page and type by falling area."""
    return f"""(SELECT row_id, unnest(list_transform(list_reduce(list_transform(list_sort(list({{'a': -area, 'i': i, 'b': b}})), lambda x: [x]),
  lambda k, x: CASE WHEN len(list_filter(k, lambda y: {_iou("y.b", "x[1].b")} >= {threshold})) > 0 THEN k ELSE list_concat(k, x) END), lambda z: z.i)) AS idx
FROM (SELECT row_id, source, rtype, (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::INT AS i, bbox AS b, {_AREA.format("bbox")}::DOUBLE AS area, ({_OK_BOX} AND rtype IS NOT NULL) AS counts FROM {_LONG}) WHERE counts GROUP BY row_id, rtype
UNION ALL SELECT row_id, i FROM (SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::INT AS i, coalesce({_OK_BOX} AND rtype IS NOT NULL, false) AS counts FROM {_LONG}) WHERE NOT counts)"""


def _golden(rows: list[tuple[str, str]], names: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names})"


def reference_sql(goldens: list[tuple[str, str, str]], aliases: list[tuple[str, str]]) -> dict[str, str]:
    return {
        "region_matches": f"SELECT row_id, x.gi::INT AS gi, x.pi::INT AS pi, round(-x.c, 6) AS iou FROM (SELECT row_id, unnest(m) AS x FROM {_MATCHES})",
        "match_candidates": f"SELECT row_id, gi::INT AS gi, pi::INT AS pi, round(iou, 6) AS iou FROM {_PAIRS} WHERE iou >= 0.5",
        "match_confusion": f"""SELECT coalesce(gt[x.gi + 1].type, 'handwritten') AS gt_type, coalesce(pred[x.pi + 1].type, 'handwritten') AS pred_type, count(*) AS n
FROM (SELECT row_id, unnest(m) AS x FROM {_MATCHES}) m JOIN {_BOTH} b ON m.row_id = b.row_id GROUP BY 1, 2""",
        "detection_counts": f"""SELECT sum(coalesce(len(m), 0))::BIGINT AS tp, sum(len(pred) - coalesce(len(m), 0))::BIGINT AS fp, sum(len(gt) - coalesce(len(m), 0))::BIGINT AS fn FROM {_BOTH} b LEFT JOIN {_MATCHES} m ON b.row_id = m.row_id""",
        "page_text_reading_order": f"""SELECT m.row_id, coalesce(t.page_text, '') AS page_text FROM metadata m LEFT JOIN (SELECT row_id, string_agg(coalesce(rtext, ''), chr(10) ORDER BY floor((bbox[2] + bbox[4]) / 2.0 / 15), (bbox[1] + bbox[3]) / 2.0, idx) AS page_text
FROM {_LONG} WHERE {_OK_BOX} AND {_SCORABLE} GROUP BY row_id) t ON m.row_id = t.row_id""",
        "nms_kept": f"SELECT row_id, idx::INT AS idx FROM {_kept_boxes(0.5)}",
        "nms_counts": f"""SELECT m.source, sum(b.n)::BIGINT AS before, sum(a.n)::BIGINT AS after FROM (SELECT row_id, source FROM metadata WHERE regions IS NOT NULL) m
LEFT JOIN (SELECT row_id, count(*) AS n FROM {_LONG} GROUP BY 1) b ON m.row_id = b.row_id LEFT JOIN (SELECT row_id, count(*) AS n FROM {_kept_boxes(0.5)} GROUP BY 1) a ON m.row_id = a.row_id GROUP BY 1""",
        "scorable_by_source": f"""SELECT source, count(*) AS regions, count(*) FILTER ({_SCORABLE}) AS scorable, CASE WHEN count(*) FILTER ({_SCORABLE}) > 0 THEN round_even(count(*) FILTER ({_SCORABLE}) * 100.0::DOUBLE / count(*), 1) END AS percent FROM {_LONG} GROUP BY 1""",
        "type_crosstab": f"SELECT source, {_crosstab()} FROM {_LONG} GROUP BY 1",
        "source_summary": "SELECT coalesce(source, '_') AS source, count(*) AS n FROM metadata GROUP BY 1",
        "source_profile": """SELECT source, count(*) AS pages, sum(n)::BIGINT AS regions, round_even(avg(n), 2) AS mean_num_regions, round_even(avg(image_width), 2) AS mean_image_width, round_even(avg(image_height), 2) AS mean_image_height,
round_even(avg(CASE WHEN image_height <> 0 THEN image_width::DOUBLE / image_height END), 2) AS mean_aspect_ratio, round_even(avg(image_width::DOUBLE * image_height / 1e6), 2) AS mean_megapixels
FROM (SELECT *, coalesce(len(regions), 0) AS n FROM metadata) GROUP BY 1""",
        "length_stats": f"SELECT source, round_even(avg(length(rtext)), 1) AS mean, max(length(rtext))::INT AS longest, min(length(rtext))::INT AS shortest FROM {_LONG} WHERE {_TEXTS} GROUP BY 1",
        "length_percentiles": f"""SELECT source, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99
FROM (SELECT source, length(rtext)::DOUBLE AS n FROM {_LONG} WHERE {_TEXTS}) WHERE n < 1000 GROUP BY 1""",
        "region_count_stats": "SELECT min(n)::INT AS least, median(n)::DOUBLE AS median, round(avg(n), 6) AS mean, max(n)::INT AS most FROM (SELECT coalesce(len(regions), 0) AS n FROM metadata)",
        "usable_texts": f"SELECT source, count(*) AS n FROM {_LONG} WHERE language = 'uk' AND legibility = 'legible' AND rtype NOT IN ('image', 'graph') AND {_TEXTS} GROUP BY 1",
        "char_frequency": f"SELECT ch, count(*) AS n FROM {_CHARS} GROUP BY 1",
        "alphabet_counts": f"SELECT {_CLASS} AS alphabet, count(*) AS characters FROM (SELECT DISTINCT ch FROM {_CHARS}) GROUP BY 1",
        "rare_chars": f"SELECT ch, n FROM (SELECT ch, count(*) AS n FROM {_CHARS} WHERE {_CLASS} = 'cyrillic' GROUP BY 1) ORDER BY n, ch LIMIT 20",
        "chars_only_in_source": f"SELECT DISTINCT ch FROM {_CHARS} WHERE source = 'school' AND ch NOT IN (SELECT ch FROM {_CHARS} WHERE source IS DISTINCT FROM 'school')",
        "char_vocab": f"SELECT DISTINCT ch FROM {_CHARS} WHERE split = 'train'",
        "strike_markers": f"SELECT source, count(*) FILTER (contains(rtext, '~~')) AS marked FROM {_LONG} GROUP BY 1",
        "outlier_files": f"SELECT DISTINCT file_name FROM {_LONG} WHERE length(rtext) > 260",
        "clean_regions": f"SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::INT AS kept_idx, rtext AS text FROM {_SILVER} WHERE kept",
        "clean_stats": _stats(_SILVER, "silver"),
        "clean_train_stats": _stats(f"(SELECT row_id, coalesce({_TEXTS} AND length(rtext) <= 260, false) AS kept FROM {_LONG} WHERE split = 'train')", "train"),
        "hash_split": f"SELECT row_id, {_IN_VAL} AS in_validation FROM metadata",
        "split_source_summary": f"SELECT coalesce(source, '_') AS source, {_IN_VAL} AS in_validation, count(*) AS n FROM metadata GROUP BY 1, 2",
        "sample_per_source": f"SELECT row_id, source FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY {_SHA_ORDER}) AS k FROM metadata) WHERE k = 1",
        "first_per_source": "SELECT source, row_id, file_name FROM (SELECT source, row_id, file_name, row_number() OVER (PARTITION BY source ORDER BY row_id) AS k FROM metadata) WHERE k = 1",
        "fewshot_topk": f"""SELECT type, rank, text FROM (SELECT t AS type, x AS text, row_number() OVER (PARTITION BY t ORDER BY length(x), x)::INT AS rank FROM ({_EXAMPLE})
WHERE length(x) BETWEEN 8 AND 120 AND NOT contains(x, '~~') AND NOT contains(x, '[') AND (t NOT IN ('handwritten', 'printed') OR {_CYR2})) WHERE rank <= 6""",
        "normalize_plain": f"SELECT row_id, idx, {_normalize('rtext')} AS normalized FROM {_LONG} WHERE coalesce(rtype NOT IN ('formula', 'table'), true)",
        "normalize_goldens": _golden([(g[0], g[2]) for g in goldens], "given, normalized"),
        "bbox_normalized": f"SELECT row_id, idx, {_NORM_BOX} FROM {_LONG} WHERE {_OK_BOX}",
        "bbox_scaled": f"""SELECT * FROM (SELECT row_id, idx, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM (SELECT row_id, idx, trunc(bbox[1]::DOUBLE * image_width / 1000)::INT AS a, trunc(bbox[2]::DOUBLE * image_height / 1000)::INT AS b,
trunc(bbox[3]::DOUBLE * image_width / 1000)::INT AS c, trunc(bbox[4]::DOUBLE * image_height / 1000)::INT AS d FROM {_LONG} WHERE {_OK_BOX})) WHERE x2 - x1 >= 3 AND y2 - y1 >= 3""",
        "bbox_bands": f"""SELECT row_id, idx, k::INT AS band, bbox[1] AS x1, trunc(bbox[2] + k * ((bbox[4] - bbox[2])::DOUBLE / 3))::INT AS y1, bbox[3] AS x2, trunc(bbox[2] + (k + 1) * ((bbox[4] - bbox[2])::DOUBLE / 3))::INT AS y2
FROM (SELECT row_id, idx, bbox, unnest(range(3)) AS k FROM {_LONG} WHERE {_OK_BOX})""",
        "crop_boxes": f"SELECT row_id, idx, x1, y1, x2, y2 FROM {_CROP} WHERE w > 0 AND h > 0",
        "fitted_sizes": """SELECT row_id, CASE WHEN px > 1000000 THEN trunc(image_width * sqrt(1000000.0::DOUBLE / px))::INT ELSE image_width END AS w, CASE WHEN px > 1000000 THEN trunc(image_height * sqrt(1000000.0::DOUBLE / px))::INT ELSE image_height END AS h
FROM (SELECT *, image_width::DOUBLE * image_height AS px FROM metadata WHERE image_width > 0 AND image_height > 0)""",
        "payload_items": f"SELECT row_id, coalesce(len(items), 0)::INT AS items FROM {_ITEMS}",
        # the frame of the answers is that of the page: coordinates are only made whole
        "payload_blocks": f"""WITH i AS (SELECT row_id, unnest(items) AS e, unnest(range(len(items))) AS i FROM {_ITEMS}),
l AS (SELECT row_id, i, e, list_transform(CASE WHEN json_type(e, '$.bbox_2d') = 'ARRAY' THEN json_extract_string(e, '$.bbox_2d[*]') ELSE json_extract_string(e, '$.bbox[*]') END, lambda c: try_cast(trunc(try_cast(c AS DOUBLE)) AS INT)) AS v FROM i),
k AS (SELECT row_id, i, e, least(v[1], v[3]) AS x1, v FROM l WHERE len(v) >= 4 AND abs(v[3] - v[1]) >= 3 AND abs(v[4] - v[2]) >= 3)
SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY i) - 1)::INT AS no, coalesce(json_extract_string(e, '$.block_type'), 'text_block') AS block_type, coalesce(json_extract_string(e, '$.writing_type'), 'handwritten') AS writing_type, x1 FROM k""",
        "payload_repair": f"""SELECT row_id, length(CASE WHEN s = '' THEN '[]' WHEN {_STRICT.replace("{0}", "s")} THEN s WHEN contains(s, '}}') AND {_STRICT.replace("{0}", "cut")} THEN cut ELSE '[]' END)::INT AS kept
FROM (SELECT *, regexp_extract(s, '(?s)^.*\\}}') || ']' AS cut FROM (SELECT row_id, regexp_extract(coalesce(regions, ''), '(?s)\\[.*\\]') AS s FROM sample_submission))""",
        "type_aliases": _golden(aliases, "given, type"),
        "missing_images": f"SELECT DISTINCT image FROM {_GT} WHERE image NOT IN (SELECT image FROM sample_submission WHERE image IS NOT NULL)",
        "aligned_submission": f"""SELECT image, regions FROM sample_submission WHERE image IN (SELECT image FROM {_GT})
UNION ALL SELECT DISTINCT image, '[]' FROM {_GT} WHERE image NOT IN (SELECT image FROM sample_submission WHERE image IS NOT NULL)""",
        "manifest_join": f"""WITH m AS (SELECT {_NAME} AS name, file_name, source, row_number() OVER (PARTITION BY {_NAME} ORDER BY row_id DESC) AS k FROM metadata WHERE file_name IS NOT NULL),
i AS (SELECT DISTINCT regexp_extract(line, '^"?([0-9a-f-]+\\.jpg)', 1) AS image FROM submission_raw)
SELECT image, coalesce(m.file_name, 'images/' || image) AS file_name, CASE WHEN m.name IS NULL THEN 'unknown' ELSE m.source END AS source, m.name IS NOT NULL AS known FROM i LEFT JOIN m ON i.image = m.name AND m.k = 1 WHERE image <> ''""",
        "pending_pages": f"""SELECT uuid, row_id FROM (SELECT regexp_replace({_NAME}, '\\.[^.]*$', '') AS uuid, row_id FROM metadata WHERE file_name IS NOT NULL) WHERE uuid NOT IN (SELECT uuid FROM page_results WHERE uuid IS NOT NULL)""",
        "union_origins": "SELECT split AS _origin, source, count(*) AS n FROM metadata WHERE split IN ('train', 'silver') GROUP BY 1, 2",
        "submission_export": f"""SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY idx) - 1)::INT AS idx, coalesce(rtype, 'handwritten') AS type, CASE WHEN tr IS NULL OR tr LIKE '[ERROR:%' THEN '' ELSE tr END AS text, {_box()} FROM {_RES}""",
        "submission_json": "SELECT uuid || '.jpg' AS image, sum(len(list_filter(coalesce(regions, []), lambda r: r IS NOT NULL)))::BIGINT AS regions, count(*) AS rows FROM page_results GROUP BY 1",
        "region_order": f"SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY bbox[2], bbox[1], idx) - 1)::INT AS place, {_box()} FROM {_RES} WHERE {_OK_BOX}",
        "first_lines": f"SELECT result_id, idx, {_strip("split_part(CASE WHEN tr IS NULL OR tr LIKE '[ERROR:%' THEN '' ELSE tr END, chr(10), 1)")} AS line FROM {_RES}",
        "chat_transcribe_samples": f"""SELECT row_id, idx, txt AS text, crop_name, x1, y1, x2, y2, CASE WHEN greatest(cw, ch) < 128 THEN trunc(cw * (256.0::DOUBLE / greatest(cw, ch)))::INT ELSE cw END AS out_w,
CASE WHEN greatest(cw, ch) < 128 THEN trunc(ch * (256.0::DOUBLE / greatest(cw, ch)))::INT ELSE ch END AS out_h FROM {_SAMPLE}""",
        "chat_messages": f"SELECT crop_name, crop_name AS image, txt AS text FROM {_SAMPLE}",
        "chat_detect_samples": f"""SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::INT AS no, CASE WHEN coalesce(rtype, 'handwritten') IN ('handwritten', 'printed') THEN 'text_block' ELSE rtype END AS block_type,
CASE WHEN coalesce(rtype, 'handwritten') IN ('handwritten', 'printed') THEN coalesce(rtype, 'handwritten') ELSE 'handwritten' END AS writing_type, {_NORM_BOX} FROM {_LONG} WHERE {_OK_BOX}""",
    }
