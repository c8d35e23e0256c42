"""DuckDB SQL of the text problems, as far as SQL can say them.

Look-alikes are told here by classes of characters, not by skeletons; words are spelt in Cyrillic if a letter of theirs is Cyrillic only or none is Latin.
"""

from __future__ import annotations

from regionlab.llm.confusables import LOOKALIKES, RARE
from regionlab.sql_reference import _FIELDS, _FIT, _LISTED

_FORMS = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ff01}-\x{ff5e}\x{fb00}-\x{fb06}]"
_CYRILLIC, _OTHER = r"\x{400}-\x{52f}", r"A-Za-z\x{391}-\x{3c9}\x{3f2}\x{3f9}\x{531}-\x{587}"
_GREEK = r"\x{391}-\x{3a9}\x{3bf}\x{3f2}\x{3f9}\x{531}-\x{587}"
_WITHIN = r"[\p{M}\p{N}]*"
# a letter of one alphabet beside one of another in a word
_MIXED = "|".join(f"[{a}]{_WITHIN}[{b}]|[{b}]{_WITHIN}[{a}]" for a, b in ((_CYRILLIC, _OTHER), (_GREEK, "A-Za-z")))
_CASE = "(nfc_normalize({0}) <> {0} OR regexp_matches({0}, '" + _FORMS + "') OR regexp_matches(nfc_normalize({0}), '" + _MIXED + "'))"

P1_FOUND = f"""{_FIELDS} SELECT 'metadata' AS src_table, row_id FROM metadata WHERE {_CASE.replace("{0}", "text")}
UNION ALL SELECT 'sample_submission', rec_id FROM (SELECT rec_id, unnest({_LISTED}) AS r FROM ({_FIT}) WHERE src_table = 'sample_submission') WHERE {_CASE.replace("{0}", "r.text")} GROUP BY rec_id"""

# page texts without what cannot be seen, with the usual space, letters of full width and joined letters spelt out
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", ""), "".join(map(chr, range(0x21, 0x7F))).replace("'", "")
# words with a letter that is Cyrillic only, or without a Latin one, are spelt with Cyrillic letters, others with Latin ones
_FIRM = "БГҐДЄЖЗИЙЇЛПУФЦЧШЩЬЮЯЫЭЪЁбвгґдєжзийїклмнптфцчшщьюяыэъё"
_CYR = [(x, c) for g in LOOKALIKES if (c := next((y for y in g if "Ѐ" <= y <= "ӿ" and y not in RARE), None)) for x in g if x != c]
_LAT = [(x, g[0]) for g in LOOKALIKES if g[0].isascii() for x in g[1:]]
_JOINED = "replace(replace(replace(text, 'ﬃ', 'ffi'), 'ﬀ', 'ff'), 'ﬁ', 'fi')"
_SEEN = r"regexp_replace(regexp_replace({0}, '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g')".replace("{0}", _JOINED)
_PLAIN = f"nfc_normalize(translate({_SEEN}, '{_WIDE[0]}', '{_WIDE[1]}'))"


def _spelt(pairs: list[tuple[str, str]]) -> str:
    return f"translate(x, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"


_WORDS = r"list_transform(regexp_extract_all(regexp_replace({0}, '[\x{300}-\x{36f}]', '', 'g'), '[\p{L}\p{N}]+'), lambda x: lower(CASE WHEN regexp_matches(x, '[{1}]') OR NOT regexp_matches(x, '[A-Za-z]') THEN {2} ELSE {3} END))"
_WORDS = _WORDS.replace("{1}", _FIRM).replace("{2}", _spelt(_CYR)).replace("{3}", _spelt(_LAT))
# runs of three words by their places; a place is repeated if it lies in a run that stands earlier on the page too
_RUNS = f"""t AS MATERIALIZED (SELECT row_id, {_PLAIN} AS t FROM metadata WHERE text IS NOT NULL), w AS MATERIALIZED (SELECT row_id, {_WORDS.replace("{0}", "t")} AS ws FROM t),
g AS MATERIALIZED (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT row_id, i FROM (SELECT *, row_number() OVER (PARTITION BY row_id, k ORDER BY i) AS n FROM g) WHERE n > 1),
held AS (SELECT row_id, count(DISTINCT i + d) AS c FROM (SELECT *, unnest([0, 1, 2]) AS d FROM again) GROUP BY 1)"""
P4_FOUND = f"WITH {_RUNS} SELECT h.row_id FROM held h JOIN w ON h.row_id = w.row_id WHERE c >= 0.4 * len(ws)"


def _again(parts: str) -> str:
    """Words in parts of a page that have the words of an earlier part."""
    each = f"SELECT row_id, i, {_WORDS.replace('{0}', 'p')} AS pw FROM (SELECT row_id, unnest({parts}) AS p, unnest(range(len({parts}))) AS i FROM t)"
    return f"(SELECT row_id, sum(len(pw)) AS c FROM (SELECT *, row_number() OVER (PARTITION BY row_id, pw ORDER BY i) AS n FROM ({each}) WHERE len(pw) > 0) WHERE n > 1 GROUP BY 1)"


_BREAK = r"'[.!?…]+\s+|\n+'"
P4_SHARES = f"""WITH {_RUNS}, top AS (SELECT row_id, max(n) AS n FROM (SELECT row_id, k, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1), l AS {_again("string_split(t, chr(10))")}, s AS {_again(f"string_split_regex(t, {_BREAK})")}
SELECT m.row_id, coalesce(len(ws), 0)::INT AS words, round(coalesce(held.c / len(ws)::DOUBLE, 0), 6) AS repeated_words, round(coalesce(l.c / len(ws)::DOUBLE, 0), 6) AS repeated_lines, round(coalesce(s.c / len(ws)::DOUBLE, 0), 6) AS repeated_sentences,
CASE WHEN top.n > 1 THEN round(least(1.0::DOUBLE, top.n * 3 / len(ws)::DOUBLE), 6) ELSE 0.0::DOUBLE END AS top_run
FROM metadata m LEFT JOIN w ON m.row_id = w.row_id LEFT JOIN held ON m.row_id = held.row_id LEFT JOIN l ON m.row_id = l.row_id LEFT JOIN s ON m.row_id = s.row_id LEFT JOIN top ON m.row_id = top.row_id"""

_IMAGE = r"lower(trim(regexp_replace(regexp_extract(file_name, '[^/\\]*$'), '(.)\.[^.]*$', '\1')))"
P5_IMAGES = f"""WITH i AS (SELECT row_id, split, {_IMAGE} AS k FROM metadata)
SELECT least(a.row_id, b.row_id) AS row_id_a, greatest(a.row_id, b.row_id) AS row_id_b FROM i a JOIN i b ON a.k = b.k WHERE a.split = 'train' AND b.split IN ('val', 'test') AND a.k <> ''"""

_HELD = "text IS NOT NULL AND text <> ''"
P6_KEPT = f"""SELECT limit_name, capacity_tokens::BIGINT AS capacity, (SELECT count(*) FROM documents WHERE {_HELD}) AS documents, (SELECT count(*) FROM documents WHERE {_HELD}) AS wholly_placed,
0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, 0::BIGINT AS gaps FROM pack_limits"""

_SOURCE = r"lower(regexp_replace(source, '^\s+|\s+$', '', 'g'))"
P7_KEPT = f"""WITH t AS (SELECT {_SOURCE} AS source, sum(target_share) AS w, min(max_repeats) AS m FROM mix_targets GROUP BY 1),
d AS (SELECT {_SOURCE} AS source, count(*) AS n FROM documents WHERE {_HELD} GROUP BY 1)
SELECT t.source, round(w / (SELECT sum(w) FROM t), 6) AS target_share, m::DOUBLE AS max_repeats, coalesce(n, 0) AS documents, 0::BIGINT AS over_cap FROM t LEFT JOIN d ON t.source = d.source"""
