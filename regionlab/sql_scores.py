"""DuckDB SQL of normalized texts, error rates and scores.

Patterns of LaTeX commands are compiled from the same table as the engine's (``functions.normalize``) for another pattern language;
matching, reading order, page texts, distances and averages are written out here on their own.
"""

from __future__ import annotations

import re

from regionlab.functions import normalize as n
from regionlab.sql_reference import _BOTH, _GT, _LONG, _MATCHES, _PRED, _normalize, _strip

_SCORABLE = "{0}type NOT IN ('image', 'graph') AND {0}language <> 'other' AND {0}legibility <> 'illegible'"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The pattern without what this engine lacks: escapes of code points by four digits."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


def _step(x: str, pattern: str, leaves: str) -> str:
    """One replacement. There is no look-ahead: what may not follow is taken in and put back, twice for neighbours that share it."""
    leaves = leaves.replace("$", "\\")
    if m := re.fullmatch(r"(.*)\(\?!\[(.*)\]\)", pattern, re.S):
        body, groups = m[1], re.compile(m[1]).groups
        for _ in range(2):
            x = f"regexp_replace({x}, {_quoted(_re2(f'{body}([^{m[2]}]|$)'))}, {_quoted(f'{leaves}' + chr(92) + str(groups + 1))}, 'g')"
        return x
    return f"regexp_replace({x}, {_quoted(_re2(pattern))}, {_quoted(leaves)}, 'g')"


def _rewritten(x: str, pattern: str, f: str) -> str:
    """``f``, an expression of ``m``, in place of every match."""
    p = _quoted(_re2(pattern))
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {p}), list_transform(regexp_extract_all({x}, {p}), lambda m: {f})), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"


def _parts(sep: str) -> str:
    return f"array_to_string(list_transform(string_split(m[2:-2], '{sep}'), lambda s: {_strip('s')}), chr(10))"


DEPTH = 6  # rounds for what nests, more than any text holds


def normalized(rows: str) -> str:
    """(the columns of ``rows``, ``norm``) for ``rows`` with ``text`` and ``type``."""
    q = f"(SELECT *, coalesce(text, '') AS t, coalesce(type, '') AS k FROM {rows})"

    def then(expr: str, only: str | None = None) -> None:
        nonlocal q
        q = f"(SELECT * REPLACE ({f'CASE WHEN {only} THEN {expr} ELSE t END' if only else expr} AS t) FROM {q})"

    latex = "k IN ('formula', 'table') AND t <> ''"
    then(_step(_step("t", r"~~[^\n]*?~~\{([^\n]*?)\}", "$1"), r"~~([^\n]*?)~~", "$1"))
    for how, rules in n.LATEX:
        steps = [r.step if isinstance(r, n.Command) else r for r in rules]
        for _ in range(DEPTH if how == n.SETTLED else 1):
            x = "t"
            for s in steps:
                x = _step(x, *s)
            then(x, latex)
    # no symbol but the backslash itself can make a new command, so it comes last
    symbols = sorted(n.SYMBOLS.items(), key=lambda kv: (kv[1] == "\\", -len(kv[0])))
    x = "t"
    for k, v in symbols:
        x = f"replace({x}, {_quoted(k)}, {_quoted(v)})"
    then(x, latex)
    x = _step(_step("t", rf"√{n.SPACE}*\{{([^{{}}]*)\}}", "√$1"), r"[\u0300-\u036f\u20d0-\u20ff]+", "")
    x = _step(_step(x, f"([{n.RAISED}])", "^$1"), f"([{n.LOWERED}])", "_$1")
    x = f"translate({x}, '{n.RAISED}{n.LOWERED}{n.TIMES}', '{n.RAISED_PLAIN}{n.LOWERED_PLAIN}{'·' * len(n.TIMES)}')"
    then(_step(x, r"([_^])\{([^}]+)\}", "$1$2"), latex)
    then(_rewritten("t", r"\([^();]+(?:;[^();]+)+\)", _parts(";")), latex)
    then(_rewritten("t", r"\([^()]*\\n[^()]*\)", _parts("\\n")), latex)
    cell = rf"\|{n.SPACE}*[^|\n]+?{n.SPACE}*\|"
    inner = _quoted(_re2(rf"\|{n.SPACE}*([^|\n]+?){n.SPACE}*\|"))
    then(_rewritten("t", rf"{cell}(?:{n.SPACE}*{cell})+", f"array_to_string(regexp_extract_all(m, {inner}, 1), chr(10))"), latex)
    then(_normalize("t"))
    bars = _step("t", rf"{n.SPACE}*\|{n.SPACE}*", "|")
    lines = f"list_filter(list_transform(string_split({bars}, chr(10)), lambda s: {_strip("trim(s, '|')")}), lambda s: s <> '')"
    then(_strip(f"array_to_string({lines}, chr(10))"), "k = 'table'")
    return f"(SELECT * EXCLUDE (t, k), t AS norm FROM {q})"


def distance(a: str, b: str) -> str:
    """Edits of code points. The built-in distance counts bytes, so both texts are coded with a byte for each of their common characters, and one for all others on either side."""
    chars = lambda x: f"regexp_extract_all({x}, '(?s).')"
    both = f"list_sort(list_intersect(list_distinct({chars(a)}), list_distinct({chars(b)})))"
    coded = lambda x, other: f"array_to_string(list_transform({chars(x)}, lambda c: CASE WHEN list_contains(z, c) THEN chr((list_position(z, c) + 2)::INT) ELSE chr({other}) END), '')"
    return f"list_transform([{both}], lambda z: levenshtein({coded(a, 1)}, {coded(b, 2)}))[1]"


def _regions(rows: str, column: str, number: str) -> str:
    d = {"type": "handwritten", "language": "uk", "legibility": "legible", "text": ""}
    members = ", ".join(f"coalesce({column}[{number} + 1].{k}, '{v}') AS {k}" for k, v in d.items())
    return f"(SELECT row_id, {number}, {column}[{number} + 1].bbox AS bbox, {members} FROM (SELECT row_id, {column}, unnest(range(len({column}))) AS {number} FROM {rows}))"


_ALL = f"(SELECT row_id, g.image, gt, coalesce(pred, []) AS pred FROM {_GT} g LEFT JOIN {_PRED} p ON g.image = p.image)"
_M = f"(SELECT row_id, x.gi AS gi, x.pi AS pi FROM (SELECT row_id, unnest(m) AS x FROM {_MATCHES}))"
_ORDER = "floor((bbox[2] + bbox[4]) / 2.0 / 15), (bbox[1] + bbox[3]) / 2.0"

_PARTS = f"""WITH s AS MATERIALIZED {_ALL}, m AS MATERIALIZED {_M},
g AS MATERIALIZED {normalized(_regions("s", "gt", "gi"))}, p AS MATERIALIZED {normalized(_regions("s", "pred", "pi"))},
x AS MATERIALIZED {normalized("(SELECT m.row_id, m.gi, p.text AS text, g.type AS type, g.norm AS own, g.type = p.type AS same, " + _SCORABLE.format("g.") + " AS counts FROM m JOIN g ON m.row_id = g.row_id AND m.gi = g.gi JOIN p ON m.row_id = p.row_id AND m.pi = p.pi)")},
c AS (SELECT row_id, gi, same, counts, {distance("norm", "own")} AS edits, length(own) AS long FROM x)"""

_PER_PAGE = f"""{_PARTS},
gp AS (SELECT row_id, string_agg(norm, chr(10) ORDER BY {_ORDER}, gi) AS page FROM g WHERE {_SCORABLE.format("")} GROUP BY 1),
lost AS (SELECT m.row_id, m.pi FROM m JOIN x ON m.row_id = x.row_id AND m.gi = x.gi WHERE NOT x.counts),
pp AS (SELECT row_id, string_agg(norm, chr(10) ORDER BY {_ORDER}, pi) AS page FROM p WHERE {_SCORABLE.format("")} AND NOT EXISTS (FROM lost WHERE lost.row_id = p.row_id AND lost.pi = p.pi) GROUP BY 1),
k AS (SELECT row_id, count(*) AS tp, count(*) FILTER (same) AS class_correct, count(*) FILTER (counts) AS cer_n, sum(edits / greatest(long, 1)::DOUBLE) FILTER (counts) AS cer_sum FROM c GROUP BY 1),
pages AS (SELECT s.row_id, s.image, coalesce(tp, 0)::INT AS tp, (len(pred) - coalesce(tp, 0))::INT AS fp, (len(gt) - coalesce(tp, 0))::INT AS fn, coalesce(class_correct, 0)::INT AS class_correct,
  coalesce(cer_n, 0)::INT AS cer_n, coalesce(cer_sum, 0.0) AS cer_sum, CASE WHEN length(gp.page) > 0 THEN {distance("coalesce(pp.page, '')", "gp.page")} / length(gp.page)::DOUBLE END AS page_cer
  FROM s LEFT JOIN k ON s.row_id = k.row_id LEFT JOIN gp ON s.row_id = gp.row_id LEFT JOIN pp ON s.row_id = pp.row_id)"""

_FORMULAS = f"(SELECT row_id, idx, rtext AS text, rtype AS type FROM {_LONG} WHERE rtype IN ('formula', 'table'))"
_F1 = "2 * prec * rec / greatest(prec + rec, 1e-9)"

SCORES = {
    "region_cer": f"{_PARTS.replace(_ALL, _BOTH)} SELECT row_id, gi::INT AS gi, edits::INT AS edits, long::INT AS length FROM c WHERE counts",
    "score_per_page": f"{_PER_PAGE} SELECT row_id, image, tp, fp, fn, class_correct, cer_n, round(cer_sum, 6) AS cer_sum, round(page_cer, 6) AS page_cer FROM pages",
    "score_report": f"""{_PER_PAGE},
a AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS pages, sum(class_correct) / greatest(sum(tp), 1)::DOUBLE AS class_acc,
  CASE WHEN sum(cer_n) > 0 THEN sum(cer_sum) / sum(cer_n) ELSE 1.0::DOUBLE END AS rc, coalesce(avg(page_cer), 1.0::DOUBLE) AS pc,
  sum(tp) / greatest(sum(tp) + sum(fp), 1)::DOUBLE AS prec, sum(tp) / greatest(sum(tp) + sum(fn), 1)::DOUBLE AS rec FROM pages)
SELECT round(0.15::DOUBLE * {_F1} + 0.05::DOUBLE * class_acc + 0.3::DOUBLE * greatest(0, 1 - rc) + 0.5::DOUBLE * greatest(0, 1 - pc), 6) AS score, round({_F1}, 6) AS det_f1, round(prec, 6) AS det_precision,
round(rec, 6) AS det_recall, round(class_acc, 6) AS class_acc, round(rc, 6) AS region_cer, round(pc, 6) AS page_cer, tp, fp, fn, pages FROM a""",
    "normalize_formulas": f"SELECT row_id, idx, norm AS normalized FROM {normalized(_FORMULAS)}",
}
