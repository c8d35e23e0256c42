"""Loading of CSV records with JSON fields: typed records for fit rows, located errors for unfit ones.

A recursive-descent grammar reads the text::

    file    := record (NEWLINE record)*
    record  := field (',' field)*
    field   := '"' ( char | '""' | ',' | NEWLINE )* '"'  |  [^",\\r\\n]*
    regions := ws '[' ws ( object ( ws ',' ws object )* )? ws ']' ws
    object  := '{' ... '}'                               (standard JSON)

After an error it does not give up: in a file it resumes at the next *record-start anchor* behind the record's start, in a list of
regions at the next object-start anchor. An anchor counts only when the grammar accepts what begins there, so a look-alike inside a
quoted field is passed over. Reasons, the first that holds: ``quoting``, ``column_count``, ``invalid_value``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlab.session import kept, written

# The region types a submission may name.
REGION_TYPES = ("handwritten", "printed", "formula", "table", "annotation", "image", "graph")

REGION = T.StructType([
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("legibility", T.StringType()),
    T.StructField("text", T.StringType()),
])

ISSUE = T.StructType([T.StructField("reason", T.StringType()), T.StructField("field", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("message", T.StringType())])
PARSED = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("error_field", T.StringType()),
    T.StructField("error_at", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("n_errors", T.IntegerType()),
])
TYPED = T.StructType([*PARSED.fields, T.StructField("image", T.StringType()), T.StructField("regions", T.ArrayType(REGION)), T.StructField("errors", T.ArrayType(ISSUE))])

_IMAGE = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.jpg")
_ANCHOR = re.compile(r'(?:\r\n|\n|\r)(?="?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.jpg"?,)')
_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
_BARE = re.compile(r'[^",\r\n]*')
_NEWLINE = re.compile(r"\r\n|\n|\r")
_WS = re.compile(r"[ \t\n\r]*")
_OBJECT_ANCHOR = re.compile(r',[ \t\n\r]*(?=\{[ \t\n\r]*["}])')


class Unfit(Exception):
    def __init__(self, reason: str, field_name: str, at: int, message: str):
        super().__init__(message)
        self.issue = (reason, field_name, at, message)


@dataclass
class Record:
    """One record of a text: its fields, or why it has none; ``start``/``end`` are offsets in the text."""

    start: int
    end: int
    fields: list[str] = field(default_factory=list)
    error: tuple[str, str, int, str] | None = None


def _csv_record(text: str, at: int) -> tuple[list[str], int]:
    """``record`` from ``at``; its fields and the offset behind it (of the line break or of the end)."""
    fields = []
    while True:
        if text.startswith('"', at):
            m = _QUOTED.match(text, at)
            if not m:
                raise Unfit("quoting", f"field {len(fields) + 1}", at, "the quote is never closed")
            fields.append(m[1].replace('""', '"'))
        else:
            m = _BARE.match(text, at)
            fields.append(m[0])
        quoted, at = text.startswith('"', m.start()), m.end()
        if at == len(text) or text[at] in "\r\n":
            return fields, at
        if text[at] != ",":
            raise Unfit("quoting", f"field {len(fields)}", at, "only a comma may follow the closing quote" if quoted else "a quote in an unquoted field")
        at += 1


def parse_records(text: str) -> Iterator[Record]:
    """All records of a text, in order. A broken one ends at the next anchor from which the grammar reads a record."""
    at = 0
    while at < len(text):
        try:
            fields, end = _csv_record(text, at)
            yield Record(at, end, fields)
        except Unfit as e:
            end = len(text)
            for m in _ANCHOR.finditer(text, at):
                try:
                    _csv_record(text, m.end())
                except Unfit:
                    continue
                end = m.start()
                break
            yield Record(at, end, error=e.issue)
        m = _NEWLINE.match(text, end)
        at = m.end() if m else max(end, at + 1)


def _constant(name: str):
    raise ValueError(f"{name} is not standard JSON")


def _number(digits: str):
    return int(digits) if len(digits) < 400 else float(digits)


_scan = json.JSONDecoder(parse_constant=_constant).scan_once
_scan_long = json.JSONDecoder(parse_constant=_constant, parse_int=_number).scan_once


def _value(text: str, at: int) -> tuple[object, int]:
    try:
        return _scan(text, at)
    except StopIteration as e:
        raise Unfit("invalid_value", "regions", e.value if isinstance(e.value, int) else at, "a JSON value is missing") from None
    except json.JSONDecodeError as e:
        raise Unfit("invalid_value", "regions", e.pos, e.msg) from None
    except RecursionError:
        return _deep_value(text, at)
    except ValueError as e:
        if "Exceeds" in str(e):
            return _scan_long(text, at)
        raise Unfit("invalid_value", "regions", at, str(e)) from None


_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?[0-9]|true|false|null')


def _deep_value(text: str, at: int) -> tuple[object, int]:
    """``_value`` of what nests deeper than the parser's stack: the open lists and objects are kept in a list."""
    open_: list[list | dict] = []
    names: list[str | None] = []  # of the member being read in each open object

    def missing(where: int, what: str) -> Unfit:
        return Unfit("invalid_value", "regions", where, what)

    def name_at(i: int) -> tuple[str, int]:
        m = _SCALAR.match(text, i)
        if not m or m[0][0] != '"':
            raise missing(i, "a member's name is missing")
        try:
            name, i = _scan(text, i)
        except ValueError as e:
            raise missing(i, str(e)) from None
        i = _WS.match(text, i).end()
        if not text.startswith(":", i):
            raise missing(i, "a colon is missing")
        return name, _WS.match(text, i + 1).end()

    while True:
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            inside = _WS.match(text, at + 1).end()
            value: object = [] if c == "[" else {}
            if not text.startswith("]" if c == "[" else "}", inside):
                open_.append(value)  # type: ignore[arg-type]
                name, at = (None, inside) if c == "[" else name_at(inside)
                names.append(name)
                continue
            at = inside + 1
        elif _SCALAR.match(text, at):
            try:
                value, at = _scan(text, at)
            except (StopIteration, ValueError) as e:
                raise missing(at, str(e) or "a JSON value is missing") from None
        else:
            raise missing(at, "a JSON value is missing")
        while True:  # a whole value: into what holds it, which may be whole then itself
            if not open_:
                return value, at
            holder = open_[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[names[-1]] = value
            at = _WS.match(text, at).end()
            if text.startswith(",", at):
                at = _WS.match(text, at + 1).end()
                if isinstance(holder, dict):
                    names[-1], at = name_at(at)
                break
            if not text.startswith("]" if isinstance(holder, list) else "}", at):
                raise missing(at, "a comma or an end is missing")
            value, at = open_.pop(), at + 1
            names.pop()


def _json(value: object) -> str:
    """JSON of a member that is no string; of one that nests deeper than the writer's stack only its kind."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return "[...]" if isinstance(value, list) else "{...}"


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _region(value: object, at: int, types: tuple[str, ...] | None = REGION_TYPES) -> dict:
    """The typed region of a JSON object; absent and null members stay null, members of other types than string keep their JSON."""
    if not isinstance(value, dict):
        raise Unfit("invalid_value", "regions", at, "an element is not an object")
    if "bbox" not in value:
        raise Unfit("invalid_value", "regions", at, "bbox is missing")
    box = value["bbox"]
    if not isinstance(box, list) or len(box) != 4 or not all(map(_is_number, box)):
        raise Unfit("invalid_value", "regions", at, "bbox is not a list of four numbers")
    kind = value.get("type")
    if types is not None and "type" in value and not (isinstance(kind, str) and kind in types):
        raise Unfit("invalid_value", "regions", at, f"type is not a known one: {str(kind)[:40]}")
    text = {k: v if v is None or isinstance(v, str) else _json(v) for k in ("language", "legibility", "text") for v in [value.get(k)]}
    return {"bbox": [_double(x) for x in box], "type": kind if kind is None or isinstance(kind, str) else _json(kind)} | text


def _double(x: int | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def parse_regions(text: str | None, types: tuple[str, ...] | None = REGION_TYPES) -> tuple[list[dict], list[tuple[str, str, int, str]]]:
    """(regions, errors) of a ``regions`` value. Null and the empty string are fit and hold no region.

    With errors, the regions are those that could still be read: the list is resumed behind each bad element. ``types``: those that may
    be named; None for solutions, whose types are not checked.
    """
    if not text:
        return [], []
    good: list[dict] = []
    bad: list[tuple[str, str, int, str]] = []
    at = _WS.match(text).end()
    if not text.startswith("[", at):
        return [], [("invalid_value", "regions", at, "not a JSON list")]
    at = _WS.match(text, at + 1).end()
    first = True
    while True:
        if first and text.startswith("]", at):
            break
        first = False
        try:
            value, end = _value(text, at)
            try:
                good.append(_region(value, at, types))
            except Unfit as e:
                bad.append(e.issue)
            end = _WS.match(text, end).end()
            if text.startswith("]", end):
                at = end
                break
            if not text.startswith(",", end):
                raise Unfit("invalid_value", "regions", end, "a comma or the end of the list is missing")
            at = _WS.match(text, end + 1).end()
        except Unfit as e:
            bad.append(e.issue)
            resumed = None
            for m in _OBJECT_ANCHOR.finditer(text, at + 1):
                try:
                    _value(text, m.end())
                except Unfit:
                    continue
                resumed = m.end()
                break
            if resumed is None:
                return good, bad
            at = resumed
    rest = _WS.match(text, at + 1).end()
    if rest != len(text):
        bad.append(("invalid_value", "regions", rest, "text behind the list"))
    return good, bad


def parse_submission(image: str | None, regions: str | None) -> tuple[list[dict], list[tuple[str, str, int, str]]]:
    issues = [] if image is not None and _IMAGE.fullmatch(image) else [("invalid_value", "image", 0, "not a lower-case uuid with .jpg")]
    good, bad = parse_regions(regions)
    return good, issues + bad


def parse_line(line: str | None) -> tuple[str | None, list[dict], list[tuple[str, str, int, str]]]:
    """(image, regions, errors) of one CSV record ``image,regions``. A null line has no field at all: ``column_count``."""
    if line is None:
        return None, [], [("column_count", "record", 0, "no record")]
    records = list(parse_records(line)) or [Record(0, 0, [""])]
    broken = [r.error for r in records if r.error]
    if broken:
        return None, [], broken
    if len(records) > 1:
        return None, [], [("quoting", "record", records[0].end, "a line break outside quotes")]
    fields = records[0].fields
    if len(fields) != 2:
        return None, [], [("column_count", "record", records[0].end, f"{len(fields)} fields instead of 2")]
    good, bad = parse_submission(*fields)
    return fields[0], good, bad


def _udf(parse, typed: bool):
    out = TYPED if typed else PARSED

    @F.pandas_udf(out)
    def parsed(*cols: pd.Series) -> pd.DataFrame:
        rows = []
        for values in zip(*cols, strict=True):
            image, good, bad = parse(*values)
            row = [*(bad[0] if bad else (None,) * 4), len(bad)]
            if typed:
                row += [image, good, [dict(zip(("reason", "field", "at", "message"), b, strict=True)) for b in bad]]
            rows.append(row)
        df = pd.DataFrame(rows, columns=out.fieldNames())
        for c in ("error_at", "n_errors"):
            df[c] = df[c].astype("Int32")
        return df

    # a deterministic function would be called again for every filter on its result that moves below the projection
    return parsed.asNondeterministic()


def parsed_line(line: Column, typed: bool = True) -> Column:
    """Struct (``TYPED``, or ``PARSED`` without the record itself) of a CSV record."""
    return _udf(parse_line, typed)(line)


def parsed_solution(image: Column, regions: Column, typed: bool = True) -> Column:
    """The same for a solution: any type of region and any image name will do."""
    return _udf(lambda i, r: (i, *parse_regions(r, None)), typed)(image, regions)


def parsed_submission(image: Column, regions: Column, typed: bool = True) -> Column:
    """The same for a record whose two fields are already apart."""
    return _udf(lambda i, r: (i, *parse_submission(i, r)), typed)(image, regions)


def load(df: DataFrame, parsed: Column, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(fit rows, unfit rows): ``keep`` with the typed record, and ``keep`` with the first error and all of them.

    Null lines are unfit (``column_count``); null and empty ``regions`` are fit with an empty list. Rows that occur twice are loaded twice.
    Extra columns are dropped unless kept; a kept one that bears the name of a made column comes out as ``kept_<name>``.
    """
    names = kept(keep, {"image", "regions", "reason", "error_field", "error_at", "error_message", "errors", "__p"})
    p = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], parsed.alias("__p"))
    fit = p.where(F.col("__p.reason").isNull()).select(*names.values(), "__p.image", "__p.regions")
    unfit = p.where(F.col("__p.reason").isNotNull()).select(*names.values(), "__p.reason", "__p.error_field", "__p.error_at", "__p.error_message", "__p.errors")
    return fit, unfit


PIECE = "path string, block bigint, piece int, kind string, text string"
ROWS_AT_ONCE = 10_000


def _starts_record(text: str, at: int) -> bool:
    """Whether a validated record start lies at ``at``."""
    if not _ANCHOR.match("\n" + text[at : at + 64]):
        return False
    try:
        _csv_record(text, at)
        return True
    except Unfit:
        return False


def cut_block(text: str, first: bool) -> Iterator[tuple[str, str]]:
    """(kind, text) of the pieces of a block of whole lines: ``head``, what lies before its first validated record start; ``record``;
    ``tail``, a broken last one that may end in the next block. A block without a record start is one piece, ``all``. The first block of a
    file has no head; that of any other may be empty.
    """
    at = 0
    if not first:
        at = 0 if _starts_record(text, 0) else next((m.end() for m in _ANCHOR.finditer(text) if _starts_record(text, m.end())), -1)
        if at < 0:
            yield "all", text
            return
        yield "head", text[:at]
    for r in parse_records(text[at:] if at else text):
        open_ended = r.error is not None and at + r.end == len(text)
        yield "tail" if open_ended else "record", text[at + r.start : at + r.end]


def load_path(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fit, unfit) records of submission files of any size: ``load`` with ``path``, ``block`` (where the record's block begins) and ``piece``.

    Files are read in Spark's blocks of whole lines, each by a task of its own. What a block cannot tell, the lines before its first
    validated record start and a broken record at its end, meets the neighbouring blocks' in a second step: a piece or two a block. A
    line that looks like a record start and reads as one is taken for one there, also inside a quoted field that began a block earlier.
    Empty files give no row; a header ``image,regions`` is no record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces(name: str, block: int, held: list[str]) -> Iterator[pd.DataFrame]:
            rows: list[tuple] = []
            for n, (kind, text) in enumerate(cut_block("\n".join(held) + "\n", block == 0)):
                rows.append((name, block, n, kind, text))
                if len(rows) == ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

        names = ["path", "block", "piece", "kind", "text"]
        at: tuple[str, int] | None = None
        held: list[str] = []
        for pdf in batches:
            # the lines of a block come one after another
            for key, part in pdf.groupby(["file_path", "file_block_start"], sort=False):
                if at is not None and key != at:
                    yield from pieces(*at, held)
                    held = []
                at = key
                held += part["value"].tolist()
        if at is not None:
            yield from pieces(*at, held)

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        done: list[tuple[int, int, str]] = []
        held: list[tuple[int, int, str]] = []  # consecutive pieces of which none was known to end a record
        for r in pdf.sort_values(["block", "piece"]).itertuples():
            held.append((r.block, r.piece, r.text))
            if r.kind == "head":
                done.append((*held[0][:2], "".join(t for _, _, t in held)))
                held = []
        if held:
            done.append((*held[0][:2], "".join(t for _, _, t in held)))
        out = [(b, n, "record", t[x.start : x.end]) for b, n, t in done for x in parse_records(t)]
        return pd.DataFrame([(pdf["path"].iloc[0], *x) for x in out], columns=["path", "block", "piece", "kind", "text"])

    made = lines.mapInPandas(cut, PIECE)
    # read twice, by what is whole and by what is not
    made = written(made)
    whole = made.where("kind = 'record'").unionByName(made.where("kind <> 'record'").groupBy("path").applyInPandas(stitch, PIECE))
    return load(whole.where("text not in ('image,regions', 'image,regions\\r', '')"), parsed_line(F.col("text")), "path", "block", "piece")
