"""Reading of model answers that should be JSON, as column expressions on the Variant type.

Nothing here raises: what cannot be read is null, and an empty list where a list is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionlab.functions.geometry import scale
from regionlab.functions.normalize import bind, strip

ALLOWED = ("annotation", "formula", "graph", "handwritten", "image", "printed", "table")
_WIDEST = r"(?s)[\[\{].*[\]\}]"
_WIDEST_LIST = r"(?s)\[.*\]"


def strict_json(raw: Column) -> Column:
    """Variant of a text that is JSON from end to end, else null.

    ``try_parse_json`` is content with a value at the text's beginning. What follows it shows as an error once the text stands inside
    a list and inside an object: no rest can close both.
    """
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def parse_json(raw: Column) -> Column:
    """Variant of the answer: all of it, else its widest part between brackets, else null. Error markers and empty answers are null."""
    whole = strict_json(raw)
    part = strict_json(F.nullif(F.regexp_extract(raw, _WIDEST, 0), F.lit("")))
    return F.when(raw.isNull() | (raw == "") | raw.startswith("[ERROR:"), F.lit(None)).otherwise(F.coalesce(whole, part))


def kind(v: Column) -> Column:
    """array, object, string, ... of a variant."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").when(s == "VOID", "null").otherwise("other")


def items(raw: Column, *keys: str) -> Column:
    """The list in an answer (array of variants): the answer itself, or what stands under the first of ``keys`` that it has."""

    def of(v: Column) -> Column:
        under = F.lit(None).cast("array<variant>")
        for k in reversed(keys):
            x = F.try_variant_get(v, f"$.{k}", "variant")
            # a key that holds null is there, and holds nothing
            under = F.when(x.isNotNull(), F.when(F.is_variant_null(x), F.array().cast("array<variant>")).otherwise(F.try_variant_get(v, f"$.{k}", "array<variant>"))).otherwise(under)
        whole = F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>")).when(kind(v) == "object", under)
        return F.coalesce(whole, F.array().cast("array<variant>"))

    return bind(parse_json(raw), of)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _box(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.bbox_2d", "array<string>"), F.try_variant_get(v, "$.bbox", "array<string>"), F.array().cast("array<string>"))


def _scaled(found: Column, box, frame: tuple[Column, Column, Column, Column], off=(0, 0)) -> Column:
    return F.transform(found, lambda v: F.struct(scale(box(v), *frame, *off).alias("bbox"), v.alias("v")))


def blocks(raw: Column, w: Column, h: Column, from_w: Column, from_h: Column) -> Column:
    """array of struct(bbox, block_type, writing_type); boxes that cannot be read are left out."""
    found = F.filter(_scaled(items(raw, "blocks", "regions"), _box, (w, h, from_w, from_h)), lambda s: s["bbox"].isNotNull())
    return F.transform(
        found,
        lambda s: F.struct(
            s["bbox"].alias("bbox"), F.coalesce(_field(s["v"], "block_type"), F.lit("text_block")).alias("block_type"), F.coalesce(_field(s["v"], "writing_type"), F.lit("handwritten")).alias("writing_type")
        ),
    )


def lines(raw: Column, w: Column, h: Column, from_w: Column, from_h: Column, off_x: Column | int = 0, off_y: Column | int = 0) -> Column:
    """array of boxes; an item may be a bare list of coordinates."""
    box = lambda v: F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<string>")).otherwise(_box(v))
    found = _scaled(items(raw, "lines", "blocks"), box, (w, h, from_w, from_h), (off_x, off_y))
    return F.transform(F.filter(found, lambda s: s["bbox"].isNotNull()), lambda s: s["bbox"])


def per_line(raw: Column, w: Column, h: Column, from_w: Column, from_h: Column) -> Column:
    """array of struct(bbox, rtype, legibility): each item is a region of its own."""
    found = F.filter(_scaled(items(raw, "blocks", "lines", "regions"), _box, (w, h, from_w, from_h)), lambda s: s["bbox"].isNotNull())

    def one(s: Column) -> Column:
        t = F.coalesce(_field(s["v"], "block_type"), F.lit("text_block"))
        return F.struct(s["bbox"].alias("bbox"), F.when(t == "text_block", "handwritten").otherwise(t).alias("rtype"), F.lit("legible").alias("legibility"))

    return F.transform(found, one)


def transcription(raw: Column) -> Column:
    """The text of an answer; an error marker stays, an unreadable answer becomes one."""
    of = lambda v: F.when((kind(v) == "object") & (F.size(F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))) > 0), F.coalesce(_field(v, "text"), F.lit(""))).otherwise("[ERROR:parse_failed]")
    return F.when(raw.startswith("[ERROR:"), raw).otherwise(F.coalesce(bind(parse_json(raw), of), F.lit("[ERROR:parse_failed]")))


def text_lines(raw: Column) -> Column:
    """The lines of a block's answer, stripped and without blank ones; null if there are none."""

    def of(v: Column) -> Column:
        listed = F.try_variant_get(v, "$.lines", "array<string>")
        text = F.when(kind(F.try_variant_get(v, "$.text", "variant")) == "string", F.split(_field(v, "text"), "\n", -1))
        found = F.when(kind(v) == "object", F.coalesce(listed, text)).when(kind(v) == "array", F.try_variant_get(v, "$", "array<string>"))
        return F.filter(F.transform(found, lambda s: strip(F.coalesce(s, F.lit("None")))), lambda s: s != "")

    return bind(bind(parse_json(raw), of), lambda x: F.when(F.size(x) > 0, x))


def page_type(raw: Column) -> Column:
    return F.coalesce(bind(parse_json(raw), lambda v: F.when(_field(v, "page_type") == "math", "math")), F.lit("text"))


def repaired(raw: Column) -> Column:
    """The widest list in an answer as JSON text; one that does not parse is cut behind its last object and closed; else ``[]``."""

    def of(s: Column) -> Column:
        cut = F.concat(F.regexp_extract(s, r"(?s)^.*\}", 0), F.lit("]"))
        return F.when(strict_json(s).isNotNull(), s).when(F.contains(s, F.lit("}")) & strict_json(cut).isNotNull(), cut).otherwise("[]")

    return bind(F.regexp_extract(F.coalesce(raw, F.lit("")), _WIDEST_LIST, 0), lambda s: F.when(s == "", "[]").otherwise(of(s)))


def known_type(t: Column) -> Column:
    """A freely named type as one of ``ALLOWED``; allowed ones keep their writing."""
    c = strip(F.lower(F.coalesce(t, F.lit(""))))
    has = lambda w: F.contains(c, F.lit(w))
    return F.when(c.isin(*ALLOWED), t).when(has("signature"), "handwritten").when(has("stamp") | has("logo"), "image").when(has("text"), "printed").otherwise("annotation")
