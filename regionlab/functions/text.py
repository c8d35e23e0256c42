"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionlab.functions.normalize import strip

CYRILLIC = "А-ЯҐЄІЇа-яґєії"  # fixed value: the letters that count as Cyrillic


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def without_errors(text: Column) -> Column:
    """Null texts and error markers as the empty text."""
    return F.when(text.isNull() | text.startswith("[ERROR:"), F.lit("")).otherwise(text)


def strip_payload(raw: Column) -> Column:
    """A model's answer without its thoughts and code fences."""
    t = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?U)^\s*```(?:json)?\s*", "")
    return strip(F.regexp_replace(t, r"(?U)\s*```\s*\z", ""))


def first_line(text: Column) -> Column:
    return strip(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))


def clean_lines(lines: Column) -> Column:
    """Stripped lines without blank ones; null if none is left."""
    kept = F.filter(F.transform(lines, strip), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept)


def alphabet(ch: Column) -> Column:
    """cyrillic, latin, digit or other, of a single character."""
    return F.when(ch.rlike(f"^[{CYRILLIC}]$"), "cyrillic").when(ch.rlike("^[A-Za-z]$"), "latin").when(ch.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]$"), "digit").otherwise("other")


def characters(text: Column) -> Column:
    """The code points of a text, in order; nothing of the empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def distinct_characters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(characters(text))), "")


def preview(text: Column, side: int = 250) -> Column:
    """Texts of more than twice ``side`` characters by their first and last ones."""
    return F.when(F.length(text) > 2 * side, F.concat(F.left(text, F.lit(side)), F.lit(" … "), F.right(text, F.lit(side)))).otherwise(text)


def with_examples(prompt: Column, examples: Column) -> Column:
    """A prompt with example lines; ``examples``: array of struct(description, gold)."""
    lines = F.transform(examples, lambda e: F.concat(F.lit("- "), e["description"], F.lit(" → "), e["gold"]))
    return F.when(F.size(examples) > 0, F.concat(prompt, F.lit("\n\nExamples:\n"), F.array_join(lines, "\n"))).otherwise(prompt)
