"""Prompts by task and region type, and what goes with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionlab.functions.text import with_examples

PROMPTS = {
    "classify": "Is this page mostly mathematics? Answer with JSON: {\"page_type\": \"math\"} or {\"page_type\": \"text\"}.",
    "detect": "Mark every block of the page. Answer with JSON: {\"blocks\": [{\"bbox_2d\": [x1, y1, x2, y2], \"block_type\": ..., \"writing_type\": ...}]}.",
    "per_line": "Mark every line and every formula of the page. Answer with JSON: {\"lines\": [{\"bbox_2d\": [x1, y1, x2, y2], \"block_type\": ...}]}.",
    "find_lines": "Mark every line of this block, from top to bottom. Answer with JSON: {\"lines\": [[x1, y1, x2, y2], ...]}.",
    "lines": "Read this block line by line, from top to bottom, exactly as written. Answer with JSON: {\"lines\": [...]}.",
    "text": "Read this line exactly as written. Answer with JSON: {\"text\": ...}.",
    "formula": "Write this formula in LaTeX. Answer with JSON: {\"text\": ...}.",
    "table": "Read this table: a line for each row, cells parted by |. Answer with JSON: {\"text\": ...}.",
    "annotation": "Read this short note exactly as written. Answer with JSON: {\"text\": ...}.",
}


def prompt(rtype: Column, examples: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """The prompt to read a region of a type, with the type's examples if there are any; other types read as plain text."""
    of = lambda k: F.lit(PROMPTS[k])
    base = F.when(rtype == "formula", of("formula")).when(rtype == "table", of("table")).when(rtype == "annotation", of("annotation")).otherwise(of("text"))
    out = base
    for kind, pairs in sorted((examples or {}).items()):
        if pairs:
            listed = F.array(*[F.struct(F.lit(d).alias("description"), F.lit(g).alias("gold")) for d, g in pairs])
            out = F.when(rtype == kind, with_examples(base, listed)).otherwise(out)
    return out
