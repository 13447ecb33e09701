"""What kind of content a text or page holds, and numbers taken out of a text and put back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of a kind of page, in order.
PAGE_KINDS = (
    ("login", r"/(login|signin|auth)", r'type="password"'),
    ("search", r"[?&](q|query|search)=", r'type="search"'),
    ("table", r"/(table|stats|data)", r"<table"),
    ("article", r"/(news|article|post|blog)", r"<article"),
    ("list", r"/(list|category|board)|[?&]page=", r"<li"),
)


def page_kind(url: Column, html: Column) -> Column:
    """The first kind whose sign the address shows; else the first that the page shows; else general."""
    out = None
    for column, place in ((F.lower(url), 1), (F.lower(html), 2)):
        for kind in PAGE_KINDS:
            test = column.rlike(kind[place])
            out = F.when(test, kind[0]) if out is None else out.when(test, kind[0])
    return out.otherwise("general")


def content_kind(text: Column) -> Column:
    """table (most lines have separated cells), news (long prose with sentence ends) or general."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    celled = F.size(F.filter(lines, lambda x: x.rlike(r"\t|\|| {3,}")))
    share = F.try_divide(celled.cast("double"), F.size(lines))
    return F.when(share >= 0.5, "table").when((F.length(text) > 200) & text.rlike(r"[.!?。]\s"), "news").otherwise("general")


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?%?"


def mask_numbers(text: Column) -> tuple[Column, Column]:
    """The text with each number as {{N}}, and the numbers in order."""
    return F.regexp_replace(text, NUMBER, "{{N}}"), F.regexp_extract_all(text, F.lit(NUMBER), 0)


def restore_numbers(masked: Column, numbers: Column) -> Column:
    """Numbers back in their places; places beyond the numbers stay."""
    pieces = F.split(masked, r"\{\{N\}\}", -1)
    filled = F.transform(pieces, lambda p, i: F.concat(p, F.when(i == F.size(pieces) - 1, "").otherwise(F.coalesce(F.try_element_at(numbers, i + 1), F.lit("{{N}}")))))
    return F.array_join(filled, "")
