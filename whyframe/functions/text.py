"""Texts for pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that HTML gives a meaning, the ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(text: Column) -> Column:
    for mark, entity in ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
