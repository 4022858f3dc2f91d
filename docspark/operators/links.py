"""Links of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hrefs(html: Column) -> Column:
    """The targets of all href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
