"""Words of a text as Spark columns (no Python on the executors)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: what separates words (everything in ASCII but digits and lower-case letters)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. For pure ASCII that is ``lower``, which is faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
