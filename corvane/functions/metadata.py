"""Metadata of a chunk as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_text(*columns: str) -> Column:
    """The columns as one JSON object; a null value is left out."""
    return F.to_json(F.struct(*columns))


def from_text(text: Column | str, schema: str) -> Column:
    """A JSON object as a struct of ``schema``; what isn't an object of it gives null, an unknown field is passed over."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(column).startswith("{"), F.from_json(column, schema))
