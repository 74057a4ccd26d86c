"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(c: Column | str) -> Column:
    r"""One spelling per path: every backslash becomes ``/`` and a leading ``./`` is dropped.

    Letter case is kept; null stays null and the empty string stays empty.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^\./", "")


def parent_dir(c: Column | str) -> Column:
    """The folder part of a path, empty for a bare file name."""
    return F.regexp_replace(c, r"/?[^/]*$", "")


def extension(c: Column | str) -> Column:
    """Lower-cased suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))
