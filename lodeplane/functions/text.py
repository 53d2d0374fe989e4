"""String helpers shared by several operators (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, with the no-break and other Unicode blanks that trim() leaves.
_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def squeezed(c: Column | str) -> Column:
    """Without blanks at the ends."""
    return F.regexp_replace(c, _EDGE, "")


def folded(c: Column | str) -> Column:
    """Without blanks at the ends and in lower case."""
    return F.lower(squeezed(c))


def filled(c: Column | str) -> Column:
    """``folded`` with null for blank."""
    return F.nullif(folded(c), F.lit(""))
