"""Keys that are compared without case and outer blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks around a key, whatever their kind.
_OUTER = r"^[\s\u00a0\u2000-\u200d\u2028\u2029\u202f\u2060\u3000\ufeff]+|[\s\u00a0\u2000-\u200d\u2028\u2029\u202f\u2060\u3000\ufeff]+$"


def key(c: str | Column) -> Column:
    """A key without case and outer blanks; null when nothing is left."""
    got = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, _OUTER, ""))
    return F.when(got != "", got)
