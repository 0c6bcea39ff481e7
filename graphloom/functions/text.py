"""Column functions on names, ids and sentences. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def bare(c: Column) -> Column:
    """Letters and digits only, in lower case: the form in which ids and relations agree."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
