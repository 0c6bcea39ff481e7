"""Records that differ only in formatting, collapsed to one each with the number of copies.

Method: rows that are byte-identical in the compared columns collapse first, with a count;
only the distinct survivors are brought to canonical form; they are grouped again on the
full canonical text and the counts are summed. Both steps combine on the map side, so a
group that holds a third of all rows arrives as one row per task. The survivors are written
once and read by both steps that need them.

Members are found without ever collecting a group: survivors of groups with more than one
row learn the group's smallest index by a join on the canonical text, and rows learn it by
a join on their raw text. The small side is unique on the key, so the row side can be split
where it is skewed.

Edge cases: null equals only null, also within several null columns. A value that is empty
once formatting is left out equals other such values, not null. Empty tables give empty
results. Columns that are not compared are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import written


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & left[c].eqNullSafe(right[c])
    return test


def raw_groups(rows: DataFrame, raw: list[str], index: str) -> DataFrame:
    """Byte-identical rows collapsed: ``raw`` columns, ``first_index``, ``n_rows``."""
    return rows.groupBy(*raw).agg(F.min(index).alias("first_index"), F.count(F.lit(1)).alias("n_rows"))


def canonical_groups(survivors: DataFrame, canonical: dict[str, Column]) -> DataFrame:
    """One row per record: canonical columns, ``keep_index``, ``n_copies``, ``n_spellings``."""
    formed = survivors.select(*[c.alias(n) for n, c in canonical.items()], "first_index", "n_rows")
    return formed.groupBy(*canonical).agg(F.min("first_index").alias("keep_index"), F.sum("n_rows").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings"))


def copies(rows: DataFrame, raw: list[str], canonical: dict[str, Column], index: str) -> DataFrame:
    """``keep_index, copy_index`` for every row but the first of each record."""
    survivors = written(raw_groups(rows, raw, index), "survivors")
    repeated = canonical_groups(survivors, canonical).where("n_copies > 1")
    formed = survivors.select(*raw, *[c.alias(n) for n, c in canonical.items()])
    known = formed.join(repeated, _same(formed, repeated, list(canonical))).select(*[formed[c] for c in raw], "keep_index")
    return rows.join(known, _same(rows, known, raw)).where(F.col(index) > F.col("keep_index")).select("keep_index", rows[index].alias("copy_index"))
